"""Corpus pipeline: language ID, near duplicates, repeated passages, benchmark passages, tokens.

``STAGES`` are applied in order; each is written as Parquet in the shared folder and read again as the
next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import byte_bpe, decontaminate, language_id, ngram_jaccard, substring_dedup
from txrisk.llm.tables import read, shared_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``lang`` becomes the language found."""
    found = language_id.identify_documents(docs).where("kept")
    return found.withColumn("lang", F.col("language")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one: that with the smallest doc_id, null after all others; documents without words stay."""
    groups = ngram_jaccard.linked_rows(docs).withColumn("unnamed", F.col("doc_id").isNull())
    # equal rows under one doc_id are one document, other texts under it are not
    texts = groups.groupBy("label", "unnamed", "doc_id", "text_hash").agg(F.count("*").alias("__rows"))
    first = texts.where("label is not null").groupBy("label").agg(F.min(F.struct("unnamed", "doc_id", "text_hash", "__rows")).alias("f")).select("f.*")
    kept = first.union(texts.where("label is null").select(*first.columns)).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}).drop("unnamed")
    own = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")))
    repeated = own.where("__rows > 1").dropDuplicates(["doc_id", "text"])
    return own.where("__rows = 1").union(repeated).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; untouched texts stay as they are, emptied ones go."""
    found = substring_dedup.substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words"))
    out = found.where(~emptied).withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with digests of the ids and of what they decode to."""
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), check=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: Language and alignment scores are not expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


