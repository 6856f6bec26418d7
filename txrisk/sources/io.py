"""Sources and sinks.

Transactions are read with a declared schema (never inferred). CSV values are
read as strings, the pandas default NA spellings become null, and values are
``try_cast`` to the declared types; a value that is present but does not
parse makes the column non-numeric, which is reported (V4) instead of being
silently nulled. A ``row_id`` is assigned once at ingest (file order) and is
then carried everywhere; it must be persisted with the cleaned table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import errors as E
from .. import schema as S

# --- fixed values: strings pandas.read_csv treats as missing by default -----
PANDAS_NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

SPLIT_COL = "split"
TYPE_GUARD_TAG = "txrisk-type"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def with_row_id(df: DataFrame, column: str = S.ROW_ID) -> DataFrame:
    """Unique, input-ordered id (partition index in the high bits).

    Deterministic for the same files and settings; assign once at ingest and
    persist it (write the table) -- never recompute it on a different plan.
    """
    if column in df.columns:
        return df
    return df.select(F.monotonically_increasing_id().alias(column), "*")


#: Pieces of files whose offsets are shipped to the tasks (about 200 bytes each); more of them are joined.
MOST_PIECES = 100_000


def with_file_order_id(scan: DataFrame, column: str = S.ROW_ID, most_pieces: int = MOST_PIECES) -> DataFrame:
    """Dense ``bigint`` id in the order of file path, then of rows in the file, for a plain file scan.

    Spark packs pieces of files into tasks by size, so task order is not file order. Files that number their rows (Parquet)
    need the rows before each file only: a count by file. Others are counted piece by piece (file and first byte), and a
    row adds its place in its piece to the rows before the piece. Up to ``most_pieces`` offsets are shipped to the tasks, so the
    rows are not shuffled; more are joined. A table without rows keeps the column.
    """
    if column in scan.columns:
        return scan
    spark = scan.sparkSession
    file, at = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")
    if "row_index" in scan.select("_metadata").schema["_metadata"].dataType.fieldNames():  # the place of a row in its file
        place, at = F.col("_metadata.row_index").alias("_seq"), F.lit(0).cast("long").alias("_at")
    else:
        place = F.monotonically_increasing_id().alias("_seq")
    pieces = scan.select(file, at, place).groupBy("_file", "_at").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    files = pieces.groupBy(F.col("_file").alias("_f")).agg(F.sum("_n").alias("_rows"))
    earlier = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("_f", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("*", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_inner"))
    starts = pieces.join(files, F.col("_file") == F.col("_f")).select(
        F.col("_file").alias("_pf"), F.col("_at").alias("_pa"), (F.col("_base") + F.col("_inner") - F.col("_first")).alias("_shift"))
    found = starts.limit(most_pieces + 1).collect()
    if len(found) <= most_pieces:
        starts = F.broadcast(spark.createDataFrame(found, "_pf string, _pa bigint, _shift bigint"))
    rows = scan.select(file, at, place, *[F.col(f"`{c}`") for c in scan.columns])
    joined = rows.join(starts, (F.col("_file") == F.col("_pf")) & (F.col("_at") == F.col("_pa")))
    return joined.select((F.col("_seq") + F.col("_shift")).alias(column), *[F.col(f"`{c}`") for c in scan.columns])


def load_transactions(spark: SparkSession, path: str, fmt: str | None = None,
                      row_id: str | None = None, check_types: bool | str = True) -> DataFrame:
    """Read a transaction table (CSV with header, or Parquet) by suffix.

    ``row_id`` names an existing unique column to use as the row id;
    otherwise one is assigned.

    For CSV, ``check_types=True`` runs one counting job over the file before
    returning. ``check_types="inline"`` runs none: an unparsable value raises
    inside the first job that reads the column (a table write then commits
    nothing), so a load-and-write job reads the file once. Map that failure
    with :func:`raise_if_type_failure`.
    """
    if check_types not in (True, False, "inline"):
        raise ValueError("check_types must be True, False or 'inline'")
    if not _exists(spark, path):
        raise E.DataLoadError(f"Dataset does not exist: {path}")
    kind = fmt or os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if f".{kind}" not in S.SUPPORTED_DATA_FILES:
        raise E.DataLoadError(f"Unsupported data file '{path}'; expected one of {S.SUPPORTED_DATA_FILES}")
    if kind == "parquet":
        from pyspark.sql import types as T

        df = spark.read.parquet(path)
        df = with_file_order_id(df) if row_id is None else df
        types = {f.name: f.dataType for f in df.schema.fields}
        wrong = [c for c in S.NUMERIC_COLUMNS + (S.LABEL, S.FLAGGED)
                 if c in types and not isinstance(types[c], T.NumericType)]
        if check_types and wrong:
            raise E.InvalidDataTypeError(f"Columns must be numeric: {wrong}")
        df = df.select(*[F.col(c).cast(S.RAW_SCHEMA[c].dataType).alias(c) if c in S.RAW_SCHEMA.fieldNames()
                         else F.col(c) for c in df.columns])
    else:
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
        na = F.array(*[F.lit(x) for x in PANDAS_NA_STRINGS])
        typed, bad = [], []
        for c in raw.columns:
            s = F.when(F.array_contains(na, F.col(c)), F.lit(None).cast("string")).otherwise(F.col(c))
            field = S.RAW_SCHEMA[c] if c in S.RAW_SCHEMA.fieldNames() else None
            if field is None or field.dataType.simpleString() == "string":
                typed.append(s.alias(c))
            else:
                t = field.dataType.simpleString()
                number = s.try_cast(t)
                if t in ("tinyint", "smallint", "int", "bigint"):  # also 0.0 and 1e3, as other tools write whole numbers
                    real = s.try_cast("double")
                    number = F.coalesce(number, F.when(real == F.floor(real), real.try_cast(t)))
                unparsable = s.isNotNull() & number.isNull()
                if check_types == "inline":
                    typed.append(F.when(unparsable, F.raise_error(F.lit(f"[{TYPE_GUARD_TAG}:{c}]")))
                                 .otherwise(number).alias(c))
                else:
                    typed.append(number.alias(c))
                bad.append((c, F.count_if(unparsable)))
        if check_types is True and bad:
            counts = raw.agg(*[b.alias(c) for c, b in bad]).first().asDict()
            wrong = [c for c, n in counts.items() if n]
            if wrong:
                raise E.InvalidDataTypeError(f"Columns must be numeric: {wrong}")
        if row_id is None and S.ROW_ID not in raw.columns:
            df = with_file_order_id(raw).select(S.ROW_ID, *typed)
        else:
            df = raw.select(*typed)
    if row_id is not None:
        if row_id not in df.columns:
            raise E.MissingColumnError(f"row id column '{row_id}' not found")
        df = df.withColumnRenamed(row_id, S.ROW_ID) if row_id != S.ROW_ID else df
        return df.select(S.ROW_ID, *[c for c in df.columns if c != S.ROW_ID])
    return df


def is_type_failure(exc: Exception) -> bool:
    """Whether ``exc`` is a job failure from ``check_types="inline"``."""
    return f"[{TYPE_GUARD_TAG}:" in str(exc)


def raise_if_type_failure(exc: Exception) -> None:
    """Raise InvalidDataTypeError if ``exc`` is a job failure from ``check_types="inline"``."""
    import re

    cols = sorted(set(re.findall(rf"\[{TYPE_GUARD_TAG}:([^\]]+)\]", str(exc))))
    if cols:
        raise E.InvalidDataTypeError(f"Columns must be numeric: {cols}") from exc


#: Rows of a compressed CSV file, which is read by one task (about 60 MB of engineered rows).
PACKED_CSV_ROWS = 1_000_000


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", packed: bool = False) -> str:
    """Write a table (Parquet by default; CSV with header as an option, ``packed`` by gzip in files of bounded length)."""
    try:
        w = df.write.mode(mode)
        if fmt == "csv":
            w = w.option("compression", "gzip").option("maxRecordsPerFile", PACKED_CSV_ROWS) if packed else w
            w.option("header", True).csv(path)
        else:
            w.parquet(path)
    except Exception as exc:  # noqa: BLE001
        raise E.DataPersistenceError(f"Failed writing {path}: {exc}") from exc
    return path


def write_split(df: DataFrame, out_dir: str, mode: str = "overwrite") -> str:
    """One write, partitioned by the split column (``train`` / ``test`` [/ ``validation``])."""
    if SPLIT_COL not in df.columns:
        raise E.DataPersistenceError(f"'{SPLIT_COL}' column missing; run split first")
    try:
        df.write.mode(mode).partitionBy(SPLIT_COL).parquet(out_dir)
    except Exception as exc:  # noqa: BLE001
        raise E.DataPersistenceError(f"Failed writing {out_dir}: {exc}") from exc
    return out_dir


def read_split(spark: SparkSession, out_dir: str, split: str) -> DataFrame:
    """One side of a written split (partition pruning reads only that folder)."""
    return spark.read.parquet(out_dir).where(F.col(SPLIT_COL) == split).drop(SPLIT_COL)


def features_and_label(df: DataFrame, label: str = S.LABEL) -> tuple[DataFrame, DataFrame]:
    """The X / y views of a split side (P3, P11): X drops label and id columns."""
    x = df.drop(*[c for c in S.NON_MODEL_COLUMNS])
    y = df.select(*([S.ROW_ID] if S.ROW_ID in df.columns else []), label)
    return x, y


def write_split_sides(spark: SparkSession, split_dir: str, out_dir: str, formats: tuple[str, ...] = ("parquet",), combined: bool = False,
                      label: str = S.LABEL) -> dict[str, str]:
    """``X_train``, ``X_test``, ``y_train``, ``y_test`` (and, ``combined``, ``train`` and ``test``) from the written split.

    The split was computed once; each side is a pruned read of it. X and y both keep the row id, by which they belong
    together. CSV outputs get the suffix ``.csv`` and are packed by gzip. Returns the path of each output.
    """
    unknown = set(formats) - {"parquet", "csv"}
    if unknown or not formats:
        raise E.DataPersistenceError(f"outputs can be written as parquet and csv, not {sorted(unknown)}")
    out = {}
    for side in ("train", "test"):
        rows = read_split(spark, split_dir, side)
        x, y = features_and_label(rows, label)
        ids = [S.ROW_ID] if S.ROW_ID in rows.columns else []
        frames = {f"X_{side}": rows.select(*ids, *[c for c in x.columns if c not in ids]), f"y_{side}": y}
        if combined:
            frames[side] = rows
        for name, frame in frames.items():
            for fmt in formats:
                suffix = ".csv" if fmt == "csv" else ""
                out[name + suffix] = write_table(frame, f"{out_dir}/{name}{suffix}", fmt, packed=True)
    return out


def remove_table(spark: SparkSession, path: str) -> None:
    """Take back a table that a job wrote."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_importance_csv(importance: DataFrame, path: str) -> str:
    """Importance table as CSV; requires ``feature`` and ``importance``."""
    missing = {"feature", "importance"} - set(importance.columns)
    if missing:
        raise E.FeatureImportanceError(f"importance table is missing column(s): {sorted(missing)}")
    return write_table(importance.coalesce(1), path, fmt="csv")
