"""Language identification by Bayesian evidence fusion.

Method. For each language the posterior is the product of
 * the text's likelihood under a byte-trigram model (lower-cased ASCII, white space as one blank,
   trigrams with digits left out), tempered because neighbouring trigrams repeat each other,
 * the likelihood of the declared language (markup ``lang`` or a declared column),
 * the likelihood of the address suffix (last label of the url's host),
 * the prior of the host, smoothed towards its domain, and that towards the whole corpus.
``und`` (undetermined) competes under a flat trigram model. A row is kept when its best language is not
``und`` and has a posterior of at least ``MIN_POSTERIOR``.

The trigram tables are learnt from a sample by declared language: of the ``WIDE`` most frequent ones about
``LABELLED_ROWS`` rows shared out evenly, at least ``LANGUAGE_ROWS`` each, of every other one ``RARE_ROWS``; those with fewer
rows whole. Every declared code gets a table, whatever their number (codes have two or three letters: 18,252 at most). The
``WIDE`` tables are dense, the others hold only the cells that occur; both give the same numbers. All counts
for the other evidence cover all rows: each row's posterior by text, with the declared languages' shares as
prior, is added up by declared language, suffix, domain and host (in units of 1 / ``SHARE``, so the sums are exact)
with partial sums, so a host with a third of the rows is no hot task. Counts of declared languages, suffixes and hosts
meet the rows by joins, broadcast only where they are at most ``BROADCAST_KEYS`` keys with ``BROADCAST_CELLS`` counts.

Cases. Null or blank text: flat text likelihood, so the other evidence decides. Null declared language,
url or host: that evidence is left out. Without any row with a declared language nothing is known and
every row is ``und``. Repeated rows get one answer. Other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import column, drop_kept, keep, read

LABELLED_ROWS = 20_000
#: Rows of each declared language in the sample, however many languages there are.
LANGUAGE_ROWS = 300
CELLS = 1 << 16
UNDETERMINED = "und"
#: Log probability of any trigram under ``und``.
FLAT = -10.5
TEMPER = 0.3
MIN_POSTERIOR = 0.5
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 100.0
BROADCAST_KEYS, BROADCAST_CELLS = 50_000, 1_000_000
#: Part of a row that is ``und`` beforehand, and units that one row is counted in.
UND_SHARE, SHARE = 0.02, 1 << 20
#: Languages with dense tables (256 KB each), and rows in the sample of each other one.
WIDE, RARE_ROWS = 256, 30
#: Numbers (rows by languages, or hits of sparse tables) worked on at once.
AT_ONCE = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams of each text, and the texts' bounds among them."""
    data, offsets = W.buffer_of(texts)
    folded = _FOLD[data]
    blank = folded == 32
    stay = np.ones(len(folded), bool)
    stay[1:] = ~(blank[1:] & blank[:-1])
    kept = np.r_[0, np.cumsum(stay)]
    offsets = kept[offsets]
    b = folded[stay].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    cell = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    inside = np.ones(len(cell), bool)
    for back in (1, 2):  # trigrams that run into the next text
        cut = offsets[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(cell))]] = False
    digit = (b >= 48) & (b <= 57)  # numbers, keys and tokens say nothing about the language
    inside &= ~(digit[:-2] | digit[1:-1] | digit[2:])
    cell = cell[inside]
    total = np.r_[0, np.cumsum(inside), *([int(inside.sum())] * 2)]
    return cell, total[np.minimum(offsets, len(total) - 1)]


@dataclass
class Model:
    """Languages in order, ``und`` last, and their log probabilities of trigram cells.

    ``base`` is that of a cell a language has not seen. Languages ``wide`` have a column of ``table`` (cells, wide); what the
    others' cells have above ``base`` is ``gain``, with ``lang``, from ``start[cell]`` on.
    """

    languages: list[str]
    base: np.ndarray
    wide: np.ndarray
    table: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    prior: np.ndarray | None = None
    #: For declared languages and suffixes: rows by language, and the number of values.
    totals: dict[str, tuple[np.ndarray, int]] | None = None

    def text(self, texts: pa.Array) -> np.ndarray:
        """Tempered log likelihood of each text under each language."""
        cell, bounds = trigrams(texts)
        long = np.diff(bounds)
        width = len(self.languages)
        out = long[:, None] * self.base
        for j, at in enumerate(self.wide.tolist()):
            total = np.r_[0.0, np.cumsum(self.table[:, j][cell], dtype=np.float64)]
            out[:, at] = total[bounds[1:]] - total[bounds[:-1]]
        if len(self.lang):
            row = np.repeat(np.arange(len(long)), long)
            hits = self.start[cell + 1] - self.start[cell]
            total = np.r_[0, np.cumsum(hits)]
            a = 0
            while a < len(cell):
                z = max(a + 1, int(np.searchsorted(total, total[a] + AT_ONCE, side="right")) - 1)
                spread = np.arange(total[a], total[z]) + np.repeat(self.start[cell[a:z]] - total[a:z], hits[a:z])
                place = np.repeat(row[a:z] * width, hits[a:z]) + self.lang[spread]
                out += np.bincount(place, self.gain[spread], minlength=out.size).reshape(out.shape)
                a = z
        return TEMPER * out


def _parts(b: pa.RecordBatch, text: str, width: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with texts and with rows x ``width`` numbers of bounded size."""
    step = max(1, AT_ONCE // width)
    for part in W.slices(b, text):
        for at in range(0, part.num_rows, step):
            yield part.slice(at, step)


def _widest(rows: np.ndarray) -> set[int]:
    """Places of the ``WIDE`` languages with most rows."""
    return set(np.argsort(-rows, kind="stable")[:WIDE].tolist())


def _sample(rows: DataFrame, most: int) -> tuple[DataFrame, dict[str, int]]:
    """Rows (text, at) of the sample, ``at`` the place of the declared language; the rows of each language in order."""
    place = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30))
    # codes of two or three letters: at most 18,252 rows come back
    strata = sorted(tuple(r) for r in rows.groupBy("declared").agg(F.count("*"), F.min(place)).collect())
    each = max(LANGUAGE_ROWS, most // max(1, min(WIDE, len(strata))))
    wide = _widest(np.array([n for _, n, _ in strata], np.int64))
    # the first row by hash is always taken, so equal rows cannot leave a language without any
    ends = [(name, i, max(first + 1, (1 << 30) * (each if i in wide else RARE_ROWS) // max(n, each if i in wide else RARE_ROWS)))
            for i, (name, n, first) in enumerate(strata)]
    ends = rows.sparkSession.createDataFrame(ends, "declared string, at int, end long")
    return rows.join(F.broadcast(ends), "declared").where(place < F.col("end")).select("text", "at"), {name: n for name, n, _ in strata}


def fit_text(rows: DataFrame, most: int = LABELLED_ROWS) -> Model:
    """Trigram tables from rows (key, text, declared)."""
    labelled, strata = _sample(rows.where("declared is not null and text is not null").select("key", "text", "declared"), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for part in W.slices(b):
                cell, bounds = trigrams(part.column("text"))
                at = part.column("at").to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                for j in np.unique(at).tolist():
                    total = counts.setdefault(j, np.zeros(CELLS, np.int64))
                    total += np.bincount(cell[(at == j)[row]], minlength=CELLS)
                if len(counts) > 100:
                    yield from out(counts)
        yield from out(counts)

    def out(counts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for j, total in counts.items():
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), j, np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["at", "cell", "n"])
        counts.clear()

    counted = labelled.mapInArrow(run, "at int, cell int, n long").groupBy("at", "cell").agg(F.sum("n").alias("n"))
    # the sample bounds what comes back
    got = counted.toArrow() if strata else None
    at, cell, n = (got[c].to_numpy() if got is not None else np.zeros(0, np.int64) for c in ("at", "cell", "n"))
    rows_of = np.array(list(strata.values()), np.int64)
    size = np.bincount(at, n, minlength=len(strata)) + 0.05 * CELLS
    base = np.r_[np.log(0.05 / size), FLAT]
    logs = np.log((n + 0.05) / size[at])
    wide = np.array(sorted(_widest(rows_of)), np.int64)
    column_of = np.full(len(base), -1)
    column_of[wide] = np.arange(len(wide))
    table = np.tile(base[wide].astype(np.float32), (CELLS, 1))
    dense = column_of[at] >= 0
    table[cell[dense], column_of[at[dense]]] = logs[dense]
    order = np.flatnonzero(~dense)
    order = order[np.argsort(cell[order], kind="stable")]
    start = np.searchsorted(cell[order], np.arange(CELLS + 1))
    return Model([*strata, UNDETERMINED], base, wide, table, start, at[order].astype(np.int32), (logs[order] - base[at[order]]).astype(np.float32),
                 prior=rows_of / rows_of.sum() if len(rows_of) else np.zeros(0))


def _evidence_counts(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (kind, key, lang, n): the rows' posteriors by text, summed by each piece of evidence, in units of 1 / ``SHARE``."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        known = len(own.languages) - 1
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            cells = [(*k, n) for k, n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*cells, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["kind", "key", "lang", "n"])

        for b in batches:
            if not known:
                return
            for part in _parts(b, "text", known + 1):
                score = own.text(part.column("text")) + _with_und(own.prior[None, :])
                share = np.exp(score - score.max(axis=1, keepdims=True))
                share = np.rint(share / share.sum(axis=1, keepdims=True) * SHARE).astype(np.int64)[:, :-1]
                row, lang = np.nonzero(share)
                evidence = {k: part.column(k).to_pylist() for k in ("declared", "suffix", "domain", "host")}
                evidence["host"] = [h if h is None else f"{h} {d or ''}" for h, d in zip(evidence["host"], evidence["domain"], strict=True)]
                for kind, values in {"all": [""] * len(share), **evidence}.items():
                    place = {v: i for i, v in enumerate(dict.fromkeys(values))}
                    names = list(place)
                    cell, at = np.unique(np.array([place[v] for v in values], np.int64)[row] * known + lang, return_inverse=True)
                    total = np.zeros(len(cell), np.int64)
                    np.add.at(total, at, share[row, lang])
                    for c, n in zip(cell.tolist(), total.tolist(), strict=True):
                        if names[c // known] is not None:
                            counts[kind, names[c // known], c % known] += n
                if len(counts) > 200_000:
                    yield out()
        if counts:
            yield out()

    return rows.mapInArrow(run, "kind string, key string, lang int, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))


def _with_und(prior: np.ndarray) -> np.ndarray:
    """Logs of priors (rows, languages) with ``und`` added."""
    return np.log(np.concatenate([prior * (1 - UND_SHARE), np.full((len(prior), 1), UND_SHARE)], axis=1))


def _lists(counts: DataFrame, kind: str, lang: str, n: str) -> DataFrame:
    """Rows (key, lang, n): languages and their counts of each value of one kind of evidence."""
    own = counts.where(F.col("kind") == kind).groupBy("key").agg(F.collect_list(F.struct("lang", "n")).alias("c"))
    return own.select("key", F.col("c.lang").alias(lang), F.col("c.n").alias(n))


def _priors(counts: DataFrame) -> DataFrame:
    """Rows (key, hl, hn, dl, dn): languages and their counts of each host and of its domain."""
    host = _lists(counts, "host", "hl", "hn").select(F.substring_index("key", " ", 1).alias("host"), F.substring_index("key", " ", -1).alias("domain"), "hl", "hn")
    both = host.join(_lists(counts, "domain", "dl", "dn").withColumnRenamed("key", "domain"), "domain", "left").drop("domain")
    return both.dropDuplicates(["host"]).withColumnRenamed("host", "key")


def _meet(rows: DataFrame, of: str, lists: DataFrame) -> DataFrame:
    """``rows`` with the lists of their value ``of``, named ``__`` and the list's name."""
    names = lists.columns[1:]
    lists = keep(lists, "evidence-of")
    size = lists.agg(F.count("*"), F.sum(sum((F.coalesce(F.size(F.coalesce(c, F.array())), F.lit(0)) for c in names), F.lit(0)))).first()
    small = size[0] <= BROADCAST_KEYS and (size[1] or 0) <= 2 * BROADCAST_CELLS
    side = lists.select(F.col("key").alias("__of"), *(F.col(c).alias(f"__{c}") for c in names))
    return rows.join(F.broadcast(side) if small else side, F.col(of) == F.col("__of"), "left").drop("__of")


def _counted(part: pa.RecordBatch, lang: str, n: str, size: int) -> np.ndarray:
    """Counts (rows, languages) from the two list columns; rows without a list have none."""
    out = np.zeros((part.num_rows, size))
    row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(part.column(lang)), 0).to_numpy(zero_copy_only=False))
    out[row, part.column(lang).flatten().to_numpy()] = part.column(n).flatten().to_numpy()
    return out


def identify(rows: DataFrame, text: Column, declared: Column, host: Column, url: Column | None = None, key: Column | None = None,
             most: int = LABELLED_ROWS, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """``rows`` with ``language``, ``posterior`` and ``kept``.

    ``declared`` is reduced to its primary subtag; suffix and domain (last label, last two labels) come
    from the host of ``url``, and ``host`` from ``url`` where it is null. ``key`` and the text draw the sample.
    """
    added = ["language", "posterior", "kept"]
    own = rows.drop(*[c for c in rows.columns if c.lower() in added])
    address = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)) if url is not None else F.lit(None).cast("string")
    address = F.when(address != "", address)
    whole = F.translate(F.coalesce(host, address), " ", "_")
    evidence = {
        "text": F.coalesce(text.cast("string"), F.lit("")),
        "declared": F.nullif(F.lower(F.regexp_extract(F.coalesce(declared.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)), F.lit("")),
        "host": F.nullif(whole, F.lit("")),
        "domain": F.coalesce(F.substring_index(address, ".", -2), F.nullif(whole, F.lit(""))),
        "suffix": F.substring_index(address, ".", -1),
    }
    bare = own.select((F.lit(None).cast("string") if key is None else key).alias("key"), *(c.alias(k) for k, c in evidence.items()))
    model = fit_text(bare, most)
    counts = keep(_evidence_counts(bare, model), "evidence")
    every = {r["lang"]: r["n"] / SHARE for r in counts.where("kind = 'all'").collect()}
    share = np.array([every.get(i, 0) + 1.0 for i in range(len(model.languages) - 1)] or [1.0])
    overall = share / share.sum()
    known = len(model.languages) - 1
    model.totals = {}
    for kind in ("declared", "suffix"):
        own_kind = counts.where(F.col("kind") == kind)
        total = np.zeros(known)
        for r in own_kind.groupBy("lang").agg(F.sum("n").alias("n")).collect():
            total[r["lang"]] = r["n"] / SHARE
        model.totals[kind] = (total, own_kind.select("key").distinct().count())
    model.prior = overall
    names = {k: f"__{k}" for k in ("text", "declared", "suffix", "host")}
    framed = own.withColumns({v: evidence[k] for k, v in names.items()})
    lists = [f"__{c}" for c in ("vl", "vn", "sl", "sn", "hl", "hn", "dl", "dn")]
    if known:
        framed = _meet(framed, "__declared", _lists(counts, "declared", "vl", "vn"))
        framed = _meet(framed, "__suffix", _lists(counts, "suffix", "sl", "sn"))
        framed = _meet(framed, "__host", _priors(counts))
    else:
        framed = framed.withColumns({c: F.lit(None).cast("array<long>") for c in lists})
    drop_kept(counts)
    framed = framed.drop("__host").select(*own.columns, "__text", "__declared", "__suffix", *lists)
    schema = T.StructType([*own.schema.fields, T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType())])
    out_names = schema.names
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            for part in _parts(b, "__text", len(m.languages)):
                score = _fused(m, part)
                best = score.argmax(axis=1)
                top = score.max(axis=1)
                posterior = 1 / np.exp(score - top[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-3 - len(lists)], pa.array([m.languages[i] for i in best.tolist()], pa.string()), pa.array(posterior)],
                                                 names=out_names)

    keep_ = (F.col("language") != UNDETERMINED) & (F.col("posterior") >= min_posterior)
    return framed.mapInArrow(run, schema).withColumn("kept", keep_)


def _fused(m: Model, part: pa.RecordBatch) -> np.ndarray:
    """Log of the unnormalised posterior of each language for each row."""
    score = m.text(part.column("__text"))
    if len(m.languages) == 1:
        return score
    for kind, c in (("declared", "v"), ("suffix", "s")):
        total, values = m.totals[kind]
        # log P(value | language), one row added to each value and to all others together; nothing is known of ``und``
        of = _counted(part, f"__{c}l", f"__{c}n", len(total)) / SHARE + 1
        whole = total + values + 1
        logs = np.log(np.c_[of, of.mean(axis=1)] / np.r_[whole, whole.mean()])
        score += np.where(part.column(f"__{kind}").is_valid().to_numpy(zero_copy_only=False)[:, None], logs, 0)
    # the host's share is smoothed towards its domain's, and that towards the corpus
    host, domain = (_counted(part, f"__{c}l", f"__{c}n", len(m.prior)) / SHARE for c in "hd")
    domain = (domain + DOMAIN_WEIGHT * m.prior) / (domain.sum(axis=1, keepdims=True) + DOMAIN_WEIGHT)
    prior = (host + HOST_WEIGHT * domain) / (host.sum(axis=1, keepdims=True) + HOST_WEIGHT)
    return score + _with_und(prior)


def identify_documents(docs: DataFrame, **how) -> DataFrame:
    """Language of each row of a documents table: ``lang`` is the declared language, ``source`` the host."""
    return identify(docs, column(docs, "text", "string"), column(docs, "lang", "string"), column(docs, "source", "string"),
                    key=column(docs, "doc_id", "string"), **how)


def identify_pages(pages: DataFrame, **how) -> DataFrame:
    """Language of each row of a pages table: markup ``lang``, url and the text between the tags."""
    html = F.coalesce(column(pages, "html", "string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    text = F.regexp_replace(bare, r"&[a-zA-Z#0-9]+;", " ")
    declared = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return identify(pages, text, declared, F.lit(None).cast("string"), column(pages, "url", "string"), column(pages, "page_id", "string"), **how)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its language."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return identify_documents(docs).select("doc_id", "language", "posterior", "kept")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` with its language."""
    return identify_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "language", "posterior", "kept")
