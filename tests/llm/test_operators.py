"""Corpus operators against brute force, round trips and held-out labels, with nulls, blanks, ties and repeated rows."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from txrisk.llm import (byte_bpe, chat_format, decontaminate, graph, html_extract, language_id, ngram_jaccard, quality_classifier, quality_rules,
                        substring_dedup, warc)

DOCS = "doc_id long, text string"


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}x" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, blanks, one long text."""
    rng = random.Random(5)
    passage = words(rng, 60)
    rows = []
    for i in range(60):
        w = words(rng, rng.choice([0, 1, 3, 19, 20, 21, 80, 200]))
        if i % 4 == 0:
            w = w[: len(w) // 2] + passage + w[len(w) // 2 :]
        rows.append((i, " ".join(w)))
    base = words(rng, 200)
    for i in range(60, 90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 3, 12])):
            w[rng.randrange(len(w))] = "edited"
        rows.append((i, "\n".join(w)))
    rows.append((90, " ".join(["again and"] * 3000)))
    rows += [(91, ""), (92, " \t\n"), (93, None), (94, "Ab cd"), (95, "aB  cd")]
    return rows


def test_substring_dedup(spark, corpus):
    for suffixes, size in ((20_000, 1 << 20), (3, 2_000)):  # also with prefixes cut into parts
        out = substring_dedup.substring_dedup(spark.createDataFrame(corpus, DOCS), most_suffixes=suffixes, tree_bytes=size)
        got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect())
        assert got == sorted(substring_dedup.brute_force(corpus))


def test_substring_dedup_cases(spark):
    text = " ".join(f"q{i}" for i in range(25))
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, text + " end", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string").withColumnRenamed("doc", "spans")
    got = {(r.doc_id, r.spans): (r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == {(1, "a"): (0, text), (None, "b"): (25, ""), (2, None): (25, "end")}
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_ngram_jaccard(spark, corpus):
    for most, block in ((30_000, 4_000_000), (4, 1_500)):  # also with cut shingles and components
        out = ngram_jaccard.jaccard_components(spark.createDataFrame(corpus, DOCS), most=most, block_shingles=block)
        assert sorted(tuple(r) for r in out.collect()) == sorted(ngram_jaccard.brute_force(corpus))
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "A b c d e f"), (8, None)]
    got = sorted((tuple(r) for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, 2, 7), (None, 2, 7), (7, 2, 7), (8, 0, 8)], key=str)
    assert ngram_jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_ngram_jaccard_postings_read_in_pieces(spark, corpus, monkeypatch):
    """No link is lost where the written postings are read back by other tasks than wrote them."""
    keep = ngram_jaccard.keep
    monkeypatch.setattr(ngram_jaccard, "keep", lambda df, name: keep(df.repartition(7) if name == "postings" else df, name))
    out = ngram_jaccard.jaccard_components(spark.createDataFrame(corpus, DOCS))
    assert sorted(tuple(r) for r in out.collect()) == sorted(ngram_jaccard.brute_force(corpus))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_count_bound_never_loses_a_link():
    rng = np.random.default_rng(3)
    for _ in range(60):
        size = int(rng.integers(20, 400))
        a = np.unique(rng.integers(0, 1 << 60, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 60, max(1, size // 30)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            points = [ngram_jaccard.point(x, ngram_jaccard.level(len(x))).tobytes() for x in (a, b, a)]
            assert len(ngram_jaccard.forest(points, np.array([len(a), len(b), len(a)]), 80, 100)) == 2
            assert ngram_jaccard.forest(points[:2], np.array([len(a), len(b)]), 80, 100) == [(0, 1)]


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.default_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_long_pieces(reference_encoding):
    """Pieces without a split, encoded in blocks, equal the library's; time grows with the piece."""
    coder = byte_bpe.Codec(byte_bpe.load_ranks(byte_bpe.default_path()), byte_bpe.default_pattern())
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["a" * 20_000, "".join(rng.choice(letters) for _ in range(20_000)), "abcabcd" * 2000, "".join(rng.choice("aab") for _ in range(9000)),
             base64.b64encode(rng.randbytes(9000)).decode(), "".join(rng.choice(["the", "ing", "er", "stand"]) for _ in range(3000)),
             "".join(rng.choice("中文字符測試漢") for _ in range(3000)), "-" * 20_000, "=-" * 6000, " " * 9000 + "x", "x" + "\n" * 9000]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == reference_encoding.encode_ordinary(text)
    # blocks too short to agree are cut anew, up to the whole piece
    raw = texts[1][:3000].encode()
    assert coder._blocks(raw, 8, 1) is None or coder._blocks(raw, 8, 1) == coder.merge([raw])[0]
    assert coder.encode_long(raw) == coder.merge([raw])[0]


def test_byte_bpe(spark, corpus, reference_encoding):
    rows = [*corpus, (96, "<|endoftext|> héllo 𝄞 \x00 'll " + "a" * 700), (96, "tie")]
    coded = byte_bpe.encode(spark.createDataFrame(rows, DOCS), check=True)
    for r in coded.collect():
        ids = reference_encoding.encode_ordinary(r.text or "")
        assert (list(r.ids), r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = byte_bpe.decode(coded.select("doc_id", "text", "ids"))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert byte_bpe.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_chat_format_round_trip(spark):
    rows = [(1, 0, "user", "a<|im_sep|>\\<|"), (1, 1, "user", "<\\|x"), (1, 2, "assistant", None), (1, 2, "assistant", None),
            (1, None, "r\n<\\n>", "\n\n"), (None, 3, None, "q"), (2, 1, "assistant", "é<|im_end|>\n<|im_start|>user"), (2, 1, "assistant", "")]
    out = chat_format.read_back(chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in out.collect():
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in own]
        assert r.loss_text == "".join(text for _, role, text in own if role == "assistant")
        blocks = sum(1 for i, x in enumerate(own) if i == 0 or own[i - 1][1] != x[1])
        assert r.formatted.count("<|im_start|>") == blocks == r.formatted.count("<|im_end|>\n")


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, "http://a b/3", big), (2, None, None), (4, "http://a/4", "WARC/1.1\r\n\r\nshort é"),
            (6, "u", "WARC/1.1\r\n\r\nshort é"), (None, "v", big), (5, "http://a/5", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.shared_path(spark, "test-warc")
    warc.write_warc(warc.with_revisits(warc.convert_arc(warc.arc_archives(pages))), path, per_file=3)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, path).collect()), key=str)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        revisit = h == big and p != 5
        want.append((p, "revisit" if revisit else "response", 5 if revisit else None, len(raw), hashlib.sha1(raw).hexdigest()))
    assert got == sorted(want, key=str)


def test_arc_errors_name_the_file():
    with pytest.raises(ValueError, match="bad.arc.*declares"):
        list(warc.parse_arc(b"http://a 1 20200101000000 text/html 99\nabc", "bad.arc"))
    with pytest.raises(ValueError, match="bad.arc.*fields"):
        list(warc.parse_arc(b"http://a text/html 3\nabc", "bad.arc"))
    v2 = b"filedesc://x 0 20200101000000 text/plain 200 - - 0 f 6\n2 0 O\n\nhttp://a 1 20200101 text/html 200 - - 0 f 3\nabc\n"
    assert [(h["URL"], b) for h, b in warc.parse_arc(v2, "x")] == [("http://a", b"abc")]


def test_decontaminate(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.choice([15, 30, 50]), 5000))) for i in range(20)] + [(20, None), (21, ""), (22, "Two words")]
    docs, planted = [], set()
    for d in range(120):
        body = words(rng, 150, 5000)
        if d % 3 == 0:
            k = rng.randrange(20)
            copy = [x for x in items[k][1].upper().split() if rng.random() > 0.06]
            copy = [x if rng.random() > 0.08 else "replaced" for x in copy]
            body[70:70] = copy
            planted.add((d, k))
        docs.append((d, ", ".join(body)))
    docs += [(500, None), (501, ""), (502, "there are two words here"), (503, items[0][1]), (503, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, DOCS)
    for block in (4_000_000, 1_500):
        out = decontaminate.benchmark_hits(frame, bench, block_chars=block).collect()
        assert {(r.doc_id, h.item_id) for r in out for h in r.hits} == planted | {(502, 22), (503, 0)}
    assert decontaminate.decontaminate(frame, bench).count() == len(docs) - len(planted) - 3
    assert decontaminate.decontaminate(frame, bench.limit(0)).count() == len(docs)


def test_suffix_repeats_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        rows = [[rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(4)]
        symbols = np.array([ord(c) for r in rows for c in r], np.uint64)
        row = np.array([i for i, r in enumerate(rows) for _ in r], np.int64)
        want = []
        for r in rows:
            for i in range(len(r)):
                best = 0
                for j in range(len(r)):
                    k = 0
                    while i != j and max(i, j) + k < len(r) and r[i + k] == r[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        assert quality_rules.suffix_repeats(symbols, row).tolist() == want


def test_quality_rules_cases(spark):
    rows = [(1, None, 9), (1, "", 9), (2, "a|b #\n\nx\nx\n x", 9), (3, " ".join(f"w{i}" for i in range(60)), 9), (4, "one two three four " * 20, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(docs).collect()}
    assert not got[1, 0].kept and got[1, 0].base_failed
    r = got[2, 5]
    assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (7, 2, 1, 0)
    assert got[3, 60].kept and not got[4, 80].kept and got[4, 80].longest_repeat == 76
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_html_extract(spark):
    rows = []
    for host in ("a.com", "b.com"):
        for i in range(12):
            rows.append((i, f"http://{host}/{i}", f"<body><div class=x><p>Welcome to {host}</p></div><div><p>own &amp; text {i}</p></div>"
                                                  f"<nav>n{i}</nav><div class='reader-comments'><p>c{i}</div><p>" + ("same foot" if host == "a.com" else f"foot {i}")))
    page = ("<html><header>Site</header><article><h1>T</h1><p><b>one <br><p>two&nbsp; three<aside>ad</aside><form>f</form><script>x</script>"
            "<article class=comment>c</article></article><footer>f")
    rows += [(50, "http://c.com", page), (51, None, None), (52, "::", "<p>only"), (52, "::", "<p>only"), (53, "http://c.com", "<div>" * 3000 + "deep")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text")
    for most in (200_000, 0):  # template sent to the tasks, or joined
        out = html_extract.extract(frame, broadcast_subtrees=most).collect()
        got = {(r.page_id, r.url): r.text for r in out}
        assert len(out) == len(rows) and all(len(r.text) == r.n_chars for r in out)
        assert got[3, "http://a.com/3"] == "own & text 3" and got[3, "http://b.com/3"] == "own & text 3\n\nfoot 3"
        assert got[50, "http://c.com"] == "T\n\none\n\ntwo three"
        assert (got[51, None], got[52, "::"], got[53, "http://c.com"]) == ("", "only", "deep")
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_html_extract_article_names():
    """Ids and parts of class names delete nothing of an article; whole class names do."""
    inner = ("<h2 id=related-work>Related work</h2><p id=comment-on-method>one</p><section id=search-results><h3 id=notice>Hits</h3><p>two</p></section>"
             "<div class='share-price x'>three</div><p>four <math><mi>x</mi></math> <object>five</object> <button>six</button></p>"
             "<div class='ad wide'>gone</div><div role=search>gone</div><p class=ad>gone</p><aside>gone</aside><form>gone</form>")
    want = "Related work\n\none\n\nHits\n\ntwo\n\nthree\n\nfour x five six"
    for page in (f"<body><div id=search>gone</div><article class='post comments-open'>{inner}</article>", f"<main>{inner}</main><button>gone</button>"):
        assert html_extract.main_text(html_extract.prune(html_extract.parse(page)), set()) == want
    page = "<body><h2 id=social-life>Social life</h2><p class=social-life>one</p><div id=site-search>gone</div>"
    assert html_extract.main_text(html_extract.prune(html_extract.parse(page)), set()) == "Social life\n\none"


def test_html_extract_copies(spark):
    """Copies under several urls and repeated rows are one page of their host; what recurs beside other text is template."""
    body = "<body><div class=top><p>Site {}</p></div><div><h1>T{}</h1><p>text {}</p></div>"
    rows = [(i, f"http://a.com/{i}", body.format("a", i, i)) for i in range(15)]
    rows += [(20 + i, f"http://a.com/copy?utm={i}", body.format("a", "copy", "of one article")) for i in range(8)]
    rows += [(30, "http://b.com/1", body.format("b", 1, 1))] * 6 + [(31, "http://c.com/1", "<p>only")] * 5
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (200_000, 0):
        got = html_extract.extract(frame, broadcast_subtrees=most).collect()
        texts = {r.page_id: r.text for r in got}
        assert len(got) == len(rows) and texts[3] == "T3\n\ntext 3"
        assert {texts[20 + i] for i in range(8)} == {"Tcopy\n\ntext of one article"}
        assert (texts[30], texts[31]) == ("Site b\n\nT1\n\ntext 1", "only")


SF = "/root/testdata/sf0.01"


def test_quality_classifier_held_out(spark):
    got = quality_classifier.op10_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    fold = both[both.held_out]
    assert len(fold) > 30 and (fold.predicted == fold.quality).mean() >= 0.95
    assert got.score.between(0, 1).all() and len(got) == 1000
    empty = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, None), (None, ""), (1, "x" * 100_000)], DOCS)
    out = quality_classifier.classify(docs, quality_classifier.fit(docs, empty)).collect()
    assert [r.score for r in out] == [0.5] * 3


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    wrong = docs.selectExpr("doc_id", "text", "case when doc_id % 50 = 0 then 'xx' else lang end as lang", "source", "lang as truth")
    out = language_id.identify_documents(wrong).toPandas()
    assert (out.language == out.truth).mean() >= 0.99 and out.kept.mean() >= 0.99
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "de", "s"), (3, "the thing", "en", None), (3, "the thing", "en", None)],
                                "doc_id long, text string, lang string, source string")
    assert language_id.identify_documents(odd).count() == 4
    assert language_id.identify_documents(odd.limit(0)).count() == 0
    none = language_id.identify_documents(odd.limit(1)).collect()
    assert none[0].language == "und" and not none[0].kept


def test_language_id_small_languages(spark):
    """Each declared language has a table: more than 200 of them, most with a few rows beside a large one."""
    rng = random.Random(3)
    rows = []
    for k in range(231):
        name = "en" if k == 230 else f"q{chr(97 + k // 26)}{chr(97 + k % 26)}"
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(40)]
        rows += [(len(rows) + i, " ".join(rng.choice(own) for _ in range(30)), name, "s") for i in range(2000 if name == "en" else 3)]
    rows += [(9000 + i, "same text of one language", "xx", "s") for i in range(3)]
    out = language_id.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), most=200).collect()
    assert len(out) == len(rows) and [r.doc_id for r in out if r.language != r.lang or not r.kept] == []
    # the same rows with most tables sparse: the same numbers
    frame = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "key long, text string, declared string")
    dense = language_id.fit_text(frame, most=1)
    wide, language_id.WIDE = language_id.WIDE, 3
    try:
        sparse = language_id.fit_text(frame, most=1)
    finally:
        language_id.WIDE = wide
    texts = pa.array([r[1] for r in rows] + ["", "no such text"])
    assert len(sparse.wide) == 3 and len(sparse.lang) and np.allclose(sparse.text(texts), dense.text(texts), atol=1e-3)


def test_language_id_junk_codes(spark):
    """1,100 junk codes, each on one new text of a real language, beside those languages: no error, and they keep their texts.

    (A junk code on an exact copy of a text learns that text, and may take it.)
    """
    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    known = {}
    for r in docs.where("lang is not null and text is not null").collect():
        known.setdefault(r.lang, []).extend(r.text.split())
    pools = [p for p in known.values() if len(p) > 5000]
    letters = "abcdefghijklmnopqrstuvwxyz"
    codes = [a + b + c for a in "qx" for b in letters for c in letters][:1100]
    junk = spark.createDataFrame([(10**6 + i, " ".join(rng.choices(rng.choice(pools), k=60)), c, "junk") for i, c in enumerate(codes)], docs.schema)
    alone = {r.doc_id: r.language for r in language_id.identify_documents(docs).collect()}
    out = language_id.identify_documents(docs.union(junk)).collect()
    assert len(out) == len(alone) + 1100
    same = [alone[r.doc_id] == r.language for r in out if r.doc_id < 10**6]
    assert sum(same) >= 0.98 * len(same)


def test_language_id_evidence_of_all_rows(spark):
    """Rows of unsure text count by their posterior."""
    rows = [("k", "the words of one language", "aa", f"h{i}", f"h{i}", "aa") for i in range(20)]
    rows += [("k", "ein paar andere worte hier", "bb", f"g{i}", f"g{i}", f"s{i}") for i in range(20)] + [("k", "", None, "blank", "blank", None)] * 3
    frame = spark.createDataFrame(rows, "key string, text string, declared string, host string, domain string, suffix string")
    model = language_id.fit_text(frame)
    got = {(r.kind, r.key, r.lang): r.n / language_id.SHARE for r in language_id._evidence_counts(frame, model).collect()}
    assert abs(got["host", "blank blank", 0] - 1.47) < 1e-3 and abs(got["host", "blank blank", 1] - 1.47) < 1e-3
    assert abs(sum(n for (kind, *_), n in got.items() if kind == "all") - 43) < 1
    docs = spark.createDataFrame([(i, r[1], r[2], r[3]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    found = language_id.identify_documents(docs).where("lang is not null").collect()
    assert len(found) == 40 and all(r.language == r.lang and r.kept for r in found)


def test_language_id_pages(spark):
    got = language_id.language_id_pages(spark, SF).toPandas()
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    truth = pages.html.str.extract(r'lang="(\w+)"')[0]
    both = got.merge(pages.assign(truth=truth), on="page_id")
    assert (both.language == both.truth).mean() >= 0.98


def test_near_duplicates_rows(spark, corpus):
    """One row of each group stays, also without a doc_id or where texts share one; a kept row brings back no other."""
    import corpus_pipeline

    text, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(None, text), (None, text + " end"), (None, text), (None, ""), (None, other), (5, other), (5, other + " x"), (6, third), (6, third + " y"), (7, third),
            (6, text[:50]), (8, None)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sum((r.text or "").startswith("a0 a1 a2 a3") and len(r.text) > 60 for r in got) == 1
    rest = sorted((str(r.doc_id), (r.text or "")[:3]) for r in got)
    assert rest == [("5", "b0 "), ("6", "a0 "), ("6", "c0 "), ("8", ""), ("None", ""), ("None", "a0 ")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(corpus, DOCS), SF).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, _, c in ngram_jaccard.brute_force(corpus) if d == c)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.language(spark, docs, SF)
    assert out.columns == columns
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    want = {d for d, _, c in ngram_jaccard.brute_force(sorted(rows.items())) if d == c}
    assert near.columns == columns and {r.doc_id for r in near.collect()} == want
    cut = corpus_pipeline.repeated_passages(spark, docs, SF)
    brute = {r[0]: r for r in substring_dedup.brute_force(sorted(rows.items()))}
    got = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == columns and set(got) == {d for d, b in brute.items() if not b[2] or b[2] < b[1]}
    for d, text in got.items():
        assert text == rows[d] if not brute[d][2] else hashlib.sha256(text.encode()).hexdigest() == brute[d][3]
    last = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "ids", "decoded_sha256"} <= set(last.columns) and 0 < last.count() <= len(want)


def test_html_deep_and_unclosed():
    """A million levels, and thousands of unclosed elements, lose no text and take no square time."""
    import time

    began = time.time()
    for text in ("<div>" * 1_000_000 + "x", "<b>" * 60_000 + "x" + "<hr>" * 60_000, "<p><td>" + "<i>" * 40_000 + "<hr>" * 40_000 + "x", "<ul>" + "<li><b>" * 60_000 + "x",
                 "<article>" + "<span>" * 300_000 + "x</article>", "</i>" * 60_000 + "<b>" * 60_000 + "</i>" * 60_000 + "x"):
        root = html_extract.prune(html_extract.parse(text))
        html_extract.mark_subtrees(root)
        assert html_extract.main_text(root, set()) == "x"
        del root
    assert time.time() - began < 120


def test_chat_format_long_conversation(spark):
    """One conversation of many turns, characters outside the basic plane, runs of one role: in proportion to the turns."""
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant"]), "\U0001F600é<| " * rng.randrange(120)) for i in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat_format.read_back(chat_format.format_chat(df)).collect()
    assert [tuple(t) for t in r.turns] == [(x[2], x[3]) for x in rows]
    assert r.loss_text == "".join(x[3] for x in rows if x[2] == "assistant")
    assert chat_format.format_chat(df.limit(0)).count() == 0
    clash = df.limit(5).selectExpr("*", "1 as i", "2 as piece", "3 as turns", "4 as formatted", "5 as loss_mask")
    assert chat_format.format_chat(clash).columns == ["conv_id", "formatted", "loss_mask"] and chat_format.format_chat(clash).count() == 1


def test_repeated_rows_count_once(spark):
    """Thousands of rows equal in id and text, ids null too: shingle components, repeated windows, fitted labels."""
    rng = random.Random(9)
    base = words(rng, 40)
    near = [*base[:-1], "other"]
    rows = [(None, " ".join(base))] * 1500 + [(None, " ".join(near))] * 1500
    # near copies in pairs without an id
    for i in range(300):
        w = words(rng, 30, 10**6)
        rows += [(None, " ".join(w)), (None, " ".join([*w[:-1], "end"]))]
    out = ngram_jaccard.linked_rows(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows) and len({r.label for r in out}) == 301
    same = [(7, " ".join(base))] * 1500 + [(8, " ".join(base))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(same, DOCS)).collect()
    assert sorted({(r.doc_id, r.n_words, r.n_removed) for r in got}) == [(7, 40, 0), (8, 40, 40)] and len(got) == 1501
    docs = spark.createDataFrame([(1, "good text " * 9), (2, "## bad ##")] * 700, DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0)] * 50, "doc_id long, quality int")
    once = quality_classifier.fit(docs.dropDuplicates(), labels)
    assert np.allclose(quality_classifier.fit(docs, labels).weight, once.weight)


def test_align_is_smith_waterman():
    """The row-wise alignment against the plain recurrence."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 25)), rng.integers(0, 5, rng.integers(0, 40))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                step = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
                h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
        assert decontaminate.align(a, b) == h.max()
