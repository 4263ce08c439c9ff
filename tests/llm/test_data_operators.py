"""Token files, mixing, archives, pages and vectors against plain Python."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from tidemark.llm import htmltext, mixing, tokenbin, vectordup, warc
from tidemark.llm.queries import tokenizer_path

TEXTS = [
    "Hello, world. The cat's hat... don't!", None, "", " \n", "été ÉTÉ straße ΑΣ σας", "a\x1cb <|endoftext|> <|ENDOFTEXT|> c",
    "中文字 ½ x1 12,5", "word " * 3000, "Ünïcode.. A.B, é", "same text", "same text",
]


def test_values_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
        control, data = tokenbin.encode_values(values)
        assert len(control) == -(-n // 4) and (tokenbin.decode_values(control, data, n) == values).all()
    assert len(tokenbin.encode_values(np.array([0, 255, 256, 65536, 1 << 24], np.uint32))[1]) == 1 + 1 + 2 + 3 + 4


def test_words_equal_whole_texts():
    words = tokenbin.WordTokenizer(tokenizer_path())
    assert words.direct
    texts = [t or "" for t in TEXTS]
    assert words.encode(texts) == [words.whole(t) for t in texts]


@pytest.mark.parametrize("word", ["H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c", "O H\u0331aver is J\u030can."])
def test_capitals_whose_small_letters_compose(word):
    words = tokenbin.WordTokenizer(tokenizer_path())
    texts = [word, word + "a", f"the {word}aver is here", word.lower()]
    assert words.encode(texts) == [words.whole(t) for t in texts]


@pytest.mark.parametrize("block", [tokenbin.BLOCK_VALUES, 50])
def test_token_files(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(tokenbin, "BLOCK_VALUES", block)
    rows = [(3 * i - 5, t) for i, t in enumerate(TEXTS)]
    docs = docs_of(rows)
    files = tokenbin.write_tokens(docs, "doc_id", "text", tokenizer_path(), 1)
    # A session that knows nothing but the folder reads the same.
    files = tokenbin.open_tokens(spark.newSession(), files.folder)
    got = {r["key"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenbin.token_digests(spark, files).collect()}
    assert got == brute.token_rows(rows, tokenizer_path(), 1)


def test_token_files_of_null_and_repeated_keys(spark, docs_of):
    docs = docs_of([(None, "b"), (2, "x y"), (2, "x y"), (1, "z")])
    files = tokenbin.write_tokens(docs, "doc_id", "text", tokenizer_path(), 1)
    got = sorted((r["start"], r["key"], r["n_tokens"]) for r in tokenbin.token_digests(spark, files).collect())
    assert got == [(0, None, 2), (2, 1, 2), (4, 2, 3), (7, 2, 3)]
    none = tokenbin.write_tokens(docs.limit(0), "doc_id", "text", tokenizer_path(), 1)
    assert tokenbin.token_digests(spark, none).count() == 0


def test_water_fill_equals_resharing():
    rng = random.Random(4)
    for n in (1, 2, 7, 25):
        sizes = [rng.choice([0, 5, 100, 1000, 50_000]) for _ in range(n)]
        weights = [(3, 1, 2)[i % 3] for i in range(n)]
        assert mixing.water_fill(sizes, weights, 1.5, 2) == pytest.approx(brute.targets(sizes))


def test_permutation_is_one():
    for n in (1, 2, 3, 64, 65, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9))
        assert sorted(got.tolist()) == list(range(n))


def mix_rows():
    rng = random.Random(6)
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(rng.randint(0, 400))), rng.choice("abc") if k % 3 else "hot") for k in range(120)]
    return rows + [(200, None, "a"), (201, "", "empty"), (202, "one\ttwo\n three", None), (5, rows[5][1], rows[5][2]), (None, "x y z", "b")]


def test_mix_meets_targets(docs_of):
    rows = mix_rows()
    docs = docs_of(rows)
    mixed = mixing.mix(docs, "doc_id", "text", "source", block=16)
    got = mixing.taken_words(mixed).collect()
    again = mixing.taken_words(mixing.mix(docs.repartition(5), "doc_id", "text", "source", block=16)).collect()
    shape = lambda rs: Counter((r["key"], r["source"], r["size"], r["taken"]) for r in rs)
    assert shape(got) == shape(again) and len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert list(mixed.plan.sources) == names and list(mixed.plan.sizes) == [size[s] for s in names]
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, target in zip(names, brute.targets([size[s] for s in names])):
        assert abs(taken[s] - target) <= 16 + 1e-9


def test_mixed_documents_hold_the_taken_words(spark, docs_of):
    from pyspark.sql import functions as F

    from tidemark.session import cut_lineage

    rows = mix_rows()
    numbered = cut_lineage(docs_of(rows).withColumn("_row", F.monotonically_increasing_id()))
    mixed = mixing.mix(numbered, "doc_id", "text", "source", block=16, row="_row")
    out = mixing.mixed_documents(mixed, numbered, "_row", "text", "n_chars")
    assert out.columns == [c for c in numbered.columns if c != "_row"]
    words, texts = Counter(), {k: t for k, t, _ in rows}
    for r in out.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(texts[r["doc_id"]].split())
    want = Counter()
    for r in mixing.taken_words(mixed).collect():
        want[r["key"]] += r["taken"]
    assert words == +want


def test_mix_of_nothing(docs_of):
    docs = docs_of([(1, "x", "a")]).limit(0)
    assert mixing.taken_words(mixing.mix(docs, "doc_id", "text", "source")).count() == 0


def page_rows():
    long = "<p>" + "é" * 700 + "</p>\r\n\r\nWARC/1.1\r\n"
    return [(1, "u", long), (2, "u v", long), (9, None, long), (4, "u\r\nx", "tiny"), (5, "u", "tiny"), (6, "u", None), (7, "u", ""), (8, "u", "z" * 1000), (None, "u", "q" * 2000)]


def test_archives_resolve_revisits(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").repartition(3)
    pages = pages.selectExpr("*", "concat('urn:page:', page_id) as record_id", "'clash' as digest")
    records = warc.payload_records(pages, "record_id", "url", "html", "page_id")
    folder = str(tmp_path / "a")
    warc.write_archives(warc.resolve_revisits(records), folder, "2024-01-01T00:00:00Z", per_file=4)
    got = warc.read_archives(spark, folder).collect()
    number = lambda x: x and int(x.removeprefix("urn:page:"))
    rows = {number(r["record_id"]): (r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in got}
    assert rows == brute.revisit_rows([(k, h) for k, _, h in page_rows() if k is not None]) | {None: rows[None]}
    assert rows[None][0] == 2000 and len(got) == len(page_rows())
    payloads = {number(r["record_id"]): r["payload"] for r in got}
    assert payloads[9] == page_rows()[0][2].encode() and payloads[1] is None and payloads[6] == b""


def test_archives_are_resolved_again(spark, tmp_path):
    """Revisits of earlier archives follow the response that is kept now."""
    pages = spark.createDataFrame(page_rows()[:3], "page_id long, url string, html string").selectExpr("*", "concat('p:', page_id) as id")
    warc.write_archives(warc.resolve_revisits(warc.payload_records(pages, "id", "url", "html", "page_id")), str(tmp_path / "a"), "d")
    newer = spark.createDataFrame([(20, "u", page_rows()[0][2])], "page_id long, url string, html string").selectExpr("*", "'p:20' as id")
    old = warc.read_archives(spark, str(tmp_path / "a")).selectExpr("*", "cast(substring(record_id, 3) as bigint) as rank")
    both = old.unionByName(warc.payload_records(newer, "id", "url", "html", "page_id"))
    warc.write_archives(warc.resolve_revisits(both), str(tmp_path / "b"), "d")
    got = {r["record_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "b")).collect()}
    assert got == {"p:20": ("response", None), **{f"p:{k}": ("revisit", "p:20") for k in (1, 2, 9)}}


def test_revisits_when_every_digest_passes_the_filter(spark, monkeypatch):
    """A filter that lets all pass costs shuffles, not payloads; rows without an id and empty tables come through."""
    monkeypatch.setattr(warc, "in_filter", lambda rows, h: lambda values: values.isNotNull())
    pages = spark.createDataFrame([*page_rows(), (None, None, "q" * 2000), (None, None, None)], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "concat('urn:page:', page_id) as record_id")
    records = warc.payload_records(pages, "record_id", "url", "html", "page_id")
    got = warc.resolve_revisits(records).collect()
    assert len(got) == len(page_rows()) + 2
    kinds = {r["record_id"]: r["record_type"] for r in got if r["record_id"]}
    assert kinds == {f"urn:page:{k}": "revisit" if k in (1, 2) else "response" for k, _, _ in page_rows() if k is not None}
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    assert [r["payload_bytes"] for r in got if r["record_id"] is None and r["payload"] is not None].count(2000) == 2
    assert warc.resolve_revisits(records.limit(0)).count() == 0


def test_gzip_members_and_damage():
    import gzip

    one = warc.record_bytes("a", "u", "response", b"xy", 2, __import__("hashlib").sha1(b"xy").hexdigest(), None, "d") + b"\r\n\r\n"
    data = warc.inflate(gzip.compress(one) + gzip.compress(one))
    assert [r[3] for r in warc.parse_records(data)] == [b"xy", b"xy"]
    with pytest.raises(ValueError):
        list(warc.parse_records(one.replace(b"xy\r\n\r\n", b"xz\r\n\r\n")))


LONG = "A paragraph that is long enough to be the main text of a page, with more than eighty characters in it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just &lt;text&gt;", "just <text>"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T&amp;T</h1><p>{LONG}<p>a&nbsp; b<br>c</article><footer>f</footer>", f"T&T\n\n{LONG}\n\na b c"),
        (f"<header>Site</header><div><p>{LONG}</p><p>Short.</p></div><div id='comments'><p>{LONG}</p></div>", f"{LONG}\n\nShort."),
        (f"<script>if (a<b) '</p>'</script><style>p{{}}</style><div class='ad'>{LONG}</div><p>{LONG}</p>", LONG),
        (f"<article><p>{LONG}</p><form><p>{LONG}</p></form><aside>x</aside><!-- {LONG} --><p>end", f"{LONG}\n\nend"),
        (f"<ul><li><a href=1>{LONG}</a></li></ul><p>{LONG}</p><p title='a>b'>x</p>", f"{LONG}\n\nx"),
        ("<article><p>Tiny.</p></article>", "Tiny."),
        ("<p title='unclosed>x", "x"),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page or "") == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='content with-sidebar'><p>{LONG}</p><div class='sidebar'>{LONG[:50]}</div></div>", LONG),
        (f"<div class='single-post has-comments'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div class='layout-sidebar'><main><p>{LONG}</p></main></div><p>{LONG}{LONG}</p>", LONG),
        (f"<div class='elementor-widget elementor-widget-text-editor'><p>{LONG}</p></div>" * 3, "\n\n".join([LONG] * 3)),
        (f"<body><form action='./page.aspx'><article><p>{LONG}</p><form>{LONG[:40]}</form></article></form>", LONG),
        (f"<form><div><p>{LONG}</p></div></form><p>x</p>", f"{LONG}\n\nx"),
        (f"<article><p>{LONG}</p></article><div id='comments'><article class='comment'>{LONG}</article></div>", LONG),
        (f"<p>{LONG}</p><div class='related-posts'>{LONG[:60]}</div><div class='post__share'>{LONG[:60]}</div>", LONG),
        (f"<div hidden><p>{LONG}{LONG}</p></div><p>{LONG}</p>", LONG),
    ],
)
def test_wrappers_are_not_dropped_for_their_names(page, text):
    assert htmltext.main_text(page) == text


def test_long_page_keeps_every_paragraph(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<article>" + "".join(f"<p>{i} {LONG}</p>" for i in range(3000)) + "</article>", "x"), (1, None, None, "y")],
        "page_id long, url string, html string, text string",
    )
    got = {r["url"]: r for r in htmltext.extract_text(pages, "page_id", "url", "html").collect()}
    assert got["u"]["text"].count("\n\n") == 2999 and got["u"]["n_chars"] == len(got["u"]["text"]) and got[None]["text"] == ""
    assert htmltext.extract_text(pages.limit(0), "page_id", "url", "html").count() == 0


def vector_rows(n=600):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(n // 4, 16)).astype(np.float32)
    rows = []
    for k in range(n):
        v = base[k // 4] if k % 4 < 2 else base[k // 4] + rng.normal(size=16) * 0.04
        rows.append((k, [float(x) for x in np.float32(v)], int(k // 4 % 3)))
    crowd = rng.normal(size=16)
    rows += [(n + k, [float(x) for x in np.float32(crowd + rng.normal(size=16) * 0.05)], 1) for k in range(150)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, rows[0][1][:8], rows[0][1][:8]]
    rows += [(5000 + i, v, 0) for i, v in enumerate(odd)]
    return rows + [(6000, rows[0][1], None), (6001, rows[0][1], 2)]


@pytest.mark.parametrize("size", [vectordup.SLICE, 20])
def test_vectors_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(vectordup, "SLICE", size)
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, id int").repartition(4)
    got = {r["key"]: (r["n_links"], r["component"]) for r in vectordup.near_vectors(frame, "vec_id", "embedding", "label", pivots=128).collect()}
    want = brute.vector_rows(rows)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert set(got) == set(want) and all(got[k][0] <= want[k][0] for k in want) and found >= 0.9 * there
    assert vectordup.near_vectors(frame.limit(0), "vec_id", "embedding", "label").count() == 0


def crowded_rows(n=2400, size=64):
    """A third of the rows are copies of one vector, with near copies around it; the others come in fours."""
    rng = np.random.default_rng(12)
    hot = rng.normal(size=size)
    rows = [hot] * (n // 3)
    rows += [hot + rng.normal(size=size) * 0.09 for _ in range(n // 6)]
    while len(rows) < n:
        base = rng.normal(size=size)
        rows += [base + rng.normal(size=size) * 0.05 for _ in range(4)]
    return [(k, [float(x) for x in np.float32(v)], 0) for k, v in enumerate(rows)]


def test_vectors_around_many_copies(spark):
    rows = crowded_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    pivots = vectordup.sample_pivots(frame, "embedding", 512)
    assert (np.triu(pivots @ pivots.T, 1) <= vectordup.APART).all()
    got = {r["key"]: (r["n_links"], r["component"]) for r in vectordup.near_vectors(frame, "vec_id", "embedding", "label").collect()}
    want = brute.vector_rows(rows)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in want) and found >= 0.99 * there
    # Every link of the copies, and their one group.
    assert all(got[k] == want[k] for k in range(800))


@pytest.mark.parametrize("vectors", [[[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]], [[2.0], [5.0], [-1.0]]])
def test_vectors_of_few_directions(spark, vectors):
    rows = [(k, v, 0) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["key"]: (r["n_links"], r["component"]) for r in vectordup.near_vectors(frame, "vec_id", "embedding", "label").collect()}
    assert got == brute.vector_rows(rows)
