"""Resampling, the source audit and personal data against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _features(text, buckets=10_000):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _low(text))
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]


def _resampled(rows, target, percent=5, least=20, buckets=10_000, seed=42):
    """Sorted (key, n_words, n_features, weight, score, rank)."""
    described = [(k, *_features(t, buckets)) for k, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in described:
        s.update(f)
    for text in target:
        t.update(_features(text, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s_all + buckets) / ((s[i] + 1) * (t_all + buckets)))) for i in range(buckets)]
    out = []
    for k, n, f in described:
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[i] for i in f)
        out.append([k, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


def _texts(n, rng):
    words = ["the", "Of", "é", "ß", "x1", "9", "Long" * 40, "und", "日本", "tail"]
    return [" ".join(rng.choice(words) + rng.choice(["", ".", "-", "\n"]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_resample_equals_plain_version(spark, docs_of):
    from tidemark.llm import resample

    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(_texts(300, rng))] + [(900, None), (901, ""), (-5, "a " * 15_000), (902, "…!? .")]
    target = [*_texts(5, rng), None, ""]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "h long, text string")
    got = resample.resample(docs_of(rows), benchmark, "doc_id", "text", "text", percent=30, least_words=5, buckets=500)
    assert got.columns == ["key", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == _resampled(rows, target, 30, 5, 500)
    drawn = resample.drawn_documents(docs_of(rows), got, "doc_id")
    assert sorted(r["rank"] for r in drawn.collect()) == list(range(1, drawn.count() + 1))


@pytest.mark.parametrize("seed", range(4))
def test_cutoff_is_the_exact_key(spark, monkeypatch, seed):
    from tidemark.llm import resample

    monkeypatch.setattr(resample, "FEW_KEYS", 3)
    rng = random.Random(seed)
    # A third of the scores is one value, ids repeat and are missing.
    rows = [(rng.choice([None, rng.randrange(50)]), rng.choice([7, rng.randrange(20), rng.randrange(-(10**12), 10**12)]), i) for i in range(500)]
    table = spark.createDataFrame(rows, "key long, score long, row long").repartition(7)
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    for wanted in (1, 2, 250, 499, 500):
        key, score, row = order[wanted - 1]
        assert resample.cutoff(table, wanted).place == (-score, int(key is None), key or 0, row)
    assert resample.cutoff(table, 0) is None


def test_resample_repeated_ids_and_empty_tables(spark, docs_of):
    from tidemark.llm import resample

    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    same = [(1, "a b c d e f")] * 30 + [(None, "a b c d e f")] * 10 + [(2, "q " * 6)] * 2
    got = resample.resample(docs_of(same), benchmark, "doc_id", "text", "text", percent=50, least_words=2)
    ranks = sorted((r["rank"], r["key"]) for r in got.where("rank IS NOT NULL").collect())
    assert [r for r, _ in ranks] == list(range(1, 22))
    assert sorted(map(tuple, got.drop("rank").collect()), key=repr) == [r[:5] for r in _resampled(same, ["a b c"], 50, 2)]
    assert resample.resample(docs_of([]), benchmark, "doc_id", "text", "text").count() == 0
    none = resample.resample(docs_of([(1, "a b")]), benchmark.limit(0), "doc_id", "text", "text").collect()
    assert [r["rank"] for r in none] == [None]


def test_registered_resampling_equals_plain_version(spark):
    from tidemark.llm import queries

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.queries()["op11_target_resampling"](spark, SF)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r[0], *r[2:]) for r in _resampled(rows, target)), key=repr)


def test_crc_of_long_words():
    from tidemark.llm.resample import features

    texts = ["x" * 70 + " b " + "ü" * 200, "", "a" * 64, "a" * 65 + " c"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    found, owner, words = features(raw, offsets, 3, 10_000)
    assert words.tolist() == [_features(t)[0] for t in texts]
    for i, text in enumerate(texts):
        assert sorted(found[owner == i].tolist()) == sorted(_features(text)[1])


def _audited(rows, least=30, smooth=5, top=50):
    """Set of (lang, source, part, item, value, rank) of (text, lang, source) rows."""
    count, docs = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _low(text))
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [w for w, n in docs[lang].items() if n >= least]
        total = Counter({w: sum(count[lang, s][w] for s in sources) for w in kept})

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + smooth) // (n + smooth * len(kept)) for w in kept}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(total)
        for s in sources:
            terms = [(w, p[s][w] - q[w]) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s]
            for part, found, most in (("term", terms, top), ("pair", pairs, None)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(found[:most], 1)}
    return out


def test_source_audit_equals_plain_version(spark, docs_of):
    from tidemark.llm import sourceaudit

    rng = random.Random(9)
    vocabulary = ["the", "THE", "éa", "straße", "longerthaneight", "longerthaneighx", "longerthaneightandsixteen", "日本語テキスト", "日本語テ", "z"]
    rows = []
    for i in range(160):
        words = [rng.choice(vocabulary[: 3 + i % 8]) for _ in range(rng.randrange(12))]
        rows.append((i % 90, rng.choice([" ", "1", "\t-"]).join(words), rng.choice(["s0", "s1", "S2", None, ""]), rng.choice(["en", "fr", None])))
    rows += [(5, None, "lone", "de"), (5, "1 2 3", "s1", "de"), (None, "word", "none", "xx"), (7, "k" * 30_000 + " " + "k" * 30_000, "s0", "en")]
    got = sourceaudit.divergence(docs_of(rows), "text", "lang", "source", least_docs=4, smooth=5, top=3)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == sorted(_audited([(t, lang, s) for _, t, s, lang in rows], 4, 5, 3))
    assert sourceaudit.divergence(docs_of([]), "text", "lang", "source").count() == 0


def test_source_audit_in_tiles(spark, docs_of, monkeypatch):
    """More sources than one tile holds."""
    from tidemark.llm import sourceaudit

    monkeypatch.setattr(sourceaudit, "TILE", 3)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(9)), f"s{i % 8}", "en") for i in range(60)]
    got = sourceaudit.divergence(docs_of(rows), "text", "lang", "source", least_docs=2)
    assert sorted(map(tuple, got.collect())) == sorted(_audited([(t, lang, s) for _, t, s, lang in rows], 2))


def test_pointer_sort_orders_words():
    from tidemark.llm.sourceaudit import equal_runs
    from tidemark.llm.words import LETTERS, word_bounds

    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(400)] * 2 + ["a" * 5000] * 3 + ["a" * 5001]
    rng.shuffle(words)
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, lengths = word_bounds(raw, np.array([0, len(raw)]), LETTERS)
    order, firsts = equal_runs(raw, starts, lengths)
    assert [words[i] for i in order] == sorted(words)
    assert len(firsts) == len(set(words))


RULES = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def _base(text):
    found = [(k, *m.span()) for k, rule in enumerate(RULES) for m in re.finditer(rule, text) if _valid(k, m[0])]
    return sorted(found, key=lambda s: (s[1], s[0]))


def test_base_spans_equal_the_rules():
    from tidemark.llm.personal import base_spans

    rng = random.Random(4)
    parts = ["a@b.c", "@", ".", "+", "1", "12", "255", "256", "4539578763621486", " ", "-", "(", ")", "x.y", "é", "+1 (499) 555-6503", "8.8.8.8", "007", "\n", "+4"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert base_spans(text) == _base(text), text


@pytest.fixture(scope="module")
def detector(spark):
    from tidemark.llm import personal
    from tidemark.llm.common import prepare

    prepare(spark)
    return personal.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "doc_id", "text")


def test_detector_adds_values_that_run_together(spark, docs_of, detector):
    """Held-out accuracy: values of other tables, set next to each other in prose."""
    from tidemark.llm import personal

    values = defaultdict(set)
    for r in spark.read.parquet("/root/testdata/check_s/documents.parquet").where("doc_id % 7 = 3").select("text").collect():
        for k, a, b in _base(r["text"]):
            values[k].add(r["text"][a:b])
    known = {r["text"][a:b] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect() for _, a, b in _base(r["text"])}
    rng = random.Random(8)
    rows, truth = [], {}
    for i in range(200):
        ka, kb = rng.choice([(2, 2), (3, 2), (3, 1), (2, 3)])
        a, b = (rng.choice(sorted(values[k] - known)) for k in (ka, kb))
        text = f"tio nés ernd {a} {b} onthe, ré."
        rows.append((i, text))
        truth[i] = {(ka, 13, 13 + len(a)), (kb, 14 + len(a), 14 + len(a) + len(b))}
    rows += [(1000 + i, t) for i, t in enumerate(["no data 2021-03-04 12:30 at 1,234,567.89", "ISBN 978-3-16-148410-0", "4539578763621487 is no card", "", None, "1 2 3 " * 3000])]
    found = {r["key"]: {tuple(s) for s in r["spans"]} for r in personal.detect(docs_of(rows), "doc_id", "text", detector).collect()}
    right = sum(len(truth[i] & found[i]) for i in truth)
    assert right >= 0.95 * 400 and sum(len(found[i] - truth[i]) for i in truth) <= 0.03 * 400
    assert all(not found[1000 + i] for i in range(6))


def test_detect_keeps_base_spans_and_rows(spark, docs_of, detector):
    from tidemark.llm import personal

    texts = ["mail é a.b@c.de and 8.8.8.8, +1 (499) 555-6503", None, "", "x" * 200_000 + " q@r.st", "4539578763621486 " * 400]
    rows = [(i % 3 if i != 4 else None, t) for i, t in enumerate(texts * 2)]
    got = personal.detect(docs_of(rows), "doc_id", "text", detector)
    assert got.columns == ["row", "key", "base", "spans"]
    want = sorted((repr(k), _base(t or "")) for k, t in rows)
    assert sorted((repr(r["key"]), [tuple(s) for s in r["base"]]) for r in got.collect()) == want
    assert all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]} for r in got.collect())
    for spans in ([tuple(s) for s in r["spans"]] for r in got.collect()):
        assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:])) and spans == sorted(spans, key=lambda s: (s[1], s[0]))
    redacted = spark.createDataFrame([("é a@b.cd, 8.8.8.8", [(0, 2, 8), (1, 10, 17)])], f"t string, s array<{personal.SPAN}>")
    assert redacted.select(personal.redact(F.col("t"), F.col("s"))).first()[0] == "é <email>, <ip>"
    nothing = personal.fit(docs_of([(1, "no data")]), "doc_id", "text")
    assert nothing.trees is None
    assert personal.detect(docs_of([]), "doc_id", "text", nothing).count() == 0
    alone = personal.detect(docs_of(rows[:2]), "doc_id", "text", nothing).collect()
    assert all(r["base"] == r["spans"] for r in alone)


def test_registered_personal_data(spark):
    from tidemark.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    names = ("email", "ip", "card", "phone")
    for r in queries.queries()["op13_personal_data"](spark, SF).collect():
        base = _base(texts[r["doc_id"]])
        joined = ",".join(f"{names[k]}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{n}"] for n in names] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_vectors_come_back_once_each(spark):
    """Rows without a key, rows that share one, and unusable vectors among them."""
    from tidemark.llm import vectordup
    from tidemark.llm.common import prepare

    prepare(spark)
    near = [1.0, 0.0, 0.1]
    rows = [(1, near, 0), (1, [0.0, 0.0, 0.0], 0), (None, near, 0), (None, None, 0), (2, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 1), (5, near, 0), (5, near, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["key"], r["n_links"], r["component"]) for r in vectordup.near_vectors(df, "vec_id", "embedding", "label").collect()), key=repr)
    # The four equal vectors of label 0 link with each other; everything else stands alone.
    want = [(1, 3, 1), (1, 0, 1), (None, 3, 1), (None, 0, None), (2, 0, 2), (2, 0, 2), (5, 3, 1), (5, 3, 1)]
    assert got == sorted(want, key=repr)


def test_tiny_sources_meet_their_targets(spark, docs_of):
    from tidemark.llm import mixing

    rows = [(i, "w " * (3 + i % 5), f"s{i % 40}") for i in range(240)] + [(1000, "w " * 20_000, "big"), (1001, None, "none")]
    mixed = mixing.mix(docs_of(rows), "doc_id", "text", "source")
    plan = mixed.plan
    taken = defaultdict(int)
    for r in mixing.taken_words(mixed).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, size, target in zip(plan.sources, plan.sizes, plan.targets):
        assert abs(taken[source] - target) <= max(1, 0.02 * size)
