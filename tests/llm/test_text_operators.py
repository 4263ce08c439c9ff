"""Language, SimHash, decontamination, chunks and suffixes against plain Python."""

import hashlib
import itertools
import random

import brute
import numpy as np
import pytest

from tidemark.llm import chunkdedup, decontam, langid, simhash, suffixdedup
from tidemark.llm.components import connected_components

EN = "the and of that with from this which have been their would there about other into".split()
DE = "und der die das nicht mit auf für sich dem werden einer wurde über nach beim".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "en", "ing", "ly"]) for _ in range(n))


def copies(rng, n=60, words=60):
    """Documents with exact and near copies, shared passages and odd texts."""
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    shared = " ".join(rng.choices(vocabulary, k=55))
    rows = []
    for k in range(n):
        text = " ".join(rng.choices(vocabulary, k=words))
        if k % 7 == 3:
            text = rows[k // 2][1]
        if k % 7 == 5 and rows[k // 2][1]:
            own = rows[k // 2][1].split()
            own[len(own) // 2] = "changed"
            text = " ".join(own)
        if k % 9 == 4:
            text += " " + shared + " " + " ".join(rng.choices(vocabulary, k=20))
        rows.append((k, text))
    odd = [None, "", " \t\n", "é", "x" * 400, "x" * 300, "ab " * 200, "A B c", "a b C", "ñandú " * 30]
    return rows + [(n + i, t) for i, t in enumerate(odd)]


def test_components_chain_star_and_none(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = brute.components({x for p in links for x in p if None not in p and p[0] != p[1]}, [p for p in links if None not in p])
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_phrases_equal_greedy_parse():
    rng = random.Random(3)
    samples = [prose(rng, EN, 80), prose(rng, DE, 80)]
    texts = [prose(rng, EN, 30), prose(rng, DE, 30), "the", "zzzz q the", "ü", "a  -- b..c", ""]
    tables = langid.Tables([s.encode() for s in samples])
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got, size = tables.phrases(np.frombuffer(raw, np.uint8), offsets)

    def plain(text):
        return " ".join("".join(chr(c) if c >= 128 or chr(c).isalpha() else " " for c in text.encode()).split(" ")).encode("latin-1")

    import re

    for i, s in enumerate(samples):
        sample = re.sub(rb" +", b" ", plain(s))
        for j, t in enumerate(texts):
            text = re.sub(rb" +", b" ", plain(t))
            assert (got[i, j], size[j]) == (brute.phrases(sample, text), len(text)), (s[:20], t)


def test_language_held_out_accuracy_and_odd_rows(docs_of):
    rng = random.Random(5)
    rows = [(k, prose(rng, EN if k % 2 else DE, rng.randint(5, 60)), None, "en" if k % 2 else "de") for k in range(200)]
    odd = [(500, None), (501, ""), (502, "12 -- 7"), (None, "der und das nicht", None, "de"), (503, "the that with", None, None)]
    docs = docs_of(rows + odd + [rows[0]])
    profiles = langid.fit(docs.where("doc_id % 3 != 1"), "text", "lang", "doc_id")
    assert profiles.languages == ["de", "en"]
    got = langid.predict(docs, profiles, "doc_id", "text").collect()
    by = {r["key"]: r for r in got}
    assert len(got) == len(rows) + len(odd) + 1
    held = [r for r in rows if r[0] % 3 == 1]
    assert sum(by[r[0]]["language"] == r[3] for r in held) / len(held) > 0.98
    assert [by[k]["language"] for k in (500, 501, 502, 503, None)] == ["und", "und", "und", "en", "de"]
    assert by[500]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got)


def test_language_without_training_rows(docs_of):
    docs = docs_of([(1, "hello there"), (2, None)])
    profiles = langid.fit(docs, "text", "lang", "doc_id")
    assert {r["language"] for r in langid.predict(docs, profiles, "doc_id", "text").collect()} == {"und"}
    assert langid.predict(docs.limit(0), profiles, "doc_id", "text").count() == 0


@pytest.mark.parametrize("text", ["", "one", "One TWO", "a b c", "a b c d a b c d", "É é ü x y\x0bz", "w " * 300])
def test_fingerprint_equals_bit_counts(text):
    assert simhash.fingerprint(text.encode(), 3) == brute.simhash(text)


def test_group_roots_equal_all_pairs():
    rng = np.random.default_rng(1)
    for n in (3, 64, 65, 400):
        prints = rng.integers(0, 1 << 64, max(1, n // 6), dtype=np.uint64)[rng.integers(0, max(1, n // 6), n)]
        for _ in range(3):
            prints = prints ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.6).astype(np.uint64)
        links = [(i, j) for i in range(n) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3).tolist()]
        want = brute.components(range(n), links)
        assert simhash.group_roots(prints, 3).tolist() == [want[i] for i in range(n)]


def test_simhash_groups(docs_of):
    rows = copies(random.Random(11), 80, 120)
    got = simhash.near_duplicates(docs_of(rows + [(None, "a b c"), (None, "no one else has this")]), "doc_id", "text").collect()
    want = brute.simhash_rows(rows)
    assert {r["key"]: (f"{r['fingerprint'] % 2**64:016x}", r["component"]) for r in got if r["key"] is not None} == want
    assert len(got) == len(rows) + 2


def test_simhash_long_lists_are_split(spark):
    rng = np.random.default_rng(2)
    center = rng.integers(0, 1 << 64, 1, dtype=np.uint64)[0]
    prints = {int(center)}
    while len(prints) < 120:
        flips = rng.choice(64, rng.integers(1, 5), replace=False)
        prints.add(int(center) ^ sum(1 << int(b) for b in flips))
    values = np.array(sorted(prints), np.uint64)
    frame = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values.view(np.int64))], "key long, fingerprint long")
    links = [(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3).tolist()]
    want = brute.components(range(len(values)), links)
    got = simhash.fingerprint_groups(frame, longest=10).collect()
    assert {r["rep"]: r["component"] for r in got} == want


def test_empty_tables(docs_of):
    none = docs_of([(1, "x")]).limit(0)
    assert simhash.near_duplicates(none, "doc_id", "text").count() == 0
    assert suffixdedup.remove_repeats(none, "doc_id", "text").count() == 0
    assert chunkdedup.duplicate_spans(none, "doc_id", "text").count() == 0


def test_overlaps_tolerate_substitutions(spark, docs_of):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(8)] + [(8, "short item of five"), (9, None), (10, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def around(text):
        return " ".join(rng.choices(vocabulary, k=40)) + " " + text + " " + " ".join(rng.choices(vocabulary, k=40))

    changed = items[1][1].split()
    for i in (4, 11, 17, 25):
        changed[i] = "other"
    rows = [
        (1, around(items[0][1])),
        (2, around(" ".join(changed))),
        (3, around(" ".join(items[2][1].split()[:14]))),
        (4, around(" ".join(items[3][1].split()[:9]))),
        (5, around("SHORT, item of five!")),
        (6, around("")),
        (7, None),
        (8, ""),
        (None, around(items[0][1])),
        (9, items[4][1].upper() + ". " + items[5][1]),
        (10, " ".join([items[6][1]] * 40)),
    ]
    docs = docs_of(rows)
    found = decontam.overlaps(docs, benchmark, "doc_id", "text", "item_id", "text")
    got = {(r["key"], r["item"]): r for r in found.collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2), (5, 8), (9, 4), (9, 5), (10, 6)}
    assert got[2, 1]["words"] == 30 and got[2, 1]["equal"] == 26 and got[1, 0]["first"] == 40
    kept = decontam.decontaminate(docs, found, "doc_id")
    assert {r["doc_id"] for r in kept.collect()} == {4, 6, 7, 8, None} and kept.columns == docs.columns
    empty = benchmark.limit(0)
    assert decontam.overlaps(docs, empty, "doc_id", "text", "item_id", "text").count() == 0


def longest_stretch(equal):
    """(positions, equal, first) of the longest stretch with over 0.8 equal words, of these the one with most."""
    found = [(j - i, sum(equal[i:j]), -i) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1) if 5 * sum(equal[i:j]) > 4 * (j - i)]
    size, same, first = max(found, default=(0, 0, 0))
    return size, same, -first


@pytest.mark.parametrize("n", [13, 14, 15, 16, 18, 20, 22, 25])
def test_stretch_equals_brute_force(n):
    words = np.arange(n)
    for count in (0, 1, 2, 3):
        for places in itertools.combinations(range(n), count):
            context = np.concatenate((np.full(5, -1), words, np.full(5, -1)))
            context[[5 + p for p in places]] = -2
            size, same, first = longest_stretch([i not in places for i in range(n)])
            assert decontam.stretch(context, words, 5) == (size, same, 5 + first), places
            if n >= 13 and 5 * (n - count) > 4 * n:
                assert size == n


def test_overlaps_of_short_items_with_replaced_words(spark, docs_of):
    """Every place of a replaced word that leaves a window of a mask leaves the overlap."""
    rng = random.Random(29)
    items = [[f"w{n}x{i}y{rng.randrange(999)}" for i in range(n)] for n in (13, 15, 17, 20)]
    rows, want = [], set()
    for item, words in enumerate(items):
        for p in range(len(words)):
            changed = words[:p] + ["other"] + words[p + 1 :]
            text = " ".join(["before"] * 20 + changed + ["behind"] * 20)
            rows.append((len(rows), text))
            if any(all(i + o != p for o, m in enumerate(mask) if m == "1") for mask in decontam.MASKS for i in range(len(words) - len(mask) + 1)):
                want.add((len(rows) - 1, item))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = decontam.overlaps(docs_of(rows), benchmark, "doc_id", "text", "item_id", "text").collect()
    assert {(r["key"], r["item"]) for r in found} == want and len(want) == len(rows)
    assert all(r["words"] == r["item_words"] == r["equal"] + 1 and r["first"] == 20 for r in found)


def test_suffix_removal_equals_brute_force(docs_of):
    rows = copies(random.Random(13), 50, 60)
    rng = random.Random(1)
    rng.shuffle(rows)
    got = suffixdedup.remove_repeats(docs_of(rows + [(None, rows[0][1])]), "doc_id", "text").collect()
    want = brute.removed_rows(rows)
    assert {r["key"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got if r["key"] is not None} == want
    assert sum(r["n_removed"] for r in got if r["key"] is None) == 0


def test_suffix_passes_and_levels(monkeypatch):
    """Many small batches, levels and passes give what one sort gives."""
    rows = [(k, (t or "")) for k, t in copies(random.Random(17), 60, 80)]
    random.Random(2).shuffle(rows)
    monkeypatch.setattr(suffixdedup, "BATCH_WINDOWS", 500)
    monkeypatch.setattr(suffixdedup, "PASS_WINDOWS", 4000)
    blobs, spans = [], {}

    def put(key, first, end):
        for k, a, b in zip(key.tolist(), first.tolist(), end.tolist()):
            spans.setdefault(k, set()).update(range(a, b))

    for at in range(0, len(rows), 5):
        part = rows[at : at + 5]
        raw = [np.frombuffer(t.encode(), np.uint8) for _, t in part]
        held = [(np.array([k for k, _ in part]), np.zeros(len(part), np.int64), np.concatenate(raw), np.array([len(x) for x in raw]))]
        batch = suffixdedup.packed(held, 50, 1)
        for windows, known, size, blob in zip(*(batch.column(c).to_pylist() for c in ("windows", "known", "size", "blob"))):
            if known:
                import zstandard

                k, _, s, c, _ = suffixdedup.unpacked(blob, size, zstandard.ZstdDecompressor().decompress)
                put(k, s, s + c + 49)
            else:
                blobs.append((blob, size, windows))
    for k, _, s in suffixdedup.bucket_repeats(blobs, 50):
        put(k, s, s + 50)
    want = brute.removed_rows(rows)
    assert {k: len(spans.get(k, ())) for k, _ in rows} == {k: v[1] for k, v in want.items()}


def test_rows_that_share_an_id_lose_their_own_repeats_alone(docs_of):
    """A third of the rows has one id; rows with an id are not smaller than each other."""
    rng = random.Random(37)
    texts = [t or "" for _, t in copies(rng, 60, 80)]
    rows = [(5 if i % 3 == 2 else i // 2, t) for i, t in enumerate(texts)]
    least = {}
    for key, text in rows:
        data = text.encode()
        for i in range(len(data) - 49):
            least[data[i : i + 50]] = min(key, least.get(data[i : i + 50], key))
    want = []
    for key, text in rows:
        data = text.encode()
        gone = {j for i in range(len(data) - 49) if least[data[i : i + 50]] < key for j in range(i, i + 50)}
        want.append((key, len(data), len(gone), hashlib.sha256(bytes(b for j, b in enumerate(data) if j not in gone)).hexdigest()))
    docs = docs_of(rows)
    got = suffixdedup.remove_repeats(docs, "doc_id", "text").collect()
    assert sorted((r["key"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)
    assert any(n for k, _, n, _ in want if k == 5) and any(not n for k, _, n, _ in want if k == 5)
    chunked = chunkdedup.remove_spans(docs, chunkdedup.duplicate_spans(docs, "doc_id", "text"), "doc_id", "text").collect()
    most = {}
    for (key, size, gone, _), (_, text) in zip(want, rows):
        most[key, text] = gone
    assert len(chunked) == len(rows) and sum(r["n_removed"] for r in chunked) > 0
    for r in chunked:
        assert any(k == r["key"] and len(t.encode()) == r["n_bytes"] and r["n_removed"] <= m for (k, t), m in most.items())


def test_cut_points_equal_positionwise_rule():
    rng = random.Random(19)
    texts = [prose(rng, EN, n) for n in (0, 1, 12, 40, 90)] + ["aaaa" * 60]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    want = set()
    for a, t in zip(offsets, texts):
        want |= {int(a) + c for c in brute.gear_cuts(t.encode(), chunkdedup.GEAR, chunkdedup.MEMORY, chunkdedup.REACH)}
    assert set(chunkdedup.cut_points(raw, offsets).tolist()) == want


def test_chunks_find_shifted_passages_and_leave_others(docs_of):
    rows = copies(random.Random(23), 70, 90)
    docs = docs_of(rows)
    spans = chunkdedup.duplicate_spans(docs, "doc_id", "text")
    got = {r["key"]: r for r in chunkdedup.remove_spans(docs, spans, "doc_id", "text").collect()}
    exact = brute.removed_rows(rows)
    assert len(got) == len(rows)
    for k, text in rows:
        data = (text or "").encode()
        assert got[k]["n_bytes"] == len(data) and len(got[k]["kept"]) == len(data) - got[k]["n_removed"]
        # What chunks remove, 50-byte windows of an earlier document hold as well.
        assert got[k]["n_removed"] <= exact[k][1]
        if exact[k][1] >= 300 and len(set(data)) > 4:
            assert got[k]["n_removed"] > 0 and all(s < k for s in got[k]["sources"])
        if not exact[k][1]:
            assert got[k]["n_removed"] == 0


LONG = "The main article text is long enough to surge over any threshold by itself. " * 3


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<article><p>{LONG}</p><p class="ad-hoc-note">A note made for this case.</p></article>', "A note made for this case."),
        (f'<article><p>{LONG}</p><div class="share-price">The share rose to 12.</div></article>', "The share rose to 12."),
        (f'<article><p>{LONG}</p><section id="search-engines"><p>How search engines rank.</p></section></article>', "How search engines rank."),
        (f'<article><p>{LONG}</p><section id="social-policy"><p>Social policy.</p></section></article>', "Social policy."),
        (f'<main><p>{LONG}</p><ul><li><a href="a">One</a></li><li><a href="b">Two</a></li></ul></main>', None),
        (f'<main><p>{LONG}</p><div class="comments-area"><p>{LONG}</p></div><div class="share-buttons">Share it</div></main>', None),
    ],
)
def test_names_of_parts_of_the_article_drop_nothing(page, want):
    from tidemark.llm import htmltext

    assert htmltext.main_text(page).split("\n\n") == [LONG.strip(), *([want] if want else [])]


def test_teaser_beside_a_body_in_plain_containers():
    from tidemark.llm import htmltext

    page = f"<div><p>{LONG}</p><p>{LONG}</p></div><article><a href='x'>Teaser</a> short teaser text</article>"
    assert htmltext.main_text(page) == "\n\n".join([LONG.strip()] * 2)
