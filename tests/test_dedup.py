"""Near-duplicate operators against plain sequential Python."""

import datetime
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup as dd
from tidemark.operators import gestalt, greedy, ranking
from tidemark.operators import similarity as sm


def _word_rows(seed, n, vocabulary=40, copies=0.3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < copies:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 2)):
                if base:
                    base[rng.randrange(len(base))] = f"w{rng.randrange(vocabulary)}"
            text = " ".join(base)
        else:
            text = " ".join(f"W{rng.randrange(vocabulary)}" for _ in range(rng.choice([0, 1, 3, 6, 9])))
        rows.append((i, text))
    return rows


def _jaccard(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 0.0


def _sequential_jaccard(rows, stored=()):
    kept, out = [r for r in rows if r[0] in stored], {}
    for i, text in rows:
        if i in stored:
            continue
        hit = next(((k, _jaccard(text, t)) for k, t in kept if _jaccard(text, t) >= 0.75), None)
        out[i] = hit
        if hit is None:
            kept.append((i, text))
    return out


@pytest.mark.parametrize("depth", [2, 200])
def test_jaccard_decisions_match_sequential_rule(spark, depth):
    rows = _word_rows(1, 150)
    df = spark.createDataFrame(rows, "id long, text string")
    got = dd.jaccard_duplicates(df, "id", "text").decisions(depth=depth).collect()
    want = _sequential_jaccard(rows)
    assert len(got) == len(rows)
    for r in got:
        hit = want[r["id"]]
        assert (r["decision"] == "stored") == (hit is None)
        if hit:
            assert r["matched_id"] == hit[0]
            assert r["similarity"] == pytest.approx(hit[1])
            assert f"{hit[1]:.2f}" in r["reason"]


def test_jaccard_against_stored_rows(spark):
    rows = _word_rows(2, 120)
    stored = set(range(40))
    df = spark.createDataFrame([(i, t, i in stored) for i, t in rows], "id long, text string, old boolean")
    got = dd.jaccard_duplicates(df, "id", "text", stored="old").decisions().collect()
    want = _sequential_jaccard(rows, stored)
    assert {r["id"]: r["matched_id"] for r in got} == {i: h and h[0] for i, h in want.items()}


def test_chain_keeps_its_far_end(spark):
    words = [f"t{i}" for i in range(16)]
    a, b, c = words[:12], words[1:13] , words[2:14]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    assert _jaccard(rows[0][1], rows[1][1]) >= 0.75 > _jaccard(rows[0][1], rows[2][1])
    df = spark.createDataFrame(rows, "id long, text string")
    assert {r["id"] for r in dd.jaccard_duplicates(df, "id", "text").kept().collect()} == {1, 3}


def test_crowd_of_near_copies_falls_to_its_first(spark):
    base = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(base + [f"own{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string")
    found = dd.jaccard_duplicates(df, "id", "text")
    assert sm.longest_list(found.lists) == 300
    assert [r["id"] for r in found.kept(depth=10).collect()] == [0]


def _headline_rows(seed, n):
    rng = random.Random(seed)
    letters = "abcde fghij klmno "
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            text = list(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 4)):
                if text:
                    spot = rng.randrange(len(text))
                    text[spot : spot + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters), "XY"])
            text = "".join(text)
        else:
            text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 5, 8, 13, 21, 34, 55, 90])))
        rows.append((i, text, datetime.date(2024, 1, 1 + rng.randrange(3))))
    return rows


def _ratio(new, stored):
    return SequenceMatcher(None, new.lower(), stored.lower()).ratio()


@pytest.mark.parametrize("seed,depth", [(3, 200), (4, 3)])
def test_gestalt_decisions_match_sequential_rule(spark, seed, depth):
    rows = _headline_rows(seed, 160)
    df = spark.createDataFrame(rows, "id long, text string, day date")
    found = dd.gestalt_duplicates(df, "id", "text", "day")
    got = found.decisions(depth=depth, rule_order=[dd.SAME_DAY.name, dd.OTHER_DAY.name]).collect()
    kept, want = [], {}
    for i, text, day in rows:
        same = [(k, _ratio(text, t)) for k, t, d in kept if d == day and _ratio(text, t) >= 0.85]
        other = [(k, _ratio(text, t)) for k, t, d in kept if d != day and _ratio(text, t) >= 0.95]
        want[i] = ("same day", *same[0]) if same else ("different day", *other[0]) if other else None
        if want[i] is None:
            kept.append((i, text, day))
    assert any(w and w[0] == "different day" for w in want.values())
    for r in got:
        hit = want[r["id"]]
        assert (r["rule"], r["matched_id"]) == ((hit[0], hit[1]) if hit else (None, None)), r
        if hit:
            assert r["similarity"] == pytest.approx(hit[2])


@pytest.mark.parametrize("depth", [3, 200])
def test_any_match_is_strict_and_case_sensitive(spark, depth):
    rows = [(i, t) for i, t, _ in _headline_rows(5, 140)] + [(900, "Same Headline Here"), (901, "sAME hEADLINE hERE")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"] for r in dd.gestalt_any_match(df, "id", "text", depth=depth).collect()}
    want = {
        i
        for p, (i, t) in enumerate(rows)
        if any(SequenceMatcher(None, t, s).ratio() > 0.85 for _, s in rows[:p])
    }
    assert got == want


def _syllables(rng, n):
    return "".join(rng.choice(["the ", "an", "er", "in", "on ", "th", "ed", "\u00e9s", "\u5b57", "\U0001f600"]) for _ in range(n))


@pytest.mark.parametrize("depth,blocks", [(48, 5), (1000, 1)])
def test_any_match_of_texts_that_share_their_grams(spark, monkeypatch, depth, blocks):
    """Nearly all texts meet nearly all by their grams: blocks meet once, and a task holds two of them."""
    rng = random.Random(11)
    texts = [_syllables(rng, rng.choice([1, 2, 18, 18, 18, 50])) for _ in range(180)] + ["", "", "x"]
    texts += [t[:k] + "q" + t[k + 1 :] for t in texts[:60] for k in [rng.randrange(max(1, len(t)))]]
    rng.shuffle(texts)
    rows = [(i // 2 * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, "x")], "id long, text string").repartition(3)
    placed, held = greedy.cut_lineage, []
    monkeypatch.setattr(greedy, "with_range_bucket", lambda *a: held.append(a[2]) or ranking.with_range_bucket(*a))
    monkeypatch.setattr(greedy, "cut_lineage", lambda d: held.append(d._jdf.queryExecution().toString()) or placed(d))
    got = {r["id"] for r in dd.gestalt_any_match(df, "id", "text", depth=depth).collect()}
    want = {i for i, t in rows if any(s < i and SequenceMatcher(None, t, u).ratio() > 0.85 for s, u in rows)}
    assert got == want and len(want) > 30
    # One pass for blocks with themselves and one for the others; no pair of texts is a row of a join.
    plans = held[1:]
    assert held[0] == blocks and len(plans) == (1 if blocks == 1 else 2) and not any("Join Inner" in p for p in plans)


def test_crowd_of_near_headlines_takes_few_full_matches(monkeypatch):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(58))
    texts = [base[:k] + x + base[k + 1 :] for k in range(50) for x in "XYZ"] + [_syllables(rng, 20) for _ in range(150)]
    place, rule, calls = np.arange(len(texts)), sm.GestaltRule("any", 0.85, strict=True), []
    monkeypatch.setattr(gestalt, "ratio_if", lambda *row, plain=gestalt.ratio_if: calls.append(row) or plain(*row))
    got = set(gestalt.later_hits(texts, place, place, place, rule))
    assert got >= set(range(1, 150)) and 0 not in got
    assert len(calls) < 2 * len(texts)


def test_bounds_ahead_of_the_ratio_never_fall_short():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            above, row = row, [0]
            for j, d in enumerate(b):
                row.append(above[j] + 1 if c == d else max(above[j + 1], row[j]))
        return row[-1]

    rng = random.Random(8)
    texts = [_syllables(rng, n) for n in (0, 1, 1, 2, 15, 15, 16, 17, 18, 30, 31, 40, 60)] + ["a" * 64, "a" * 65, "a" * 87]
    lengths = np.array([len(t) for t in texts])
    a, b = (x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts))))
    share = gestalt.shortest_partner(0.85)
    bounds = gestalt.CommonLengths(texts, lengths, share).bounds(a, b)
    counts = gestalt.pair_counts(texts, lengths, 256)
    for i, j, bound in zip(a, b, bounds):
        true = plain(texts[i], texts[j])
        assert bound >= true and gestalt.common_length(texts[i], texts[j]) == true
        if min(lengths[i], lengths[j]) >= max(lengths[i], lengths[j]) * share:
            assert bound == true
        grams = [Counter(t[k : k + 2] for k in range(len(t) - 1)) for t in (texts[i], texts[j])]
        assert counts[i] @ counts[j] >= sum((grams[0] & grams[1]).values())


@pytest.mark.parametrize("threshold,q", [(0.85, 3), (0.85, 2), (0.95, 5), (0.95, 2)])
def test_shared_grams_bound_never_exceeds_truth(threshold, q):
    rng = random.Random(q)
    for _ in range(3000):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            spot = rng.randrange(len(b) + 1)
            b[spot : spot + rng.randint(0, 1)] = rng.choice(["", "z", "a"])
        b = "".join(b)
        if _ratio(a, b) < threshold:
            continue
        def grams(t):
            return sorted(t[i : i + q] for i in range(len(t) - q + 1))
        left, right = grams(a), grams(b)
        shared = 0
        for g in set(left):
            shared += min(left.count(g), right.count(g))
        assert shared >= sm.shared_grams_bound(len(a), len(b), q, threshold) - 1e-9
        assert 2 * min(len(a), len(b)) / (len(a) + len(b)) >= threshold


def test_settle_edges_on_random_graph(spark):
    rng = random.Random(9)
    edges = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(200)})
    got = {r["rid"] for r in greedy.settle_edges(spark.createDataFrame(edges, "early long, late long")).collect()}
    dropped = set()
    for v in range(120):
        if any(l == v and e not in dropped for e, l in edges):
            dropped.add(v)
    assert got == dropped


def test_insert_ignore_keeps_first_of_new_keys(spark):
    new = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z")], "id long, key string, v string")
    stored = spark.createDataFrame([("b",)], "key string")
    got = dd.insert_ignore(new, stored, ["key"], "id").collect()
    assert [(r["id"], r["key"], r["v"]) for r in got] == [(1, "a", "y")]


def test_short_texts_follow_the_sequential_rule(spark):
    draw = random.Random(3)
    rows = [(i, "".join(draw.choice("abcd") for _ in range(draw.randint(0, 8))), draw.choice([None, "x", "y"])) for i in range(400)]
    kept = []
    for i, text, day in rows:
        if not any(SequenceMatcher(None, text, t).ratio() >= (0.85 if day == d else 0.95) for _, t, d in kept):
            kept.append((i, text, day))
    df = spark.createDataFrame(rows, "id long, text string, day string")
    got = sorted(r["id"] for r in dd.gestalt_duplicates(df, "id", "text", "day").kept(depth=20).collect())
    assert got == [i for i, _, _ in kept]


def test_item_in_very_many_records(spark):
    order = spark.createDataFrame([(1, 30_000), (2, 3_000_000_000), (3, 1)], "item long, freq long")
    items = spark.createDataFrame([(7, i) for i in (1, 2, 3, 4)], "rid long, item long")
    got = {r["item"]: r["freq"] for r in sm._with_frequency(items, order).collect()}
    assert got == {1: 30_000, 2: 3_000_000_000, 3: 1, 4: 0}


def test_sketches_differ_in_no_more_bits_than_sets_in_words(spark):
    draw = random.Random(11)
    rows = [(i, sorted({f"w{draw.randrange(500)}" for _ in range(draw.choice([0, 1, 6, 400, 9000]))})) for i in range(40)]
    sketch = sm.parity_sketch("tokens").alias("sketch")
    found = spark.createDataFrame(rows, "rid long, tokens array<string>").select("tokens", sketch).collect()
    for a in found:
        for b in found:
            bits = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a["sketch"], b["sketch"]))
            words = len(set(a["tokens"]) ^ set(b["tokens"]))
            assert words >= bits >= words / 2


@pytest.mark.parametrize("kind", ["jaccard", "gestalt"])
def test_similarity_joins_broadcast_no_lists_or_records(spark, kind):
    df = spark.createDataFrame([(i, f"some headline number {i % 7}", "x") for i in range(40)], "id long, text string, day string")
    found = dd.jaccard_duplicates(df, "id", "text") if kind == "jaccard" else dd.gestalt_duplicates(df, "id", "text", "day")
    edges = found.verify(sm.pairs_between(found.lists, found.lists, found.bounds).unionByName(sm.pairs_within(found.lists, found.bounds)))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_one_shared_rare_word_makes_no_candidate(spark):
    """Records that meet in a list, but not as often as records that match."""
    draw = random.Random(5)
    rows = [(i, " ".join([f"rare{i // 2}", *(f"w{draw.randrange(400)}" for _ in range(40))])) for i in range(80)]
    rows += [(100 + i, rows[i][1].replace(f"rare{i // 2}", "other")) for i in range(0, 80, 9)]
    found = dd.jaccard_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    pairs = {(r["early"], r["late"]) for r in sm.pairs_within(found.lists, found.bounds).collect()}
    alike = {(a, b) for a, t in rows for b, u in rows if a < b and _jaccard(t, u) >= 0.75}
    assert alike <= pairs and len(pairs) < len(alike) + 10 < 40


@pytest.mark.parametrize("cells", [1, 4, 22])
def test_any_order_of_words_finds_all_pairs(spark, monkeypatch, cells):
    """Whatever share a cell of the count: words with one place in the order share a list."""
    monkeypatch.setattr(sm, "_CELL_BITS", cells)
    rows = _word_rows(7, 300, vocabulary=24) + [(900, None), (901, " ")]
    df = spark.createDataFrame(rows, "id long, text string")
    found = dd.jaccard_duplicates(df, "id", "text")
    edges = found.verify(sm.pairs_within(found.lists, found.bounds)).collect()
    texts = {r["rid"]: r["words"] for r in found.records.collect()}
    want = {(a, b): _jaccard(t, u) for a, t in texts.items() for b, u in texts.items() if a < b and _jaccard(t, u) >= 0.75}
    assert {(r["early"], r["late"]): r["similarity"] for r in edges} == pytest.approx(want) and len(want) > 5


def test_crowds_take_few_comparisons(spark):
    """Three crowds in long lists beside records that are not alike: a crowd meets its first, not itself."""
    draw = random.Random(2)
    bases = [[f"b{k}x{i}" for i in range(40)] for k in range(3)]
    rows = [(i, " ".join([*bases[i % 3], f"own{i}"])) for i in range(180)]
    rows += [(200 + i, " ".join(f"w{draw.randrange(60)}" for _ in range(12))) for i in range(60)]
    found = dd.jaccard_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    plain, met = found.verify, []
    found.verify = lambda pairs, **how: met.append(pairs.count()) or plain(pairs, **how)
    kept = {r["id"] for r in found.kept(depth=20).collect()}
    assert kept == {i for i, hit in _sequential_jaccard(rows).items() if hit is None}
    assert sum(met) < 1500


def test_headlines_meet_in_blocks(spark, monkeypatch):
    """Texts that share nearly all grams, copies that arrive after other kept rows, no days: blocks, no lists."""
    draw = random.Random(13)
    texts = [_syllables(draw, draw.choice([0, 1, 2, 18, 18, 18, 40])) for _ in range(120)]
    texts += [t[:k] + "q" + t[k + 1 :] for t in texts[:70] for k in [draw.randrange(max(1, len(t)))]]
    draw.shuffle(texts)
    rows = [(i * 2, t, draw.choice([None, "x", "y"])) for i, t in enumerate([*texts, *texts[:30]])]
    monkeypatch.setattr(sm, "gestalt_lists", lambda *a: pytest.fail("lists of grams"))
    found = dd.gestalt_duplicates(spark.createDataFrame(rows, "id long, text string, day string"), "id", "text", "day")
    kept, want = [], set()
    for i, text, day in rows:
        near = [(k, _ratio(text, t), day == d) for k, t, d in kept]
        hits = {(k, i, "same day" if same else "different day", round(r, 6)) for k, r, same in near if r >= (0.85 if same else 0.95)}
        # A copy of a kept row is reported with that row only, as with lists.
        twin = [k for k, t, d in kept if (t.lower(), d) == (text.lower(), day)]
        want |= {h for h in hits if not twin or h[0] == twin[0]}
        if not hits:
            kept.append((i, text, day))
    got = [(r["kept_id"], r["id"], r["rule"], round(r["similarity"], 6)) for r in found.matches(depth=2).collect()]
    assert sorted(got) == sorted(want) and len({h[2] for h in want}) == 2


def test_crowd_of_headlines_is_not_compared_with_itself(monkeypatch):
    draw = random.Random(4)
    base = "".join(draw.choice("abcdefgh ") for _ in range(58))
    texts = [base[:k] + x + base[k + 1 :] for k in range(50) for x in "XYZUVW"] + [_syllables(draw, 20) for _ in range(100)]
    rules, calls = [dd.SAME_DAY, dd.OTHER_DAY], []
    monkeypatch.setattr(gestalt, "ratio_if", lambda *row, plain=gestalt.ratio_if: calls.append(row) or plain(*row))
    order, days = np.arange(len(texts)), np.arange(len(texts)) % 2
    got = gestalt.Matcher(texts, days, rules).kept(order)
    kept = []
    for i, t in enumerate(texts):
        if not any(SequenceMatcher(None, t, texts[k]).ratio() >= (0.85 if days[i] == days[k] else 0.95) for k in kept):
            kept.append(i)
    # All with all would be 45,000 in the crowd alone; only the first few meet each other.
    assert got == kept and len(calls) < 6000


def test_repeated_rows(spark):
    """A row that comes twice is matched as often as ever, and a heading that comes twice is found by one that came before."""
    base = [f"t{i}" for i in range(20)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x"])), (2, " ".join([*base, "x"])), (3, "else")]
    found = dd.jaccard_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    # Two rows of record 2 in the join with words and two for their copies, each with each.
    assert Counter((r["kept_id"], r["id"]) for r in found.matches().collect()) == {(1, 2): 8}
    assert {r["id"] for r in found.kept().collect()} == {1, 3}
    heads = [(40, "to oned onerntat that", "a"), (129, "to oned onerntat that", "b"), (129, "to oned onerntat that", "b")]
    df = spark.createDataFrame(heads, "id long, text string, day string")
    got = {(r["id"], r["matched_id"], r["rule"]) for r in dd.gestalt_duplicates(df, "id", "text", "day").decisions().collect()}
    assert got == {(40, None, None), (129, 40, "different day")}
