import bisect
import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import vectors as vx
from tidemark.operators import evaluation as ev
from tidemark.operators import labels as lb
from tidemark.operators import ranking as rk
from tidemark.operators import runs as rn
from tidemark.operators import scoring as sc
from tidemark.operators import splits as sp
from tidemark.operators import tables as tb
from tidemark.operators import timeseries as ts
from tidemark.operators import training as tr
from tidemark.session import spread


# --- ranking and splits ---------------------------------------------------------------


def test_bucketed_rank_with_null_groups_and_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), k if k % 17 else None if k == 17 else k) for k in range(-300, 300)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = rk.bucketed_rank(df, ["k"], rk.id_bucket(F.col("k"), 50), ["g"]).collect()
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        mine = sorted((r["k"] for r in got if r["g"] == g), key=lambda k: (k is not None, k))
        ranks = sorted(r["rank"] for r in got if r["g"] == g)
        assert ranks == list(range(1, len(mine) + 1))
        assert [r["k"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == mine


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_split_sizes_and_independence_of_partitioning(spark, n):
    ids = spark.range(n)
    one = {r["id"]: r["split"] for r in sp.train_val_test(ids, 0.7, 0.15, 0.15, 42, "id").collect()}
    two = {r["id"]: r["split"] for r in sp.train_val_test(ids.repartition(7), 0.7, 0.15, 0.15, 42, "id").collect()}
    assert one == two and len(one) == n
    sizes = [sum(v == s for v in one.values()) for s in ("train", "val", "test")]
    first = int(n * 0.7)
    assert sizes[0] == first and sizes[1] == (n - first) // 2


def test_split_proportions_must_sum_to_one(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        sp.train_val_test(spark.range(3), 0.7, 0.2, 0.2, 42, "id")


def test_stratified_partitions(spark):
    df = spark.range(600).select("id", (F.col("id") % 10).cast("int").alias("label"))
    got = sp.stratified_partitions(df, "label", range(10), "id", 200).groupBy("version", "label").count().collect()
    assert len(got) == 30 and {r["count"] for r in got} == {20}
    with pytest.raises(ValueError, match="need"):
        sp.stratified_partitions(df, "label", range(10), "id", 201)


def test_minibatches_cover_every_epoch(spark):
    got = sp.minibatches(spark.range(130), "id", 2, 50, 7).groupBy("epoch", "batch").count().collect()
    assert sorted((r["epoch"], r["batch"], r["count"]) for r in got) == [
        (e, b, c) for e in (0, 1) for b, c in ((0, 50), (1, 50), (2, 30))
    ]


def test_union_versions_repeats_mentions(spark):
    df = spark.createDataFrame([(1, "v1"), (2, "v2"), (3, "v3"), (4, None)], "id int, version string")
    got = lb.union_versions(df, "version", "v1+v2+v1").collect()
    assert sorted((r["id"], r["part"]) for r in got) == [(1, 0), (1, 2), (2, 1)]


def test_partition_counts(spark):
    got = lb.partition_counts(spark.range(0, 100, 1, 4)).collect()
    assert sorted((r["partition"], r["n"]) for r in got) == [(i, 25) for i in range(4)]


def test_column_and_row_guards(spark):
    with pytest.raises(ValueError, match="Text"):
        lb.require_columns(spark.range(1), ["Text"])
    with pytest.raises(ValueError, match="empty"):
        lb.require_rows(spark.range(0))


# --- evaluation -----------------------------------------------------------------------


def test_binary_confusion_golden(spark):
    counts = {("POSITIVE", "POSITIVE"): 242, ("POSITIVE", "NEGATIVE"): 9, ("NEGATIVE", "POSITIVE"): 63, ("NEGATIVE", "NEGATIVE"): 51}
    rows = [pair for pair, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "pred string, truth string")
    r = ev.confusion_binary(df, "truth", "pred").first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (242, 51, 9, 63)
    assert f"{r['precision']:.4f}" == "0.9641" and f"{r['recall']:.4f}" == "0.7934"
    none = ev.confusion_binary(df.limit(0), "truth", "pred").first()
    assert (none["precision"], none["recall"]) == (0.0, 0.0)


# Published counts of a ten-class run, rows are true classes.
MATRIX = [
    [666, 8, 79, 11, 4, 4, 15, 23, 66, 25],
    [20, 725, 10, 9, 1, 4, 7, 2, 27, 73],
    [54, 2, 588, 38, 48, 30, 71, 54, 18, 13],
    [19, 3, 93, 443, 31, 81, 131, 58, 20, 23],
    [22, 1, 137, 37, 505, 16, 83, 88, 5, 3],
    [7, 5, 95, 162, 29, 431, 63, 92, 8, 4],
    [3, 4, 47, 19, 16, 4, 786, 9, 3, 2],
    [6, 3, 53, 28, 33, 19, 18, 747, 3, 7],
    [63, 28, 23, 14, 3, 3, 16, 6, 718, 22],
    [37, 63, 10, 9, 4, 3, 10, 22, 27, 719],
]
CLASS_ACCURACY = [0.7392, 0.8257, 0.6419, 0.4911, 0.5630, 0.4810, 0.8802, 0.8146, 0.8013, 0.7954]


def _matrix_rows(spark):
    cells = [(t, p, n) for t, row in enumerate(MATRIX) for p, n in enumerate(row)]
    return spark.createDataFrame(cells, "truth int, pred int, n int").select("truth", "pred", F.explode(F.array_repeat(F.lit(1), F.col("n"))))


def test_ten_class_golden(spark):
    df = _matrix_rows(spark)
    cells = {(r["truth"], r["pred"]): r["n"] for r in ev.confusion_matrix(df, "truth", "pred", range(10)).collect()}
    assert cells == {(t, p): n for t, row in enumerate(MATRIX) for p, n in enumerate(row)}
    got = {r["truth"]: round(r["accuracy"], 4) for r in ev.class_accuracy(df, "truth", "pred", range(10)).collect()}
    assert got == dict(enumerate(CLASS_ACCURACY))
    assert round(df.agg(ev.accuracy("truth", "pred")).first()[0], 4) == 0.7031


def test_hard_report_counts_the_hard_rows(spark):
    hard = spark.createDataFrame([(0, 2), (0, 2), (2, 1)], "t int, p int")
    got = sorted(tuple(r) for r in ev.hard_report(hard, "t", "p", range(3)).na.fill(-1).collect())
    assert got == [("class", 0, -1, 2), ("class", 1, -1, 0), ("class", 2, -1, 1), ("pair", 0, 2, 2), ("pair", 2, 1, 1), ("total", -1, -1, 3)]
    none = ev.hard_report(hard.limit(0), "t", "p", range(2)).na.fill(-1).collect()
    assert sorted(tuple(r) for r in none) == [("class", 0, -1, 0), ("class", 1, -1, 0), ("total", -1, -1, 0)]


def test_absent_classes_do_not_shift_names(spark):
    df = spark.createDataFrame([(0, 0), (2, 0), (2, 2)], "truth int, pred int")
    got = {r["truth"]: r["accuracy"] for r in ev.class_accuracy(df, "truth", "pred", range(3)).collect()}
    assert got == {0: 1.0, 1: None, 2: 0.5}
    cells = {(r["truth"], r["pred"]): r["n"] for r in ev.confusion_matrix(df, "truth", "pred", range(3)).collect()}
    assert len(cells) == 9 and cells[(2, 0)] == 1 and cells[(1, 1)] == 0
    assert {r["truth"]: r["n"] for r in ev.class_counts(df, "truth", range(3)).collect()} == {0: 1, 1: 0, 2: 2}


def test_failed_batches_are_reported(spark):
    def load():
        def score(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("model failed")
            return ["POSITIVE" if len(t) > 3 else "NEGATIVE" for t in texts]

        return score

    df = spark.createDataFrame([(1, "long text"), (2, None), (3, "boom")], "id int, text string").coalesce(1)
    got = {r["id"]: r for r in sc.score_texts(df, "text", load, batch_size=1).collect()}
    assert got[1]["predicted_sentiment"] == "POSITIVE" and got[1]["error"] is None
    assert got[2]["predicted_sentiment"] == "NEGATIVE"
    assert got[3]["predicted_sentiment"] is None and "model failed" in got[3]["error"]


def test_lexicon_forms_agree(spark):
    texts = ["good good bad", "bad", "", None, "nothing here", "GOOD  \n worst worst"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    scored = sc.score_texts(df, "text", sc.lexicon_scorer())
    both = scored.withColumn("e", tx.lexicon_sentiment("text", sc.DEFAULT_POSITIVE, sc.DEFAULT_NEGATIVE))
    assert all(r["e"] == r["predicted_sentiment"] for r in both.collect())


# --- tables ---------------------------------------------------------------------------


@pytest.mark.parametrize("order", ["id", "url"])
def test_ids_go_on_without_gaps(spark, order):
    new = spark.createDataFrame([(i * 7, f"u{i}") for i in range(50)], "id long, url string")
    stored = spark.createDataFrame([(41,), (9,)], "key long")
    got = sorted(r["key"] for r in tb.append_with_ids(new, stored, "key", order).collect())
    assert got == list(range(42, 92))
    first = tb.append_with_ids(new, stored.limit(0), "key", order)
    assert first.agg(F.min("key")).first()[0] == 1


@pytest.mark.parametrize("keys", [["d", "b", "a", "c"], [9 * 10**17, -(10**18), 5, 10**15], [4.5, -1.0, 0.0, 1e300]])
def test_new_ids_follow_the_order_of_any_key(spark, keys):
    new = spark.createDataFrame([(k,) for k in keys], ["k"])
    stored = spark.createDataFrame([(5,)], "key long")
    got = {r["k"]: r["key"] for r in tb.append_with_ids(new, stored, "key", "k").collect()}
    assert got == {k: 6 + i for i, k in enumerate(sorted(keys))}


def test_spreading_rows_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    spread(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "k")
    assert len(tracker.getJobIdsForGroup()) == before


def test_linked_insert(spark):
    new = spark.createDataFrame([(1, "h", "u", "img1"), (2, "h", "u", "img2"), (3, "x", "y", "img3")], "n long, headline string, article_url string, image string")
    stored = spark.createDataFrame([(5, "x", "y")], "headline_id long, headline string, article_url string")
    parents, children = tb.insert_linked(new, stored, ["headline", "article_url"], "n", "headline_id", ["image"])
    assert [(r["headline_id"], r["n"]) for r in parents.collect()] == [(6, 1)]
    assert [tuple(r) for r in children.collect()] == [(6, "img1")]


def test_marks_and_delivery(spark, tmp_path):
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    assert tb.read_mark(spark, state, "mail") == 0
    rows = spark.range(1, 6).withColumnRenamed("id", "headline_id")
    sent = []
    assert tb.deliver_new(spark, rows, "headline_id", state, "mail", lambda d: sent.append([r[0] for r in d.collect()])) == 5
    more = spark.range(1, 9).withColumnRenamed("id", "headline_id")
    assert tb.deliver_new(spark, more, "headline_id", state, "mail", lambda d: sent.append([r[0] for r in d.collect()])) == 8
    assert tb.deliver_new(spark, more, "headline_id", state, "mail", lambda d: sent.append("again")) == 8
    assert sent == [[1, 2, 3, 4, 5], [6, 7, 8]]
    with pytest.raises(RuntimeError):
        tb.deliver_new(spark, spark.range(20).toDF("headline_id"), "headline_id", state, "mail", lambda d: (_ for _ in ()).throw(RuntimeError()))
    assert tb.read_mark(spark, state, "mail") == 8
    assert tb.write_counted(rows, out) == 5
    assert tb.table_or_empty(spark, str(tmp_path / "none"), tb.ARTICLES).count() == 0
    filled = tb.with_table_schema(spark.createDataFrame([("h", "u")], "headline string, url string"), tb.FEED_ARTICLES).first()
    assert filled["headline"] == "h" and filled["published_at"] is not None and filled["summary"] is None


def test_digest_parts_and_empty_groups(spark):
    rows = [("a", i, f"h{i}", f"u{i}", "2024" if i % 2 else None) for i in range(1, 6)] + [("b", 1, "old", "u", None)]
    df = spark.createDataFrame(rows, "src string, id long, headline string, url string, at string")
    got = {(r["src"], r["part"]): r for r in tb.digest(df, "src", "id", "headline", "url", "at", last_id=1, part_size=3).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0)}
    assert got[("a", 0)]["subject"] == "New Articles Alert: 4 new entries"
    assert got[("a", 0)]["body"] == (
        "New articles have been added!:\n• h2\n URL: u2\n\n• h3\nPublished on\t: 2024\n URL: u3\n\n• h4\n URL: u4\n\n"
    )
    assert got[("a", 1)]["body"] == "• h5\nPublished on\t: 2024\n URL: u5\n\n"
    assert got[("b", 0)]["body"] == "No new top stories!\n"


def test_feed_change_needs_same_order(spark):
    old = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("g", 1, "a"), ("h", 1, "a")], "feed string, pos int, title string")
    new = spark.createDataFrame([("f", 1, "b"), ("f", 2, "a"), ("g", 1, "a"), ("i", 1, "z")], "feed string, pos int, title string")
    got = {r["feed"]: r["changed"] for r in tb.feed_changes(old, new, "feed", "pos", ["title"]).collect()}
    assert got == {"f": True, "g": False, "i": True}


# --- time series ----------------------------------------------------------------------


def _series(seed, n, step):
    rng = random.Random(seed)
    at, total, rows = datetime.datetime(2024, 1, 1), 0.0, []
    for i in range(n):
        at += datetime.timedelta(seconds=rng.choice([step, step, step, step * 20]))
        total = 0.0 if rng.random() < 0.05 else total + rng.randint(0, 9)
        rows.append(("hot" if rng.random() < 0.8 else "cold", i, at, total))
    return rows


def _in_range(rows, name, at, seconds):
    return [r for r in rows if r[0] == name and at - datetime.timedelta(seconds=seconds) <= r[2] <= at]


def _growth(points):
    return sum(b[3] if b[3] < a[3] else b[3] - a[3] for a, b in zip(points, points[1:]))


@pytest.mark.parametrize("extrapolate", [False, True])
def test_counter_rate_against_plain_python(spark, extrapolate):
    rows = _series(3, 250, 11)
    df = spark.createDataFrame(rows, "name string, id int, ts timestamp, total double")
    got = ts.counter_rate(df, ["name"], "ts", "id", "total", 60, extrapolate, blocks=5).collect()
    want = {}
    for name, i, at, _ in rows:
        points = _in_range(rows, name, at, 60)
        if len(points) < 2:
            continue
        grown = _growth(points)
        if extrapolate:
            covered = (points[-1][2] - points[0][2]).total_seconds()
            mean = covered / (len(points) - 1)
            missing = 60 - covered
            stretch = mean / 2 if missing >= mean * 1.1 else missing
            if grown > 0:
                stretch = min(stretch, covered * points[0][3] / grown)
            grown *= (covered + stretch) / covered
        want[i] = grown / 60
    assert {r["id"] for r in got} == set(want)
    for r in got:
        assert r["rate"] == pytest.approx(want[r["id"]])


@pytest.mark.parametrize("blocks, seconds", [(1, 60), (9, 60), (40, 7), (16, 4000)])
def test_dense_series_splits_into_blocks(spark, blocks, seconds):
    """One series of an hour, several samples a second, dealt evenly to as many blocks as asked for."""
    from tidemark.operators.ranking import with_range_bucket

    rng = random.Random(blocks)
    start = datetime.datetime(2024, 1, 1)
    rows, total = [], 0.0
    for i in range(4000):
        total = 0.0 if rng.random() < 0.02 else total + rng.randint(0, 9)
        rows.append(("dense", i, start + datetime.timedelta(seconds=i // 3 + (600 if i > 3000 else 0)), total))
    rows += [(None, 5000 + i, start + datetime.timedelta(seconds=i * 50), float(i % 4)) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, id int, ts timestamp, total double")
    got = {r["id"]: (r["samples"], r["increase"]) for r in ts.counter_rate(df, ["name"], "ts", "id", "total", seconds, blocks=blocks).collect()}
    want = {}
    for name in ("dense", None):
        own = [r for r in rows if r[0] == name]
        grown = [0.0]
        for a, b in zip(own, own[1:]):
            grown.append(grown[-1] + (b[3] if b[3] < a[3] else b[3] - a[3]))
        times = [r[2] for r in own]
        for k, r in enumerate(own):
            first = bisect.bisect_left(times, r[2] - datetime.timedelta(seconds=seconds))
            last = bisect.bisect_right(times, r[2]) - 1
            if last > first:
                want[r[1]] = (last - first + 1, grown[last] - grown[first])
    assert got == want
    sizes = [r["count"] for r in with_range_bucket(df, ["name", "ts"], blocks).groupBy("_range").count().collect()]
    assert len(sizes) >= 0.8 * blocks and max(sizes) < 2.5 * len(rows) / blocks + 6


def test_carry_forward_across_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", None]), i, rng.choice([None, None, None, None, "x", "y"])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, n long, m string")
    got = {r["n"]: r["s"] for r in ts.carry_forward(df, ["g"], "n", "m", "s", block_size=7).collect()}
    last = {}
    for g, n, m in rows:
        last[g] = m if m is not None else last.get(g)
        assert got[n] == last[g]


def test_ratio_drops_unmatched_and_guards_zero(spark):
    a = spark.createDataFrame([(1, 4.0), (2, 1.0), (3, 1.0)], "t int, value double")
    b = spark.createDataFrame([(1, 8.0), (2, 0.0)], "t int, value double")
    assert {r["t"]: r["ratio"] for r in ts.series_ratio(a, b, ["t"]).collect()} == {1: 0.5, 2: None}


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 9.9, 10.0, 39.0, 40.0, 79.9, 80.0)], "p double")
    got = [r[0] for r in df.select(ts.threshold_band("p", ts.PERCENT_BANDS)).collect()]
    assert got == ["green", "green", "dark-blue", "blue", "#EAB839", "orange", "red"]


# --- vectors and training -------------------------------------------------------------


def test_vector_forms(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0, 3.0, 800.0, 0.0],)], "v array<double>")
    r = df.select(
        vx.relu(F.col("v")).alias("relu"),
        vx.argmax(F.col("v")).alias("top"),
        vx.softmax(F.col("v")).alias("soft"),
        vx.planar_to_interleaved(F.col("v"), 3).alias("inter"),
        vx.unnest(vx.nest(F.col("v"), 2, 3)).alias("flat"),
        vx.one_hot(F.lit(2), 4).alias("hot"),
    ).first()
    assert r["relu"] == [1.0, 0.0, 3.0, 3.0, 800.0, 0.0] and r["top"] == 4
    assert sum(r["soft"]) == pytest.approx(1.0)
    assert r["inter"] == [1.0, 3.0, 800.0, -2.0, 3.0, 0.0]
    assert r["flat"] == [1.0, -2.0, 3.0, 3.0, 800.0, 0.0] and r["hot"] == [0, 0, 1, 0]


def _blobs(n=90):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, n)
    x = rng.standard_normal((n, 4)) + np.eye(3, 4)[y] * 4
    return x, y


def _mean_loss(x, y, model):
    return -np.log(tr.activations(x, model)[-1][np.arange(len(y)), y] + tr.EPS).mean()


def test_gradients_match_finite_differences():
    x, y = _blobs(30)
    model = tr.random_model([4, 5, 4, 3], 1, 0.5)
    summed, loss = tr.gradients(x, y, model)
    assert loss / len(y) == pytest.approx(_mean_loss(x, y, model))
    for layer, parts in enumerate(model):
        for part in (0, 1):
            for at in np.ndindex(parts[part].shape):
                ends = []
                for step in (1e-6, -1e-6):
                    moved = [[m.copy(), b.copy()] for m, b in model]
                    moved[layer][part][at] += step
                    ends.append(_mean_loss(x, y, moved))
                assert summed[layer][part][at] / len(y) == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)


def test_training_follows_the_gradient(spark, tmp_path):
    x, y = _blobs()
    df = spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(x, y)], "v array<double>, y int").repartition(5)
    start = tr.random_model([4, 8, 6, 3], 1, 0.3)
    once, _ = tr.train(df, "v", "y", start, 0.2, 1)
    for (m, b), (m0, b0), (gm, gb) in zip(once, start, tr.gradients(x, y, start)[0]):
        assert np.allclose(m, m0 - 0.2 * gm / len(y)) and np.allclose(b, b0 - 0.2 * gb / len(y))
    model, history = tr.train(df, "v", "y", start, 0.2, 6)
    losses = [loss for _, loss in history]
    assert losses[0] == pytest.approx(_mean_loss(x, y, start)) and losses[1] == pytest.approx(_mean_loss(x, y, once))
    assert losses[6] == pytest.approx(_mean_loss(x, y, model)) and losses == sorted(losses, reverse=True)
    tr.save_model(spark, once, str(tmp_path / "model"))
    warm, _ = tr.train(df, "v", "y", tr.load_model(spark, str(tmp_path / "model")), 0.2, 5)
    assert all(np.allclose(m, wm) and np.allclose(b, wb) for (m, b), (wm, wb) in zip(model, warm))
    scored = tr.score(df, "v", warm).collect()
    top = [int(np.argmax(tr.activations(np.array([r["v"]]), warm)[-1])) for r in scored]
    assert [r["pred"] for r in scored] == top


def test_runs_log_parameters_and_validation(spark, tmp_path):
    x, y = _blobs()
    df = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id int, v array<double>, y int")
    names, start = ["a", "bb", "ccc"], tr.random_model([4, 8, 6, 3], 1, 0.3)
    model, rows = tr.train_logged(df.where("id < 60"), df.where("id >= 60"), "v", "y", start, 0.2, 2, names, "r1")
    assert [(r[1], r[2]) for r in rows] == [(k, e) for e in (1, 2) for k in ("train_loss", "val_loss", "avg_edit_distance")]
    last = {key: value for _, key, step, value in rows if step == 2}
    assert last["train_loss"] == pytest.approx(_mean_loss(x[:60], y[:60], model))
    assert last["val_loss"] == pytest.approx(_mean_loss(x[60:], y[60:], model))
    guess = tr.activations(x[60:], model)[-1].argmax(axis=1)
    # Names of one repeated letter each: all characters of the longer one change.
    far = [0 if a == b else max(a, b) + 1 for a, b in zip(y[60:], guess)]
    assert last["avg_edit_distance"] == pytest.approx(np.mean(far))
    params, metrics = str(tmp_path / "params"), str(tmp_path / "metrics")
    rn.log_params(spark, params, [("r1", "rate", "0.2"), ("r2", "rate", "0.1")])
    rn.log_metrics(spark, metrics, rows)
    tables = spark.read.schema(rn.PARAMS).parquet(params), spark.read.schema(rn.METRICS).parquet(metrics)
    got = {r["run_id"]: (r["rate"], r["val_loss"]) for r in rn.run_table(*tables, ["rate"], ["val_loss"]).collect()}
    assert got == {"r1": ("0.2", pytest.approx(last["val_loss"])), "r2": ("0.1", None)}
    with pytest.raises(ValueError, match="rate"):
        rn.run_table(*tables, ["rate"], ["rate"])


def test_local_batches_learn(spark):
    x, y = _blobs()
    df = spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(x, y)], "v array<double>, y int").repartition(2)
    _, history = tr.train(df, "v", "y", tr.random_model([4, 8, 6, 3], 1, 0.3), 0.2, 5, batch_size=8)
    assert history[-1][1] < history[0][1] / 2


def test_grid_search_marks_one_best(spark):
    x, y = _blobs()
    rows = [(i, r.tolist(), int(c), "train" if i % 3 else "val") for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int, split string")
    got = tr.grid_search(df, "v", "y", "split", [0.01, 0.5], [4, 8], 4, 3, 15, scale=0.3).collect()
    best = [r for r in got if r["best"]]
    top = max(r["val_accuracy"] for r in got)
    assert len(got) == 4 and len(best) == 1
    assert best[0]["run_no"] == min(r["run_no"] for r in got if r["val_accuracy"] == top)


def test_best_run_ties_and_all_zero(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.9), ("z", 1, 0.0)], "g string, run int, acc double")
    assert [(r["g"], r["run"]) for r in rn.best_run(df, ["g"], "run", "acc").collect()] == [("a", 2)]


def test_run_metrics(spark, tmp_path):
    path = str(tmp_path / "runs")
    rn.log_metrics(spark, path, [("r1", "loss", s, 1.0 / (s + 1)) for s in range(21)])
    rn.log_metrics(spark, path, [("r1", "acc", 0, 0.5), ("r2", "loss", 3, 7.0)])
    df = spark.read.schema(rn.METRICS).parquet(path)
    got = {r["run_id"]: (r["loss"], r["acc"]) for r in rn.last_metrics(df, "run_id", "key", "step", "value", ["loss", "acc"]).collect()}
    assert got == {"r1": (1.0 / 21, 0.5), "r2": (7.0, None)}
    kept = rn.every_kth_step(df.filter("run_id = 'r1' and key = 'loss'"), "step", 10)
    assert sorted(r["step"] for r in kept.collect()) == [0, 10, 20]
    combos = spark.range(1).select(F.inline(rn.options(rate=[0.1, 0.2], width=[1, 2, 3]))).collect()
    assert len(combos) == 6 and tuple(combos[1]) == (0.1, 2)


def test_best_run_of_text_ids_takes_the_smallest(spark):
    from tidemark.operators import runs

    rows = [("a", "r2", 0.5), ("a", "r10", 0.5), ("a", "r1", 0.1), (None, "x", 0.2), ("b", "y", 0.0)]
    df = spark.createDataFrame(rows, "g string, run_id string, acc double")
    got = {(r["g"], r["run_id"], r["acc"]) for r in runs.best_run(df, ["g"], "run_id", "acc").collect()}
    assert got == {("a", "r10", 0.5), (None, "x", 0.2)}


def test_links_with_schemes_and_hosts_stay(spark):
    from tidemark.functions import text

    links = ["//cdn.x/y.png", "mailto:a@b", "http://h/z", "/a/b", "./c", "d"]
    df = spark.createDataFrame([(x,) for x in links], "href string")
    got = {r[0]: r[1] for r in df.select("href", text.resolve_url("https://n.com", "href")).collect()}
    assert got == {
        "//cdn.x/y.png": "https://cdn.x/y.png",
        "mailto:a@b": "mailto:a@b",
        "http://h/z": "http://h/z",
        "/a/b": "https://n.com/a/b",
        "./c": "https://n.com/c",
        "d": "https://n.com/d",
    }


def test_blank_texts_are_neutral_in_both_scorers(spark):
    from tidemark.functions import text
    from tidemark.operators import scoring

    rows = [("\t\n",), ("",), (" ",), (None,), ("good \t day",)]
    df = spark.createDataFrame(rows, "t string")
    plain = df.select("t", text.lexicon_sentiment("t", scoring.DEFAULT_POSITIVE, scoring.DEFAULT_NEGATIVE).alias("s"))
    assert {r["t"]: r["s"] for r in plain.collect()} == {"\t\n": "NEUTRAL", "": "NEUTRAL", " ": "NEUTRAL", None: "NEUTRAL", "good \t day": "POSITIVE"}
