import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import training as tr
from tidemark.streaming import ingest as ing
from tidemark.streaming import marks
from tidemark.streaming import metrics as sx


def _land(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def _stories(words):
    return " ".join(words)


BASE = [f"w{i}" for i in range(16)]
BATCHES = [
    [
        {"key": 1, "text": _stories(BASE[:12])},
        {"key": 2, "text": _stories(BASE[:12])},
        {"key": 3, "text": _stories(BASE[1:13])},
        {"key": 4, "text": "something else entirely"},
    ],
    [
        {"key": 5, "text": _stories(BASE[2:14])},
        {"key": 6, "text": "SOMETHING else ENTIRELY"},
        {"key": 7, "text": ""},
        {"key": 8, "text": ""},
    ],
    [{"key": 9, "text": _stories(BASE[2:14] + ["extra"])}, {"key": 10, "text": "new words only"}],
]


def test_near_duplicate_ingest_over_batches(spark, tmp_path):
    landing, root, checkpoint = (str(tmp_path / p) for p in ("landing", "tables", "checkpoint"))
    store = ing.NearDuplicateIngest(spark, root)
    for n, rows in enumerate(BATCHES):
        _land(landing, f"{n}.json", rows)
        stream = ing.landing_stream(spark, landing, "key bigint, text string")
        ing.run_once(stream, store, checkpoint)
    got = sorted((r["key"], r["id"]) for r in store.stored().collect())
    # 3 repeats 1; 5 is unlike 1 though it resembles the dropped 3; 9 repeats 5; empty texts are unlike all.
    assert got == [(1, 1), (4, 2), (5, 3), (7, 4), (8, 5), (10, 6)]
    # The same batch again replaces its own output.
    batch = spark.createDataFrame([(r["key"], r["text"]) for r in BATCHES[2]], "key bigint, text string")
    store(batch, 2)
    assert sorted((r["key"], r["id"]) for r in store.stored().collect()) == got


def test_insert_ignore_stream(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / p) for p in ("landing", "table", "checkpoint"))
    schema = "id bigint, url string"
    for n, rows in enumerate([[(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "c")]]):
        _land(landing, f"{n}.json", [{"id": i, "url": u} for i, u in rows])
        stream = ing.landing_stream(spark, landing, schema)
        ing.run_once(stream, ing.ignore_known(table, schema, ["url"], "id"), checkpoint)
    got = ing.read_batches(spark, table, schema).collect()
    assert sorted((r["id"], r["url"]) for r in got) == [(1, "a"), (3, "b"), (5, "c")]


def test_status_of_batches(spark, tmp_path):
    table, status = str(tmp_path / "table"), str(tmp_path / "status")
    schema = "id bigint, url string"
    handle = ing.with_status(ing.ignore_known(table, schema, ["url"], "id"), table, status)
    batches = [[(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "a")], [(6, "c"), (7, "c")]]
    # Batch 1 is run twice.
    for n in (0, 1, 1, 2):
        handle(spark.createDataFrame(batches[n], schema), n)
    rows = ing.read_batches(spark, status, ing.STATUS).collect()
    assert sorted((r["batch_id"], r["received"], r["stored"], r["skipped"]) for r in rows) == [(0, 3, 2, 1), (1, 2, 0, 2), (2, 2, 1, 1)]
    assert all(r["millis"] >= 0 for r in rows)


def test_rows_past_a_mark_are_delivered_again_after_a_failure_and_never_after_success(spark, tmp_path):
    stored, checkpoint = str(tmp_path / "stored rows"), str(tmp_path / "checkpoint")
    got, broken = [], []

    def append(ids):
        rows = spark.createDataFrame([(i, {"doc_id": i}, f"t{i}") for i in ids], "doc_id bigint, note struct<doc_id: bigint>, title string")
        rows.repartition(2).write.mode("append").parquet(stored)

    def deliver(batch, batch_id):
        ids = sorted((r["doc_id"], r["title"]) for r in batch.collect())
        if broken:
            broken.pop()
            raise RuntimeError("no delivery")
        got.append(ids)

    def run(path=stored):
        ing.run_once(marks.rows_after(spark, path, "title string, doc_id bigint", "doc_id", 3), deliver, checkpoint)

    named = lambda *ids: [(i, f"t{i}") for i in ids]
    append([1, 2, 3, 4, 5, 6])
    run()
    assert got == [named(4, 5, 6)]
    append([7, 8, None])
    broken.append(True)
    with pytest.raises(Exception, match="no delivery"):
        run()
    append([9])
    # What failed is delivered with the same rows, then what came after it; nothing comes twice.
    run(f"file:{stored}")
    run()
    assert got == [named(4, 5, 6), named(7, 8), named(9)]


def test_mark_needs_statistics_and_skips_files_below_it(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for n in range(3):
        pq.write_table(pa.table({"id": [10 * n + 1, 10 * n + 2]}), tmp_path / f"{n}.parquet")
    pq.write_table(pa.table({"id": pa.array([None], pa.int64())}), tmp_path / "none.parquet")
    (tmp_path / "_temporary").mkdir()
    pq.write_table(pa.table({"id": [99]}), tmp_path / "_temporary" / "x.parquet")
    reader = marks.RowsByIdReader(str(tmp_path), "id", 0, ["id"])
    assert reader.latestOffset() == {"id": 22}
    parts = reader.partitions({"id": 2}, {"id": 21})
    assert [p.file.rsplit("/", 1)[1] for p in parts] == ["1.parquet", "2.parquet"]
    assert [i for p in parts for b in reader.read(p) for i in b.column("id").to_pylist()] == [11, 12, 21]
    # A first mark beyond all ids stays.
    assert marks.RowsByIdReader(str(tmp_path), "id", 500, ["id"]).latestOffset() == {"id": 500}
    pq.write_table(pa.table({"id": [50]}), tmp_path / "bare.parquet", write_statistics=False)
    with pytest.raises(ValueError, match="statistics"):
        reader.latestOffset()
    assert marks.RowsByIdReader(str(tmp_path / "absent"), "id", 7, ["id"]).latestOffset() == {"id": 7}


def test_unchanged_feed_is_skipped(spark, tmp_path):
    landing, state, out, checkpoint = (str(tmp_path / p) for p in ("landing", "state", "out", "checkpoint"))
    schema = "feed string, pos int, title string, link string"
    first = [{"feed": "f", "pos": 1, "title": "a", "link": "x"}, {"feed": "f", "pos": 2, "title": "b", "link": "y"}]
    swapped = [{**first[1], "pos": 1}, {**first[0], "pos": 2}]
    for n, rows in enumerate([first, first, swapped, swapped]):
        _land(landing, f"{n}.json", rows)
        stream = ing.landing_stream(spark, landing, schema)
        ing.run_once(stream, ing.changed_feeds(state, out, "feed", "pos", ["title", "link"]), checkpoint)
    got = ing.read_batches(spark, out, schema).groupBy("batch_id").count().collect()
    assert {r["batch_id"]: r["count"] for r in got} == {0: 2, 2: 2}


def test_captures_of_one_batch_are_told_apart(spark, tmp_path):
    handle = ing.changed_feeds(str(tmp_path / "state"), str(tmp_path / "out"), "feed", "pos", ["title"], capture="taken")
    schema = "feed string, taken int, pos int, title string"
    # Feed f: as it was, the same, changed, back again.  Feed g: once, with a missing title.
    first = [("f", 1, 1, "a"), ("f", 2, 1, "a"), ("f", 3, 1, "b"), ("f", 4, 1, "a"), ("g", 1, 1, None)]
    handle(spark.createDataFrame(first, schema), 0)
    handle(spark.createDataFrame([("f", 5, 1, "a"), ("g", 5, 1, None), ("g", 6, 1, "x")], schema), 1)
    got = sorted((r["batch_id"], r["feed"], r["taken"]) for r in ing.read_batches(spark, str(tmp_path / "out"), schema).collect())
    assert got == [(0, "f", 1), (0, "f", 3), (0, "f", 4), (0, "g", 1), (1, "g", 6)]


def test_stored_batches_are_not_replaced_under_a_new_checkpoint(spark, tmp_path):
    table = str(tmp_path / "table")
    handle = ing.ignore_known(table, "id bigint, url string", ["url"], "id")
    for n in (0, 1):
        handle(spark.createDataFrame([(n, f"u{n}")], "id bigint, url string"), n)
    with pytest.raises(RuntimeError, match="old checkpoint"):
        handle(spark.createDataFrame([(7, "u7")], "id bigint, url string"), 0)
    handle(spark.createDataFrame([(1, "u1")], "id bigint, url string"), 1)
    assert ing.read_batches(spark, table, "id bigint, url string").count() == 2


def test_latest_gauge_stream_keeps_newest(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / p) for p in ("landing", "out", "checkpoint"))
    schema = "name string, at bigint, value double"
    for n, rows in enumerate([[("a", 5, 1.0), ("b", 1, 2.0)], [("a", 3, 9.0)], [("a", 7, 4.0)]]):
        _land(landing, f"{n}.json", [dict(zip(("name", "at", "value"), r)) for r in rows])
        stream = sx.latest_gauge(ing.landing_stream(spark, landing, schema), ["name"], ["at"])
        ing.run_once(stream, lambda b, i: ing.write_batch(b, out, i), checkpoint, "update")
    got = ing.latest_updates(spark, out, "name string, value double, at bigint", ["name"]).collect()
    assert {r["name"]: (r["value"], r["at"]) for r in got} == {"a": (4.0, 7), "b": (2.0, 1)}


def _plain_windows(points, window, slide):
    """{window end: (samples, increase)} of (second, order, value) samples."""
    out = {}
    for end in range(slide, max(s for s, _, _ in points) + window + 1, slide):
        inside = [v for s, _, v in sorted(points) if end - window <= s < end]
        if inside:
            out[end] = (len(inside), sum(b if b < a else b - a for a, b in zip(inside, inside[1:])))
    return out


def _run_windows(spark, tmp_path, batches, window, slide, late):
    landing, out, checkpoint = (str(tmp_path / p) for p in ("landing", "out", "checkpoint"))
    start = datetime.datetime(2024, 1, 1)
    for i, points in enumerate(batches):
        _land(landing, f"{i}.json", [{"name": "c", "n": n, "ts": str(start + datetime.timedelta(seconds=s)), "v": v} for s, n, v in points])
        stream = ing.landing_stream(spark, landing, "name string, n int, ts timestamp, v double")
        windows = sx.sliding_increase(stream, ["name"], "ts", "n", "v", f"{window} seconds", f"{slide} seconds", f"{late} seconds")
        ing.run_once(windows, lambda b, i: ing.write_batch(b, out, i), checkpoint, "update")
    rows = ing.latest_updates(spark, out, "name string, window_end timestamp_ntz, samples bigint, increase double", ["name", "window_end"]).collect()
    return {int((r["window_end"] - start).total_seconds()): (r["samples"], r["increase"]) for r in rows}, checkpoint


def test_sliding_increase_stream_equals_plain_windows_in_any_order(spark, tmp_path):
    points = [(s, n, float((s * 7 + n) % 23)) for n, s in enumerate(range(0, 400, 3))]
    # Every sample arrives up to 100 seconds late, in three batches; the last also brings equal times.
    late = sorted(points, key=lambda p: p[0] + p[1] * 37 % 100)
    batches = [late[:50], late[50:90], [*late[90:], (399, 900, 1.0)]]
    got, checkpoint = _run_windows(spark, tmp_path, batches, 60, 20, 120)
    assert got == _plain_windows([p for b in batches for p in b], 60, 20)
    state = spark.read.format("statestore").option("stateVarName", "panes").load(checkpoint)
    open_rows = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    # A row per pane of closed times that an open window reaches; the samples kept are those that the watermark, of the
    # batches before, had not passed.
    passed = 1_000_000 * (max(s for b in batches[:2] for s, _, _ in b) - 120) + 1_704_067_200_000_000
    assert 0 < state.count() <= 60 // 20 + 2
    assert 0 < open_rows.count() < len(points) and open_rows.agg(F.min("list_element.at")).first()[0] >= passed


def test_sliding_increase_folds_at_once_and_deals_a_series_by_time(spark, tmp_path):
    """One batch of a long series: what no later sample can precede is folded in that batch, and many keys share the series."""
    points = [(s, s, float((s * 7) % 23)) for s in range(0, 3000, 5)]
    got, checkpoint = _run_windows(spark, tmp_path, [points], 60, 20, 120)
    assert got == _plain_windows(points, 60, 20)
    state = lambda batch: {
        name: spark.read.format("statestore").option("stateVarName", name).option("batchId", batch).load(checkpoint) for name in ("panes", "open")
    }
    # After the batch itself: every span but the last ones keeps its newest 120 seconds only.
    first = state(0)
    spans = first["open"].select("key").distinct().count()
    assert spans > 10 and first["open"].count() <= spans * (120 // 5 + 1) < len(points) * 0.6
    # Once the watermark moves, the spans that ended go.
    assert state(1)["open"].select("key").distinct().count() <= 3
    assert state(1)["panes"].count() <= 2 * (60 // 20 + 2)


def test_sliding_increase_goes_on_after_a_series_ended(spark, tmp_path):
    batches = [[(0, None, 5.0), (10, 2, 8.0)], [(900, 3, 1.0)], [(1800, 4, 1.0), (1801, 5, 3.0)], [(2700, 6, 1.0)]]
    got, _ = _run_windows(spark, tmp_path, batches, 60, 20, 30)
    assert got[60] == (2, 3.0) and got[920] == (1, 0.0) and got[1820] == (2, 2.0) and got[2720] == (1, 0.0)


@pytest.mark.parametrize("window,slide", [(60, 20), (9, 6), (6, 9), (7, 7)])
def test_spans_hold_every_window_of_a_time(spark, window, slide):
    times = [*range(-100, 400, 3), 239, 240, 241]
    rows = spark.createDataFrame([(t,) for t in times], "at long").select("at", sx.spans_of(F.col("at"), window, slide).alias("s")).collect()
    for at, spans in rows:
        ends = [s + window for s in range((at - window) // slide * slide, at + 1, slide) if s <= at < s + window]
        # A pane is in a window as a whole.
        assert set(spans or []) == {e // (sx.SPAN * window) * sx.SPAN * window for e in ends}


def test_sliding_increase_drops_samples_behind_the_watermark(spark, tmp_path):
    batches = [[(0, 1, 5.0), (10, 2, 8.0), (600, 3, 1.0)], [(12, 4, 9.0), (601, 5, 4.0)]]
    got, _ = _run_windows(spark, tmp_path, batches, 60, 5, 30)
    assert got[60] == (2, 3.0) and got[605] == (2, 3.0)


def test_window_that_is_no_multiple_of_its_slide(spark, tmp_path):
    points = [(s, s, float(s % 11)) for s in range(0, 50, 2)]
    got, _ = _run_windows(spark, tmp_path, [points], 9, 6, 100)
    want = {}
    for start in range(-6, 54, 6):
        inside = [v for s, _, v in points if start <= s < start + 9]
        if inside:
            want[start + 9] = (len(inside), sum(b if b < a else b - a for a, b in zip(inside, inside[1:])))
    assert got == want


def test_arriving_vectors_are_scored(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / p) for p in ("landing", "out", "checkpoint"))
    model = tr.random_model([3, 4, 4, 2], 1, 0.5)
    _land(landing, "0.json", [{"id": i, "image": [float(i), 1.0, -float(i)]} for i in range(5)])
    stream = ing.landing_stream(spark, landing, "id bigint, image array<double>")
    ing.run_once(tr.score(stream, "image", model), lambda b, i: ing.write_batch(b, out, i), checkpoint)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 5
    for r in rows:
        p = tr.activations([r["image"]], model)[-1]
        assert r["pred"] == int(p.argmax())


def test_interval_trigger_starts_and_stops(spark, tmp_path):
    landing = str(tmp_path / "landing")
    _land(landing, "0.json", [{"id": 1}])
    seen = []
    query = ing.start(
        ing.landing_stream(spark, landing, "id bigint"), lambda b, i: seen.append(b.count()), str(tmp_path / "c"), every="1 second"
    )
    query.processAllAvailable()
    query.stop()
    assert seen == [1]


def _greedy_kept(texts, threshold=0.75):
    kept = []
    for key, text in texts:
        words = set(text.lower().split())
        if all(len(words & k) < threshold * len(words | k) or not words | k for _, k in kept):
            kept.append((key, words))
    return [key for key, _ in kept]


def test_ingest_with_a_word_that_turns_common_late(spark, tmp_path):
    """Ten arrivals: results as by comparing all with all, few files, a new item order, stored lists met where they lie."""
    import random

    rng = random.Random(5)
    texts, key = [], 0
    store = ing.NearDuplicateIngest(spark, str(tmp_path / "tables"), buckets=4)
    for n in range(10):
        rows = []
        for _ in range(12):
            key += 1
            words = [f"w{rng.randrange(400)}" for _ in range(10)] + (["late"] if n > 4 else [])
            if rows and rng.random() < 0.3:
                words = rows[-1][1].split()[1:] + ["x"]
            if texts and rng.random() < 0.2:
                words = rng.choice(texts)[1].split()
                words[0] = "y"
            rows.append((key, " ".join(words)))
        texts += rows
        store(spark.createDataFrame(rows, "key bigint, text string"), n)
    kept = _greedy_kept(texts)
    got = sorted((r["id"], r["key"]) for r in store.stored().collect())
    assert got == list(enumerate(kept, 1)) and len(kept) < 0.8 * len(texts)
    version, _ = store.version()
    assert version >= 4
    for table in (store.words(spark), store.lists(spark, version)):
        runs = table.runs()
        assert table.total() > 0 and len(runs) < 10 and table.files() <= 4 * len(runs)
    # A new object, as after a restart, finds the same; the last batch again changes nothing.
    again = ing.NearDuplicateIngest(spark, str(tmp_path / "tables"), buckets=4)
    again(spark.createDataFrame(texts[-12:], "key bigint, text string"), 9)
    assert sorted((r["id"], r["key"]) for r in again.stored().collect()) == got


def _above_scan(plan, name):
    """Names of the operators between the top and the scan of a table, nearest last."""
    above = []
    node = plan

    def walk(node, path):
        if node.nodeName().startswith("Scan") and name in node.nodeName():
            above.append(path)
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), [*path, node.nodeName()])

    walk(node, [])
    return above


def test_stored_runs_are_not_shuffled(spark, tmp_path):
    from tidemark.streaming.runtable import RunTable

    table = RunTable(spark, str(tmp_path / "keys"), "k bigint, v string", ["k"], buckets=4, fan=2)
    for n in range(5):
        table.add(spark.range(n * 10, n * 10 + 10).selectExpr("id AS k", "'a' AS v"), n)
    assert sorted(r["k"] for r in table.rows().collect()) == list(range(50)) and len(table.runs()) <= 3
    assert sorted(r["k"] for r in table.rows(before=3).collect()) == list(range(30)) or table.runs(before=3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        new = spark.range(45, 60).selectExpr("id AS k")
        joined = new.join(table.rows(), "k", "left_anti")
        paths = _above_scan(joined._jdf.queryExecution().executedPlan(), table.name)
        assert paths and all("Exchange" not in p for path in paths for p in path)
        assert sorted(r["k"] for r in joined.collect()) == list(range(50, 60))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_newest_row_of_a_key(spark, tmp_path):
    from tidemark.streaming.runtable import RunTable

    table = RunTable(spark, str(tmp_path / "feeds"), "feed string, print string, batch bigint", ["feed"], buckets=2, fan=2, newest="batch")
    for n in range(6):
        table.add(spark.createDataFrame([(f, f"{f}{n}", n) for f in ("a", "b")[: 1 + n % 2]], table.schema), n)
    assert sorted((r["feed"], r["print"]) for r in table.rows().collect()) == [("a", "a5"), ("b", "b5")]
    assert table.total() < 9


def test_ingest_refuses_lists_of_an_older_form(spark, tmp_path):
    batch = spark.createDataFrame([(1, "some words")], "key bigint, text string")
    (tmp_path / "old" / "words").mkdir(parents=True)
    with pytest.raises(RuntimeError, match="older form"):
        ing.NearDuplicateIngest(spark, str(tmp_path / "old"))(batch, 0)
    store = ing.NearDuplicateIngest(spark, str(tmp_path / "new"), buckets=2)
    store(batch, 0)
    # The order of words is a row for each cell of the count, whatever the words.
    assert store.order(spark, 0).columns == ["cell", "level"] and store.order(spark, 0).count() == 2
