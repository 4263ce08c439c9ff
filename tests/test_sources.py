import base64
import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.sources import feeds, folders, hostmetrics, pages, payloads, records, sinks


def _record(i, text):
    return f"product/productId: P{i}\nproduct/title: Title: with colon {i}\nreview/score: {i % 5}.0\nreview/text: {text}"


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_records_survive_split_borders(spark, tmp_path, newline):
    blocks = []
    for i in range(240):
        block = _record(i, f"body {i}")
        if i % 7 == 0:
            block += "\nreview/text: second wins  "
        if i % 5 == 0:
            block = "shop/name: ignored\n" + block + "\nnot a field"
        blocks.append(block)
    blocks.insert(10, "shop/name: only an unknown category")
    blocks.insert(20, "product/unknown: known category, unknown key")
    text = "\n\n".join(b + ("\n \t\n" if i % 11 == 0 else "") for i, b in enumerate(blocks)) + "\n\n\n\n"
    path = tmp_path / "reviews.txt"
    path.write_bytes(text.replace("\n", newline).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = records.read_records(spark, str(path))
        if newline == "\n":
            assert rows.rdd.getNumPartitions() > 3
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows.columns == records.REVIEW_COLUMNS
    assert len(got) == 241
    empty = [r for r in got if r["product_productId"] is None]
    assert len(empty) == 1 and all(v is None for v in empty[0])
    by_id = {r["product_productId"]: r for r in got}
    for i in range(240):
        r = by_id[f"P{i}"]
        assert r["product_title"] == f"Title: with colon {i}"
        assert r["review_text"] == ("second wins" if i % 7 == 0 else f"body {i}")
        assert r["review_time"] is None


def test_csv_with_quoted_newline_and_quotes(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text('Id,Score,Text\n1,5,"two\nlines"\n2,,"said ""hi"""\n3,1,\n', encoding="utf-8")
    got = records.read_csv(spark, str(path), records.REVIEW_CSV, multi_line=True).orderBy("Id").collect()
    assert [tuple(r) for r in got] == [(1, 5, "two\nlines"), (2, None, 'said "hi"'), (3, 1, None)]
    labelled = records.read_csv(spark, str(path), records.REVIEW_CSV, multi_line=True).select(
        "Id", tx.threshold_label("Score").alias("s")
    )
    assert [r["s"] for r in labelled.orderBy("Id").collect()] == ["POSITIVE", "NEGATIVE", "NEGATIVE"]


def test_manifest_must_not_be_empty(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("image,label\na.png,3\n")
    (tmp_path / "empty.csv").write_text("image,label\n")
    assert records.read_manifest(spark, str(tmp_path / "ok.csv")).first()["label"] == 3
    with pytest.raises(ValueError, match="empty"):
        records.read_manifest(spark, str(tmp_path / "empty.csv"))


def test_class_folders(spark, tmp_path):
    for version, cls, name in [("v1", "cat", "a.png"), ("v1", "cat", "b.png"), ("v2", "dog", "c.png"), ("v1", "dog", "d.txt"), ("v1", "zebra", "e.png")]:
        folder = tmp_path / version / cls
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x" * len(name))
    with pytest.warns(UserWarning, match="bird"):
        rows = folders.read_class_folders(spark, str(tmp_path), ["bird", "cat", "dog"], with_md5=True)
    got = sorted((r["version"], r["class"], r["label"], r["length"]) for r in rows.collect())
    assert got == [("v1", "cat", 1, 5), ("v1", "cat", 1, 5), ("v2", "dog", 2, 5)]
    with pytest.raises(FileNotFoundError):
        folders.read_class_folders(spark, str(tmp_path), ["bird", "cat"], on_missing="raise")


def test_feed_items_in_order_with_defaults(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        """<rss xmlns:media="http://search.yahoo.com/mrss/"><channel>
<item><title>One</title><link>http://x/1</link><description>d1</description><media:content url="http://i/1"/><media:content url="http://i/1b"/></item>
<item><title>Two</title><link>http://x/2</link></item>
<item><title>Three</title><link>http://x/3</link><media:content url="http://i/3"/></item>
</channel></rss>""",
        encoding="utf-8",
    )
    got = feeds.read_feed(spark, str(tmp_path / "feed.xml")).orderBy("pos").collect()
    assert [(r["pos"], r["title"], r["summary"], r["media_url"]) for r in got] == [
        (1, "One", "d1", "http://i/1"),
        (2, "Two", "", None),
        (3, "Three", "", "http://i/3"),
    ]


PAGE = """<html><body><a href="./section/top.">Top <b>Stories</b></a><a href="/other">TOP stories again</a><a>no href</a>
<article><a href="./read/1.">First headline</a><figure><img src="/img/1.jpg"></figure><time>5 minutes ago</time></article>
<article><a href="http://abs/2">Second headline</a><a href="/later">unused</a><figure><img data-src="http://cdn/2.jpg"></figure><time>Yesterday</time></article>
<article><a href="/3">No figure here</a><time>2 hours ago</time></article>
<article><a href="http://abs/4"> </a><figure><img src="/4.jpg"></figure></article>
<article><a href="http://abs/5">No time</a><figure></figure><figure><img src="/5.jpg"></figure></article>
<article><a href="http://abs/6">Also no time</a><figure><img src="/6.jpg"></figure></article>
</body></html>"""


def test_links_and_articles(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    links = pages.page_links(df)
    assert links.count() == 10
    hits = pages.links_by_text(links, "top stories")
    best = pages.first_and_last_link(hits).collect()
    assert [(r["first_href"], r["last_href"]) for r in best] == [("./section/top.", "/other")]
    now = datetime.datetime(2024, 5, 2, 12)
    got = pages.articles(df, "http://news.test", F.lit(now)).orderBy("pos").collect()
    assert [(r["pos"], r["headline"], r["article_url"], r["thumbnail_url"], r["published_at"]) for r in got] == [
        (1, "First headline", "http://news.test/read/1.", "http://news.test/img/1.jpg", now - datetime.timedelta(minutes=5)),
        (2, "Second headline", "http://abs/2", "http://cdn/2.jpg", now - datetime.timedelta(days=1)),
        (6, "Also no time", "http://abs/6", "http://news.test/6.jpg", now),
    ]
    loose = pages.articles(df, "http://news.test", F.lit(now), require_thumbnail=False, cut_ends=True, compat=True)
    rows = {r["pos"]: r for r in loose.collect()}
    assert set(rows) == {1, 2, 3, 5, 6}
    assert rows[1]["article_url"] == "http://news.test/read/1"
    assert rows[2]["published_at"] == now


def test_relative_time_edge_cases(spark):
    now = datetime.datetime(2024, 5, 2, 12)
    said = ["1 hour ago", "3 days ago", "ten minutes ago", "in a while", "", None, "Yesterday"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, said string")
    got = [r["t"] for r in df.orderBy("i").select(tx.relative_time("said", F.lit(now)).alias("t")).collect()]
    day = datetime.timedelta(days=1)
    assert got == [now - datetime.timedelta(hours=1), now - 3 * day, now, now, now, now, now - day]


def test_relative_time_of_large_counts(spark):
    now = datetime.datetime(2024, 5, 2, 12)
    said = ["24856 days ago", "90000 days ago", "-24856 days ago", "700000 hours ago", "2147483647 minutes ago", "2147483647 days ago"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, said string")
    as_of = F.lit(now).cast("timestamp_ntz")
    got = df.orderBy("i").select(tx.relative_time("said", as_of).alias("t")).select(F.unix_seconds(F.col("t").cast("timestamp")).alias("t"))
    start = int(now.replace(tzinfo=datetime.timezone.utc).timestamp())
    ago = [24856 * 86400, 90000 * 86400, -24856 * 86400, 700000 * 3600, 2147483647 * 60, 0]
    assert [r["t"] for r in got.collect()] == [start - a for a in ago]


def test_base64_of_long_data_has_no_line_breaks(spark):
    data = bytes(range(256)) * 20
    df = spark.createDataFrame([(bytearray(data),), (bytearray(b""),), (None,)], "b binary")
    got = [r["u"] for r in df.select(tx.data_uri("b", "image/png").alias("u")).collect()]
    assert got == ["data:image/png;base64," + base64.b64encode(data).decode(), None, None]


IOSTAT = """Linux 5.10

avg-cpu:  %user   %nice %system %iowait  %steal   %idle
           1.50    0.10    2.50    0.20    0.30   95.40

Device             tps      r/s     w/s     rkB/s    wkB/s  a b c d e f g tps
sda               1.00     2.00    3.00      4.00     5.00  6 7 8 9 10 11 12 13.50
sdb               short
sdc               1.00     0.00    3.00      4.00     5.00  6 7 8 9 10 11 12 13.50"""


def test_io_stats(spark):
    lines = [(h, s, n, text) for h in ("h1", "h2") for s in (1, 2) for n, text in enumerate(IOSTAT.split("\n"))]
    df = spark.createDataFrame(lines, "host string, ts int, line_no int, line string")
    samples = hostmetrics.parse_io_stats(df)
    one = {(r["metric"], r["label"]): r["value"] for r in samples.filter("host = 'h2' and ts = 1").collect()}
    assert one[("cpu_avg_percent", "iowait")] == 0.30 and one[("cpu_avg_percent", "idle")] == 95.40
    assert one[("io_read_rate", "sda")] == 2.0 and one[("io_write_bytes", "sda")] == 5 * 1024
    assert one[("io_tps", "sdc")] == 13.5 and ("io_tps", "sdb") not in one
    assert samples.count() == 4 * (5 + 10)
    assert hostmetrics.devices_seen(samples).count() == 4
    rates = hostmetrics.read_write_gauges(samples).filter("host = 'h1' and ts = 2 and label = 'sdc'")
    assert {r["metric"]: r["value"] for r in rates.collect()} == {"io_read_rate": 0.0, "io_write_rate": 3.0}


def test_memory_lines(spark):
    text = ["MemTotal:       100 kB", "Active(anon):   5 kB", "HugePages_Total:   7", "", "junk"]
    df = spark.createDataFrame([("h", 1, i, t) for i, t in enumerate(text)], "host string, ts int, line_no int, line string")
    got = {r["metric"]: r["value"] for r in hostmetrics.parse_memory(df).collect()}
    assert got == {"meminfo_memtotal": 102400.0, "meminfo_hugepages_total": 7168.0}
    assert {r["value"] for r in hostmetrics.parse_memory(df, scale_unitless=False).collect()} == {102400.0, 7.0}


def test_payload_forms(spark):
    df = spark.createDataFrame([('{"image": [1, 2.5]}',), ('{"inputs": [[[[1],[2]],[[3],[4]]]]}',), ("nonsense",)], "payload string")
    got = [r["features"] for r in payloads.read_payload(df).collect()]
    assert got == [[1.0, 2.5], [1.0, 2.0, 3.0, 4.0], None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "ä\n\"x\""), (2, "val", None)], "id long, split string, text string")
    sinks.write_report_csv(df, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*.csv"))) == 1
    back = records.read_csv(spark, str(tmp_path / "one"), "id long, split string, text string", multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_report_csv(df.repartition(2), str(tmp_path / "many"), one_file=False)
    assert len(list((tmp_path / "many").glob("part-*.csv"))) == 2
    sinks.write_splits_csv(df, str(tmp_path / "splits"))
    assert {p.name for p in (tmp_path / "splits").iterdir() if p.is_dir()} == {"split=train", "split=val"}
    sinks.write_json(df, str(tmp_path / "json"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "json").glob("part-*"))
    assert "ä" in text and '"text":null' in text
    sinks.write_parquet(df, str(tmp_path / "pq"))
    sinks.write_parquet(df, str(tmp_path / "pq"), ["split"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def _split_small(spark, size):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    return old


@pytest.mark.parametrize("size", [37, 64, 150, 1 << 20])
def test_records_of_mixed_line_ends_split_by_bytes(spark, tmp_path, size):
    import random

    rng = random.Random(size)
    want, number = [], 0
    for name, ends in (("a", ["\n"]), ("b", ["\r\n"]), ("c", ["\r\n", "\n"]), ("d", ["\r"])):
        text = ""
        for _ in range(40):
            number += 1
            fields = [f"product/productId: p{number}"] + [f"review/text: {'x' * rng.randrange(60)}é{i}" for i in range(rng.randrange(3))]
            text += "".join(f + rng.choice(ends) for f in fields) + "".join(rng.choice(["", "  "]) + rng.choice(ends) for _ in range(rng.randrange(1, 4)))
            want.append((f"p{number}", fields[-1].removeprefix("review/text: ") if len(fields) > 1 else None))
        (tmp_path / f"{name}.txt").write_bytes(text.rstrip().encode() if name == "c" else text.encode())
    old = _split_small(spark, size)
    try:
        df = records.read_records(spark, str(tmp_path))
        got = sorted((r["product_productId"], r["review_text"]) for r in df.collect())
        from tidemark.sources.lines import split_lines

        tasks = split_lines(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted(want)
    assert size > 1000 or tasks > 20


@pytest.mark.parametrize("size", [41, 90, 300, 1 << 20])
def test_csv_with_quoted_newlines_split_by_bytes(spark, tmp_path, size):
    import csv
    import random

    rng = random.Random(size)
    for name, end in (("a", "\n"), ("b", "\r\n")):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_NONNUMERIC)
            out.writerow(["Id", "Score", "Text"])
            for i in range(60):
                words = [rng.choice(["a", "\n", '"', ",", "é", "\r\n", " x ", "\n\n"]) for _ in range(rng.randrange(1, 25))]
                out.writerow([i, rng.randrange(5), "t" + "".join(words) + "t"])
    plain = spark.read.schema(records.REVIEW_CSV).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    # The whole-file reader takes the first line end it meets for all, also inside values.
    rows = lambda df: sorted((a, b, (c or "").replace("\r\n", "\n")) for a, b, c in df.collect())
    want = rows(plain)
    old = _split_small(spark, size)
    try:
        got = rows(records.read_csv(spark, str(tmp_path), records.REVIEW_CSV, multi_line=True))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(want) == 120 and got == want
