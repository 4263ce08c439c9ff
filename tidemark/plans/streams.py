"""Registered queries: stream forms, run through what has landed and then read back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidemark.operators import training as tr
from tidemark.plans.dedup import SQL_GREEDY
from tidemark.plans.registry import all_oracles, register, table
from tidemark.plans.timeseries import COUNTER, SQL_SLIDING
from tidemark.plans.vectors import formula_weights
from tidemark.sources import records as rc
from tidemark.streaming import ingest as ing
from tidemark.streaming import marks
from tidemark.streaming import metrics as sx
from tidemark.session import work_path


def table_stream(spark, sf_dir, name):
    """A given table, one file or a folder of files, as a stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet*")


def arrivals(df, key, n):
    """The table cut into ``n`` successive arrivals by key."""
    top = df.agg(F.max(key)).first()[0]
    for i in range(n):
        low, high = top * i // n, top * (i + 1) // n
        after = F.lit(True) if i == 0 else F.col(key) > low
        yield df.filter(after & (F.col(key) <= high))


def run_arrivals(spark, parts, root, schema, handle):
    """Land each arrival and run the stream through it, as a periodic ingest does."""
    landing = os.path.join(root, "landing")
    for part in parts:
        part.write.mode("append").parquet(landing)
        stream = ing.landing_stream(spark, landing, schema, "parquet")
        ing.run_once(stream, handle, os.path.join(root, "checkpoint"))


@register(
    "stream_latest_gauge",
    "SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY event_type, user_id",
)
def stream_latest_gauge(spark, sf_dir):
    root = work_path(spark, "latest")
    keys = ["event_type", "user_id"]
    gauges = sx.latest_gauge(table_stream(spark, sf_dir, "events"), keys, ["ts", "event_id"])
    out = os.path.join(root, "out")
    ing.run_once(gauges, lambda b, n: ing.write_batch(b, out, n), os.path.join(root, "checkpoint"), "update")
    schema = "event_type string, user_id bigint, value double, ts timestamp_ntz"
    return ing.latest_updates(spark, out, schema, keys)


@register("stream_sliding_counts", f"WITH {SQL_SLIDING} SELECT event_type, window_end, samples, increase FROM sliding")
def stream_sliding_counts(spark, sf_dir):
    """Events arrive in three parts, some of them up to two hours late."""
    root = work_path(spark, "sliding")
    out = os.path.join(root, "out")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.expr(COUNTER).cast("double").alias("total"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    arrived = at + F.pmod(F.xxhash64("event_id"), F.lit(7_200_000_000))
    cut = events.withColumn("part", F.least(F.lit(2), F.floor((arrived - low) * 3 / (high - low + 1))))
    for part in range(3):
        cut.where(F.col("part") == part).drop("part").write.mode("append").parquet(os.path.join(root, "landing"))
        stream = ing.landing_stream(spark, os.path.join(root, "landing"), "event_id bigint, ts timestamp_ntz, event_type string, total double", "parquet")
        windows = sx.sliding_increase(stream, ["event_type"], "ts", "event_id", "total", "6 hours", "1 hour", "3 hours")
        ing.run_once(windows, lambda b, n: ing.write_batch(b, out, n), os.path.join(root, "checkpoint"), "update")
    schema = "event_type string, window_end timestamp_ntz, samples bigint, increase double"
    return ing.latest_updates(spark, out, schema, ["event_type", "window_end"])


@register("stream_insert_ignore", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def stream_insert_ignore(spark, sf_dir):
    root = work_path(spark, "ignore")
    stored, schema = os.path.join(root, "stored"), "doc_id bigint, text string"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    run_arrivals(spark, arrivals(docs, "doc_id", 3), root, schema, ing.ignore_known(stored, schema, ["text"], "doc_id"))
    return ing.read_batches(spark, stored, schema).drop("batch_id")


#: DuckDB: which of three arrivals a document comes in, see :func:`arrivals`.
SQL_PART = """t AS (SELECT max(doc_id) AS top FROM documents),
p AS (SELECT d.*, top, CASE WHEN doc_id <= top // 3 THEN 0 WHEN doc_id <= top * 2 // 3 THEN 1 ELSE 2 END AS part FROM documents d, t)"""


@register(
    "stream_run_status",
    f"""WITH {SQL_PART}, f AS (SELECT part, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM p)
SELECT part AS batch_id, count(*) AS received, count(*) FILTER (nth = 1) AS stored, count(*) FILTER (nth > 1) AS skipped FROM f GROUP BY part""",
)
def stream_run_status(spark, sf_dir):
    """Documents arrive in three batches and are stored unless their text is known: what became of each batch."""
    root = work_path(spark, "status")
    stored, status, schema = os.path.join(root, "stored"), os.path.join(root, "status"), "doc_id bigint, text string"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    handle = ing.with_status(ing.ignore_known(stored, schema, ["text"], "doc_id"), stored, status)
    run_arrivals(spark, arrivals(docs, "doc_id", 3), root, schema, handle)
    return ing.read_batches(spark, status, ing.STATUS).select("batch_id", "received", "stored", "skipped")


@register(
    "stream_incremental_since",
    f"""WITH {SQL_PART} SELECT part AS delivery, doc_id, lang, source FROM p WHERE doc_id > top // 10""",
)
def stream_incremental_since(spark, sf_dir):
    """Rows past a mark are delivered, then those of each later append, under one checkpoint."""
    root = work_path(spark, "marks")
    stored, out = os.path.join(root, "stored"), os.path.join(root, "out")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    mark = docs.agg(F.max("doc_id")).first()[0] // 10
    for part in arrivals(docs, "doc_id", 3):
        part.write.mode("append").parquet(stored)
        stream = marks.rows_after(spark, stored, "doc_id bigint, lang string, source string", "doc_id", mark)
        ing.run_once(stream, lambda b, n: ing.write_batch(b, out, n), os.path.join(root, "checkpoint"))
    found = ing.read_batches(spark, out, "doc_id bigint, lang string, source string")
    return found.withColumnRenamed("batch_id", "delivery")


@register(
    "stream_feed_changed",
    """WITH s AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM conversations)
SELECT conv_id, turn, clean AS text FROM s WHERE conv_id IN (SELECT conv_id FROM s WHERE clean <> text)""",
)
def stream_feed_changed(spark, sf_dir):
    """Two snapshots of all conversations arrive; the second passes on only what changed."""
    root = work_path(spark, "feeds")
    out, schema = os.path.join(root, "out"), "conv_id bigint, turn bigint, text string"
    entries = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    cleaned = entries.withColumn("text", F.trim(F.regexp_replace("text", "\\s+", " ")))
    handle = ing.changed_feeds(os.path.join(root, "state"), out, "conv_id", "turn", ["text"])
    run_arrivals(spark, [entries, cleaned], root, schema, handle)
    return ing.read_batches(spark, out, schema).filter("batch_id = 1").drop("batch_id")


@register(
    "stream_feed_captures",
    """WITH s AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM conversations)
SELECT 0 AS taken, conv_id, turn, text FROM s UNION ALL
SELECT 2 AS taken, conv_id, turn, clean AS text FROM s WHERE conv_id IN (SELECT conv_id FROM s WHERE clean <> text)""",
)
def stream_feed_captures(spark, sf_dir):
    """Three snapshots of all conversations arrive at once: the first, the same again, a cleaned one."""
    root = work_path(spark, "captures")
    out, schema = os.path.join(root, "out"), "taken int, conv_id bigint, turn bigint, text string"
    entries = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    cleaned = entries.withColumn("text", F.trim(F.regexp_replace("text", "\\s+", " ")))
    first, again, last = (df.select(F.lit(i).alias("taken"), "*") for i, df in enumerate([entries, entries, cleaned]))
    handle = ing.changed_feeds(os.path.join(root, "state"), out, "conv_id", "turn", ["text"], capture="taken")
    run_arrivals(spark, [first.unionByName(again).unionByName(last)], root, schema, handle)
    return ing.read_batches(spark, out, schema).drop("batch_id")


@register(
    "stream_dedup",
    f"""WITH {SQL_GREEDY} SELECT doc_id AS key, row_number() OVER (ORDER BY doc_id) AS id FROM decided WHERE decision = 'stored'""",
)
def stream_dedup(spark, sf_dir):
    """Documents arrive in three batches and are stored unless they nearly repeat a stored one."""
    root = work_path(spark, "near")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    store = ing.NearDuplicateIngest(spark, os.path.join(root, "tables"), buckets=8)
    run_arrivals(spark, arrivals(docs, "key", 3), root, "key bigint, text string", store)
    return store.stored().select("key", "id")


@register("stream_scores", all_oracles().get("mlp_forward"))
def stream_scores(spark, sf_dir):
    """Vectors scored as they arrive."""
    root = work_path(spark, "scores")
    model, out = tr.to_model(formula_weights(spark)), os.path.join(root, "out")
    scored = tr.score(table_stream(spark, sf_dir, "embeddings"), "embedding", model, probabilities="p")
    slim = scored.select("vec_id", "pred", F.round(F.array_max("p"), 6).alias("top"))
    ing.run_once(slim, lambda b, n: ing.write_batch(b, out, n), os.path.join(root, "checkpoint"))
    return ing.read_batches(spark, out, "vec_id bigint, pred int, top double").drop("batch_id")


@register(
    "parse_records",
    """SELECT doc_id::VARCHAR AS "product_productId", source AS product_title, NULL::VARCHAR AS product_price, NULL::VARCHAR AS "review_userId",
  NULL::VARCHAR AS "review_profileName", NULL::VARCHAR AS review_helpfulness, (n_chars % 5 + 1)::VARCHAR AS review_score, NULL::VARCHAR AS review_time,
  lang AS review_summary, nullif(trim(replace(text, chr(10), ' ')), '') AS review_text FROM documents""",
)
def parse_records(spark, sf_dir):
    """Documents written as record text and parsed again."""
    path = work_path(spark, "records")

    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value)

    block = F.concat_ws(
        "\n",
        line("product/productId", F.col("doc_id").cast("string")),
        line("product/title", F.col("source")),
        line("review/summary", F.lit("replaced by the next")),
        line("review/summary", F.col("lang")),
        line("shop/name", F.lit("ignored")),
        line("review/score", (F.col("n_chars") % 5 + 1).cast("string")),
        F.lit("a line that is no field"),
        line("review/text", F.replace("text", F.lit("\n"), F.lit(" "))),
        F.lit(""),
    )
    table(spark, sf_dir, "documents").select(block.alias("value")).write.text(path)
    return rc.read_records(spark, path)
