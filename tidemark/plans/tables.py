"""Registered queries: stored tables, marks, digests, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vectors as vx
from tidemark.operators import labels as lb
from tidemark.operators import tables as tb
from tidemark.operators.dedup import insert_ignore
from tidemark.plans.registry import register, table


@register(
    "append_with_ids",
    """WITH m AS (SELECT max(c_custkey) AS m FROM customer)
SELECT s_suppkey, s_name, m + row_number() OVER (ORDER BY s_suppkey) AS id FROM supplier, m""",
)
def append_with_ids(spark, sf_dir):
    """Suppliers appended to the customer table under ids that go on from its largest."""
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    new = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return tb.append_with_ids(new, stored, "id", "s_suppkey", dense=True)


@register(
    "append_by_text_key",
    """WITH m AS (SELECT max(c_custkey) AS m FROM customer), s AS (SELECT md5(p_partkey::VARCHAR) AS code FROM part)
SELECT code, m + row_number() OVER (ORDER BY code) AS id FROM s, m""",
)
def append_by_text_key(spark, sf_dir):
    """Parts appended in the order of a text key."""
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    new = table(spark, sf_dir, "part").select(F.md5(F.col("p_partkey").cast("string")).alias("code"))
    return tb.append_with_ids(new, stored, "id", "code")


@register(
    "append_by_sparse_key",
    """WITH m AS (SELECT max(c_custkey) AS m FROM customer),
s AS (SELECT p_partkey * 1000000007 * (CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END) AS code FROM part)
SELECT code, m + row_number() OVER (ORDER BY code) AS id FROM s, m""",
)
def append_by_sparse_key(spark, sf_dir):
    """Parts appended in the order of 64-bit ids with wide gaps."""
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    sign = F.when(F.col("p_partkey") % 3 == 0, -1).otherwise(1)
    new = table(spark, sf_dir, "part").select((F.col("p_partkey").cast("long") * 1000000007 * sign).alias("code"))
    return tb.append_with_ids(new, stored, "id", "code")


@register(
    "child_for_survivors",
    """WITH survivors AS (SELECT min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM survivors)""",
)
def child_for_survivors(spark, sf_dir):
    """Lines of the orders that survive a unique key on the customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    survivors = insert_ignore(orders, orders.select("o_custkey").limit(0), ["o_custkey"], "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    return tb.children_of(lines, survivors, "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey")


@register(
    "insert_linked",
    """WITH fresh AS (SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents
  WHERE text NOT IN (SELECT text FROM benchmark) GROUP BY text), m AS (SELECT max(item_id) AS m FROM benchmark)
SELECT m + row_number() OVER (ORDER BY doc_id) AS item_id, doc_id, source AS image_data FROM fresh, m""",
)
def insert_linked(spark, sf_dir):
    """Child rows written for documents that survive insertion into the benchmark table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("image_data"))
    stored = table(spark, sf_dir, "benchmark")
    parents, children = tb.insert_linked(docs, stored, ["text"], "doc_id", "item_id", ["image_data"])
    return children.join(parents.select("item_id", "doc_id"), "item_id")


@register(
    "incremental_since",
    """WITH m AS (SELECT (max(o_orderkey) // 2)::BIGINT AS m FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice, max(o_orderkey) OVER () AS next_mark FROM orders, m WHERE o_orderkey > m""",
)
def incremental_since(spark, sf_dir):
    """Rows past a mark with the mark to save next."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    top = orders.agg(F.max("o_orderkey"))
    mark = orders.agg(F.floor(F.max("o_orderkey") / 2)).scalar()
    return tb.since(orders.withColumn("next_mark", top.scalar()), "o_orderkey", mark)


DAY = "1997-08-23"


@register(
    "articles_of_day",
    f"""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate::DATE = DATE '{DAY}' ORDER BY o_orderdate DESC""",
)
def articles_of_day(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return lb.rows_of_day(rows, "o_orderdate", DAY).orderBy(F.desc("o_orderdate"))


@register(
    "same_day_split",
    f"""SELECT o_orderpriority, count(*) FILTER (o_orderdate::DATE = DATE '{DAY}') AS same_day,
  count(*) FILTER (o_orderdate::DATE <> DATE '{DAY}') AS other_day FROM orders GROUP BY o_orderpriority""",
)
def same_day_split(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority")
        .agg(
            F.count_if(day == F.lit(DAY).cast("date")).alias("same_day"),
            F.count_if(day != F.lit(DAY).cast("date")).alias("other_day"),
        )
    )


@register(
    "row_counts",
    """SELECT 'lineitem' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents""",
)
def row_counts(spark, sf_dir):
    out = None
    for name in ("lineitem", "orders", "events", "documents"):
        part = table(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "digest",
    """WITH m AS (SELECT (max(o_orderkey) // 3)::BIGINT AS m FROM orders),
rows_ AS (SELECT o_orderstatus, o_orderkey, o_orderpriority, CASE WHEN o_totalprice >= 100000 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS pub FROM orders),
fresh AS (SELECT o_orderstatus, o_orderkey, '• Order ' || o_orderkey || chr(10) ||
    CASE WHEN pub IS NULL THEN '' ELSE 'Published on' || chr(9) || ': ' || pub || chr(10) END || ' URL: orders/' || o_orderkey || chr(10) || chr(10) AS entry
  FROM rows_, m WHERE o_orderkey > m),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM fresh)
SELECT o_orderstatus, floor((rn - 1) / 100)::INTEGER AS part, 'New Articles Alert: ' || any_value(n) || ' new entries' AS subject,
  CASE WHEN min(rn) = 1 THEN 'New articles have been added!:' || chr(10) ELSE '' END || string_agg(entry, '' ORDER BY rn) AS body
FROM ranked GROUP BY ALL""",
)
def digest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    mark = orders.agg(F.floor(F.max("o_orderkey") / 3)).scalar()
    key = F.col("o_orderkey").cast("string")
    at = F.when(F.col("o_totalprice") >= 100000, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = orders.select(
        "o_orderstatus",
        "o_orderkey",
        F.concat(F.lit("Order "), key).alias("headline"),
        F.concat(F.lit("orders/"), key).alias("url"),
        at.alias("at"),
    )
    return tb.digest(rows, "o_orderstatus", "o_orderkey", "headline", "url", "at", mark, dense=True)


@register(
    "feed_changed",
    """WITH s AS (SELECT conv_id, turn, role, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM conversations)
SELECT conv_id, count(*) AS n, bool_or(text <> clean) AS changed FROM s GROUP BY conv_id""",
)
def feed_changed(spark, sf_dir):
    """Conversations as feeds; the second snapshot has its white space cleaned."""
    old = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    new = old.withColumn("text", F.trim(F.regexp_replace("text", "\\s+", " ")))
    return tb.feed_changes(old, new, "conv_id", "turn", ["role", "text"])


@register(
    "feed_delta",
    """WITH s AS (SELECT conv_id, turn, role, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM conversations)
SELECT conv_id, turn, clean AS text FROM s WHERE clean <> text""",
)
def feed_delta(spark, sf_dir):
    """Entries of the new snapshot that the old one did not have."""
    old = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return old.withColumn("text", F.trim(F.regexp_replace("text", "\\s+", " "))).exceptAll(old)


def _sql_fingerprint(row):
    lanes = ", ".join(f"sum(('0x' || substr({row}, {1 + 8 * i}, 8))::UBIGINT)::VARCHAR" for i in range(4))
    return f"md5(concat_ws(':', {lanes}))"


@register(
    "dataset_manifest",
    f"""WITH f AS (SELECT source, octet_length(encode(text)) AS size, md5(concat_ws(chr(1), doc_id::VARCHAR, text)) AS h FROM documents)
SELECT source, count(*) AS nfiles, sum(size)::BIGINT AS size, {_sql_fingerprint('h')} AS md5 FROM f GROUP BY source""",
)
def dataset_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return tb.manifest(docs, "source", F.octet_length("text"), "doc_id", "text")


@register(
    "json_vector_roundtrip",
    """SELECT vec_id, len(embedding)::INTEGER AS n, round(list_sum(embedding::DOUBLE[]), 5) AS total, embedding[1]::DOUBLE AS first,
  embedding[64]::DOUBLE AS last FROM embeddings""",
)
def json_vector_roundtrip(spark, sf_dir):
    """Vectors as {"inputs": 1 x 8 x 8 x 1} JSON text and back."""
    from tidemark.sources import payloads as pl

    texts = pl.write_payload(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8, 8)
    back = pl.read_payload(texts.select("vec_id", "payload"))
    return back.select(
        "vec_id",
        F.size("features").alias("n"),
        F.round(vx.vector_sum(F.col("features")), 5).alias("total"),
        F.get("features", 0).alias("first"),
        F.get("features", 63).alias("last"),
    )
