"""Registered queries: text expressions and page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import labels as lb
from tidemark.operators import scoring as sc
from tidemark.plans.registry import html_pages, register, table, texts
from tidemark.sources import pages as pg

SQL_LINKS = """
raw AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
               regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages),
links AS (SELECT page_id, unnest(hrefs) AS href, trim(unnest(texts)) AS text,
                 generate_subscripts(hrefs, 1)::INTEGER AS pos FROM raw)"""


@register("page_links", f"WITH {SQL_LINKS} SELECT page_id, pos, href, text FROM links")
def page_links(spark, sf_dir):
    return pg.page_links(html_pages(spark, sf_dir))


@register("links_by_text", f"WITH {SQL_LINKS} SELECT page_id, pos, href, text FROM links WHERE contains(lower(text), 'the')")
def links_by_text(spark, sf_dir):
    return pg.links_by_text(pg.page_links(html_pages(spark, sf_dir)), "The")


@register(
    "first_last_link",
    f"WITH {SQL_LINKS} SELECT page_id, arg_min(href, pos) AS first_href, arg_max(href, pos) AS last_href FROM links GROUP BY page_id",
)
def first_last_link(spark, sf_dir):
    return pg.first_and_last_link(pg.page_links(html_pages(spark, sf_dir)))


@register(
    "page_articles",
    # HTML reads these references without their semicolon too (some headings are cut inside one).
    """SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  trim(regexp_extract(html, '<article><h1>([^<]*)</h1>', 1)),
  '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS heading FROM pages WHERE contains(html, '<article>')""",
)
def page_articles(spark, sf_dir):
    """Heading of every article block, next to its page's url."""
    return pg.article_blocks(html_pages(spark, sf_dir), keep=["url"]).select("page_id", "url", "heading")


@register(
    "resolve_url",
    f"""WITH {SQL_LINKS}
SELECT page_id, pos, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://news.example.com/' || ltrim(href, '/.') END AS url,
  CASE WHEN starts_with(href, 'http') THEN href
       ELSE 'https://news.example.com' || substr(href, 2, greatest(length(href) - 2, 0)) END AS url_cut
FROM links""",
)
def resolve_url(spark, sf_dir):
    links = pg.page_links(html_pages(spark, sf_dir))
    base = "https://news.example.com"
    return links.select(
        "page_id",
        "pos",
        tx.resolve_url(base, "href").alias("url"),
        tx.resolve_url(base, "href", cut_ends=True).alias("url_cut"),
    )


SQL_WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"


@register(
    "word_sets",
    f"""SELECT doc_id, len({SQL_WORDS})::INTEGER AS n_words, len(list_distinct({SQL_WORDS}))::INTEGER AS n_distinct,
  {SQL_WORDS}[1] AS first_word FROM documents""",
)
def word_sets(spark, sf_dir):
    split = texts(spark, sf_dir, "doc_id", "text").select("doc_id", tx.words("text").alias("w"))
    return split.select(
        "doc_id",
        F.size("w").alias("n_words"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.get("w", 0).alias("first_word"),
    )


@register("truncate_text", "SELECT doc_id, substr(text, 1, 512) AS head, greatest(length(text) - 512, 0)::INTEGER AS cut FROM documents")
def truncate_text(spark, sf_dir):
    """The truncation operator itself: the kept head and the number of characters cut."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.head("text", 512).alias("head"), F.greatest(F.length("text") - 512, F.lit(0)).alias("cut")
    )


@register(
    "data_uri",
    """SELECT doc_id, CASE WHEN octet_length(encode(text)) > 0 THEN 'data:text/plain;base64,' || base64(encode(text)) END AS uri
FROM documents""",
)
def data_uri(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.data_uri(F.col("text").cast("binary"), "text/plain").alias("uri")
    )


SQL_RELATIVE = """
said AS (
  SELECT event_id, CASE event_type
    WHEN 'click' THEN user_id::VARCHAR || ' minutes ago' WHEN 'view' THEN user_id::VARCHAR || ' hours ago'
    WHEN 'signup' THEN user_id::VARCHAR || ' days ago' WHEN 'purchase' THEN 'Yesterday' ELSE 'just now' END AS said
  FROM events)"""


@register(
    "relative_time",
    f"""WITH {SQL_RELATIVE}, n AS (SELECT *, try_cast(split_part(said, ' ', 1) AS INT) AS k, TIMESTAMP '2024-02-01 12:00:00' AS now FROM said)
SELECT event_id, CASE WHEN contains(said, 'Yesterday') THEN now - INTERVAL 1 DAY
    WHEN k IS NULL THEN now WHEN contains(said, 'minute') THEN now - k * INTERVAL 1 MINUTE
    WHEN contains(said, 'hour') THEN now - k * INTERVAL 1 HOUR WHEN contains(said, 'day') THEN now - k * INTERVAL 24 HOUR ELSE now END AS at,
  CASE WHEN k IS NULL THEN now WHEN contains(said, 'minute') THEN now - k * INTERVAL 1 MINUTE
    WHEN contains(said, 'hour') THEN now - k * INTERVAL 1 HOUR WHEN contains(said, 'day') THEN now - k * INTERVAL 24 HOUR ELSE now END AS at_compat
FROM n""",
)
def relative_time(spark, sf_dir):
    """Relative time texts derived from events, resolved against a fixed clock."""
    n = F.col("user_id").cast("string")
    said = (
        F.when(F.col("event_type") == "click", F.concat(n, F.lit(" minutes ago")))
        .when(F.col("event_type") == "view", F.concat(n, F.lit(" hours ago")))
        .when(F.col("event_type") == "signup", F.concat(n, F.lit(" days ago")))
        .when(F.col("event_type") == "purchase", F.lit("Yesterday"))
        .otherwise(F.lit("just now"))
    )
    now = F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").select("event_id", said.alias("said"))
    return rows.select(
        "event_id",
        tx.relative_time("said", now).alias("at"),
        tx.relative_time("said", now, compat=True).alias("at_compat"),
    )


@register(
    "format_times",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS text, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso,
  o_orderdate::DATE AS day, substr(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 1, 10) AS prefix FROM orders""",
)
def format_times(spark, sf_dir):
    t = F.col("o_orderdate")
    text = F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.alias("text"),
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.to_date(t).alias("day"),
        F.substring(text, 1, 10).alias("prefix"),
    )


@register(
    "format_metrics",
    """SELECT event_type, format('{:.4f}', avg(value)) AS mean_text, 'series: ' || event_type AS legend FROM events GROUP BY event_type""",
)
def format_metrics(spark, sf_dir):
    return (
        table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.avg("value").alias("m"))
        .select(
            "event_type",
            F.format_string("%.4f", "m").alias("mean_text"),
            F.format_string("series: %s", "event_type").alias("legend"),
        )
    )


@register(
    "label_threshold",
    "SELECT event_id, CASE WHEN value >= 3 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS upper_label, "
    "CASE WHEN value >= 3 THEN 'positive' ELSE 'negative' END AS lower_label FROM events",
)
def label_threshold(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        tx.threshold_label("value").alias("upper_label"),
        tx.threshold_label("value", yes="positive", no="negative").alias("lower_label"),
    )


@register(
    "label_threshold_cast",
    """SELECT event_id, CASE WHEN try_cast(raw AS FLOAT) >= 3.0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'n/a' WHEN 'view' THEN NULL ELSE value::VARCHAR END AS raw FROM events)""",
)
def label_threshold_cast(spark, sf_dir):
    """Scores held as text, some unreadable or missing."""
    raw = (
        F.when(F.col("event_type") == "error", F.lit("n/a"))
        .when(F.col("event_type") == "view", F.lit(None).cast("string"))
        .otherwise(F.col("value").cast("string"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", tx.threshold_label("raw", from_text=True).alias("label"))


SQL_LEFT = "(SELECT d.doc_id, d.lang, l.quality, CASE WHEN l.quality = 1 THEN d.text END AS body FROM documents d LEFT JOIN labels l USING (doc_id))"


def _partly_labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = docs.join(marks, "doc_id", "left")
    return joined.select("doc_id", "lang", "quality", F.when(F.col("quality") == 1, F.col("text")).alias("body"))


@register("fill_nulls", f"SELECT doc_id, coalesce(body, '') AS body, coalesce(quality, -1) AS quality FROM {SQL_LEFT}")
def fill_nulls(spark, sf_dir):
    rows = _partly_labelled(spark, sf_dir).select("doc_id", "body", "quality")
    return lb.fill_defaults(rows, {"body": "", "quality": -1})


@register(
    "null_profile",
    f"""SELECT count(*) AS n_rows, count(*) FILTER (body IS NULL) AS body_nulls, count(*) FILTER (quality IS NULL) AS quality_nulls,
  count(*) FILTER (lang IS NULL) AS lang_nulls FROM {SQL_LEFT}""",
)
def null_profile(spark, sf_dir):
    return lb.null_profile(_partly_labelled(spark, sf_dir), ["body", "quality", "lang"])


@register("contains_filter", "SELECT doc_id, source FROM documents WHERE contains(source, 'src1')")
def contains_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("source").contains("src1")).select("doc_id", "source")


@register(
    "label_names",
    "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def label_names(spark, sf_dir):
    """Index to name lookup; Spark broadcasts the dimension while its file is small."""
    names = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, sf_dir, "nation").join(names, "n_regionkey").select("n_nationkey", "n_name", "r_name")


# Demonstration word lists that occur in the test texts.
DEMO_POSITIVE = ["the", "that", "with", "der", "que", "le", "for"]
DEMO_NEGATIVE = ["of", "to", "and", "die", "de", "la", "not"]


def _sql_sentiment():
    pos = ", ".join(f"'{w}'" for w in DEMO_POSITIVE)
    neg = ", ".join(f"'{w}'" for w in DEMO_NEGATIVE)
    return f"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 'NEUTRAL'
  WHEN len(list_filter({SQL_WORDS}, lambda w: w IN ({pos}))) >= len(list_filter({SQL_WORDS}, lambda w: w IN ({neg})))
  THEN 'POSITIVE' ELSE 'NEGATIVE' END AS predicted_sentiment FROM documents"""


@register("sentiment_scores", _sql_sentiment())
def sentiment_scores(spark, sf_dir):
    """Lexicon scoring as column expressions."""
    return texts(spark, sf_dir, "doc_id", "text").select(
        "doc_id", tx.lexicon_sentiment("text", DEMO_POSITIVE, DEMO_NEGATIVE).alias("predicted_sentiment")
    )


@register("sentiment_scores_batched", _sql_sentiment())
def sentiment_scores_batched(spark, sf_dir):
    """The same scores through the pluggable batch scorer."""
    docs = texts(spark, sf_dir, "doc_id", "text")
    scored = sc.score_texts(docs, "text", sc.lexicon_scorer(DEMO_POSITIVE, DEMO_NEGATIVE))
    return scored.select("doc_id", "predicted_sentiment")


@register(
    "sentiment_evaluation",
    f"""WITH s AS ({_sql_sentiment()}),
j AS (SELECT predicted_sentiment AS pred, CASE WHEN quality >= 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS truth FROM s JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (pred = 'POSITIVE' AND truth = 'POSITIVE') AS tp, count(*) FILTER (pred = 'NEGATIVE' AND truth = 'NEGATIVE') AS tn,
  count(*) FILTER (pred = 'POSITIVE' AND truth = 'NEGATIVE') AS fp, count(*) FILTER (pred = 'NEGATIVE' AND truth = 'POSITIVE') AS fn FROM j)
SELECT tp, tn, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6)::DOUBLE AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6)::DOUBLE AS recall FROM c""",
)
def sentiment_evaluation(spark, sf_dir):
    """Label, score, count and rate in one plan, nothing collected in between."""
    from tidemark.operators import evaluation as ev

    docs = texts(spark, sf_dir, "doc_id", "text")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(marks, "doc_id").select(
        tx.threshold_label("quality", 1).alias("truth"),
        tx.lexicon_sentiment("text", DEMO_POSITIVE, DEMO_NEGATIVE).alias("pred"),
    )
    out = ev.confusion_binary(rows, "truth", "pred")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})
