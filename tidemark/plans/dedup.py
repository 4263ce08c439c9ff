"""Registered queries: exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dedup as dd
from tidemark.plans.registry import html_pages, register, table, texts
from tidemark.sources import pages as pg

SQL_PAIRS = """
words AS MATERIALIZED (
  SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents),
sized AS MATERIALIZED (SELECT doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
met AS (
  SELECT a.doc_id AS early, b.doc_id AS late, len(list_intersect(a.w, b.w)) AS common, a.n + b.n AS total
  FROM sized a JOIN sized b ON a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.75 * greatest(a.n, b.n)),
near AS MATERIALIZED (SELECT early, late, common / (total - common) AS similarity FROM met WHERE common / (total - common) >= 0.75)"""

# The sequential rule itself: visit matched rows in id order, keep a row unless it matches a kept one.
SQL_GREEDY = (
    SQL_PAIRS
    + """,
visited AS (SELECT late, list(early) AS earlier, row_number() OVER (ORDER BY late) AS i FROM near GROUP BY late),
walk(i, gone) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT v.i, CASE WHEN len(list_filter(v.earlier, lambda e: NOT list_contains(w.gone, e))) > 0
              THEN list_append(w.gone, v.late) ELSE w.gone END
  FROM walk w JOIN visited v ON v.i = w.i + 1),
gone AS (SELECT unnest(arg_max(gone, i)) AS doc_id FROM walk),
hits AS (SELECT late AS doc_id, early, similarity FROM near
  WHERE late IN (SELECT doc_id FROM gone) AND early NOT IN (SELECT doc_id FROM gone)),
decided AS (
  SELECT d.doc_id, d.source, CASE WHEN m.doc_id IS NULL THEN 'stored' ELSE 'skipped' END AS decision,
         m.early AS matched_id, m.similarity
  FROM documents d LEFT JOIN (SELECT doc_id, min(early) AS early, arg_min(similarity, early) AS similarity FROM hits GROUP BY doc_id) m
  USING (doc_id))"""
)
SQL_GREEDY = "RECURSIVE " + SQL_GREEDY.lstrip()


def _documents(spark, sf_dir):
    return dd.jaccard_duplicates(texts(spark, sf_dir, "doc_id", "text"), "doc_id", "text")


@register("exact_dedup", "SELECT min(doc_id) AS doc_id, lang, source, text FROM documents GROUP BY lang, source, text")
def exact_dedup(spark, sf_dir):
    """First of every group of equal records."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return dd.first_per_key(rows, ["lang", "source", "text"], "doc_id")


@register(
    "insert_ignore",
    """SELECT min(doc_id) AS doc_id, text FROM documents
WHERE text NOT IN (SELECT text FROM conversations) GROUP BY text""",
)
def insert_ignore(spark, sf_dir):
    """Documents as new rows against conversations as stored rows, unique by text."""
    new = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dd.insert_ignore(new, table(spark, sf_dir, "conversations"), ["text"], "doc_id")


@register("greedy_dedup", f"WITH {SQL_GREEDY} SELECT doc_id FROM decided WHERE decision = 'stored'")
def greedy_dedup(spark, sf_dir):
    return _documents(spark, sf_dir).kept().withColumnRenamed("id", "doc_id")


@register(
    "jaccard_pairs",
    f"WITH {SQL_GREEDY} SELECT early AS kept_id, doc_id, round(similarity, 6) AS similarity FROM hits",
)
def jaccard_pairs(spark, sf_dir):
    """Every skipped document with the kept documents before it that it matches."""
    hits = _documents(spark, sf_dir).matches()
    return hits.select("kept_id", F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity"))


@register(
    "dedup_decisions",
    f"""WITH {SQL_GREEDY} SELECT doc_id, decision, matched_id, round(similarity, 6) AS similarity,
  CASE WHEN decision = 'stored' THEN 'No duplicate found' ELSE 'Duplicate (jaccard), similarity ' || format('{{:.2f}}', similarity) END AS reason
FROM decided""",
)
def dedup_decisions(spark, sf_dir):
    out = _documents(spark, sf_dir).decisions()
    return out.select(
        F.col("id").alias("doc_id"), "decision", "matched_id", F.round("similarity", 6).alias("similarity"), "reason"
    )


@register(
    "dedup_summary",
    f"WITH {SQL_GREEDY} SELECT source, decision, count(*) AS n FROM decided GROUP BY source, decision",
)
def dedup_summary(spark, sf_dir):
    """Stored and skipped counts per source."""
    docs = table(spark, sf_dir, "documents")
    kept = _documents(spark, sf_dir).kept().select(F.col("id").alias("doc_id"), F.lit(1).alias("k"))
    decided = docs.select("doc_id", "source").join(kept, "doc_id", "left")
    decision = F.when(F.col("k").isNull(), "skipped").otherwise("stored").alias("decision")
    return decided.groupBy("source", decision).agg(F.count(F.lit(1)).alias("n"))


def _headlines(spark, sf_dir):
    """Page headings as headlines, published over a week."""
    blocks = pg.article_blocks(html_pages(spark, sf_dir))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(7)).cast("int"))
    return blocks.select("page_id", F.col("heading").alias("headline"), day.alias("day"))


# The article headings of pages, as in page_articles.
SQL_HEADINGS = """heads AS (SELECT page_id, page_id % 7 AS day, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  trim(regexp_extract(html, '<article><h1>([^<]*)</h1>', 1)),
  '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS heading FROM pages WHERE contains(html, '<article>'))"""


def _sql_ratios(body, least):
    """``ratios`` (early, late, same, similarity) of all pairs that can reach ``least`` by the characters they share.

    A text pair is cut at its longest common block, the first one in the later text and then in the
    earlier, and again on either side of it; similarity is twice the matched characters by all.
    """
    return f"""RECURSIVE {SQL_HEADINGS},
bodies AS MATERIALIZED (SELECT page_id AS id, day, string_split({body}, '') AS chars, length({body}) AS n FROM heads),
spots AS MATERIALIZED (SELECT id, unnest(chars) AS c, generate_subscripts(chars, 1) AS at FROM bodies WHERE n > 0),
bags AS MATERIALIZED (SELECT id, c, count(*) AS k FROM spots GROUP BY id, c),
shared AS (SELECT a.id AS early, b.id AS late, sum(least(a.k, b.k)) AS k FROM bags a JOIN bags b ON a.c = b.c AND a.id < b.id GROUP BY a.id, b.id),
pairs AS MATERIALIZED (SELECT early, late, a.day = b.day AS same, a.n AS na, b.n AS nb FROM shared JOIN bodies a ON a.id = early JOIN bodies b ON b.id = late
  WHERE 2.0::DOUBLE * k / (a.n + b.n) >= {least}),
equal AS (SELECT early, late, b.at AS i, a.at AS j FROM pairs JOIN spots a ON a.id = early JOIN spots b ON b.id = late AND b.c = a.c),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY early, late, i - j ORDER BY i) AS g FROM equal),
runs AS MATERIALIZED (SELECT early, late, min(i) AS i, min(j) AS j, count(*) AS n FROM islands GROUP BY early, late, i - j, g),
cuts(early, late, la, ha, lb, hb, k) AS (
  SELECT early, late, 1::BIGINT, nb::BIGINT + 1, 1::BIGINT, na::BIGINT + 1, 0::BIGINT FROM pairs
  UNION ALL
  SELECT early, late, CASE WHEN side = 0 THEN la ELSE m[2] - m[1] END, CASE WHEN side = 0 THEN m[2] ELSE ha END,
    CASE WHEN side = 0 THEN lb ELSE m[3] - m[1] END, CASE WHEN side = 0 THEN m[3] ELSE hb END, CASE WHEN side = 0 THEN -m[1] ELSE 0 END
  FROM (SELECT early, late, la, ha, lb, hb, min([s - e, s, j + s - i]) AS m FROM (
      SELECT c.*, r.i, r.j, greatest(r.i, c.la, r.i + c.lb - r.j) AS s, least(r.i + r.n, c.ha, r.i + c.hb - r.j) AS e
      FROM cuts c JOIN runs r ON r.early = c.early AND r.late = c.late) WHERE e > s GROUP BY early, late, la, ha, lb, hb)
  CROSS JOIN (VALUES (0), (1)) sides(side)),
matched AS (SELECT early, late, sum(k) AS k FROM cuts GROUP BY early, late),
ratios AS MATERIALIZED (SELECT early, late, same, 2.0::DOUBLE * k / (na + nb) AS similarity FROM matched JOIN pairs USING (early, late)
  UNION ALL SELECT a.id, b.id, a.day = b.day, 1 FROM bodies a JOIN bodies b ON a.id < b.id AND a.n = 0 AND b.n = 0)"""


@register(
    "gestalt_pairs",
    f"""WITH {_sql_ratios("lower(heading)", 0.85)},
near AS MATERIALIZED (SELECT early, late, similarity, CASE WHEN same THEN 'same day' ELSE 'different day' END AS rule FROM ratios WHERE similarity >= CASE WHEN same THEN 0.85 ELSE 0.95 END),
visited AS (SELECT late, list(early) AS earlier, row_number() OVER (ORDER BY late) AS i FROM near GROUP BY late),
walk(i, gone) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT v.i, CASE WHEN len(list_filter(v.earlier, lambda e: NOT list_contains(w.gone, e))) > 0 THEN list_append(w.gone, v.late) ELSE w.gone END
  FROM walk w JOIN visited v ON v.i = w.i + 1),
gone AS (SELECT unnest(arg_max(gone, i)) AS page_id FROM walk),
first AS (SELECT late AS page_id, min((CASE WHEN rule = 'same day' THEN 1 ELSE 2 END, early)) AS m FROM near
  WHERE late IN (SELECT page_id FROM gone) AND early NOT IN (SELECT page_id FROM gone) GROUP BY late),
hits AS (SELECT page_id, n.rule, n.early, n.similarity FROM first JOIN near n ON n.late = page_id AND n.early = m[2])
SELECT page_id, CASE WHEN early IS NULL THEN 'stored' ELSE 'skipped' END AS decision, rule, early AS matched_id, round(similarity, 6) AS similarity,
  CASE WHEN early IS NULL THEN 'No duplicate found' ELSE 'Duplicate (' || rule || '), similarity ' || format('{{:.2f}}', similarity) END AS reason
FROM heads LEFT JOIN hits USING (page_id)""",
)
def gestalt_pairs(spark, sf_dir):
    """Headline decisions: 0.85 within a day, 0.95 across days."""
    found = dd.gestalt_duplicates(_headlines(spark, sf_dir), "page_id", "headline", "day")
    out = found.decisions(rule_order=[dd.SAME_DAY.name, dd.OTHER_DAY.name])
    return out.withColumnRenamed("id", "page_id").withColumn("similarity", F.round("similarity", 6))


@register("gestalt_exists", f"WITH {_sql_ratios('heading', 0.85)} SELECT DISTINCT late AS page_id FROM ratios WHERE similarity > 0.85")
def gestalt_exists(spark, sf_dir):
    """Headlines with any earlier headline above 0.85, case-sensitive."""
    return dd.gestalt_any_match(_headlines(spark, sf_dir), "page_id", "headline").withColumnRenamed("id", "page_id")
