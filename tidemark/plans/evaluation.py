"""Registered queries: labels, confusion counts and class accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import evaluation as ev
from tidemark.operators.ranking import label_by_rank, seeded_key
from tidemark.plans.registry import register, table
from tidemark.session import cut_lineage

CLASSES = list(range(10))
DIGITS = 6

# Common table expressions shared by the check SQL.
SQL_LABELLED = """
labelled AS (
  SELECT d.doc_id,
         CASE WHEN l.quality >= 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS truth,
         CASE WHEN d.n_chars >= 400 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS pred
  FROM documents d JOIN labels l USING (doc_id))"""

SQL_ITEMS = """
items AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
  FROM embeddings)"""

SQL_PREDICTED = (
    SQL_ITEMS
    + """,
centers AS (SELECT label, pos, avg(x) AS c FROM items GROUP BY ALL),
distances AS (
  SELECT i.vec_id, i.label AS truth, c.label AS pred, sum((i.x - c.c) * (i.x - c.c)) AS d
  FROM items i JOIN centers c USING (pos) GROUP BY ALL),
predicted AS (
  SELECT vec_id, truth, pred FROM distances
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, pred) = 1)"""
)

SQL_CLASSES = "classes AS (SELECT unnest(range(10))::INTEGER AS c)"


def labelled(spark, sf_dir):
    """Documents with a truth label and a length-based stand-in prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(marks, "doc_id").select(
        "doc_id",
        tx.threshold_label("quality", 1).alias("truth"),
        tx.threshold_label("n_chars", 400).alias("pred"),
    )


def predicted(spark, sf_dir):
    """Vectors with their class and the class of the nearest centroid."""
    vectors = table(spark, sf_dir, "embeddings")
    centers = ev.centroid_table(vectors, "embedding", "label")
    scored = ev.score_nearest(vectors, centers, "embedding")
    return scored.select("vec_id", F.col("label").alias("truth"), "pred")


@register(
    "confusion_binary",
    f"""WITH {SQL_LABELLED}, c AS (
  SELECT count(*) FILTER (pred = 'POSITIVE' AND truth = 'POSITIVE') AS tp,
         count(*) FILTER (pred = 'NEGATIVE' AND truth = 'NEGATIVE') AS tn,
         count(*) FILTER (pred = 'POSITIVE' AND truth = 'NEGATIVE') AS fp,
         count(*) FILTER (pred = 'NEGATIVE' AND truth = 'POSITIVE') AS fn
  FROM labelled)
SELECT tp, tn, fp, fn,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6)::DOUBLE AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6)::DOUBLE AS recall
FROM c""",
)
def confusion_binary(spark, sf_dir):
    out = ev.confusion_binary(labelled(spark, sf_dir), "truth", "pred")
    return out.withColumns({c: F.round(c, DIGITS) for c in ("precision", "recall")})


@register(
    "confusion_pairs", f"WITH {SQL_LABELLED} SELECT pred, truth, count(*) AS n FROM labelled GROUP BY pred, truth"
)
def confusion_pairs(spark, sf_dir):
    return ev.confusion_pairs(labelled(spark, sf_dir), "truth", "pred")


@register(
    "confusion_pivot",
    f"""WITH {SQL_LABELLED}
SELECT pred, count(*) FILTER (truth = 'POSITIVE') AS "truth_POSITIVE",
       count(*) FILTER (truth = 'NEGATIVE') AS "truth_NEGATIVE"
FROM labelled GROUP BY pred""",
)
def confusion_pivot(spark, sf_dir):
    return ev.crosstab(labelled(spark, sf_dir), "pred", "truth", [tx.POSITIVE, tx.NEGATIVE], "truth_")


@register(
    "precision_recall",
    f"""WITH {SQL_PREDICTED}, {SQL_CLASSES}, c AS (
  SELECT c AS class,
         (SELECT count(*) FROM predicted WHERE pred = c AND truth = c) AS tp,
         (SELECT count(*) FROM predicted WHERE pred = c) AS n_pred,
         (SELECT count(*) FROM predicted WHERE truth = c) AS n_true
  FROM classes)
SELECT class, tp, CASE WHEN n_pred > 0 THEN round(tp / n_pred, 6) ELSE 0 END::DOUBLE AS precision,
       CASE WHEN n_true > 0 THEN round(tp / n_true, 6) ELSE 0 END::DOUBLE AS recall
FROM c""",
)
def precision_recall(spark, sf_dir):
    """Per class: every row counts once for its prediction and once for its truth."""
    rows = predicted(spark, sf_dir).withColumn("hit", (F.col("truth") == F.col("pred")).cast("int"))
    sides = F.array(
        F.struct(F.col("pred").alias("class"), F.lit(1).alias("p"), F.lit(0).alias("t"), F.col("hit").alias("tp")),
        F.struct(F.col("truth").alias("class"), F.lit(0).alias("p"), F.lit(1).alias("t"), F.lit(0).alias("tp")),
    )
    sums = (
        rows.select(F.inline(sides)).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("p", "t", "tp")])
    )
    return (
        ev.class_domain(spark, CLASSES, "class")
        .join(sums, "class", "left")
        .na.fill(0)
        .select(
            "class",
            "tp",
            F.round(ev.ratio(F.col("tp"), F.col("p")), DIGITS).alias("precision"),
            F.round(ev.ratio(F.col("tp"), F.col("t")), DIGITS).alias("recall"),
        )
    )


@register(
    "confusion_matrix_k",
    f"""WITH {SQL_PREDICTED}, {SQL_CLASSES}
SELECT t.c AS truth, p.c AS pred, count(predicted.vec_id) AS n
FROM classes t CROSS JOIN classes p
LEFT JOIN predicted ON predicted.truth = t.c AND predicted.pred = p.c GROUP BY ALL""",
)
def confusion_matrix_k(spark, sf_dir):
    return ev.confusion_matrix(predicted(spark, sf_dir), "truth", "pred", CLASSES)


@register(
    "class_accuracy",
    f"""WITH {SQL_PREDICTED}, {SQL_CLASSES}
SELECT c AS truth, count(*) FILTER (pred = c) AS hits, count(vec_id) AS n,
       CASE WHEN count(vec_id) > 0 THEN round(count(*) FILTER (pred = c) / count(vec_id), 6) END AS accuracy
FROM classes LEFT JOIN predicted ON truth = c GROUP BY c""",
)
def class_accuracy(spark, sf_dir):
    out = ev.class_accuracy(predicted(spark, sf_dir), "truth", "pred", CLASSES)
    return out.withColumn("accuracy", F.round("accuracy", DIGITS))


@register(
    "class_distribution",
    f"""WITH {SQL_CLASSES}
SELECT c AS label, count(vec_id) AS n FROM classes LEFT JOIN embeddings ON label = c GROUP BY c""",
)
def class_distribution(spark, sf_dir):
    return ev.class_counts(table(spark, sf_dir, "embeddings"), "label", CLASSES)


@register(
    "crosstab",
    f"""WITH {SQL_PREDICTED}
SELECT truth, {", ".join(f"count(*) FILTER (pred = {c}) AS pred_{c}" for c in CLASSES)}
FROM predicted GROUP BY truth""",
)
def crosstab(spark, sf_dir):
    return ev.crosstab(predicted(spark, sf_dir), "truth", "pred", CLASSES, "pred_")


@register(
    "accuracy",
    f"""WITH {SQL_PREDICTED}
SELECT count(*) AS n, count(*) FILTER (truth = pred) AS hits, round(avg((truth = pred)::INT), 6) AS accuracy
FROM predicted""",
)
def accuracy(spark, sf_dir):
    return predicted(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("truth") == F.col("pred")).alias("hits"),
        F.round(ev.accuracy("truth", "pred"), DIGITS).alias("accuracy"),
    )


@register(
    "avg_edit_distance",
    f"""WITH {SQL_PREDICTED}
SELECT count(*) AS n, round(avg(levenshtein('class ' || truth::VARCHAR, 'class ' || pred::VARCHAR)), 6) AS distance
FROM predicted""",
)
def avg_edit_distance(spark, sf_dir):
    """Mean edit distance between true and predicted label text."""
    names = [F.concat(F.lit("class "), F.col(c).cast("string")) for c in ("truth", "pred")]
    return predicted(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.levenshtein(*names)), DIGITS).alias("distance")
    )


@register("misclassified", f"WITH {SQL_PREDICTED} SELECT vec_id, truth, pred FROM predicted WHERE truth <> pred")
def misclassified(spark, sf_dir):
    return ev.misclassified(predicted(spark, sf_dir))


@register(
    "metrics_json",
    f"""WITH {SQL_PREDICTED}
SELECT k, round(v, 6) AS v FROM (
  SELECT 'overall_accuracy' AS k, avg((truth = pred)::INT) AS v FROM predicted
  UNION ALL SELECT truth::VARCHAR, avg((truth = pred)::INT) FROM predicted GROUP BY truth)""",
)
def metrics_json(spark, sf_dir):
    """The nested metrics record, written as JSON and read back in long form."""
    rows = predicted(spark, sf_dir)
    per_class = ev.class_accuracy(rows, "truth", "pred", CLASSES)
    overall = F.sum("hits") / F.sum("n")
    record = ev.metrics_record(per_class, overall, "truth")
    parsed = record.select(
        F.from_json("metrics", "overall_accuracy double, class_accuracy map<string,double>").alias("m")
    )
    long_form = F.map_concat(
        F.create_map(F.lit("overall_accuracy"), F.col("m.overall_accuracy")), F.col("m.class_accuracy")
    )
    return (
        parsed.select(F.explode(long_form).alias("k", "v"))
        .filter(F.col("v").isNotNull())
        .select("k", F.round("v", DIGITS).alias("v"))
    )


@register(
    "cross_entropy",
    f"""WITH {SQL_PREDICTED}, e AS (SELECT vec_id, truth, pred, exp(-10 * d) AS w FROM distances),
p AS (SELECT vec_id, truth, pred, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM e)
SELECT count(*) AS n, round(avg(-ln(p + 1e-8)), 5) AS loss FROM p WHERE truth = pred""",
)
def cross_entropy(spark, sf_dir):
    """Mean loss of class probabilities softmax(-10 * squared distance to each centroid)."""
    from tidemark.functions import vectors as vx

    vectors = table(spark, sf_dir, "embeddings")
    centers = ev.centroid_table(vectors, "embedding", "label")

    def scores(x):
        return F.transform(x["centers"], lambda c: -10.0 * vx.squared_distance(x["v"], c["center"]))

    both = F.struct(vx.doubles("embedding").alias("v"), F.col("_centers").alias("centers"))
    with_scores = vectors.withColumn("_centers", centers).select("label", vx.bind(both, scores).alias("s"))
    probabilities = with_scores.select("label", vx.softmax(F.col("s")).alias("p"))
    return probabilities.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(vx.cross_entropy(F.col("p"), "label")), 5).alias("loss")
    )


# --- hard examples over three training sets -------------------------------------------

RUNS = [("v1", ["v1"]), ("v1v2", ["v1", "v2"]), ("v1v2v3", ["v1", "v2", "v3"])]

SQL_VERSIONS = """
ranked AS (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id::VARCHAR)) AS rn,
         floor(count(*) OVER (PARTITION BY label) / 3)::BIGINT AS m
  FROM embeddings),
versions AS (
  SELECT vec_id, label, CASE WHEN rn <= m THEN 'v1' WHEN rn <= 2 * m THEN 'v2' WHEN rn <= 3 * m THEN 'v3' END AS version
  FROM ranked)"""


def versioned(spark, sf_dir, seed=42):
    """Three disjoint partitions with a third of every class each; the remainder has no version."""
    third = F.floor(F.col("total") / 3)
    return label_by_rank(
        table(spark, sf_dir, "embeddings"),
        seeded_key(seed, "vec_id"),
        [("v1", third), ("v2", 2 * third), ("v3", 3 * third)],
        rest=None,
        classes=CLASSES,
        class_col="label",
        out="version",
    )


def _sql_run(name, versions):
    inside = ", ".join(f"'{v}'" for v in versions)
    return f"""
c_{name} AS (SELECT i.label, i.pos, avg(i.x) AS c FROM items i JOIN versions v USING (vec_id)
  WHERE v.version IN ({inside}) GROUP BY ALL),
m_{name} AS (
  SELECT vec_id, truth, pred FROM (
    SELECT i.vec_id, i.label AS truth, c.label AS pred, sum((i.x - c.c) * (i.x - c.c)) AS d
    FROM items i JOIN versions v USING (vec_id) JOIN c_{name} c ON c.pos = i.pos
    WHERE v.version = 'v1' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, pred) = 1)"""


SQL_HARD = f"""WITH {SQL_ITEMS}, {SQL_VERSIONS}, {", ".join(_sql_run(n, v) for n, v in RUNS)},
hard AS (
SELECT a.vec_id, a.truth AS truth_v1, a.pred AS pred_v1, b.truth AS truth_v1v2, b.pred AS pred_v1v2,
       c.truth AS truth_v1v2v3, c.pred AS pred_v1v2v3
FROM m_v1 a JOIN m_v1v2 b USING (vec_id) JOIN m_v1v2v3 c USING (vec_id)
WHERE a.truth <> a.pred AND b.truth <> b.pred AND c.truth <> c.pred)"""


@register("hard_examples", f"{SQL_HARD} SELECT * FROM hard")
def hard_examples(spark, sf_dir):
    """Rows of partition v1 that all three centroid models get wrong."""
    data = cut_lineage(versioned(spark, sf_dir).select("vec_id", "label", "embedding", "version"))
    tables = {
        name: ev.centroid_table(data.filter(F.col("version").isin(versions)), "embedding", "label")
        for name, versions in RUNS
    }
    first = data.filter(F.col("version").contains("v1"))
    runs = []
    for name, _ in RUNS:
        scored = ev.score_nearest(first, tables[name], "embedding")
        runs.append((name, ev.misclassified(scored.select("vec_id", F.col("label").alias("truth"), "pred"))))
    return ev.hard_examples(runs, "vec_id")


@register(
    "hard_report",
    f"""{SQL_HARD}, {SQL_CLASSES}
SELECT 'class' AS part, c AS truth, NULL::INTEGER AS pred, count(vec_id) AS n FROM classes LEFT JOIN hard ON truth_v1 = c GROUP BY c
UNION ALL SELECT 'pair', truth_v1, pred_v1, count(*) FROM hard GROUP BY truth_v1, pred_v1
UNION ALL SELECT 'total', NULL, NULL, count(*) FROM hard""",
)
def hard_report(spark, sf_dir):
    """Class distribution, cross table and total of the hard examples."""
    return ev.hard_report(hard_examples(spark, sf_dir), "truth_v1", "pred_v1", CLASSES)
