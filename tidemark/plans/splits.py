"""Registered queries: samples, splits, partitions, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import labels as lb
from tidemark.operators import splits as sp
from tidemark.operators.ranking import bucketed_rank, hash_bucket, id_bucket, seeded_key
from tidemark.plans.evaluation import CLASSES, SQL_VERSIONS, versioned
from tidemark.plans.registry import register, table


@register(
    "hash_sample",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE ('0x' || substr(md5(concat_ws(':', '42', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR)), 1, 8))::UBIGINT
      / 4294967296.0::DOUBLE < 0.01""",
)
def hash_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lb.hash_sample(rows, 0.01, 42, "l_orderkey", "l_linenumber", "l_partkey")


@register(
    "train_val_test_split",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR)) AS rn, count(*) OVER () AS n FROM documents),
c AS (SELECT *, floor(n * 0.7::DOUBLE)::BIGINT AS a FROM r),
d AS (SELECT *, a + floor((n - a) * (0.15::DOUBLE / (0.15::DOUBLE + 0.15::DOUBLE)))::BIGINT AS b FROM c)
SELECT doc_id, CASE WHEN rn <= a THEN 'train' WHEN rn <= b THEN 'val' ELSE 'test' END AS split FROM d""",
)
def train_val_test_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sp.train_val_test(docs, 0.7, 0.15, 0.15, 42, "doc_id")


def _sql_subsets():
    parts = []
    for train, val, seed in sp.SUBSET_CONFIGS:
        parts.append(
            f"""SELECT {seed} AS seed, vec_id,
  CASE WHEN rn <= floor(n * {train}::DOUBLE) THEN 'train'
       WHEN rn <= floor(n * {train}::DOUBLE) + ceil(n * {val}::DOUBLE) THEN 'val' ELSE 'unused' END AS split
FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('{seed}:' || vec_id::VARCHAR)) AS rn, count(*) OVER () AS n FROM embeddings)"""
        )
    return " UNION ALL ".join(parts)


@register("subset_split", _sql_subsets())
def subset_split(spark, sf_dir):
    """Three train/validation subsets that leave a remainder, one per seed."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    out = None
    for train, val, seed in sp.SUBSET_CONFIGS:
        part = sp.train_val_subset(ids, train, val, seed, "vec_id").select(F.lit(seed).alias("seed"), "vec_id", "split")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "stratified_partitions",
    f"WITH {SQL_VERSIONS} SELECT vec_id, label, version FROM versions WHERE version IS NOT NULL",
)
def stratified_partitions(spark, sf_dir):
    return versioned(spark, sf_dir).filter(F.col("version").isNotNull()).select("vec_id", "label", "version")


@register(
    "version_union",
    f"""WITH {SQL_VERSIONS}, parts AS (SELECT 0 AS part, 'v1' AS v UNION ALL SELECT 1, 'v2' UNION ALL SELECT 2, 'v1')
SELECT vec_id, label, version, part FROM versions JOIN parts ON version = v""",
)
def version_union(spark, sf_dir):
    return lb.union_versions(versioned(spark, sf_dir).select("vec_id", "label", "version"), "version", "v1+v2+v1")


@register(
    "minibatch_ids",
    """SELECT epoch, vec_id, floor((rn - 1) / 64)::BIGINT AS batch FROM (
  SELECT epoch, vec_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('7:' || epoch::VARCHAR || ':' || vec_id::VARCHAR)) AS rn
  FROM embeddings, (SELECT unnest(range(3))::INTEGER AS epoch))""",
)
def minibatch_ids(spark, sf_dir):
    return sp.minibatches(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 3, 64, 7)


@register(
    "sequence_paths",
    """SELECT vec_id, label, format('images/class_{}/image_{:07d}.png', label, row_number() OVER (ORDER BY vec_id) - 1) AS path
FROM embeddings""",
)
def sequence_paths(spark, sf_dir):
    """Sequential file names in id order, foldered by class."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    numbered = bucketed_rank(rows, ["vec_id"], id_bucket(F.col("vec_id")))
    return numbered.select(
        "vec_id", "label", F.format_string("images/class_%d/image_%07d.png", "label", F.col("rank") - 1).alias("path")
    )


@register(
    "positional_join",
    """WITH l AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
r AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings)
SELECT doc_id, n_chars, vec_id, label FROM l JOIN r USING (i)""",
)
def positional_join(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    right = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return sp.positional_join(left, "doc_id", right, "vec_id")


@register(
    "class_subset",
    """SELECT vec_id, label, label AS block FROM embeddings WHERE label IN (0, 1)""",
)
def class_subset(spark, sf_dir):
    return lb.stack_classes(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", [0, 1])


@register(
    "first_rows",
    "SELECT doc_id, source, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5",
)
def first_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").orderBy("doc_id").limit(5)


@register(
    "permutation",
    "SELECT vec_id, row_number() OVER (ORDER BY md5('5:' || vec_id::VARCHAR)) - 1 AS place FROM embeddings",
)
def permutation(spark, sf_dir):
    """Place of every row in a seeded shuffle."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id").withColumn("_key", seeded_key(5, "vec_id"))
    return bucketed_rank(ids, ["_key"], hash_bucket(F.col("_key"))).select("vec_id", (F.col("rank") - 1).alias("place"))


def _sql_run_matrix():
    runs = ", ".join(f"({i}, '{v}', {s})" for i, (v, s) in enumerate(sp.run_options()))
    return f"""WITH {SQL_VERSIONS}, runs(run_no, spec, seed) AS (VALUES {runs}),
rows_ AS (SELECT run_no, spec, seed, vec_id, label,
    row_number() OVER (PARTITION BY run_no ORDER BY md5(seed::VARCHAR || ':' || vec_id::VARCHAR)) AS rn,
    count(*) OVER (PARTITION BY run_no) AS n
  FROM versions JOIN runs ON list_contains(string_split(spec, '+'), version)),
cut AS (SELECT *, floor(n * 0.7::DOUBLE) AS a FROM rows_),
split AS (SELECT *, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + floor((n - a) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM cut),
items AS (SELECT s.run_no, s.vec_id, s.label, s.split, unnest(e.embedding)::DOUBLE AS x, generate_subscripts(e.embedding, 1) AS pos
  FROM split s JOIN embeddings e USING (vec_id)),
centers AS (SELECT run_no, label, pos, avg(x) AS c FROM items WHERE split = 'train' GROUP BY ALL),
scored AS (
  SELECT i.run_no, i.vec_id, i.label AS truth, c.label AS pred, sum((i.x - c.c) * (i.x - c.c)) AS d
  FROM items i JOIN centers c ON c.run_no = i.run_no AND c.pos = i.pos WHERE i.split = 'test' GROUP BY ALL),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY run_no, vec_id ORDER BY d, pred) = 1),
acc AS (SELECT run_no, avg((truth = pred)::INT) AS acc FROM best GROUP BY run_no)
SELECT run_no, spec, seed, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
       count(*) FILTER (split = 'test') AS n_test, round(any_value(acc), 6) AS test_accuracy
FROM split JOIN acc USING (run_no) GROUP BY run_no, spec, seed"""


@register("run_matrix", _sql_run_matrix())
def run_matrix(spark, sf_dir):
    """Five version unions x three seeds: split, fit centroids, test accuracy, all runs in one plan."""
    return sp.run_matrix(versioned(spark, sf_dir), "vec_id", "embedding", "label", CLASSES)
