"""Repeatable splits, partitions and run matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import doubles
from tidemark.operators.evaluation import score_nearest
from tidemark.session import cut_lineage
from tidemark.operators.ranking import bucketed_rank, hash_bucket, id_bucket, label_by_rank, seeded_key, with_range_bucket

# Train share, validation share and seed of the standard subset runs.
SUBSET_CONFIGS = [(0.7, 0.2, 10), (0.6, 0.3, 100), (0.8, 0.1, 300)]
# Version unions and seeds of the standard experiment matrix.
RUN_VERSIONS = ["v1", "v2", "v3", "v1+v2", "v1+v2+v3"]
RUN_SEEDS = [42, 123, 456]


def train_val_test(df: DataFrame, train: float, val: float, test: float, seed: int, key: str) -> DataFrame:
    """Exact-size split: floor(n * train) rows, then the validation share of the rest."""
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("split proportions must sum to 1")
    n = F.col("total")
    first = F.floor(n * F.lit(float(train)))
    second = first + F.floor((n - first) * F.lit(val / (val + test)))
    return label_by_rank(df, seeded_key(seed, key), [("train", first), ("val", second)], "test")


def train_val_subset(df: DataFrame, train: float, val: float, seed: int, key: str) -> DataFrame:
    """Train and validation sets that may leave rows ``unused``."""
    n = F.col("total")
    first = F.floor(n * F.lit(float(train)))
    second = first + F.ceil(n * F.lit(float(val)))
    return label_by_rank(df, seeded_key(seed, key), [("train", first), ("val", second)], "unused")


def stratified_partitions(
    df: DataFrame, label: str, classes: Sequence[int], key: str, num_samples: int, parts: int = 3, seed: int = 42
) -> DataFrame:
    """``parts`` disjoint partitions of ``num_samples`` rows, the same number from each class."""
    available = df.filter(F.col(label).isin(list(classes))).count()
    if available < parts * num_samples:
        raise ValueError(f"{available} rows available, need {parts * num_samples}")
    per_class = num_samples // len(classes)
    cuts = [(f"v{i}", F.lit(i * per_class)) for i in range(1, parts + 1)]
    out = label_by_rank(
        df, seeded_key(seed, key), cuts, rest=None, classes=classes, class_col=label, out="version"
    )
    return out.filter(F.col("version").isNotNull())


def minibatches(df: DataFrame, key: str, epochs: int, size: int, seed: int) -> DataFrame:
    """Batch number of every row in every epoch's own shuffle."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.withColumn("_key", seeded_key(seed, "epoch", key))
    ranked = bucketed_rank(rows, ["_key"], hash_bucket(F.col("_key")), ["epoch"])
    return ranked.select("epoch", key, F.floor((F.col("rank") - 1) / size).alias("batch"))


def positional_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, dense: bool = False) -> DataFrame:
    """Pair the i-th row of one table with the i-th row of the other, by key order.

    ``dense`` says that both keys are integers without wide gaps, which saves a pass.
    """

    def placed(df: DataFrame, key: str) -> DataFrame:
        if dense:
            return bucketed_rank(df, [key], id_bucket(F.col(key)), out="_place")
        return bucketed_rank(with_range_bucket(df, [key]), [key], F.col("_range"), out="_place").drop("_range")

    return placed(left, left_key).join(placed(right, right_key), "_place").drop("_place")


def run_options(versions: Sequence[str] = RUN_VERSIONS, seeds: Sequence[int] = RUN_SEEDS) -> list[tuple[str, int]]:
    return [(v, s) for v in versions for s in seeds]


def run_matrix(
    versioned: DataFrame,
    key: str,
    vector: str,
    label: str,
    classes: Sequence[int],
    options: Sequence[tuple[str, int]] | None = None,
) -> DataFrame:
    """One split and centroid fit per (version union, seed), all runs in one plan.

    A row is repeated once per run that uses it, so the plan grows with the fixed
    number of runs and there is no join of options with data.
    """
    options = list(options or run_options())
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("run_no"), F.lit(v).alias("spec"), F.lit(s).alias("seed"))
            for i, (v, s) in enumerate(options)
        ]
    )
    used = F.filter(listed, lambda r: F.array_contains(F.split(r["spec"], "\\+"), F.col("version")))
    rows = cut_lineage(versioned.select(key, vector, label, "version")).select(key, vector, label, F.inline(used))
    n = F.col("total")
    first = F.floor(n * F.lit(0.7))
    second = first + F.floor((n - first) * F.lit(0.5))
    split = label_by_rank(
        rows,
        seeded_key(F.col("seed"), key),
        [("train", first), ("val", second)],
        "test",
        classes=range(len(options)),
        class_col="run_no",
    )
    split = cut_lineage(split)
    # Centers of all runs as one array value: runs x classes x dimensions numbers.
    centers = (
        split.filter(F.col("split") == "train")
        .select("run_no", label, F.posexplode(doubles(vector)).alias("pos", "x"))
        .groupBy("run_no", label, "pos")
        .agg(F.avg("x").alias("x"))
        .groupBy("run_no", label)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("items"))
        .groupBy("run_no")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col("items.x").alias("center")))).alias("c"))
        .agg(F.map_from_entries(F.collect_list(F.struct("run_no", "c"))))
        .scalar()
    )
    scored = score_nearest(split.withColumn("_all", centers), F.col("_all")[F.col("run_no")], vector)
    hit = F.col("pred") == F.col(label)
    return (
        scored.withColumn("_hit", F.when(F.col("split") == "test", hit.cast("int")))
        .groupBy("run_no", "spec", "seed")
        .agg(
            *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")],
            F.round(F.avg("_hit"), 6).alias("test_accuracy"),
        )
    )
