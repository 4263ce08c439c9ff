"""Evaluation of (truth, prediction) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import NEGATIVE, POSITIVE, as_col
from tidemark.functions.vectors import bind, doubles, squared_distance
from tidemark.operators.labels import suffix_columns
from tidemark.session import cut_lineage


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion_binary(df: DataFrame, truth: str, pred: str, yes: str = POSITIVE, no: str = NEGATIVE) -> DataFrame:
    """tp, tn, fp, fn, precision and recall in one aggregation."""
    t, p = F.col(truth), F.col(pred)
    return df.agg(
        F.count_if((p == yes) & (t == yes)).alias("tp"),
        F.count_if((p == no) & (t == no)).alias("tn"),
        F.count_if((p == yes) & (t == no)).alias("fp"),
        F.count_if((p == no) & (t == yes)).alias("fn"),
    ).select(
        "*",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )


def confusion_pairs(df: DataFrame, truth: str, pred: str, n: str = "n") -> DataFrame:
    return df.groupBy(pred, truth).agg(F.count(F.lit(1)).alias(n))


def class_domain(spark, classes: Sequence[int], name: str) -> DataFrame:
    """The fixed class list as rows."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias(name))


def confusion_matrix(df: DataFrame, truth: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """All (truth, pred) cells of the class domain, zero where nothing was counted."""
    spark = df.sparkSession
    cells = class_domain(spark, classes, truth).select(
        truth, F.explode(F.array(*[F.lit(c) for c in classes])).alias(pred)
    )
    return cells.join(confusion_pairs(df, truth, pred), [truth, pred], "left").na.fill(0, ["n"])


def crosstab(df: DataFrame, row: str, col: str, values: Sequence, prefix: str) -> DataFrame:
    """One row per ``row`` value, one count column per entry of ``values``."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(f"{prefix}{v}") for v in values])


def class_accuracy(df: DataFrame, truth: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """Hits, rows and accuracy per class of the domain; null accuracy for an absent class."""
    hits = df.groupBy(truth).agg(
        F.count_if(F.col(pred) == F.col(truth)).alias("hits"), F.count(F.lit(1)).alias("n")
    )
    domain = class_domain(df.sparkSession, classes, truth)
    return (
        domain.join(hits, truth, "left")
        .na.fill(0, ["hits", "n"])
        .withColumn("accuracy", F.when(F.col("n") > 0, F.col("hits") / F.col("n")))
    )


def accuracy(truth: str | Column, pred: str | Column) -> Column:
    return F.avg((as_col(truth) == as_col(pred)).cast("int"))


def class_counts(df: DataFrame, label: str, classes: Sequence[int]) -> DataFrame:
    """Rows per class with zeros for classes that do not occur."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return class_domain(df.sparkSession, classes, label).join(counts, label, "left").na.fill(0, ["n"])


def misclassified(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return df.filter(F.col(truth) != F.col(pred))


def hard_examples(runs: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Rows misclassified in every run, with each run's columns suffixed by its name."""
    joined = None
    for name, wrong in runs:
        part = suffix_columns(wrong, f"_{name}", keep=[key])
        joined = part if joined is None else joined.join(part, key)
    return joined


def hard_report(hard: DataFrame, truth: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """(part, truth, pred, n) of hard examples: rows per class of the domain, per pair that occurs, and in total.

    ``part`` is ``class``, ``pair`` or ``total``; what a part does not count is null.
    """
    # One pass over the rows; what follows works on a row per pair of classes.
    pairs = cut_lineage(confusion_pairs(hard.select(F.col(truth).alias("truth"), F.col(pred).alias("pred")), "truth", "pred"))
    sums = pairs.groupBy("truth").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("int")
    by_class = class_domain(hard.sparkSession, classes, "truth").join(sums, "truth", "left").na.fill(0, ["n"])
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return (
        by_class.select(F.lit("class").alias("part"), "truth", none.alias("pred"), "n")
        .unionByName(pairs.select(F.lit("pair").alias("part"), "truth", "pred", "n"))
        .unionByName(total.select(F.lit("total").alias("part"), none.alias("truth"), none.alias("pred"), "n"))
    )


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean vector per class: one row per (label, position), partial sums map-side."""
    return (
        df.select(label, F.posexplode(doubles(vector)).alias("pos", "x"))
        .groupBy(label, "pos")
        .agg(F.avg("x").alias("x"))
    )


def centroid_table(df: DataFrame, vector: str, label: str) -> Column:
    """All class centroids as one array value (classes x dimensions numbers).

    A scalar subquery: evaluated once, then a constant in every task.
    """
    by_class = (
        centroids(df, vector, label)
        .groupBy(label)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("items"))
        .select(F.struct(F.col(label).alias("label"), F.col("items.x").alias("center")).alias("c"))
    )
    return by_class.agg(F.array_sort(F.collect_list("c"))).scalar()


def score_nearest(df: DataFrame, table: Column, vector: str, out: str = "pred") -> DataFrame:
    """Add the label of the closest centroid, the smaller label on equal distance."""

    def nearest(x: Column) -> Column:
        ranked = F.transform(
            x["centers"],
            lambda c: F.struct(squared_distance(x["v"], c["center"]).alias("d"), c["label"].alias("l")),
        )
        return F.array_min(ranked)["l"]

    both = F.struct(doubles(vector).alias("v"), F.col("_centers").alias("centers"))
    return df.withColumn("_centers", table).withColumn(out, bind(both, nearest)).drop("_centers")


def metrics_record(per_class: DataFrame, overall: Column, label: str) -> DataFrame:
    """One JSON record {overall, per class}; the class domain bounds its size."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(label).cast("string").alias("k"), F.col("accuracy").alias("v"))))
    return per_class.agg(
        F.to_json(
            F.struct(overall.alias("overall_accuracy"), F.map_from_entries(pairs).alias("class_accuracy"))
        ).alias("metrics")
    )
