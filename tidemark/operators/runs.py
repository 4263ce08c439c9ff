"""Runs in long form: metrics ``run_id, key, step, value`` and parameters ``run_id, key, value``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "run_id string, key string, step int, value double"
PARAMS = "run_id string, key string, value string"


def log_metrics(spark: SparkSession, path: str, rows: Sequence[tuple[str, str, int, float]]) -> None:
    spark.createDataFrame(list(rows), METRICS).write.mode("append").parquet(path)


def log_params(spark: SparkSession, path: str, rows: Sequence[tuple[str, str, str]]) -> None:
    spark.createDataFrame(list(rows), PARAMS).write.mode("append").parquet(path)


def run_table(params: DataFrame, metrics: DataFrame, param_keys: Sequence[str], metric_keys: Sequence[str]) -> DataFrame:
    """One row per run: its parameters and the last value of each metric.

    A run that has only parameters or only metrics has nulls for the others; of a
    parameter logged twice the larger text counts.
    """
    if both := set(param_keys) & set(metric_keys):
        raise ValueError(f"both parameter and metric: {sorted(both)}")
    given = params.groupBy("run_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in param_keys])
    return given.join(last_metrics(metrics, "run_id", "key", "step", "value", metric_keys), "run_id", "full")


def last_metrics(df: DataFrame, run: str, key: str, step: str, value: str, keys: Sequence[str]) -> DataFrame:
    """One row per run, the last logged value of each key as a column."""
    return df.groupBy(run).agg(
        *[F.max_by(value, F.when(F.col(key) == k, F.col(step))).alias(k) for k in keys]
    )


def every_kth_step(df: DataFrame, step: str, k: int = 10) -> DataFrame:
    return df.filter(F.col(step) % k == 0)


def best_run(df: DataFrame, group: Sequence[str], run: str, score: str) -> DataFrame:
    """Per group the run with the highest score above 0, the smallest run on ties.

    Groups whose scores are all 0 have no best run.
    """
    rated = df.filter(F.col(score) > 0)
    top = rated.groupBy(*[F.col(g).alias(f"_top_{g}") for g in group]).agg(F.max(score).alias("_top"))
    # Groups by a null key meet themselves again.
    same = [F.col(g).eqNullSafe(F.col(f"_top_{g}")) for g in group] + [F.col(score) == F.col("_top")]
    tied = rated.join(top, same).select(*group, run, score)
    return tied.groupBy(*group).agg(F.min(run).alias(run), F.max(score).alias(score))


def options(**values: Sequence) -> Column:
    """All combinations of option lists as an array of structs, for exploding."""
    combos = [{}]
    for name, choices in values.items():
        combos = [{**c, name: v} for c in combos for v in choices]
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in c.items()]) for c in combos])
