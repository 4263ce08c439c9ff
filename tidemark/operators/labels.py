"""Row-level preparation: schema checks, null handling, sampling, snapshots by day."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import as_col
from tidemark.operators.ranking import seeded_key


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not found; available: {df.columns}")
    return df


def require_rows(df: DataFrame, what: str = "dataset") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"empty {what}")
    return df


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def null_profile(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Total rows and nulls per column, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in names]
    )


def partition_counts(df: DataFrame) -> DataFrame:
    """Rows per partition of the plan as it is executed."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def hash_sample(df: DataFrame, fraction: float, seed: int, *key: str) -> DataFrame:
    """Keep each row with probability ``fraction``; the same rows on any partitioning."""
    draw = F.conv(F.substring(seeded_key(seed, *key), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
    return df.filter(draw < F.lit(fraction))


def suffix_columns(df: DataFrame, suffix: str, keep: Iterable[str] = ()) -> DataFrame:
    held = set(keep)
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in held})


def prefix_columns(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    held = set(keep)
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in held})


def rows_of_day(df: DataFrame, time_col: str, day: str | Column) -> DataFrame:
    """Rows of one date, as a time range so that Parquet statistics can skip files."""
    start = (F.lit(day) if isinstance(day, str) else day).cast("date")
    kind = df.schema[time_col].dataType.simpleString()
    first, after = start.cast(kind), F.date_add(start, 1).cast(kind)
    return df.filter((F.col(time_col) >= first) & (F.col(time_col) < after))


def stack_classes(df: DataFrame, label: str, classes: Iterable[int]) -> DataFrame:
    """Rows of the given classes, one block per class, with the block's place."""
    parts = [df.filter(F.col(label) == c).withColumn("block", F.lit(i)) for i, c in enumerate(classes)]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def union_versions(df: DataFrame, version_col: str, spec: str) -> DataFrame:
    """``v1+v2+v1``: rows of the named versions, once per mention."""
    mentions = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(v).alias("v")) for i, v in enumerate(spec.split("+"))])
    hit = F.filter(mentions, lambda m: m["v"] == as_col(version_col))
    return (
        df.filter(F.col(version_col).isin(spec.split("+")))
        .withColumn("_hit", F.explode(hit))
        .withColumn("part", F.col("_hit.part"))
        .drop("_hit")
    )
