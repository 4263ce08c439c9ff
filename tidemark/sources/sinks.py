"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """A report as CSV with a header: one file, or, for results that one task can't write, one per partition."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_splits_csv(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder of CSV files per split value."""
    df.write.mode("overwrite").partitionBy(split).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("encoding", "UTF-8").json(path)
