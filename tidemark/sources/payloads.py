"""Vectors as JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import doubles, nest, unnest


def write_payload(df: DataFrame, vector: str, rows: int, cols: int, out: str = "payload") -> DataFrame:
    """``{"inputs": [[[[x]]]]}`` text of a rows x cols image."""
    return df.withColumn(out, F.to_json(F.struct(nest(doubles(vector), rows, cols).alias("inputs"))))


def read_payload(df: DataFrame, payload: str = "payload", out: str = "features") -> DataFrame:
    """Flat vector of either payload form: nested ``inputs`` or flat ``image``.

    Text that is neither gives null.
    """
    shape = "inputs array<array<array<array<double>>>>, image array<double>"
    parsed = F.from_json(payload, shape)
    return (
        df.withColumn("_p", parsed)
        .withColumn(out, F.coalesce(unnest(F.col("_p.inputs")), F.col("_p.image")))
        .drop("_p")
    )
