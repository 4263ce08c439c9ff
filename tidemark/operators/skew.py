"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    big: DataFrame, lookup: DataFrame, keys: Sequence[str], spread_by: str, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join of many rows per key with few rows per key.

    The rows of one key spread over ``salts`` tasks by a hash of ``spread_by``; the
    lookup side is repeated once per salt.  Without full outer or right joins, so
    the repetition never shows in the result.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do {how}")
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
