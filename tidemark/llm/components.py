"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of ``links`` with the smallest node it reaches.

    Each round hangs neighbours on the smallest neighbour, first the larger ones (large
    star), then the smaller ones (small star).  Minima are aggregates with map-side
    combination and a plain join, so a node with very many links is never collected, and
    each round's links are written to the shared folder.  Rounds stop when a round
    changes nothing; their number grows with the logarithm of the longest chain.
    Links with a null end and self links have no effect; an empty table gives no rows.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = links.where(F.col(a) != F.col(b)).select(high, low).distinct()
    now = cut_lineage(now)
    state = _state(now)
    while state[0]:
        following = cut_lineage(_small_star(_large_star(now)))
        after = _state(following)
        now = following
        if after == state:
            break
        state = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    # The sum of hashes, as a decimal, cannot overflow for any number of rows that fits a table.
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
    )
    least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
    return both.where("y > x").join(least, "x").where("y != m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
