"""Exact ranks and rank cuts that never sort a whole group in one task.

A rank is computed from an order-preserving *bucket* of the order key: count the
rows of each bucket (a map-side combined aggregate), turn the counts into the
number of rows before each bucket, and number rows only inside a bucket.  Rows
of one group, however hot, spread over all its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def seeded_key(seed: int | str | Column, *cols: str | Column) -> Column:
    """Uniform, repeatable sort key: md5 over ``seed:col:col``."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws(":", head.cast("string"), *[p.cast("string") for p in parts]))


def hash_bucket(key: Column, hex_digits: int = 4) -> Column:
    """Leading hex digits of a seeded key: uniform and in key order."""
    return F.substring(key, 1, hex_digits)


def id_bucket(key: Column, width: int = 1_000_000) -> Column:
    """Blocks of a unique integer key: in key order, at most ``width`` rows each.

    For dense keys, where it needs no pass over the data; ids with wide gaps would make as
    many blocks as rows.  :func:`with_range_bucket` serves any key.
    """
    return (key - F.pmod(key, F.lit(width))).cast("long")


def with_range_bucket(df: DataFrame, order: Sequence[str], buckets: int | None = None, out: str = "_range") -> DataFrame:
    """Add order-preserving buckets of about equal size for a unique key of any type.

    Spark's range partitioning takes the bounds from a sample of the keys.  The dealt rows
    are written, since another run might sample other bounds.  ``buckets`` is
    ``spark.sql.shuffle.partitions`` unless given.
    """
    dealt = df.repartitionByRange(*([buckets] if buckets else []), *order)
    return cut_lineage(dealt.withColumn(out, F.spark_partition_id()))


def rows_before(df: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    """Per (group, bucket): its row count and the rows of the group in earlier buckets.

    The window runs over one row per bucket, not over the data.
    """
    counts = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def bucketed_rank(
    df: DataFrame,
    order: Sequence[str | Column],
    bucket: Column,
    group: Sequence[str] = (),
    out: str = "rank",
) -> DataFrame:
    """Add the exact 1-based rank by ``order`` within ``group``.

    ``bucket`` must be monotone in ``order``.  One shuffle on (group, bucket);
    the offsets join reuses that partitioning.
    """
    # A struct is never null itself and compares null fields as equal, so rows with a
    # null group or key are ranked too and the join can still reuse the partitioning.
    marked = df.withColumn("_group", F.struct(F.lit(0).alias("g"), *group)).withColumn("_bucket", bucket)
    offsets = rows_before(marked, ["_group"], "_bucket").select(F.struct("_group", "_bucket").alias("_cell"), "_before")
    inside = F.row_number().over(W.partitionBy("_cell").orderBy(*order))
    numbered = marked.withColumn("_cell", F.struct("_group", "_bucket")).withColumn("_inside", inside)
    return (
        numbered.join(offsets, "_cell")
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_cell", "_group", "_bucket", "_inside", "_before")
    )


def label_by_rank(
    df: DataFrame,
    key: Column,
    cuts: Sequence[tuple[str, Column]],
    rest: str | None,
    classes: Sequence[int] | None = None,
    class_col: str | None = None,
    out: str = "split",
    hex_digits: int = 4,
) -> DataFrame:
    """Label rows by the rank range their seeded key falls in, without moving them.

    ``cuts`` lists (label, last rank of the range) in rank order; a rank may refer to
    column ``total``, the size of the whole set or class.  Rows past the last cut get
    ``rest``.  Only the buckets that hold a cut are sorted, to find the key *at* the
    cut; every row is then labelled by comparing its own key with those few keys.
    The key table has one row, or one per entry of the fixed ``classes`` domain,
    which bounds what is broadcast.
    """
    group = [class_col] if class_col else []
    keyed = df.withColumn("_key", key).withColumn("_bucket", hash_bucket(F.col("_key"), hex_digits))
    slim = keyed.select(*group, "_key", "_bucket")
    if class_col:
        slim = slim.filter(F.col(class_col).isin(list(classes)))
    sizes = rows_before(slim, group, "_bucket")
    spans = sizes.withColumn("total", F.sum("_n").over(W.partitionBy(*group)))
    wanted = F.array(
        *[F.struct(F.lit(i).alias("i"), F.least(rank.cast("long"), F.col("total")).alias("rank")) for i, (_, rank) in enumerate(cuts)]
    )
    holding = (
        spans.withColumn("_cut", F.explode(wanted))
        .filter((F.col("_cut.rank") > F.col("_before")) & (F.col("_cut.rank") <= F.col("_before") + F.col("_n")))
        .select(*group, "_bucket", F.col("_cut.i").alias("_i"), (F.col("_cut.rank") - F.col("_before")).alias("_need"))
    )
    # At most one row per cut and class, so the broadcast is bounded by the arguments.
    # A bucket can hold several cuts; number its rows once, then match each cut.
    buckets = holding.select(*group, "_bucket").distinct()
    near = slim.join(F.broadcast(buckets), [*group, "_bucket"], "left_semi")
    numbered = near.withColumn("_inside", F.row_number().over(W.partitionBy(*group, "_bucket").orderBy("_key")))
    at_cut = numbered.join(F.broadcast(holding), [*group, "_bucket"]).filter(F.col("_inside") == F.col("_need"))
    columns = [F.max(F.when(F.col("_i") == i, F.col("_key"))).alias(f"_k{i}") for i in range(len(cuts))]
    if class_col:
        cut_keys = at_cut.groupBy(class_col).agg(*columns)
        labelled = keyed.join(F.broadcast(cut_keys), class_col, "left")
    else:
        cut_keys = at_cut.agg(*columns)
        one = cut_keys.select(F.struct(*cut_keys.columns)).scalar()
        labelled = keyed.withColumn("_cuts", one)
        for i in range(len(cuts)):
            labelled = labelled.withColumn(f"_k{i}", F.col(f"_cuts._k{i}"))
    label = F.lit(rest)
    for i in reversed(range(len(cuts))):
        label = F.when(F.col("_key") <= F.col(f"_k{i}"), F.lit(cuts[i][0])).otherwise(label)
    extra = ["_key", "_bucket", "_cuts", *[f"_k{i}" for i in range(len(cuts))]]
    return labelled.withColumn(out, label).drop(*extra)
