"""Upkeep of stored tables: generated ids, linked writes, high-water marks, digests, change tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import fingerprint
from tidemark.operators.dedup import insert_ignore
from tidemark.operators.ranking import bucketed_rank, id_bucket, with_range_bucket
from tidemark.operators.skew import salted_join

# The stored tables, with the columns that default to the load time.
ARTICLES = "headline_id bigint, image_id bigint, headline string, thumbnail_url string, article_url string, publication_date timestamp, scrape_timestamp timestamp"
IMAGES = "image_id bigint, image_data string, created_at timestamp"
FEED_ARTICLES = "id bigint, headline string, url string, published_at timestamp, thumbnail binary, summary string"
STATE = "stream string, last_id bigint"
TIME_DEFAULTS = {"scrape_timestamp", "created_at", "published_at"}


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored table, or an empty one of that schema before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def with_table_schema(df: DataFrame, schema: str) -> DataFrame:
    """Columns of the stored schema: missing ones null, load-time columns defaulting to now."""
    out = []
    for field in T._parse_datatype_string(schema).fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in TIME_DEFAULTS:
            value = F.coalesce(value, F.current_timestamp())
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def append_with_ids(new: DataFrame, stored: DataFrame, id_col: str, order: str, dense: bool = False) -> DataFrame:
    """New rows with ids contiguous from the largest stored id, in ``order`` (a unique key).

    The key may be of any type that sorts.  ``dense`` says that it is an integer without
    wide gaps, which saves a pass over the rows.
    """
    last = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
    if dense:
        ranked = bucketed_rank(new, [order], id_bucket(F.col(order)), out="_rank")
    else:
        ranked = bucketed_rank(with_range_bucket(new, [order]), [order], F.col("_range"), out="_rank").drop("_range")
    return ranked.withColumn(id_col, last + F.col("_rank")).drop("_rank")


def insert_linked(
    new: DataFrame, stored: DataFrame, keys: Sequence[str], order: str, parent_id: str, child_cols: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(parents, children) to append: survivors of the unique key, and their child rows.

    Who survives is decided before anything is written, so no child row ever has to
    be deleted again.
    """
    survivors = append_with_ids(insert_ignore(new, stored, keys, order), stored, parent_id, order)
    return survivors.drop(*child_cols), survivors.select(parent_id, *child_cols)


def children_of(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent survived."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def since(df: DataFrame, id_col: str, last_id: int | Column) -> DataFrame:
    """Rows past a high-water mark, in id order; the comparison is pushed to the scan."""
    return df.filter(F.col(id_col) > last_id).orderBy(id_col)


def read_mark(spark: SparkSession, path: str, stream: str) -> int:
    """The saved high-water mark, 0 before the first save."""
    state = table_or_empty(spark, path, STATE).filter(F.col("stream") == stream)
    return state.agg(F.coalesce(F.max("last_id"), F.lit(0)).alias("m")).first()["m"]


def save_mark(spark: SparkSession, path: str, stream: str, last_id: int) -> None:
    """Append the new mark.  Marks only grow, so the largest one counts."""
    spark.createDataFrame([(stream, last_id)], STATE).write.mode("append").parquet(path)


def deliver_new(spark: SparkSession, df: DataFrame, id_col: str, state: str, stream: str, deliver: Callable[[DataFrame], None]) -> int:
    """Deliver the rows past the mark, then save the mark: at least once."""
    last = read_mark(spark, state, stream)
    fresh = since(df, id_col, last)
    newest = df.filter(F.col(id_col) > last).agg(F.max(id_col).alias("m")).first()["m"]
    if newest is None:
        return last
    # Rows that arrive while we work belong to the next delivery.
    deliver(fresh.filter(F.col(id_col) <= newest))
    save_mark(spark, state, stream, newest)
    return newest


def write_counted(df: DataFrame, path: str, mode: str = "append") -> int:
    """Write and return how many rows were really written, without a second pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("stored")).write.mode(mode).parquet(path)
    return seen.get["stored"]


# The texts of a digest.
DIGEST_SUBJECT = "New Articles Alert: %d new entries"
DIGEST_OPENING = "New articles have been added!:\n"
DIGEST_ENTRY = "• %s\n"
DIGEST_DATE = "Published on\t: %s\n"
DIGEST_LINK = " URL: %s\n\n"
DIGEST_EMPTY = "No new top stories!\n"


def digest(
    df: DataFrame,
    group: str,
    id_col: str,
    headline: str,
    url: str,
    published: str,
    last_id: int | Column = 0,
    part_size: int = 100,
    empty: bool = True,
    dense: bool = False,
) -> DataFrame:
    """Digest texts of the rows past the mark, per group and in id order.

    ``dense`` says that the ids are integers without wide gaps, which saves a pass.

    A group of any size becomes numbered parts of ``part_size`` entries, so no task
    collects more than that.  Groups without new rows get the "no new" text.
    """
    entry = F.concat(
        F.format_string(DIGEST_ENTRY, headline),
        F.when(F.col(published).isNotNull(), F.format_string(DIGEST_DATE, published)).otherwise(F.lit("")),
        F.format_string(DIGEST_LINK, url),
    )
    fresh = df.filter(F.col(id_col) > last_id).select(group, F.col(id_col).alias("_id"), entry.alias("_entry"))
    if dense:
        ranked = bucketed_rank(fresh, ["_id"], id_bucket(F.col("_id"), 10_000), [group], "_rank")
    else:
        ranked = bucketed_rank(with_range_bucket(fresh, ["_id"]), ["_id"], F.col("_range"), [group], "_rank").drop("_range")
    parts = (
        ranked.withColumn("part", F.floor((F.col("_rank") - 1) / part_size).cast("int"))
        .groupBy(group, "part")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "_entry"))).alias("_e"), F.max("_rank").alias("_top"))
    )
    totals = parts.groupBy(group).agg(F.max("_top").alias("_total"))
    out = salted_join(parts, totals, [group], "part").select(
        group,
        "part",
        F.format_string(DIGEST_SUBJECT, "_total").alias("subject"),
        F.concat(
            F.when(F.col("part") == 0, F.lit(DIGEST_OPENING)).otherwise(F.lit("")), F.array_join("_e._entry", "")
        ).alias("body"),
    )
    if not empty:
        return out
    # Groups whose newest row is not past the mark.
    quiet = df.groupBy(group).agg(F.max(id_col).alias("_m")).filter(F.col("_m") <= last_id)
    return out.unionByName(
        quiet.select(
            group,
            F.lit(0).alias("part"),
            F.format_string(DIGEST_SUBJECT, F.lit(0)).alias("subject"),
            F.lit(DIGEST_EMPTY).alias("body"),
        )
    )


def feed_fingerprints(entries: DataFrame, feed: str, position: str, cols: Sequence[str]) -> DataFrame:
    """Per feed: number of entries and a fingerprint of the ordered entry list."""
    return entries.groupBy(feed).agg(
        F.count(F.lit(1)).alias("n"), fingerprint(position, *cols).alias("fingerprint")
    )


def feed_changes(old: DataFrame, new: DataFrame, feed: str, position: str, cols: Sequence[str]) -> DataFrame:
    """Feeds of the new snapshot with whether their ordered entry list changed.

    A feed the old snapshot does not know counts as changed.
    """
    before = feed_fingerprints(old, feed, position, cols).select(feed, F.col("fingerprint").alias("_old"))
    now = feed_fingerprints(new, feed, position, cols)
    changed = ~F.col("fingerprint").eqNullSafe(F.col("_old"))
    return now.join(before, feed, "left").select(feed, "n", changed.alias("changed"))


def manifest(df: DataFrame, version: str, size: Column, *content: str) -> DataFrame:
    """Per version: rows, bytes and a content fingerprint."""
    return df.groupBy(version).agg(
        F.count(F.lit(1)).alias("nfiles"), F.sum(size).cast("long").alias("size"), fingerprint(*content).alias("md5")
    )
