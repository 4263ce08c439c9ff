"""RSS feeds captured as XML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ITEM = "title string, link string, description string, `media:content` array<struct<_url:string>>"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """``feed, pos, title, link, summary, media_url`` of every item.

    ``feed`` is the file, ``pos`` the item's place in it (a captured feed is one small
    document).  The summary defaults to "", the media url is the first one or null.
    """
    items = (
        spark.read.format("xml")
        .option("rowTag", "item")
        .schema(ITEM)
        .load(path)
        .select("*", F.col("_metadata.file_path").alias("feed"), F.monotonically_increasing_id().alias("_at"))
    )
    place = F.row_number().over(W.partitionBy("feed").orderBy("_at"))
    return items.select(
        "feed",
        place.alias("pos"),
        "title",
        "link",
        F.coalesce("description", F.lit("")).alias("summary"),
        F.get(F.col("media:content"), 0)["_url"].alias("media_url"),
    )
