"""Image folders: ``<version>/<class>/*.png``."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The ten class names in label order.
CLASS_NAMES = ["airplane", "automobile", "bird", "cat", "deer", "dog", "frog", "horse", "ship", "truck"]


def read_class_folders(
    spark: SparkSession,
    path: str,
    classes: Sequence[str] = CLASS_NAMES,
    on_missing: str = "warn",
    with_md5: bool = False,
) -> DataFrame:
    """``image, version, class, label, length`` of the PNG files below ``path``.

    The label is the class's place in ``classes``; other folders are ignored.  Only
    file listings are read unless the content hash is asked for.  A class without
    files is a warning, or an error with ``on_missing="raise"``.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    )
    parts = F.split("path", "/")
    rows = files.select(
        F.col("path").alias("image"),
        F.get(parts, F.size(parts) - 3).alias("version"),
        F.get(parts, F.size(parts) - 2).alias("class"),
        "length",
        *([F.md5("content").alias("md5")] if with_md5 else []),
    )
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")) - 1
    rows = rows.withColumn("label", place.cast("int")).filter(F.col("label") >= 0)
    # At most one row per class comes back.
    present = {r["class"] for r in rows.select("class").distinct().collect()}
    missing = [c for c in classes if c not in present]
    if missing and on_missing == "raise":
        raise FileNotFoundError(f"no images for classes {missing} below {path}")
    if missing:
        warnings.warn(f"no images for classes {missing} below {path}", stacklevel=2)
    return rows
