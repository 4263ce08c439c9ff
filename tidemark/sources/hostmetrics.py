"""Host statistics text -> gauge samples.

Input rows are captured lines: ``host, ts, line_no, line``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import WHITESPACE
from tidemark.operators.timeseries import carry_forward, zero_fill

# Gauge name, field index and factor for the two kinds of line.
DISK_GAUGES = [
    ("io_read_rate", 2, 1.0),
    ("io_write_rate", 3, 1.0),
    ("io_read_bytes", 4, 1024.0),
    ("io_write_bytes", 5, 1024.0),
    ("io_tps", 13, 1.0),
]
DISK_FIELDS = 14
CPU_MODES = [("user", 0), ("nice", 1), ("system", 2), ("iowait", 4), ("idle", 5)]
CPU_FIELDS = 6
CPU_GAUGE = "cpu_avg_percent"


def sections(lines: DataFrame) -> DataFrame:
    """Data lines with their fields and the section ("disk", "cpu" or null) they are in."""
    marker = F.when(F.col("line").contains("Device"), "disk").when(F.col("line").contains("avg-cpu"), "cpu")
    marked = carry_forward(lines.withColumn("_marker", marker), ["host", "ts"], "line_no", "_marker", "section")
    fields = F.filter(F.split("line", WHITESPACE), lambda w: w != "")
    return (
        marked.filter(F.col("_marker").isNull())
        .withColumn("fields", fields)
        .filter(F.size("fields") > 0)
        .drop("_marker")
    )


def parse_io_stats(lines: DataFrame) -> DataFrame:
    """Gauge samples ``host, ts, line_no, metric, label, value``; short lines give none."""
    rows = sections(lines)

    def number(i):
        return F.get("fields", F.lit(i)).try_cast("double")

    disk = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.get("fields", F.lit(0)).alias("label"), (number(i) * k).alias("value"))
            for m, i, k in DISK_GAUGES
        ]
    )
    cpu = F.array(
        *[
            F.struct(F.lit(CPU_GAUGE).alias("metric"), F.lit(mode).alias("label"), number(i).alias("value"))
            for mode, i in CPU_MODES
        ]
    )
    is_disk = (F.col("section") == "disk") & (F.size("fields") >= DISK_FIELDS)
    is_cpu = (F.col("section") == "cpu") & (F.size("fields") >= CPU_FIELDS)
    gauges = F.when(is_disk, disk).when(is_cpu, cpu)
    return rows.select("host", "ts", "line_no", F.inline(gauges)).filter(F.col("value").isNotNull())


def devices_seen(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("metric").startswith("io_")).select("host", F.col("label").alias("device")).distinct()


def read_write_gauges(samples: DataFrame) -> DataFrame:
    """Read and write rate of every seen device and snapshot, 0 where none was parsed."""
    names = ["io_read_rate", "io_write_rate"]
    disk = samples.filter(F.col("metric").startswith("io_"))
    return zero_fill(disk, ["host", "ts", "label"], "metric", names, "value")


def parse_memory(lines: DataFrame, scale_unitless: bool = True) -> DataFrame:
    """``Name: 123 kB`` lines -> gauges ``meminfo_<name>`` in bytes.

    Counts without a unit are scaled as well, unless ``scale_unitless`` is off.
    """
    pattern = r"^(\w+):\s+(\d+)(\s+kB)?"
    number = F.regexp_extract("line", pattern, 2).try_cast("double")
    unit = F.regexp_extract("line", pattern, 3) != ""
    factor = F.lit(1024.0) if scale_unitless else F.when(unit, 1024.0).otherwise(1.0)
    matched = lines.filter(F.col("line").rlike(pattern))
    name = F.concat(F.lit("meminfo_"), F.lower(F.regexp_extract("line", pattern, 1)))
    return matched.select("host", "ts", "line_no", name.alias("metric"), (number * factor).alias("value"))
