"""Registered queries: metric series over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import timeseries as ts
from tidemark.plans.registry import register, table
from tidemark.sources import hostmetrics as hm

# Counter stand-in: grows with the event id and starts again every 500 events.
COUNTER = "pmod(event_id, 500)"
SQL_COUNTER = "counters AS (SELECT event_id, ts, event_type, (event_id % 500)::DOUBLE AS total FROM events)"
RANGE_SECONDS = 6 * 3600


def counters(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "event_type", F.expr(COUNTER).cast("double").alias("total")
    )


def samples(spark, sf_dir):
    """Events as long-form metric samples with a label map."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("metric"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        "value",
    )


@register(
    "series_select",
    "SELECT event_id, ts, event_type AS metric, value FROM events WHERE event_type = 'error' AND user_id::VARCHAR = '42'",
)
def series_select(spark, sf_dir):
    picked = ts.select_series(samples(spark, sf_dir), "error", {"user": "42"})
    return picked.select("event_id", "ts", "metric", "value")


@register(
    "latest_gauge",
    """SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY event_type, user_id""",
)
def latest_gauge(spark, sf_dir):
    return ts.latest_gauge(table(spark, sf_dir, "events"), ["event_type", "user_id"], ["ts", "event_id"])


@register(
    "series_first_last",
    """SELECT event_type, user_id, arg_min(v, (ts, event_id)) AS first_value, arg_max(v, (ts, event_id)) AS last_value
FROM (SELECT *, CASE WHEN value >= 5 THEN value END AS v FROM events) WHERE v IS NOT NULL GROUP BY event_type, user_id""",
)
def series_first_last(spark, sf_dir):
    """Values below 5 count as missing."""
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    return ts.first_last(rows, ["event_type", "user_id"], ["ts", "event_id"])


@register(
    "series_share",
    """SELECT user_id, round(sum(value) / (SELECT sum(value) FROM events), 8) AS share FROM events GROUP BY user_id""",
)
def series_share(spark, sf_dir):
    per_user = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("value"))
    return ts.share_of_total(per_user, "value").select("user_id", F.round("share", 8).alias("share"))


@register(
    "series_ratio",
    """WITH d AS (SELECT event_type, user_id, ts::DATE AS day, count(*)::DOUBLE AS value FROM events GROUP BY ALL)
SELECT a.user_id, a.day, round(a.value / b.value, 8) AS ratio FROM d a JOIN d b USING (user_id, day)
WHERE a.event_type = 'purchase' AND b.event_type = 'view'""",
)
def series_ratio(spark, sf_dir):
    """Purchases per view, per user and day."""
    daily = (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("purchase", "view"))
        .groupBy("event_type", "user_id", F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )
    part, whole = (daily.filter(F.col("event_type") == t) for t in ("purchase", "view"))
    out = ts.series_ratio(part, whole, ["user_id", "day"])
    return out.withColumn("ratio", F.round("ratio", 8))


@register(
    "range_query",
    """WITH e AS (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-16 00:00:00' - INTERVAL 5 DAY AND ts <= TIMESTAMP '2024-01-16 00:00:00')
SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS step, arg_max(value, (ts, event_id)) AS value FROM e GROUP BY ALL""",
)
def range_query(spark, sf_dir):
    as_of = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return ts.range_query(
        table(spark, sf_dir, "events"), ["event_type"], "ts", "event_id", as_of, "5 DAYS", "1 hour"
    )


SQL_RATE = f"""
{SQL_COUNTER},
s AS (SELECT *, lag(total) OVER w AS before FROM counters WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
t AS (SELECT *, CASE WHEN total < before THEN total ELSE total - before END AS step FROM s),
r AS (SELECT *, count(*) OVER v AS samples, sum(step) OVER v AS grown, first_value(step) OVER v AS entering,
        first_value(ts) OVER v AS first_at, first_value(total) OVER v AS first_total
  FROM t WINDOW v AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL {RANGE_SECONDS} SECOND PRECEDING AND CURRENT ROW)),
rates AS (SELECT event_type, ts, event_id, samples, coalesce(grown, 0) - coalesce(entering, 0) AS increase, first_at, first_total FROM r WHERE samples > 1)"""


@register(
    "counter_rate",
    f"WITH {SQL_RATE} SELECT event_type, ts, event_id, samples, increase, round(increase / {RANGE_SECONDS}, 8) AS rate FROM rates",
)
def counter_rate(spark, sf_dir):
    out = ts.counter_rate(counters(spark, sf_dir), ["event_type"], "ts", "event_id", "total", RANGE_SECONDS)
    return out.withColumn("rate", F.round("rate", 8))


@register(
    "counter_rate_extrapolated",
    f"""WITH {SQL_RATE}, c AS (SELECT *, (epoch_us(ts) - epoch_us(first_at)) / 1e6::DOUBLE AS covered FROM rates),
g AS (SELECT *, covered / (samples - 1) AS spacing, {RANGE_SECONDS}::DOUBLE - covered AS missing FROM c),
h AS (SELECT *, least(CASE WHEN missing >= spacing * 1.1::DOUBLE THEN spacing / 2 ELSE missing END,
    CASE WHEN increase > 0 AND first_total >= 0 THEN covered * first_total / increase END) AS stretch FROM g)
SELECT event_type, ts, event_id, samples, increase,
  round(CASE WHEN covered > 0 THEN increase * (covered + stretch) / covered END / {RANGE_SECONDS}, 8) AS rate FROM h""",
)
def counter_rate_extrapolated(spark, sf_dir):
    out = ts.counter_rate(
        counters(spark, sf_dir), ["event_type"], "ts", "event_id", "total", RANGE_SECONDS, extrapolate=True
    )
    return out.withColumn("rate", F.round("rate", 8))


SQL_SLIDING = f"""
{SQL_COUNTER},
s AS (SELECT *, lag(total) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM counters),
t AS (SELECT *, CASE WHEN total < before THEN total ELSE total - before END AS step FROM s),
p AS (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts) + k * INTERVAL 1 HOUR FOR k IN range(1, 7)]) AS window_end FROM t),
sliding AS (SELECT event_type, window_end, count(*) AS samples,
  coalesce(sum(step), 0) - coalesce(arg_min_null(step, (ts, event_id)), 0) AS increase FROM p GROUP BY ALL)"""


@register("sliding_counts", f"WITH {SQL_SLIDING} SELECT event_type, window_end, samples, increase FROM sliding")
def sliding_counts(spark, sf_dir):
    """Reset-corrected increase in six-hour windows that start every hour."""
    return ts.sliding_increase(
        counters(spark, sf_dir), ["event_type"], "ts", "event_id", "total", "6 hours", "1 hour", RANGE_SECONDS
    )


@register(
    "sum_rate",
    f"""WITH {SQL_SLIDING} SELECT window_end, count(*) AS series, round(sum(increase) / {RANGE_SECONDS}, 8) AS rate
FROM sliding WHERE samples > 1 GROUP BY window_end""",
)
def sum_rate(spark, sf_dir):
    out = ts.sum_rate(
        counters(spark, sf_dir), ["event_type"], "ts", "event_id", "total", "6 hours", "1 hour", RANGE_SECONDS
    )
    return out.withColumn("rate", F.round("rate", 8))


@register(
    "fill_forward",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS state FROM events""",
)
def fill_forward(spark, sf_dir):
    """The last signup or error of the same user, carried to each event."""
    marker = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", marker.alias("marker"))
    return ts.carry_forward(rows, ["user_id"], "event_id", "marker", "state", block_size=2000).drop("marker")


@register("distinct_keys", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type").distinct()


KINDS = ["click", "view", "signup", "error", "purchase", "refund"]


@register(
    "zero_fill",
    f"""SELECT u.user_id, k.event_type, round(coalesce(sum(e.value), 0), 6) AS value
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest({KINDS}) AS event_type) k
LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = k.event_type GROUP BY ALL""",
)
def zero_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return ts.zero_fill(rows, ["user_id"], "event_type", KINDS, "value").withColumn("value", F.round("value", 6))


def _sql_bands(position, bands):
    steps = " ".join(f"WHEN {position} >= {b} THEN '{c}'" for b, c in reversed(bands[1:]))
    return f"CASE {steps} ELSE '{bands[0][1]}' END"


@register(
    "threshold_band",
    f"""WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
p AS (SELECT event_id, value, (value - lo) * 100.0::DOUBLE / (hi - lo) AS position FROM events, m)
SELECT event_id, {_sql_bands('position', ts.PERCENT_BANDS)} AS percent_band, {_sql_bands('value', ts.ABSOLUTE_BANDS)} AS absolute_band FROM p""",
)
def threshold_band(spark, sf_dir):
    rows = ts.percent_position(table(spark, sf_dir, "events").select("event_id", "value"), "value")
    return rows.select(
        "event_id",
        ts.threshold_band("position", ts.PERCENT_BANDS).alias("percent_band"),
        ts.threshold_band("value", ts.ABSOLUTE_BANDS).alias("absolute_band"),
    )


def captured_lines(spark, sf_dir):
    """Events written out as statistics lines, one capture per user and day."""
    v = F.col("value").cast("string")
    disk = F.concat_ws("   ", F.concat(F.lit("sda"), F.pmod("event_id", F.lit(3)).cast("string")), F.lit("0.00"), v, v, v, v, *[F.lit("1.00")] * 7, v)
    cpu = F.concat_ws(" ", F.lit(""), v, F.lit("0.50"), v, F.lit("9.99"), v, v)
    line = (
        F.when(F.col("event_type") == "error", F.lit("avg-cpu:  %user   %nice %system %iowait  %steal   %idle"))
        .when(F.col("event_type") == "signup", F.lit("Device            tps    kB_read/s    kB_wrtn/s"))
        .when(F.col("event_type") == "click", disk)
        .when(F.col("event_type") == "view", cpu)
        .otherwise(F.lit("  short line "))
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("host"),
        F.to_date("ts").alias("ts"),
        F.col("event_id").alias("line_no"),
        line.alias("line"),
    )


SQL_SECTIONS = """
s AS (SELECT event_id AS line_no, user_id AS host, ts::DATE AS ts, event_type, value,
  last_value(CASE event_type WHEN 'signup' THEN 'disk' WHEN 'error' THEN 'cpu' END IGNORE NULLS)
    OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM events),
disk AS (SELECT host, ts, line_no, unnest(['io_read_rate', 'io_write_rate', 'io_read_bytes', 'io_write_bytes', 'io_tps']) AS metric,
  'sda' || (line_no % 3) AS label, unnest([value, value, value * 1024, value * 1024, value]) AS value
  FROM s WHERE event_type = 'click' AND section = 'disk'),
cpu AS (SELECT host, ts, line_no, 'cpu_avg_percent' AS metric, unnest(['user', 'nice', 'system', 'iowait', 'idle']) AS label,
  unnest([value, 0.5, value, value, value])::DOUBLE AS value FROM s WHERE event_type IN ('click', 'view') AND section = 'cpu'),
cpu_fixed AS (SELECT c.host, c.ts, c.line_no, c.metric, c.label, CASE WHEN s.event_type = 'view' THEN c.value
  WHEN c.label = 'user' THEN NULL WHEN c.label = 'nice' THEN 0.0 ELSE c.value END AS value
  FROM cpu c JOIN s USING (line_no)),
parsed AS (SELECT host, ts, line_no, metric, label, value FROM disk
  UNION ALL SELECT host, ts, line_no, metric, label, value FROM cpu_fixed WHERE value IS NOT NULL)"""


@register("parse_iostat", f"WITH {SQL_SECTIONS} SELECT host, ts, line_no, metric, label, value FROM parsed")
def parse_iostat(spark, sf_dir):
    """Parse the captured lines; disk lines inside a cpu section are read as cpu lines, as their field count allows."""
    return hm.parse_io_stats(captured_lines(spark, sf_dir))


@register(
    "device_gauges",
    f"""WITH {SQL_SECTIONS}, d AS (SELECT DISTINCT host, ts, label FROM disk)
SELECT d.host, d.ts, d.label, m.metric, round(coalesce(sum(disk.value), 0), 6) AS value
FROM d CROSS JOIN (SELECT unnest(['io_read_rate', 'io_write_rate']) AS metric) m
LEFT JOIN disk ON disk.host = d.host AND disk.ts = d.ts AND disk.label = d.label AND disk.metric = m.metric GROUP BY ALL""",
)
def device_gauges(spark, sf_dir):
    parsed = hm.parse_io_stats(captured_lines(spark, sf_dir))
    return hm.read_write_gauges(parsed).withColumn("value", F.round("value", 6))


@register(
    "parse_meminfo",
    """SELECT user_id AS host, ts, event_id AS line_no, 'meminfo_' || event_type AS metric, (floor(value) * 1024)::DOUBLE AS value
FROM events WHERE event_type <> 'error'""",
)
def parse_meminfo(spark, sf_dir):
    """Events written out as memory lines: with and without unit, and with a name that does not match."""
    number = F.floor("value").cast("string")
    name = F.initcap("event_type")
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("Active(anon):   "), number, F.lit(" kB")))
        .when(F.col("event_type") == "view", F.concat(name, F.lit(":     "), number))
        .otherwise(F.concat(name, F.lit(":     "), number, F.lit(" kB")))
    )
    lines = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("host"), "ts", F.col("event_id").alias("line_no"), line.alias("line")
    )
    return hm.parse_memory(lines)
