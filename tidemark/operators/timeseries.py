"""Metric series: selection, gauges, counter rates, ratios, carried markers.

Samples are rows of (series columns, time, value).  No window here spans a whole
series: a series is cut into time or order blocks, and each block gets the few rows
of its predecessor that it needs.  One very hot series is many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import as_col
from tidemark.operators.ranking import with_range_bucket
from tidemark.session import cut_lineage

MICROS = 1_000_000


def select_series(df: DataFrame, metric: str, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Samples of one metric whose label map has the given values."""
    cond = F.col("metric") == metric
    for key, value in (labels or {}).items():
        cond = cond & (F.col("labels")[key] == value)
    return df.filter(cond)


def latest_gauge(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Last value of every series; keeps one candidate per series and map task."""
    at = F.struct(*order)
    return df.groupBy(*series).agg(F.max_by(value, at).alias(value), F.max(order[0]).alias(order[0]))


def first_last(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """First and last non-null value of every series."""
    at = F.struct(*order)
    present = df.filter(F.col(value).isNotNull())
    return present.groupBy(*series).agg(
        F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value")
    )


def share_of_total(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Each row's part of the overall sum."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, F.col(value) / total)


def series_ratio(a: DataFrame, b: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """a / b for equal time and labels; unmatched samples are dropped, x/0 gives null."""
    right = b.select(*on, F.col(value).alias("_b"))
    return a.select(*on, F.col(value).alias("_a")).join(right, list(on)).select(
        *on, F.try_divide("_a", "_b").alias("ratio")
    )


def range_query(df: DataFrame, series: Sequence[str], ts: str, order: str, as_of: Column, span: str, step: str, value: str = "value") -> DataFrame:
    """Last value per step of the raw samples in (as_of - span, as_of]."""
    inside = df.filter((F.col(ts) > as_of - F.expr(f"INTERVAL {span}")) & (F.col(ts) <= as_of))
    return (
        inside.groupBy(*series, F.window(ts, step).alias("_w"))
        .agg(F.max_by(value, F.struct(ts, order)).alias(value))
        .select(*series, F.col("_w.start").alias("step"), value)
    )


def _micros(ts: str) -> Column:
    """Time as a number of microseconds; zone-less times are read as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _with_halo(df: DataFrame, at: Column, width: int, halo: int) -> DataFrame:
    """Give every row its block of ``width``, and repeat rows of a block's last ``halo`` in the next block."""
    marked = df.withColumn("_at", at).withColumn("_block", F.floor(F.col("_at") / width))
    late = (F.col("_block") + 1) * width - F.col("_at") <= halo
    places = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("_ahead", F.explode(places)).withColumn("_block", F.col("_block") + F.col("_ahead"))


def _step(before: Column, now: Column) -> Column:
    """Growth of a counter between two samples, a drop counting as a reset to zero; 0 without a first."""
    return F.coalesce(F.when(now < before, now).otherwise(now - before), F.lit(0.0))


def _block_totals(rows: DataFrame, value: str, reach: int) -> DataFrame:
    """Per series and block: samples and growth before it, and the earlier blocks that its ranges may begin in.

    The windows run over one row per series and block.  ``_earlier`` lists (last time,
    block) of those blocks of which some sample lies within ``reach`` of the block before.
    """
    cells = rows.groupBy("_series", "_range").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("_grown", "_n").alias("grown"),
        F.max("_at").alias("last_at"),
        F.min_by(value, "_n").alias("first"),
        F.max_by(value, "_n").alias("last"),
    )
    line = W.partitionBy("_series").orderBy("_range")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    near = W.partitionBy("_series").orderBy("last_at").rangeBetween(-reach, 0)
    marked = cells.withColumn("border", _step(F.lag("last").over(line), F.col("first"))).withColumn(
        "near", F.collect_list(F.struct("last_at", "_range")).over(near)
    )
    grown = F.coalesce(F.sum("grown").over(before), F.lit(0.0)) + F.sum("border").over(line.rowsBetween(W.unboundedPreceding, W.currentRow))
    return marked.select(
        "_series",
        "_range",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base_n"),
        grown.alias("_base_grown"),
        F.lag("near").over(line).alias("_earlier"),
    )


def counter_samples(
    df: DataFrame, series: Sequence[str], ts: str, order: str, value: str, seconds: float, blocks: int | None = None
) -> DataFrame:
    """Add, per sample, what happened in the trailing ``seconds`` up to it.

    ``increase``: growth between samples inside the range, a drop counting as a reset
    to zero; ``samples``, ``first_at`` and ``first_value`` of the range.

    A prefix scan of two levels: samples are dealt by series and time into ``blocks`` of about
    equal row counts (``spark.sql.shuffle.partitions`` unless given), counted and summed up
    inside a block and, one row per block, across blocks.  A range's sums are then the
    difference of two samples.  Each sample sends a probe to the block in which its range
    begins, so a block meets about as many probes as it has samples, however dense a series is
    or how long the range.  Samples of one series and time lie in one block.
    """
    reach = int(seconds * MICROS)
    marked = df.withColumn("_at", _micros(ts)).withColumn("_series", F.struct(F.lit(0).alias("s"), *series))
    dealt = with_range_bucket(marked, [*series, "_at"], blocks)
    line = W.partitionBy("_series", "_range").orderBy("_at", order)
    rows = dealt.withColumn("_step", _step(F.lag(value).over(line), F.col(value))).withColumn("_n", F.row_number().over(line))
    rows = rows.withColumn("_grown", F.sum("_step").over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # Samples with the same time belong to each other's ranges.
    by_time = W.partitionBy("_series", "_range").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = cut_lineage(rows.withColumn("_last", F.max(F.struct("_n", "_grown")).over(by_time)).drop("_step"))
    rows = rows.join(_block_totals(rows, value, reach), ["_series", "_range"])
    whole = lambda at: F.struct((F.col("_base_n") + at["_n"]).alias("n"), (F.col("_base_grown") + at["_grown"]).alias("grown"))
    own = F.struct((F.col("_base_n") + F.col("_n")).alias("n"), (F.col("_base_grown") + F.col("_grown")).alias("grown"), "_at", F.col(value).alias("v"))
    start = F.col("_at") - reach
    reached = F.filter(F.coalesce("_earlier", F.array()), lambda b: b["last_at"] >= start)
    target = F.coalesce(F.get(reached, F.lit(0))["_range"], F.col("_range"))
    probe = lambda block, at, is_probe: F.struct(block.alias("block"), at.alias("t"), F.lit(is_probe).alias("probe"))
    marks = F.explode(F.array(probe(F.col("_range"), F.col("_at"), 0), probe(target, start, 1)))
    met = rows.withColumns({"_last": whole(F.col("_last")), "_own": own}).withColumn("_mark", marks)
    # Running backwards in time, the last sample before a probe is the first one of its range.
    back = W.partitionBy("_series", "_mark.block").orderBy(F.col("_mark.t").desc(), "_mark.probe", F.col("_own.n").desc())
    sample = F.when(F.col("_mark.probe") == 0, F.col("_own"))
    first = F.last(sample, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = (
        met.withColumn("_first", first)
        .filter("_mark.probe = 1")
        .withColumn("increase", F.col("_last.grown") - F.col("_first.grown"))
        .withColumn("samples", (F.col("_last.n") - F.col("_first.n") + 1).cast("bigint"))
        .withColumn("first_at", F.col("_first._at"))
        .withColumn("first_value", F.col("_first.v"))
    )
    return out.select(*df.columns, "_at", "increase", "samples", "first_at", "first_value")


def counter_rate(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    order: str,
    value: str,
    seconds: float = 60,
    extrapolate: bool = False,
    blocks: int | None = None,
) -> DataFrame:
    """Per-second increase over the trailing range at every sample with at least two in range.

    The plain mode divides the increase by the range.  ``extrapolate`` first stretches
    it towards the range's start: by half a mean sample distance when the first sample
    lies far from the start, else all the way, and never below a counter value of zero.
    """
    rows = counter_samples(df, series, ts, order, value, seconds, blocks).filter(F.col("samples") > 1)
    increase = F.col("increase")
    if extrapolate:
        covered = (F.col("_at") - F.col("first_at")) / float(MICROS)
        spacing = covered / (F.col("samples") - 1)
        missing = F.lit(float(seconds)) - covered
        stretch = F.when(missing >= spacing * 1.1, spacing / 2).otherwise(missing)
        to_zero = F.when((increase > 0) & (F.col("first_value") >= 0), covered * F.col("first_value") / increase)
        stretch = F.least(stretch, to_zero)  # ignores a null
        increase = F.when(covered > 0, increase * (covered + stretch) / covered)
    return rows.withColumn("rate", increase / F.lit(float(seconds))).select(
        *series, ts, order, "samples", "increase", "rate"
    )


def sliding_increase(
    df: DataFrame, series: Sequence[str], ts: str, order: str, value: str, window: str, slide: str, seconds: float
) -> DataFrame:
    """Increase per sliding window of ``seconds``: last - first + what resets lost.

    A sample joins every window that covers it; per window only sums and the first
    step are kept, so the same code serves batch and (per batch) streams.
    """
    steps = counter_steps(df, series, ts, order, value, seconds)
    placed = steps.withColumn("_w", F.window(F.col(ts).cast("timestamp"), window, slide))
    at = F.struct(ts, order)
    return (
        placed.groupBy(*series, "_w")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            (F.coalesce(F.sum("_step"), F.lit(0.0)) - F.coalesce(F.min_by("_step", at), F.lit(0.0))).alias("increase"),
        )
        .select(*series, F.col("_w.end").cast("timestamp_ntz").alias("window_end"), "samples", "increase")
    )


def counter_steps(df: DataFrame, series: Sequence[str], ts: str, order: str, value: str, seconds: float, block_seconds: float = 3600) -> DataFrame:
    """Reset-corrected growth since the previous sample; null when that is over ``seconds`` back in another block."""
    reach = int(seconds * MICROS)
    width = max(int(block_seconds * MICROS), reach + 1)
    blocks = _with_halo(df, _micros(ts), width, reach)
    before = F.lag(value).over(W.partitionBy(*series, "_block").orderBy("_at", order))
    step = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return blocks.withColumn("_step", step).filter(F.col("_ahead") == 0).drop("_ahead", "_block", "_at")


def sum_rate(df: DataFrame, series: Sequence[str], ts: str, order: str, value: str, window: str, slide: str, seconds: float) -> DataFrame:
    """Sum over all series of their rates, per window end."""
    parts = sliding_increase(df, series, ts, order, value, window, slide, seconds).filter(F.col("samples") > 1)
    return parts.groupBy("window_end").agg(
        F.count(F.lit(1)).alias("series"), (F.sum("increase") / F.lit(float(seconds))).alias("rate")
    )


def carry_forward(
    df: DataFrame, group: Sequence[str], order: str, marker: str, out: str, block_size: int = 100_000
) -> DataFrame:
    """Last non-null ``marker`` at or before each row, by a unique integer ``order``.

    Inside a block of ``block_size`` order values by a window; across blocks by a
    window over one summary row per block.
    """
    # Structs are never null themselves, so rows with a null group find their block too.
    group_key, block = F.struct(F.lit(0).alias("g"), *group), F.floor(F.col(order) / block_size)
    rows = df.withColumn("_group", group_key).withColumn("_block", block)
    rows = rows.withColumn("_cell", F.struct("_group", "_block"))
    near = F.last(marker, ignorenulls=True).over(
        W.partitionBy("_cell").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    lasts = rows.groupBy("_group", "_block").agg(
        F.max_by(marker, F.when(F.col(marker).isNotNull(), F.col(order))).alias("_last")
    )
    earlier = W.partitionBy("_group").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select(
        F.struct("_group", "_block").alias("_cell"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    return (
        rows.withColumn("_near", near)
        .join(carried, "_cell", "left")
        .withColumn(out, F.coalesce("_near", "_carried"))
        .drop("_near", "_carried", "_group", "_block", "_cell")
    )


def zero_fill(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], value: str) -> DataFrame:
    """One row per seen key and kind of the fixed list; kinds without a value get 0."""
    sums = df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(value))), F.lit(0.0)).alias(k) for k in kinds]
    )
    return sums.unpivot(list(keys), list(kinds), kind, value)


# Lower bounds and colours of the percentage and absolute bands.
PERCENT_BANDS = [(None, "green"), (10, "dark-blue"), (20, "blue"), (40, "#EAB839"), (60, "orange"), (80, "red")]
ABSOLUTE_BANDS = [(None, "green"), (80, "red")]


def threshold_band(position: str | Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Colour of the highest band whose lower bound is reached."""
    at = as_col(position)
    out = F.lit(bands[0][1])
    for bound, colour in bands[1:]:
        out = F.when(at >= F.lit(float(bound)), F.lit(colour)).otherwise(out)
    return out


def percent_position(df: DataFrame, value: str, out: str = "position") -> DataFrame:
    """Place of each value between the smallest (0) and the largest (100)."""
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    marked = df.withColumn("_ends", ends)
    span = F.col("_ends.hi") - F.col("_ends.lo")
    return marked.withColumn(
        out, F.when(span > 0, (F.col(value) - F.col("_ends.lo")) * 100.0 / span).otherwise(F.lit(0.0))
    ).drop("_ends")
