"""Streaming forms of the metric operators."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Name of a state store that keyed operators with several states need; the choice is kept in a checkpoint.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Columns of a sample as the state operator gets them; it renames those that begin with an underscore.
SAMPLE = ("sample_at", "sample_id", "sample_value")
#: Fixed value: a state key holds the windows of a series that end within so many window lengths.  Samples near the
#: ends of such a span belong to two, so it decides between more copies and larger states.
SPAN = 4
#: (time, order, value) of a sample; times in microseconds.
Sample = tuple[int, int, float]
#: First and last sample of a pane, growth between its samples, and how many they are.
Pane = tuple[Sample, Sample, float, int]


def latest_gauge(stream: DataFrame, series: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Running last value per series, for update mode; state is one row per series."""
    return stream.groupBy(*series).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(order[0]).alias(order[0]))


def step(before: float, now: float) -> float:
    """Growth of a counter from one sample to the next; a drop is a reset to zero."""
    return now if now < before else now - before


def merged(a: Pane | None, b: Pane) -> Pane:
    """Two panes as one, ``a`` before ``b``."""
    if a is None:
        return b
    return a[0], b[1], a[2] + step(a[1][2], b[0][2]) + b[2], a[3] + b[3]


class PaneRates(StatefulProcessor):
    """Keeps a series as panes and gives the windows that a batch of samples changes.

    A key is a series and a span of time, and has the windows that end within the span.  A pane
    is one row of state, however many samples it had.  Only samples less than ``late`` behind the
    newest are kept as they are: a later one may still come between them, and its growth
    depends on both neighbours.  The others are folded into their panes in order of time, in the
    batch that brings them, and panes that no open window reaches are dropped.
    """

    def __init__(self, window: int, slide: int, late: float, names: list[str]):
        self.window, self.slide, self.late, self.names = window, slide, late, names
        self.pane, self.span = math.gcd(window, slide), SPAN * window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        summary = "first_at bigint, first_id bigint, first double, last_at bigint, last_id bigint, last double, grown double, n bigint"
        self.panes = handle.getMapState("panes", "pane bigint", summary)
        self.open = handle.getListState("open", "at bigint, id bigint, v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        kept = pd.DataFrame([tuple(s) for s in self.open.get()] if self.open.exists() else [], columns=list(SAMPLE))
        fresh = pd.concat([part[list(SAMPLE)] for part in rows])
        if len(kept):
            # What is earlier was folded; Spark itself drops late rows a batch later than the watermark moves.
            fresh = fresh[fresh["sample_at"] >= self._line(int(kept["sample_at"].max()))]
        touched = np.unique(fresh["sample_at"].to_numpy(np.int64) // self.pane).tolist()
        both = pd.concat([kept, fresh]) if len(kept) else fresh
        at, ids, v = (both[c].to_numpy(kind) for c, kind in zip(SAMPLE, (np.int64, np.int64, np.float64)))
        order = np.lexsort((v, ids, at))
        at, ids, v = at[order], ids[order], v[order]
        line = max(passed, self._line(int(at[-1]))) if len(at) else passed
        done = int(np.searchsorted(at, line))
        panes = {k[0]: ((w[0], w[1], w[2]), (w[3], w[4], w[5]), w[6], w[7]) for k, w in self.panes.iterator()}
        reached = lambda p: (p + 1) * self.pane + self.window > line
        for p in [p for p in panes if not reached(p)]:
            self.panes.removeKey((p,))
        for p, pane in self._summaries(at[:done], ids[:done], v[:done]):
            panes[p] = merged(panes.get(p), pane)
            if reached(p):
                (a, b, grown, n) = panes[p]
                self.panes.updateValue((p,), (*a, *b, grown, n))
        self._keep(list(zip(at[done:].tolist(), ids[done:].tolist(), v[done:].tolist())))
        *series, span = key
        if len(at):
            # No window is open from here on: all of the span ended, or none reaches the newest sample.
            self._wake(min(int(at[-1]) + 2 * self.window, span + self.span))
        for p, pane in self._summaries(at[done:], ids[done:], v[done:]):
            panes[p] = merged(panes.get(p), pane)
        out = []
        for end in sorted({e for p in touched for e in self._ends(p) if e // self.span * self.span == span}):
            whole = None
            for p in range((end - self.window) // self.pane, end // self.pane):
                if p in panes:
                    whole = merged(whole, panes[p])
            out.append((*series, end, whole[3], whole[2]))
        if out:
            yield pd.DataFrame(out, columns=[*self.names, "window_ends", "samples", "increase"])

    def _line(self, newest: int) -> float:
        """The time before which no sample counts after this batch; the watermark will be no less."""
        return newest // 1000 * 1000 - self.late

    def _summaries(self, at: np.ndarray, ids: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, Pane]]:
        """Panes of sorted samples, in order."""
        if not len(at):
            return
        pane = at // self.pane
        first = np.flatnonzero(np.concatenate(([True], pane[1:] != pane[:-1])))
        grown = np.zeros(len(v))
        with np.errstate(invalid="ignore"):
            grown[1:] = np.where(v[1:] < v[:-1], v[1:], v[1:] - v[:-1])
        grown[first] = 0
        last = np.concatenate((first[1:], [len(at)])) - 1
        ends = [zip(at[i].tolist(), ids[i].tolist(), v[i].tolist()) for i in (first, last)]
        yield from zip(pane[first].tolist(), zip(*ends, np.add.reduceat(grown, first).tolist(), (last - first + 1).tolist()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No window of the key is open any more: its state goes."""
        self.panes.clear()
        self.open.clear()
        return iter(())

    def _keep(self, samples: list[Sample]) -> None:
        if samples:
            self.open.put(samples)
        elif self.open.exists():
            self.open.clear()

    def _wake(self, when: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(when // 1000 + 1)

    def _ends(self, pane: int) -> range:
        """Ends of the windows that hold a pane; windows begin at multiples of the slide."""
        first = pane * self.pane // self.slide * self.slide
        starts = range(first, (pane + 1) * self.pane - self.window - 1, -self.slide)
        return range(starts[-1] + self.window, first + self.window + 1, self.slide)


def spans_of(at: Column, window: int, slide: int) -> Column:
    """Starts of the spans in which some window with a sample at this time ends; none if no window has it."""
    pane, span = math.gcd(window, slide), SPAN * window
    floor = lambda x, n: x - F.pmod(x, F.lit(n))
    earliest = floor(at, pane) + pane - window
    first, last = earliest + F.pmod(-earliest, F.lit(slide)) + window, floor(at, slide) + window
    return F.when(first <= last, F.sequence(floor(first, span), floor(last, span), F.lit(span)))


def sliding_increase(
    stream: DataFrame, series: Sequence[str], ts: str, order: str, value: str, window: str, slide: str, late: str
) -> DataFrame:
    """(series, window_end, samples, increase) of the sliding windows that each batch changes, for update mode.

    The increase corrects counter resets; samples may arrive in any order up to ``late``
    behind the newest, later ones are dropped.  State is a row per pane of the length that
    divides window and slide, and the samples of the last ``late``; windows share panes
    instead of holding their samples each.  A series is dealt by spans of time, so a long one
    is worked on by many tasks.  ``order`` is an integer that tells samples of
    one time apart, none being the smallest.  Samples without a time or value are left out.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    length, shift = (micros_of(spark, text) for text in (window, slide))
    kinds = {f.name: f for f in stream.schema.fields}
    schema = StructType(
        [*(kinds[s] for s in series), StructField("window_ends", LongType()), StructField("samples", LongType()), StructField("increase", DoubleType())]
    )
    place = F.coalesce(F.col(order).cast("long"), F.lit(-(2**63)))
    timed = stream.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(
        *series, F.col(ts).cast("timestamp").alias("sample_time"), place.alias("sample_id"), F.col(value).cast("double").alias("sample_value")
    )
    timed = timed.withColumn("sample_at", F.unix_micros("sample_time")).withWatermark("sample_time", late)
    dealt = timed.withColumn("sample_span", F.explode(spans_of(F.col("sample_at"), length, shift)))
    # Months have no fixed length: with them only the watermark itself tells what is late.
    behind = math.inf if re.search("month|year", late, re.IGNORECASE) else micros_of(spark, late)
    found = dealt.groupBy(*series, "sample_span").transformWithStateInPandas(
        PaneRates(length, shift, behind, list(series)), outputStructType=schema, outputMode="Update", timeMode="EventTime"
    )
    end = F.timestamp_micros("window_ends").cast("timestamp_ntz").alias("window_end")
    return found.select(*series, end, "samples", "increase")


def micros_of(spark: SparkSession, span: str) -> int:
    """Microseconds of a span such as '5 seconds'; months and years have none."""
    at = F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {span}")
    return spark.range(1).select(F.unix_micros(at).alias("n")).first()["n"]
