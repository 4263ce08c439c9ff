"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Bytes of an Arrow batch handed to Python; a longer text is a batch of its own.
TEXT_BATCH_BYTES = 4 << 20
#: Rows that the Parquet reader decodes at once: whole texts in large batches fill an executor's heap.
READER_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators expect: UTC, adaptive plans, batches bounded by bytes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written with a number each, and the number's column; keys need not tell rows apart."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id())), name


def shared_keys(docs: DataFrame, key: str) -> np.ndarray:
    """A filter of the integer keys that more than one row has; see :func:`row_marks`."""
    found = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).count()
    return hash_filter(found.where("count > 1").select(F.xxhash64("key").alias("h")), "h")


def row_marks(bits: np.ndarray, keys: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """What tells rows with a key apart: 0 where the key is one row's, else the hash of its text.

    ``keys`` and ``texts`` are hashes.  A key that passes the filter by chance has a mark that it
    does not need, and the same one everywhere.
    """
    out = np.zeros(len(keys), np.int64)
    at = passing(bits, keys.view(np.uint64))
    out[at] = texts[at]
    return out


def worker_state(name: str, make: Callable[[], object]) -> object:
    """A value that the Python worker process keeps for its next tasks, made at its first use.

    A worker keeps one at a time: a worker that serves several operators in turn would
    otherwise hold the tables of all of them.
    """
    holder = sys.modules.setdefault("_tidemark_worker_state", types.ModuleType("_tidemark_worker_state"))
    if getattr(holder, "held", None) != name:
        holder.held = holder.value = None
        pa.default_memory_pool().release_unused()
        holder.value = make()
        holder.held = name
    return holder.value


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        empty = pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type)
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay near ``most``; a longer row is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def key_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from batches sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[-1]
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, last.as_py(), side="left"))
        if cut == 0 and held and held[-1].column(key)[-1] == last:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)]) if held or cut else None
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    n = len(sorted_values)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [n]))


#: log2 of a filter's bits: 8 MB, whatever is put in.
FILTER_BITS = 26


def filter_places(h: np.ndarray) -> list[np.ndarray]:
    """Three bits of a filter for each 64-bit hash."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return [h & mask, (h >> np.uint64(19)) & mask, (h >> np.uint64(38)) & mask]


def hash_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes: tasks set bits, Spark merges the words they set.

    Its size is fixed; the more hashes, the more others pass.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(filter_places(batch.column(0).to_numpy().view(np.uint64))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["word", "bit"])

    words = hashes.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "word bigint, bit bigint")
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the filter may hold."""
    at = np.arange(len(h))
    for place in filter_places(h):
        p = place[at].astype(np.int64)
        at = at[(bits[p >> 6] >> (p & 63)) & 1 == 1]
    return at
