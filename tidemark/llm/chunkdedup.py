"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the bytes of a text, and a chunk ends where the hash is the largest
of its neighbourhood.  Cuts depend on nearby bytes alone, so an insertion moves the chunks
behind it without changing them.  Chunks with equal digests are duplicates of the first
one, by document key; runs of duplicate chunks that are long enough are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hash_filter, passing, row_marks, shared_keys, slices_of, text_buffers
from tidemark.session import cut_lineage

#: A cut is the largest hash among this many positions on either side: chunks are longer than it.
REACH = 24
#: Bytes that the gear hash remembers.
MEMORY = 32
#: A chunk without an own cut ends after so many bytes.
LONGEST = 4096
WORK_BYTES = 2 << 20
#: Chunks of a task among which duplicates are found before any shuffle.
TASK_CHUNKS = 1 << 18

GEAR = np.random.default_rng(20_240_501).integers(0, 1 << 64, 256, dtype=np.uint64)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """hash[i] = sum of gear[raw[i - j]] << j over the last MEMORY bytes, by doubling."""
    h, width = GEAR[raw], 1
    while width < MEMORY:
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    return h


def cut_points(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted ends of the chunks of texts that lie side by side; every text's end is one.

    The hash is the same wherever a run of bytes stands, so a position is a cut if its
    hash is the only largest one within REACH positions.  Texts are told apart by
    leaving out cuts whose neighbourhood, or whose hash's memory, would reach over an edge.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    h = gear_hashes(raw)
    # Largest of the REACH positions ahead and behind, by doubling.
    top, width = h.copy(), 1
    while width * 2 <= REACH:
        top[:-width] = np.maximum(top[:-width], top[width:])
        width *= 2
    rest = REACH - width
    if rest:
        top[:-rest] = np.maximum(top[:-rest], top[rest:])
    cut = np.zeros(n, bool)
    if n > 2 * REACH:
        # top[i] is the largest of positions i .. i + REACH - 1
        mid = h[REACH : n - REACH]
        cut[REACH : n - REACH] = (mid > top[: n - 2 * REACH]) & (mid > top[REACH + 1 : n - REACH + 1])
    at = np.flatnonzero(cut)
    text = np.searchsorted(offsets, at, side="right") - 1
    inside = (at - offsets[text] >= MEMORY + REACH) & (offsets[text + 1] - at > REACH)
    ends = np.union1d(at[inside] + 1, offsets[1:])
    ends = ends[ends > 0]
    gaps = np.diff(np.concatenate(([0], ends)))
    if (long := np.flatnonzero(gaps > LONGEST)).size:
        more = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[long], gaps[long])]
        ends = np.union1d(ends, np.concatenate(more))
    return ends


def marked_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, kh, th): the rows with a key, and the hashes that :func:`row_marks` takes."""
    chosen = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return chosen.select("key", "text", F.xxhash64("key").alias("kh"), F.xxhash64("text").alias("th"))


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mark, start, size, h1, h2, known): the chunks of all texts; key and mark name a row.

    ``known`` marks chunks that an earlier document read by the same task has too: they
    need no look-up, so a digest leaves a task at most once per TASK_CHUNKS chunks however
    often it occurs.
    """
    bits = docs.sparkSession.sparkContext.broadcast(shared_keys(docs, key))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            marks = row_marks(bits.value, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            raw, bounds = text_buffers(batch.column(1))
            for a, b in slices_of(bounds, WORK_BYTES):
                part, offsets = raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                ends = cut_points(part, offsets)
                if not len(ends):
                    continue
                starts = np.concatenate(([0], ends[:-1]))
                data = part.tobytes()
                digest = xxhash.xxh3_128_digest
                sums = b"".join([digest(data[s:e]) for s, e in zip(starts.tolist(), ends.tolist())])
                pair = np.frombuffer(sums, "<i8").reshape(-1, 2)
                # The last text that begins at or before a chunk; empty texts have none.
                row = np.searchsorted(offsets[1:], starts, side="right")
                held.append((keys[a + row], marks[a + row], starts - offsets[row], ends - starts, pair[:, 0], pair[:, 1]))
                count += len(starts)
                if count >= TASK_CHUNKS:
                    yield _marked(held)
                    held, count = [], 0
        if held:
            yield _marked(held)

    return marked_rows(docs, key, text).mapInArrow(run, "key bigint, mark bigint, start bigint, size int, h1 bigint, h2 bigint, known boolean")


def _marked(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    key, mark, start, size, h1, h2 = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((key, h2, h1))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (h1[a] == h1[b]) & (h2[a] == h2[b])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    known = np.zeros(len(order), bool)
    known[order] = key[order] > key[order[first]]
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(mark), pa.array(start), pa.array(size.astype(np.int32)), pa.array(h1), pa.array(h2), pa.array(known)],
        ["key", "mark", "start", "size", "h1", "h2", "known"],
    )


def duplicate_spans(docs: DataFrame, key: str, text: str, min_bytes: int = 64) -> DataFrame:
    """(key, mark, spans, sources): runs of chunks that documents with smaller keys have too.

    A span is (first byte, byte behind the last) of a run of neighbouring duplicate chunks
    of at least ``min_bytes``; shorter runs stay.  ``sources`` are the smallest keys that
    have the chunks of a document's spans, as far as they were looked up.  Documents
    without spans are not in the result.  Rows that share a key are not smaller than each
    other, and each has the spans of its own text; ``mark`` tells them apart.  Null keys
    neither have nor cause duplicates.  A chunk without an own cut ends after ``LONGEST``
    bytes: in texts that give no cut at all, a copy is found only where it lies a multiple
    of that apart.
    """
    found = cut_lineage(chunks(docs, key, text))
    # A key's digest stands once in the window for each task batch, see chunks().
    asked = found.where(~F.col("known")).select("key", "mark", "start", "size", "h1", "h2")
    owner = F.min("key").over(Window.partitionBy("h1", "h2")).alias("owner")
    later = asked.select("key", "mark", "start", "size", owner).where("key > owner")
    known = found.where("known").select("key", "mark", "start", "size", F.lit(None).cast("long").alias("owner"))
    parts = later.unionByName(known).groupBy("key", "mark").agg(F.collect_list(F.struct("start", "size", "owner")).alias("parts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans, sources = [], [], []
            for row, own in enumerate(batch.column(2)):
                got = own.values
                start, size = (got.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                a, b = merged(start, start + size, 0)
                keep = b - a >= min_bytes
                if not keep.any():
                    continue
                a, b = a[keep], b[keep]
                rows.append(row)
                spans.append([{"first": int(x), "end": int(y)} for x, y in zip(a, b)])
                which = np.searchsorted(a, start, side="right") - 1
                inside = (which >= 0) & (start < b[np.maximum(which, 0)])
                owners = got.field(2).filter(pa.array(inside)).drop_null()
                sources.append(np.unique(owners.to_numpy()))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            own = [batch.column(i).take(pa.array(rows, pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(spans, kind), pa.array(sources, pa.list_(pa.int64()))], ["key", "mark", "spans", "sources"]
            )

    return parts.mapInArrow(run, "key bigint, mark bigint, spans array<struct<first:bigint,end:bigint>>, sources array<bigint>")


def merged(first: np.ndarray, end: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans with those that overlap, touch or lie at most ``gap`` apart as one."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], first[1:] > end[:-1] + gap)) if len(first) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    return first[begins], end[np.append(begins[1:], len(first)) - 1] if len(first) else end


def remove_spans(docs: DataFrame, spans: DataFrame, key: str, text: str, keep_text: bool = True) -> DataFrame:
    """(key, kept, n_bytes, n_removed, n_spans, kept_sha256, sources) of every row: the text without its spans.

    ``spans`` has (key, mark, spans), and ``sources`` or none, with sorted spans that do not overlap; ``kept`` is the rest
    of the bytes, which need not be valid UTF-8, or null without ``keep_text``.  A null
    text is empty.  Every row comes back once, whatever its key, and rows that share a key
    lose the spans of their own texts alone.
    """
    kind = "array<bigint>"
    sources = F.col("sources") if "sources" in spans.columns else F.lit(None).cast(kind)
    spans = cut_lineage(spans.select("key", "mark", "spans", sources.alias("sources")))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    rows = rows.withColumns({"kh": F.xxhash64("key"), "th": F.xxhash64("text")})
    # Texts that surely have no spans are not shuffled.
    share = docs.sparkSession.sparkContext.broadcast
    bits, shared = share(hash_filter(spans.select(F.xxhash64("key").alias("h")), "h")), share(shared_keys(docs, key))

    @F.pandas_udf("may boolean, mark bigint")
    def found(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        h = keys.to_numpy(np.int64)
        may = np.zeros(len(h), bool)
        may[passing(bits.value, h.view(np.uint64))] = True
        return pd.DataFrame({"may": may, "mark": row_marks(shared.value, h, texts.to_numpy(np.int64))})

    flagged = rows.withColumn("found", found("kh", "th")).select("key", "text", "found.*")
    lone = flagged.where(~F.col("may")).select("key", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(None).cast(kind).alias("sources"))
    joined = flagged.where("may").drop("may").join(spans, ["key", "mark"], "left").select(*lone.columns).unionByName(lone)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_buffers(batch.column(1))
            for a, b in slices_of(bounds, 4 << 20):
                out, sizes, removed, counts, sums = [], [], [], [], []
                for i, own in zip(range(a, b), batch.column(2).slice(a, b - a).to_pylist()):
                    data = raw[bounds[i] : bounds[i + 1]].tobytes()
                    cut = [(s["first"], s["end"]) for s in own or ()]
                    at, parts = 0, []
                    for x, y in cut:
                        parts.append(data[at:x])
                        at = y
                    kept = b"".join((*parts, data[at:]))
                    out.append(kept if keep_text else None), sizes.append(len(data)), removed.append(len(data) - len(kept)), counts.append(len(cut))
                    sums.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(out, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(sums, pa.string()), batch.column(3).slice(a, b - a)],
                    ["key", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "sources"],
                )

    return joined.mapInArrow(run, "key bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, sources array<bigint>")
