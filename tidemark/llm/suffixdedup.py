"""Removal of long repeats across documents by a logarithmic family of suffix arrays.

A suffix counts by its first ``length`` bytes, so a suffix array here is the list of all
such windows, ordered by their first four bytes and then by two independent hashes of all of
them, 96 bits in sum: equal windows stand side by side, and two arrays are matched in one scan.

Windows are dealt to buckets by their minimizer, the m-gram in them with the smallest
hash.  Neighbouring windows mostly share it, so they travel as one stretch of text, a few
bytes a window, and equal windows always meet.  In a bucket the batches of documents
arrive in the order of their keys.  A batch gets its array, is scanned against the array
of every level before it, and becomes a level; levels of like size are merged, so there
are few of them and each window is moved a logarithmic number of times.  Of equal windows
only those of the smallest document stay in the index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunkdedup import marked_rows, merged, remove_spans
from tidemark.llm.common import key_runs, row_marks, shared_keys, text_buffers

#: Bytes of the minimizer.
GRAM = 12
#: Text that a task cuts into stretches at once.
BLOCK_BYTES = 3 << 20
#: Windows of a batch before it gets its array.
BATCH_WINDOWS = 1 << 19
#: Windows of a bucket that a task indexes at once; a larger bucket takes several passes, each over a part of the hashes.
PASS_WINDOWS = 3 << 20
#: Buckets for each shuffle partition.
BUCKETS = 8

_random = np.random.default_rng(20_240_502)
BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
ODD = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: The same for the second hash.
BYTE_2 = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
ODD_2 = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hash(raw: np.ndarray, length: int, byte: np.ndarray = BYTE, odd: np.ndarray = ODD) -> np.ndarray:
    """Hash of the ``length`` bytes from each position on, by doubling; the last positions are not valid."""
    h, width, out, done = byte[raw], 1, None, 0
    while True:
        if length & width:
            if out is None:
                out = h.copy()
            else:
                out[: len(h) - done] = out[: len(h) - done] * odd[width.bit_length() + 32] + h[done:]
            done += width
        if done == length:
            return out
        following = h * odd[width.bit_length()]
        following[:-width] += h[width:]
        h, width = following, width * 2


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def sliding_min(values: np.ndarray, count: int) -> np.ndarray:
    """Smallest of ``count`` values from each position on; the last positions see fewer."""
    out, width = values.copy(), 1
    while width * 2 <= count:
        out[:-width] = np.minimum(out[:-width], out[width:])
        width *= 2
    if rest := count - width:
        out[:-rest] = np.minimum(out[:-rest], out[rest:])
    return out


def stretches(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, minimizer) of the runs of windows that share a minimizer."""
    sizes = np.diff(offsets)
    if not (sizes >= length).any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least = sliding_min(mixed(window_hash(raw, GRAM)), length - GRAM + 1)
    edge = np.zeros(len(raw) + 1, np.int8)
    long = sizes >= length
    edge[offsets[:-1][long]] += 1
    edge[offsets[1:][long] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    value = least[at]
    row = np.searchsorted(offsets, at, side="right") - 1
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])))
    begin = np.flatnonzero(new)
    return row[begin], at[begin], np.diff(np.append(begin, len(at))), value[begin]


BLOB = "bucket int, low bigint, windows bigint, known boolean, size int, blob binary"


def dealt_stretches(docs: DataFrame, key: str, text: str, length: int, buckets: int) -> DataFrame:
    """Stretches of all texts by bucket, packed; a block of text sends each different stretch once.

    A stretch that a smaller document of the same block has as well is known to be a
    repeat; such rows only carry its place.
    """
    bits = docs.sparkSession.sparkContext.broadcast(shared_keys(docs, key))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            keys = batch.column(0).to_numpy()
            marks = row_marks(bits.value, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            a = 0
            while a < len(keys):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES - size, side="right")) - 1)
                held.append((keys[a:b], marks[a:b], raw[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])))
                size += int(offsets[b] - offsets[a])
                a = b
                if size >= BLOCK_BYTES:
                    yield packed(held, length, buckets)
                    held, size = [], 0
        if held:
            yield packed(held, length, buckets)

    return marked_rows(docs, key, text).mapInArrow(run, BLOB)


def packed(held: list[tuple], length: int, buckets: int) -> pa.RecordBatch:
    keys, marks, raw, sizes = (np.concatenate(x) for x in zip(*held))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    row, first, count, value = stretches(raw, offsets, length)
    data, key, mark, start = raw.tobytes(), keys[row], marks[row], first - offsets[row]
    pieces = [data[a:b] for a, b in zip(first.tolist(), (first + count + length - 1).tolist())]
    digest = xxhash.xxh3_128_digest
    sums = np.frombuffer(b"".join(map(digest, pieces)), "<u8").reshape(-1, 2)
    order = np.lexsort((key, sums[:, 1], sums[:, 0]))
    same = np.zeros(len(order), bool)
    same[1:] = (sums[order[1:]] == sums[order[:-1]]).all(axis=1)
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    known = np.zeros(len(order), bool)
    known[order] = key[order] > key[lead]
    bucket = ((value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(buckets)
    rows = []
    zip_ = zstandard.ZstdCompressor(level=3).compress
    fresh = np.flatnonzero(~known)
    fresh = fresh[np.argsort(bucket[fresh], kind="stable")]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket[fresh])) + 1, [len(fresh)])) if len(fresh) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = fresh[a:b]
        body = b"".join((places(key[own], mark[own], start[own], count[own]), *(pieces[i] for i in own.tolist())))
        rows.append((int(bucket[own[0]]), int(key[own].min()), int(count[own].sum()), False, len(own), zip_(body)))
    if known.any():
        own = np.flatnonzero(known)
        body = places(key[own], mark[own], start[own], count[own])
        rows.append((int(bucket[own[0]]), int(key[own].min()), 0, True, len(own), zip_(body)))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in BLOB.split(", ")])


class Level:
    """A suffix array: windows ordered by (order, hash), with their places.

    Equal windows in it are all of one document, the smallest that was added.
    """

    __slots__ = ("order", "hash", "key", "mark", "start", "group")

    def __init__(self, order: np.ndarray, hashed: np.ndarray, key: np.ndarray, mark: np.ndarray, start: np.ndarray):
        self.order, self.hash, self.key, self.mark, self.start = order, hashed, key, mark, start
        new = np.ones(len(order), bool)
        new[1:] = (order[1:] != order[:-1]) | (hashed[1:] != hashed[:-1])
        self.group = np.cumsum(new, dtype=np.int32) - np.int32(1)

    def __len__(self) -> int:
        return len(self.order)

    def only(self, keep: np.ndarray) -> Level:
        return Level(self.order[keep], self.hash[keep], self.key[keep], self.mark[keep], self.start[keep])

    def find(self, order: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """Row of an equal window, or -1."""
        at = np.searchsorted(self.order, order)
        at[at == len(self)] = -1
        hit = (at >= 0) & (self.order[at] == order)
        good = hit & (self.hash[at] == hashed)
        out = np.where(good, at, -1)
        # Other windows with the same order value stand side by side; they are very rare.
        for i in np.flatnonzero(hit & ~good).tolist():
            j = int(at[i])
            while j < len(self) and self.order[j] == order[i]:
                if self.hash[j] == hashed[i]:
                    out[i] = j
                    break
                j += 1
        return out


def sorted_level(order: np.ndarray, hashed: np.ndarray, key: np.ndarray, mark: np.ndarray, start: np.ndarray, kind: str | None = None) -> Level:
    at = np.argsort(order, kind=kind)
    order, hashed, key, mark, start = order[at], hashed[at], key[at], mark[at], start[at]
    mixed_up = np.flatnonzero((order[1:] == order[:-1]) & (hashed[1:] != hashed[:-1]))
    for value in np.unique(order[mixed_up]):
        a, b = np.searchsorted(order, value, "left"), np.searchsorted(order, value, "right")
        inner = np.argsort(hashed[a:b], kind="stable")
        for column in (hashed, key, mark, start):
            column[a:b] = column[a:b][inner]
    return Level(order, hashed, key, mark, start)


class Family:
    """Levels of a bucket, and the windows found to be repeats."""

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.repeats: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def drop(self, level: Level, repeat: np.ndarray) -> Level:
        if not repeat.any():
            return level
        self.repeats.append((level.key[repeat], level.mark[repeat], level.start[repeat]))
        return level.only(~repeat)

    def add(self, batch: Level) -> None:
        smallest = np.full(int(batch.group[-1]) + 1 if len(batch) else 0, np.iinfo(np.int64).max)
        np.minimum.at(smallest, batch.group, batch.key)
        batch = self.drop(batch, batch.key > smallest[batch.group])
        for i, level in enumerate(self.levels):
            if not len(level) or not len(batch):
                continue
            at = level.find(batch.order, batch.hash)
            met = at >= 0
            other = level.key[at]
            # The smaller document keeps a window; the other one's is a repeat.
            older = np.zeros(int(level.group[-1]) + 1, bool)
            older[level.group[at[met & (other > batch.key)]]] = True
            batch = self.drop(batch, met & (other < batch.key))
            self.levels[i] = self.drop(level, older[level.group])
        if len(batch):
            self.levels.append(batch)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            b, a = self.levels.pop(), self.levels.pop()
            columns = (np.concatenate((getattr(a, c), getattr(b, c))) for c in ("order", "hash", "key", "mark", "start"))
            # A stable sort merges two ordered runs in one go.
            self.levels.append(sorted_level(*columns, kind="stable"))


def windows_of(raw: np.ndarray, key: np.ndarray, mark: np.ndarray, start: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(order, hash, key, mark, start) of all windows of stretches that lie side by side."""
    size = count + length - 1
    begin = np.cumsum(size) - size
    h = window_hash(raw, length)
    valid = np.zeros(len(raw) + 1, np.int8)
    valid[begin] += 1
    valid[begin + count] -= 1
    at = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    h = h[at]
    head = raw[at].astype(np.uint64)
    for i in (1, 2, 3):
        head = head << np.uint64(8) | raw[at + i]
    order = head << np.uint64(32) | mixed(window_hash(raw, length, BYTE_2, ODD_2)[at]) >> np.uint64(32)
    n = np.repeat(np.arange(len(key)), count)
    return order, h, key[n], mark[n], start[n] + (at - begin[n])


def places(key: np.ndarray, mark: np.ndarray, start: np.ndarray, count: np.ndarray) -> bytes:
    """The four columns byte plane by byte plane, keys by their differences: planes of zeros pack to nothing."""
    columns = (np.diff(key, prepend=0), mark, start, count)
    return b"".join(np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def unpacked(blob: bytes, size: int, zip_) -> tuple[np.ndarray, ...]:
    """(key, mark, start, count, raw) of packed stretches."""
    body = zip_(blob)
    planes = np.frombuffer(body, np.uint8, 32 * size).reshape(4, 8, size)
    key, mark, start, count = (np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes)
    return np.cumsum(key), mark, start, count, np.frombuffer(body, np.uint8, offset=32 * size)


class Marks:
    """Numbers the different marks of a bucket: windows hold four bytes instead of eight."""

    def __init__(self) -> None:
        self.number: dict[int, int] = {}

    def numbers(self, mark: np.ndarray) -> np.ndarray:
        values, which = np.unique(mark, return_inverse=True)
        return np.array([self.number.setdefault(v, len(self.number)) for v in values.tolist()], np.int32)[which]

    def values(self, number: np.ndarray) -> np.ndarray:
        return np.array(list(self.number), np.int64)[number]


def bucket_repeats(blobs: list[tuple[bytes, int, int]], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, mark, start) of the repeated windows of a bucket; blobs are (packed, stretches, windows)."""
    zip_ = zstandard.ZstdDecompressor().decompress
    passes = -(-sum(n for _, _, n in blobs) // PASS_WINDOWS)
    for part in range(passes):
        family, marks, held, waiting = Family(), Marks(), [], 0
        for i, (blob, size, _) in enumerate(blobs):
            key, mark, start, count, raw = unpacked(blob, size, zip_)
            columns = windows_of(raw, key, marks.numbers(mark), start, count, length)
            if passes > 1:
                own = mixed(columns[1]) % np.uint64(passes) == part
                columns = tuple(c[own] for c in columns)
            held.append(columns)
            waiting += len(columns[0])
            if waiting >= BATCH_WINDOWS or i == len(blobs) - 1:
                if waiting:
                    family.add(sorted_level(*(np.concatenate(c) for c in zip(*held))))
                held, waiting = [], 0
        for key, mark, start in family.repeats:
            yield key, marks.values(mark), start


def repeat_spans(docs: DataFrame, key: str, text: str, length: int = 50) -> DataFrame:
    """(key, mark, spans): the bytes covered by ``length``-byte strings that also start in a document with a smaller key.

    Texts count as UTF-8 bytes, null ones as empty; no string reaches from one document
    into the next.  Spans are (first byte, byte behind the last), sorted, and neither
    overlap nor touch.  Documents without any are not in the result; null keys neither
    have nor cause repeats.  Keys are integers and tell documents apart.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt_stretches(docs, key, text, length, buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdDecompressor().decompress
        for table in key_runs(batches, "bucket"):
            if table is None or not table.num_rows:
                continue
            bounds = table.column("bucket").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(bounds)) + 1, [len(bounds)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = table.slice(a, b - a)
                windows, known, sizes, blobs = (own.column(c) for c in ("windows", "known", "size", "blob"))
                fresh = []
                for n, again, size, blob in zip(windows.to_pylist(), known.to_pylist(), sizes.to_pylist(), blobs):
                    if again:
                        k, m, s, c, _ = unpacked(blob.as_py(), size, zip_)
                        yield _spans(k, m, s, s + c + length - 1)
                    else:
                        fresh.append((blob.as_py(), size, n))
                found = list(bucket_repeats(fresh, length))
                if found:
                    k, m, s = (np.concatenate(x) for x in zip(*found))
                    order = np.lexsort((s, m, k))
                    k, m, s = k[order], m[order], s[order]
                    new = np.concatenate(([True], (k[1:] != k[:-1]) | (m[1:] != m[:-1]) | (s[1:] > s[:-1] + length)))
                    begin = np.flatnonzero(new)
                    yield _spans(k[begin], m[begin], s[begin], s[np.append(begin[1:], len(s)) - 1] + length)

    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "low")
    parts = ordered.mapInArrow(run, "key bigint, mark bigint, first bigint, end bigint")
    listed = parts.groupBy("key", "mark").agg(F.collect_list(F.struct("first", "end")).alias("parts"))

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = []
            for own in batch.column(2):
                first, end = (own.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                spans.append([{"first": int(a), "end": int(b)} for a, b in zip(*merged(first, end, 0))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], ["key", "mark", "spans"])

    return listed.mapInArrow(join, "key bigint, mark bigint, spans array<struct<first:bigint,end:bigint>>")


def _spans(key: np.ndarray, mark: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, mark, first, end)], ["key", "mark", "first", "end"])


def remove_repeats(docs: DataFrame, key: str, text: str, length: int = 50, keep_text: bool = True) -> DataFrame:
    """(key, kept, n_bytes, n_removed, n_spans, kept_sha256) of every row; see :func:`repeat_spans`."""
    return remove_spans(docs, repeat_spans(docs, key, text, length), key, text, keep_text)
