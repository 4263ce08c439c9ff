"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over windows of words ignore some positions, so a window keeps its hash when
ignored words are replaced.  Hashes of the training texts are joined with those of the
test items; around each hit, text and item are compared word by word along the diagonal,
and the longest stretch with enough equal words counts as an overlap.

Almost no window of a training text has a hash of the test set.  A Bloom filter of fixed
size, whatever the test set, drops the others where the texts are read; what passes is
joined exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_filter, passing, slices_of, text_buffers
from tidemark.session import cut_lineage

#: 1 marks a position that counts.  Every mask spans fewer words than the shortest overlap.
MASKS = ("110101011", "1110010101", "11001011001", "101100100111")
#: Gain of a mismatch against 1 of a match, so that just the stretches with a gain have over 0.8 equal words.
MISMATCH = -4

WORK_BYTES = 4 << 20
#: Bytes that separate words after lower-casing, and those that are ignored.
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit value per word: ASCII punctuation is ignored, white space separates."""
    words = text.translate(None, _PUNCTUATION).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mask_offsets(short: list[int]) -> list[np.ndarray]:
    """Counting positions of each mask, then whole windows for items shorter than a mask."""
    spaced = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]
    return spaced + [np.arange(n) for n in short]


SPANS = [len(m) for m in MASKS]


def window_hashes(words: np.ndarray, offsets: np.ndarray, span: int, number: int) -> np.ndarray:
    """Hash of the counting words of every window."""
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15 * (number + 1) & 0xFFFFFFFFFFFFFFFF))
    for o in offsets.tolist():
        out ^= words[o : o + n]
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out


def test_index(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame, list[int], int]:
    """(hashes: item, pos, mask, h; items: item, words; short lengths; words of the longest item)."""
    shortest = max(SPANS)
    chosen = benchmark.select(F.col(item).alias("item"), F.lower(F.col(text)).alias("text"))
    kind = chosen.schema["item"].dataType.simpleString()

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [word_hashes((t.as_py() or "").encode()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["item", "words"])

    items = cut_lineage(chosen.mapInArrow(words, f"item {kind}, words array<bigint>").where("size(words) > 0"))
    sizes = items.groupBy(F.least(F.size("words"), F.lit(100 * shortest)).alias("n")).count().collect()
    # At most as many lengths as the longest mask has positions.
    short = sorted(r["n"] for r in sizes if r["n"] < shortest)
    longest = items.agg(F.max(F.size("words")).alias("n")).first()["n"] or 0
    offsets, spans = mask_offsets(short), SPANS + short

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, mask, h = [], [], [], []
            for row, own in enumerate(batch.column(1)):
                values = own.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for k, (o, span) in enumerate(zip(offsets, spans)):
                    if k >= len(MASKS) and len(values) != span:
                        continue
                    got = window_hashes(values, o, span, k)
                    rows.append(np.full(len(got), row)), pos.append(np.arange(len(got)))
                    mask.append(np.full(len(got), k)), h.append(got)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, pos, mask, h)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(flat[0].astype(np.int64))), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32)), pa.array(flat[3].astype(np.uint64).view(np.int64))],
                ["item", "pos", "mask", "h"],
            )

    found = cut_lineage(items.mapInArrow(hashes, f"item {kind}, pos int, mask int, h bigint"))
    return found, items, short, longest


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str,
    text: str,
    item: str,
    item_text: str,
    min_words: int = 13,
) -> DataFrame:
    """(key, item, words, equal, first, item_words): the longest overlap of each document with each test item it meets.

    Words are compared in lower case, without ASCII punctuation.  An overlap is a stretch
    of ``words`` positions of a text and an item side by side, from word ``first`` of the
    text on, of which ``equal``, over 0.8 of them, agree, wherever in the stretch the others
    are; it has at least ``min_words`` words, or all words of an item with fewer.  Items with fewer words than a mask must
    occur unchanged.  Null and empty texts and items overlap with nothing.  Rows of
    documents or items that share a key give one row per pair of keys; null keys give none.
    """
    spark = docs.sparkSession
    tests, items, short, longest = test_index(benchmark, item, item_text)
    bits = spark.sparkContext.broadcast(hash_filter(tests, "h"))
    offsets, spans = mask_offsets(short), SPANS + short
    reach = longest + max(SPANS)
    chosen = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text"))
    kind, item_kind = chosen.schema["key"].dataType.simpleString(), items.schema["item"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows for each stretch of a text around windows that passed: its words and their hashes."""
        for batch in batches:
            raw, bounds = text_buffers(batch.column(1))
            for a, b in slices_of(bounds, WORK_BYTES):
                rows, begins, contexts, hits = [], [], [], []
                own = [word_hashes(raw[bounds[i] : bounds[i + 1]].tobytes()) for i in range(a, b)]
                sizes = np.array([len(w) for w in own], np.int64)
                flat = np.concatenate(own)
                start = np.cumsum(sizes) - sizes
                found = []
                for k, (o, span) in enumerate(zip(offsets, spans)):
                    h = window_hashes(flat, o, span, k)
                    at = passing(bits.value, h)
                    doc = np.searchsorted(start, at, side="right") - 1
                    inside = at + span <= start[doc] + sizes[doc]
                    found.append((doc[inside], at[inside] - start[doc[inside]], np.full(int(inside.sum()), k), h[at[inside]]))
                doc, pos, mask, h = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((pos, doc))
                doc, pos, mask, h = doc[order], pos[order], mask[order], h[order]
                new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > 2 * reach))) if len(doc) else np.zeros(0, bool)
                cuts = np.append(np.flatnonzero(new), len(doc))
                for c, d in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    i = int(doc[c])
                    low, high = max(0, int(pos[c]) - reach), int(pos[d - 1]) + reach
                    rows.append(a + i), begins.append(low)
                    contexts.append(own[i][low:high].view(np.int64))
                    hits.append([{"h": int(x), "mask": int(m), "at": int(p)} for x, m, p in zip(h[c:d].view(np.int64), mask[c:d], pos[c:d])])
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(rows, pa.int64())),
                            pa.array(begins, pa.int64()),
                            pa.array(contexts, pa.list_(pa.int64())),
                            pa.array(hits, pa.list_(pa.struct([("h", pa.int64()), ("mask", pa.int32()), ("at", pa.int64())]))),
                        ],
                        ["key", "low", "context", "hits"],
                    )

    schema = f"key {kind}, low bigint, context array<bigint>, hits array<struct<h:bigint,mask:int,at:bigint>>"
    stretches = cut_lineage(chosen.mapInArrow(scan, schema).withColumn("id", F.monotonically_increasing_id()))
    hits = stretches.select("id", F.explode("hits").alias("hit")).select("id", "hit.h", "hit.mask", "hit.at")
    met = hits.join(tests, ["h", "mask"]).select("id", "item", (F.col("at") - F.col("pos")).alias("diagonal")).distinct()
    sides = met.groupBy("id", "item").agg(F.sort_array(F.collect_set("diagonal")).alias("diagonals"))
    pairs = sides.join(stretches.select("id", "key", "low", "context"), "id").join(items, "item")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row in range(batch.num_rows):
                context, words = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in (3, 4))
                low = batch.column(2)[row].as_py()
                best = max(stretch(context, words, d - low) for d in batch.column(5)[row].as_py())
                if best[0] >= min(min_words, len(words)):
                    rows.append(row)
                    out.append((best[0], best[1], low + best[2], len(words)))
            columns = list(zip(*out)) if out else [()] * 4
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, pa.int64()) for c in columns)],
                ["key", "item", "words", "equal", "first", "item_words"],
            )

    shaped = pairs.select("key", "item", "low", "context", "words", "diagonals")
    found = shaped.mapInArrow(verify, f"key {kind}, item {item_kind}, words bigint, equal bigint, first bigint, item_words bigint")
    best = F.max(F.struct("words", "equal", (-F.col("first")).alias("early"), "item_words")).alias("best")
    return found.where("item IS NOT NULL").groupBy("key", "item").agg(best).select(
        "key", "item", "best.words", "best.equal", (-F.col("best.early")).alias("first"), "best.item_words"
    )


def stretch(context: np.ndarray, words: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(positions, equal, first) of the longest stretch of an item laid at ``shift`` with over 0.8 equal words."""
    a, b = max(0, -shift), min(len(words), len(context) - shift)
    if a >= b:
        return 0, 0, 0
    equal = context[a + shift : b + shift] == words[a:b]
    gain = np.concatenate(([0], np.cumsum(np.where(equal, 1, MISMATCH))))
    # For each start the last end with more gain: the greatest gain of all later ends falls from end to end.
    most = np.maximum.accumulate(gain[::-1])[::-1]
    ends = np.searchsorted(-most, -gain) - 1
    starts = np.arange(len(gain))
    size = int((ends - starts).max())
    if size <= 0:
        return 0, 0, 0
    # Of the longest the one with the most equal words, and of these the first.
    starts = np.flatnonzero(ends - starts == size)
    start = int(starts[(gain[starts + size] - gain[starts]).argmax()])
    return size, int(equal[start : start + size].sum()), a + start + shift


def decontaminate(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose key has no overlap; rows with a null key stay."""
    hit = found.select(F.col("key").alias("_hit")).distinct()
    return docs.join(hit, docs[key] == hit["_hit"], "left_anti")
