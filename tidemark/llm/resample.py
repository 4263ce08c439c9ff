"""Target-distribution importance resampling: draw the documents that look most like a target.

Texts are bags of hashed word n-grams.  An array holds, per hash bucket, how much more
frequent the bucket is in the target than in the corpus; a document's weight is the sum of
the array over its features.  A seeded Gumbel number per document turns the highest scores
into a draw without replacement.

The cutoff of the draw is found by a weighted median of medians: every partition tells the
median of its remaining keys and how many it has, the median of those medians, weighted by the
sizes, splits the keys, and the side without the cutoff, at least about a quarter, is
discarded.  Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices_of, text_buffers
from tidemark.llm.words import LETTERS_DIGITS, LOWER, texts_of, word_bounds
from tidemark.operators.ranking import bucketed_rank, with_range_bucket
from tidemark.session import cut_lineage

#: Text bytes whose features are hashed at once.
SLICE_BYTES = 2 << 20
#: Longer words are hashed one by one.
LONG_WORD = 64
#: So many remaining keys are sorted instead of divided further.
FEW_KEYS = 4096

_ALL = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def continued(register: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, by_length: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of one word each; ``by_length`` orders the words from the longest."""
    out = register[by_length]
    at, size = starts[by_length], lengths[by_length]
    long = int(np.searchsorted(-size, -LONG_WORD, side="left"))
    for i in range(long):
        out[i] = zlib.crc32(raw[at[i] : at[i] + size[i]].tobytes(), int(out[i] ^ _ALL)) ^ 0xFFFFFFFF
    alive = np.searchsorted(-size[long:], -np.arange(LONG_WORD), side="left")
    part, at = out[long:], at[long:]
    for t, k in enumerate(alive.tolist()):
        if not k:
            break
        part[:k] = CRC[(part[:k] ^ raw[at[:k] + t]) & np.uint32(255)] ^ (part[:k] >> np.uint32(8))
    back = np.empty_like(out)
    back[by_length] = out
    return back


def features(raw: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every feature and the number of words by text.

    A feature is a run of 1 to ``longest`` neighbouring words of a text, joined by one space;
    its bucket is the CRC-32 of its bytes modulo ``buckets``.
    """
    raw = LOWER[raw]
    starts, lengths = word_bounds(raw, offsets, LETTERS_DIGITS)
    text = texts_of(starts, offsets)
    words = np.bincount(text, minlength=len(offsets) - 1)
    by_length = np.argsort(-lengths, kind="stable")
    nth = np.arange(len(starts)) - (np.cumsum(words) - words)[text]
    found, owners = [], []
    register = np.full(len(starts), _ALL, np.uint32)
    for n in range(longest):
        if n:
            # The run that ends at the word before, and a space.
            before = np.concatenate((register[:1], register[:-1]))
            register = CRC[(before ^ np.uint32(32)) & np.uint32(255)] ^ (before >> np.uint32(8))
        register = continued(register, raw, starts, lengths, by_length)
        whole = nth >= n
        found.append(((register[whole] ^ _ALL) % np.uint32(buckets)).astype(np.int64))
        owners.append(text[whole])
    return np.concatenate(found), np.concatenate(owners), words


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Features of all rows by bucket: ``buckets`` numbers, whatever the table's size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for a, b in slices_of(offsets, SLICE_BYTES):
                found, _, _ = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], longest, buckets)
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    parts = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio) of the target's and the corpus' share, by bucket."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    pairs = zip(corpus.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in pairs], np.int64)


def weighed(docs: DataFrame, key: str, text: str, gain: np.ndarray, longest: int) -> DataFrame:
    """(key, n_words, n_features, weight) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            n = batch.num_rows
            words, count, weight = (np.zeros(n, np.int64) for _ in range(3))
            for a, b in slices_of(offsets, SLICE_BYTES):
                found, text, words[a:b] = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], longest, len(gain))
                count[a:b] = np.bincount(text, minlength=b - a)
                order = np.argsort(text, kind="stable")
                summed = np.concatenate(([0], np.cumsum(gain[found[order]])))
                ends = np.cumsum(count[a:b])
                weight[a:b] = summed[ends] - summed[ends - count[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, count, weight))], ["key", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel number) from the first 32 bits of sha256(seed:key)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


@dataclass(frozen=True)
class Cutoff:
    """The last key drawn, in drawing order: score downwards, null keys last, key, row number."""

    place: tuple[int, int, int, int]

    def drawn(self) -> Column:
        """True for rows up to the cutoff."""
        return drawing_place() <= F.struct(*(F.lit(x).cast("long") for x in self.place))


def drawing_place() -> Column:
    """A row's place in drawing order; unique by its row number."""
    named = {"a": -F.col("score"), "b": F.col("key").isNull().cast("long"), "c": F.coalesce("key", F.lit(0).cast("long")), "d": F.col("row")}
    return F.struct(*(column.alias(name) for name, column in named.items()))


def cutoff(scored: DataFrame, wanted: int) -> Cutoff | None:
    """The exact ``wanted``-th key of a written table of (key, score, row), by weighted medians of medians.

    A round reads the remaining keys twice, for the partitions' medians and to count what
    lies on either side; the rest is written anew whenever it has halved, so all rounds
    together read a few times the keys.  The driver gets one row per partition.
    """
    if wanted < 1:
        return None

    def medians(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            columns = [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            order = np.lexsort(columns[::-1])
            middle = order[(len(order) - 1) // 2]
            out = [pa.array([int(c[middle])], pa.int64()) for c in columns] + [pa.array([len(order)], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "c", "d", "n"])

    names = ["a", "b", "c", "d"]
    rest = cut_lineage(scored.select(drawing_place().alias("p")).select("p.*"))
    place = F.struct(*names)
    written = left = None
    while True:
        found = sorted(tuple(r) for r in rest.mapInArrow(medians, "a bigint, b bigint, c bigint, d bigint, n bigint").collect())
        left = sum(r[4] for r in found)
        written = written or left
        if left <= FEW_KEYS:
            return Cutoff(sorted(tuple(r) for r in rest.collect())[wanted - 1])
        reached = np.cumsum([r[4] for r in found])
        pivot = found[int(np.searchsorted(reached, (left + 1) // 2))][:4]
        upto = place <= F.struct(*(F.lit(x).cast("long") for x in pivot))
        below = rest.where(upto).count()
        if below == wanted:
            return Cutoff(pivot)
        if wanted < below:
            rest, left = rest.where(upto), below
        else:
            rest, left, wanted = rest.where(~upto), left - below, wanted - below
        if 2 * left <= written:
            rest, written = cut_lineage(rest), left


def resample(
    docs: DataFrame, target: DataFrame, key: str, text: str, target_text: str, percent: int = 5, least_words: int = 20,
    longest: int = 3, buckets: int = 10_000, seed: int = 42,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of ``docs``.

    ``rank`` numbers the drawn rows from 1: of the N rows of at least ``least_words`` words
    the floor(percent * N / 100) with the highest scores, equal scores by the smaller key.
    Words are lower-cased in ASCII alone; ``weight`` sums the gains of all features.

    Null texts have no words, so weight 0, and are never drawn.  Keys are integers; rows with
    a null key come last among equal scores, and rows that share a key are ranked each, equal
    ones in the order they were read.  With an empty target or corpus all gains come from
    the smoothing; an empty corpus gives no rows.  Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    found = weighed(docs, key, text, gain, longest)
    scored = found.withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)).withColumn("row", F.monotonically_increasing_id())
    scored = cut_lineage(scored)
    eligible = F.col("n_words") >= least_words
    wanted = percent * scored.where(eligible).count() // 100
    last = cutoff(scored.where(eligible), wanted)
    if last is None:
        return scored.drop("row").withColumn("rank", F.lit(None).cast("long"))
    drawn = eligible & last.drawn()
    winners = scored.where(drawn).withColumn("place", drawing_place())
    ranked = bucketed_rank(with_range_bucket(winners, ["place"], out="part"), ["place"], F.col("part"))
    losers = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("place", "part", "row").unionByName(losers.drop("row"))


def drawn_documents(docs: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` that were drawn, with their ``rank``; keys must be unique and not null."""
    ranks = ranked.where("rank IS NOT NULL").select(F.col("key").alias("_drawn"), "rank")
    return docs.drop("rank").join(ranks, docs[key] == ranks["_drawn"]).drop("_drawn")
