"""Mixing sources to target weights in fixed-length blocks of words.

Every source's documents are packed, one after the other, into blocks of a fixed number of
words.  Output shards have a fixed number of slots; each shard draws how many slots every
source gets, and the slots of a source run through a pseudorandom permutation of its block
numbers, pass after pass.  Slots and blocks meet by an equality join on the block number.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.session import cut_lineage

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: Parts of a source whose words are numbered side by side.
PARTS = 8192


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Plan:
    """Sources in code-point order, null last; sizes, targets, block lengths and planned block slots of each."""

    sources: tuple[str | None, ...]
    sizes: tuple[int, ...]
    targets: tuple[float, ...]
    slots: tuple[int, ...]
    lengths: tuple[int, ...]

    @property
    def blocks(self) -> list[int]:
        return [-(-size // length) for size, length in zip(self.sizes, self.lengths)]


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets in proportion to the weights that add up to ``share`` of all sizes.

    A target stops at ``most`` times its source's size, and the excess is shared again by
    weight among the others until none is above (or all have stopped).
    """
    total = share * sum(sizes)
    targets, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    stopped = 0.0
    while open_:
        left = total - stopped
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in above:
            targets[i] = float(most * sizes[i])
        if not above:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        stopped += sum(targets[i] for i in above)
        gone = set(above)
        open_ = [i for i in open_ if i not in gone]
    return targets


def make_plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: int, block: int) -> Plan:
    """The plan for (key, source, size) rows; one row per source reaches the driver.

    ``weights`` repeat over the sources in code-point order, null last.  A source has blocks
    of ``block`` words, or shorter ones if it has fewer than that many blocks: then half a
    block is under a hundredth of it, and its target can be met.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"] or 0) for r in rows]
    own = [float(weights[i % len(weights)]) for i in range(len(rows))]
    targets = water_fill(sizes, own, share, most)
    lengths = [min(block, max(1, -(-s // block))) for s in sizes]
    counts = [-(-s // n) for s, n in zip(sizes, lengths)]
    slots = [min(most * b, round(t / s * b)) if s else 0 for s, t, b in zip(sizes, targets, counts)]
    return Plan(tuple(r["source"] for r in rows), tuple(sizes), tuple(targets), tuple(slots), tuple(lengths))


def draw_shards(plan: Plan, shard_slots: int, seed: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """(shard, source number, first slot of the source, slots) of each output shard.

    A shard draws multinomial counts with chances in proportion to the slots that each
    source has left.  What a source hasn't left goes to those that have most left, so the
    totals meet the plan and no block is taken more often than planned.
    """
    left = np.array(plan.slots, np.int64)
    first = np.zeros_like(left)
    shard = 0
    while (total := int(left.sum())) > 0:
        n = min(shard_slots, total)
        counts = np.random.default_rng([seed, shard]).multinomial(n, left / total)
        counts = np.minimum(counts, left)
        short = n - int(counts.sum())
        for i in np.argsort(counts - left, kind="stable"):
            more = min(short, int(left[i] - counts[i]))
            counts[i] += more
            short -= more
        yield [(shard, int(i), int(first[i]), int(counts[i])) for i in np.flatnonzero(counts)]
        first += counts
        left -= counts
        shard += 1


def permuted(index: np.ndarray, n: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for every salt, applied to each index.

    Four Feistel rounds over the next even number of bits; results beyond n walk on.
    """
    half = np.array([max(1, (max(int(x) - 1, 1).bit_length() + 1) // 2) for x in np.unique(n)], np.uint64)
    half = half[np.searchsorted(np.unique(n), n)]
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    size = n.astype(np.uint64)
    while len(todo):
        a, b = out[todo] >> half[todo], out[todo] & low[todo]
        for r in range(4):
            mixed = (b + salt[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(32)
            a, b = b, (a ^ mixed) & low[todo]
        out[todo] = (a << half[todo]) | b
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Mix:
    """The mix: its plan, the slots, and the pieces of documents in each block."""

    plan: Plan
    #: shard, slot, source_no, pass, block
    slots: DataFrame
    #: source_no, block, row, first (word of the document), words
    pieces: DataFrame
    #: row, key, source, size, source_no
    sized: DataFrame


def mix(
    docs: DataFrame,
    key: str,
    text: str,
    source: str,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    block: int = 64,
    shard_slots: int = 16_384,
    seed: int = 7,
    row: str | None = None,
) -> Mix:
    """Mixes the sources of ``docs`` to the targets of :func:`water_fill`.

    Null texts have no words and null sources are one source.  Documents are packed in
    the order of a hash of their key (equal keys next to each other), so reruns agree.
    ``block`` bounds how far a source may miss its target: half a block, or, of a source of
    fewer blocks than words in one, a hundredth of it.  A block is
    taken at most ``most`` times, and so is each word.  ``row`` names a column that numbers
    the rows, if there is one.
    """
    # Rows with equal keys are ordered by their texts' hash; the row number, fixed once
    # written, only tells equal rows apart.
    sized = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(text).alias("tie"),
    )
    sized = cut_lineage(sized)
    plan = make_plan(sized, weights, share, most, block)
    spark = docs.sparkSession
    numbers = spark.createDataFrame(
        [(s, i, n) for i, (s, n) in enumerate(zip(plan.sources, plan.lengths))], "source string, source_no int, length int"
    )
    sized = sized.join(F.broadcast(numbers), sized["source"].eqNullSafe(numbers["source"])).select(
        "row", "key", sized["source"], "size", "tie", "source_no", "length"
    )
    return Mix(plan, _slots(spark, plan, shard_slots, seed), _pieces(sized), sized)


def _pieces(sized: DataFrame) -> DataFrame:
    """Each document's words in the blocks of its source.

    Parts of a source are numbered side by side; the parts' totals, at most ``PARTS`` a
    source, give where each begins.
    """
    parted = sized.where("size > 0").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    totals = parted.groupBy("source_no", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("source_no", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("source_no", "part").orderBy("key", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = parted.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(begins, ["source_no", "part"])
    placed = placed.withColumn("at", F.col("begin") + F.col("ahead"))
    number = F.explode(F.sequence(F.expr("at div length"), F.expr("(at + size - 1) div length"))).alias("block")
    cut = placed.select("source_no", "row", "at", "size", "length", number)
    first = F.greatest(F.lit(0), F.col("block") * F.col("length") - F.col("at"))
    last = F.least(F.col("size"), (F.col("block") + 1) * F.col("length") - F.col("at"))
    return cut.select("source_no", "block", "row", first.alias("first"), (last - first).alias("words"))


def _slots(spark, plan: Plan, shard_slots: int, seed: int) -> DataFrame:
    """One row per slot; the driver holds a row per shard and source at most."""
    drawn = [row for shard in draw_shards(plan, shard_slots, seed) for row in shard]
    blocks = plan.blocks
    rows = spark.createDataFrame(
        [(shard, no, first, n, blocks[no]) for shard, no, first, n in drawn],
        "shard int, source_no int, begin bigint, n bigint, blocks bigint",
    )
    tasks = max(1, math.ceil(len(drawn) / 64))
    each = rows.repartition(tasks, "shard", "source_no").select(
        "shard", "source_no", "blocks", F.explode(F.sequence("begin", F.expr("begin + n - 1"))).alias("j")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, no, size, j = (c.to_numpy() for c in batch.columns)
            turn = j // size
            # Every pass over a source has a permutation of its own.
            at = permuted(j % size, size, no.astype(np.int64) * 1_000_003 + turn * 7919 + seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(no), pa.array(j), pa.array(turn), pa.array(at)], ["shard", "source_no", "slot", "turn", "block"]
            )

    return each.mapInArrow(run, "shard int, source_no int, slot bigint, turn bigint, block bigint")


def taken_words(mixed: Mix) -> DataFrame:
    """(key, source, source_no, size, taken): the words of each document that the mix takes, repeats counted."""
    # Slots come from a small table and grow with the corpus; Spark would take them for small.
    times = mixed.slots.groupBy("source_no", "block").agg(F.count("*").alias("times")).hint("merge")
    taken = (
        mixed.pieces.join(times, ["source_no", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    )
    return mixed.sized.join(taken.hint("merge"), "row", "left").select(
        "key", "source", "source_no", "size", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def _taken_pieces(mixed: Mix) -> DataFrame:
    """(row, turn, pieces) for each pass of the mix over a document that takes some of it.

    A document has at most as many pieces as words, so its list is bounded.
    """
    met = mixed.pieces.join(mixed.slots.select("source_no", "block", "turn").hint("merge"), ["source_no", "block"])
    return met.groupBy("row", "turn").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("pieces"))


def mixed_documents(mixed: Mix, docs: DataFrame, row: str, text: str, n_chars: str) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, one row for each pass that takes a part.

    ``text`` holds the words taken, in order and with the white space between neighbours
    (the whole text, where all of it is taken), and ``n_chars`` its length; the other
    columns are kept, but ``row``, which numbers the rows for :func:`mix`.
    """
    rest = [c for c in docs.columns if c not in (row, text, n_chars)]
    names = [c for c in docs.columns if c != row]
    known = docs.select(F.col(row).alias("row"), F.col(text).alias("text"), F.struct(*rest).alias("rest"))
    joined = known.join(_taken_pieces(mixed).hint("merge"), "row").select("rest", "text", "pieces")
    schema = StructType(
        [StructField("rest", joined.schema["rest"].dataType), StructField("text", StringType()), StructField("n_chars", LongType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [taken_text(t.as_py(), p.as_py()) for t, p in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["rest", "text", "n_chars"]
            )

    out = joined.mapInArrow(run, schema)
    kinds = dict(docs.dtypes)
    column = {text: F.col("text"), n_chars: F.col("n_chars").cast(kinds.get(n_chars, "long"))}
    return out.select(*(column.get(c, F.col("rest").getField(c)).alias(c) for c in names))


def taken_text(text: str, pieces: list[dict]) -> str:
    """The words of sorted pieces; neighbours keep the white space between them."""
    spans = [m.span() for m in WORDS.finditer(text)]
    if sum(p["words"] for p in pieces) == len(spans):
        return text
    runs: list[list[int]] = []
    for p in pieces:
        if runs and runs[-1][1] == p["first"]:
            runs[-1][1] += p["words"]
        else:
            runs.append([p["first"], p["first"] + p["words"]])
    return " ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)
