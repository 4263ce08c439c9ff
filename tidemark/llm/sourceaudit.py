"""Source divergence audit: how differently the sources of a language use its words.

Terms are counted by a token-start pointer sort.  A task lays pointers to the word starts of
an Arrow buffer, sorts them by multikey quicksort, eight bytes a level, and reads document
frequency and counts by source off the runs of equal words.  Spark merges the runs of all
slices; terms that too few documents of a language hold are dropped only after that.

A group's share of a term is smoothed and scaled to an integer; groups are compared by the
sum of absolute differences over all kept terms.  All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import run_bounds, slices_of, text_buffers
from tidemark.llm.words import LETTERS, LOWER, texts_of, word_bounds
from tidemark.session import cut_lineage

#: Text bytes whose words are sorted at once.
SLICE_BYTES = 4 << 20
#: Sources of a language that one dense block of the comparison holds.
TILE = 256
#: Shares are integers, in parts of this.
SCALE = 1_000_000_000

#: Keeps the first k bytes of eight.
HEAD = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], np.uint64)


def equal_runs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pointers in the byte order of their words, first place of each run of equal words).

    A level compares the next eight bytes of all runs still open, which are those of several
    words that go on; words hold no zero byte, so a shorter word precedes its extensions.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(8, np.uint8))), 8)

    def keys(pointers: np.ndarray, depth: int) -> np.ndarray:
        at = np.minimum(starts[pointers] + depth, len(raw))
        left = np.clip(lengths[pointers] - depth, 0, 8)
        return np.ascontiguousarray(eight[at]).view(">u8").ravel().astype(np.uint64) & HEAD[left]

    key = keys(np.arange(len(starts)), 0)
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    places, run, depth = np.arange(len(order)), np.cumsum(new), 8
    while True:
        begins = run_bounds(run)
        size = np.diff(begins)
        still = np.repeat(size > 1, size) & ((key & np.uint64(255)) != 0)
        if not still.any():
            return order, np.flatnonzero(new)
        places, run = places[still], run[still]
        key = keys(order[places], depth)
        within = np.lexsort((key, run))
        order[places], key = order[places[within]], key[within]
        differs = np.concatenate(([True], (key[1:] != key[:-1]) | (run[1:] != run[:-1])))
        new[places] = differs
        run = np.cumsum(differs)
        depth += 8


def grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes in order, first place of each in the sorted codes and the length)."""
    codes = np.sort(codes)
    bounds = run_bounds(codes)
    return codes[bounds[:-1]], bounds


def slice_counts(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, count, document count) of the words of a slice; ``group`` is by text."""
    raw = LOWER[raw]
    starts, lengths = word_bounds(raw, offsets, LETTERS)
    order, firsts = equal_runs(raw, starts, lengths)
    texts, groups = len(offsets) - 1, int(group.max(initial=0)) + 1
    text_of = texts_of(starts, offsets)
    term_of = np.zeros(len(order), np.int64)
    term_of[firsts[1:]] = 1
    pairs, bounds = grouped(np.cumsum(term_of) * texts + text_of[order])
    term, text = pairs // max(texts, 1), pairs % max(texts, 1)
    cells = term * groups + group[text]
    by = np.argsort(cells, kind="stable")
    edges = run_bounds(cells[by])
    count = np.add.reduceat(np.diff(bounds)[by], edges[:-1]) if len(pairs) else np.zeros(0, np.int64)
    cell = cells[by][edges[:-1]] if len(pairs) else np.zeros(0, np.int64)
    at, size = starts[order[firsts]], lengths[order[firsts]]
    ends = np.concatenate(([0], np.cumsum(size)))
    spots = np.arange(ends[-1]) + np.repeat(at - ends[:-1], size)
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw[spots]))
    return words.take(pa.array(cell // groups)), cell % groups, count, np.diff(edges)


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows of each term by group, merged over all slices.

    Null texts, languages and sources are ``''``.  Every group has a row with the term
    ``''``, whether its texts have words or not.
    """
    rows = docs.select(
        F.col(text).cast("string").alias("text"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, sources = (batch.column(i).dictionary_encode() for i in (1, 2))
            code = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            seen, group = np.unique(code, return_inverse=True)
            lang_of, source_of = pa.array(seen // len(sources.dictionary)), pa.array(seen % len(sources.dictionary))
            raw, offsets = text_buffers(batch.column(0))
            none = np.zeros(len(seen), np.int64)
            made = [(pa.array([""] * len(seen), pa.string()), np.arange(len(seen)), none, none)]
            for a, b in slices_of(offsets, SLICE_BYTES):
                made.append(slice_counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], group[a:b]))
            for term, own, n, found in made:
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(lang_of.take(own)), sources.dictionary.take(source_of.take(own)), term, pa.array(n), pa.array(found)],
                    ["lang", "source", "term", "n", "docs"],
                )

    parts = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str | Column, total: str, terms: str, smooth: int) -> Column:
    """1 + floor(SCALE * (count + smooth) / (total + smooth * terms)), exact."""
    count = F.col(count) if isinstance(count, str) else count
    above = (count + smooth).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    below = (F.col(total) + smooth * F.col(terms)).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", above, below)


def block_sums(terms: DataFrame) -> DataFrame:
    """(lang, a, b, value) summed absolute differences of the shares of sources a < b.

    ``terms`` has (lang, zeros, at, shares): one row per kept term of a language, where
    ``zeros`` holds the shares of all its sources without an occurrence, ``at`` the places of
    those with some and ``shares`` their shares.  A row is dealt to each pair of source
    tiles, so what a task holds does not grow with the number of sources.
    """
    tiles = F.sequence(F.lit(0), F.expr(f"(size(zeros) - 1) div {TILE}").cast("int"))
    dealt = terms.select("*", F.explode(tiles).alias("i")).select("*", F.explode(F.expr(f"sequence(i, cast((size(zeros) - 1) div {TILE} as int))")).alias("j"))

    def part(tile: str) -> list[Column]:
        inside = f"filter(arrays_zip(at, shares), x -> x.at div {TILE} = {tile})"
        return [
            F.expr(f"slice(zeros, {tile} * {TILE} + 1, {TILE})").alias(f"zeros_{tile}"),
            F.expr(f"transform({inside}, x -> cast(x.at - {tile} * {TILE} as int))").alias(f"at_{tile}"),
            F.expr(f"transform({inside}, x -> x.shares)").alias(f"shares_{tile}"),
        ]

    slim = dealt.select("lang", F.col("i").cast("int"), F.col("j").cast("int"), *part("i"), *part("j"))

    def dense(batch: pa.RecordBatch, first: int, rows: np.ndarray) -> np.ndarray:
        zeros, at, shares = (batch.column(first + k).take(pa.array(rows)) for k in range(3))
        out = np.tile(zeros[0].values.to_numpy(), (len(rows), 1))
        row = np.repeat(np.arange(len(rows)), pc.list_value_length(at).to_numpy(zero_copy_only=False))
        out[row, at.flatten().to_numpy()] = shares.flatten().to_numpy()
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), sums in held.items():
                a, b = np.nonzero(sums >= 0)
                keep = a + i * TILE < b + j * TILE
                a, b = a[keep], b[keep]
                cols = [pa.array([lang] * len(a), pa.string()), pa.array(a + i * TILE), pa.array(b + j * TILE), pa.array(sums[a, b])]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "a", "b", "value"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column(0).dictionary_encode()
            where = np.stack([langs.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            cells, own = np.unique(where, axis=1, return_inverse=True)
            for c in range(cells.shape[1]):
                rows = np.flatnonzero(own.ravel() == c)
                left, right = dense(batch, 3, rows), dense(batch, 6, rows)
                sums = np.stack([np.abs(right - left[:, x : x + 1]).sum(axis=0) for x in range(left.shape[1])])
                key = (langs.dictionary[int(cells[0, c])].as_py(), int(cells[1, c]), int(cells[2, c]))
                held[key] = held[key] + sums if key in held else sums
            if len(held) > 64:
                yield from flush()
        yield from flush()

    parts = slim.mapInArrow(run, "lang string, a bigint, b bigint, value bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, text: str, lang: str, source: str, least_docs: int = 30, smooth: int = 5, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group.

    Part ``pair`` lists all other sources of the language by the summed difference of shares
    over the language's kept terms, part ``term`` the at most ``top`` terms that the group
    uses more than its language does, by that difference.  Larger values come first, equal
    ones in the byte order of their items.  Terms are lower-cased in ASCII alone; a term is
    kept if at least ``least_docs`` rows of the language hold it.

    Nulls count as ``''`` in all three columns, so they form groups of their own.  Rows are
    counted as they are, repeated ones each; ids are not looked at.  A language without kept
    terms gives pairs of value 0; an empty table gives no rows.
    """
    counts = term_counts(docs, text, lang, source)
    whole = Window.partitionBy("lang", "term")
    totals = {"in_docs": F.sum("docs").over(whole), "in_lang": F.sum("n").over(whole)}
    kept = counts.withColumns(totals).where((F.col("in_docs") >= least_docs) | (F.col("term") == ""))
    kept = cut_lineage(kept.select("lang", "source", "term", "n", "in_lang"))
    terms = kept.where("term <> ''")
    vocabulary = terms.groupBy("lang", "term").agg(F.first("in_lang").alias("n")).groupBy("lang").agg(F.count("n").alias("terms"), F.sum("n").alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        sizes.join(vocabulary, "lang", "left")
        .na.fill(0, ["terms", "lang_total"])
        .withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("zero", F.when(F.col("terms") > 0, share(F.lit(0), "total", "terms", smooth)))
    )
    groups = cut_lineage(groups)
    shares = terms.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms", smooth))

    above = shares.withColumn("value", F.col("p") - share("in_lang", "lang_total", "terms", smooth)).where("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    by_term = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    zeros = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "zero"))), lambda x: x["zero"]).alias("zeros"))
    dense = shares.groupBy("lang", "term").agg(F.collect_list("at").alias("at"), F.collect_list("p").alias("shares"))
    sums = block_sums(dense.join(zeros, "lang").select("lang", "zeros", "at", "shares"))
    one, other = (groups.select("lang", F.col("source").alias(s), F.col("at").cast("bigint").alias(x)) for s, x in (("source", "x"), ("item", "y")))
    pairs = one.join(other, "lang").where("x <> y").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    valued = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    by_pair = valued.withColumn("rank", F.row_number().over(best))
    return by_term.unionByName(by_pair)
