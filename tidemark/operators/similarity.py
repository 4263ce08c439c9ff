"""Candidate lists for similarity joins.

A record's items (words, or numbered character grams) are put in one global order,
rare items first.  Two records similar enough must share an item among the first
``p`` of each, ``p`` following from the threshold and the record's size.  So each
record is listed under its first ``p`` items only, and only records that meet in a
list are compared.  The rule loses no pair and needs no comparison of all with all.

Tables used throughout:

- records: ``rid`` (order id) and the columns the verifier needs
- lists:   ``list_key, rid, size, rule, grams, rest``, one row per record and list;
  ``rest`` counts the record's items after this one in the global order; lists of word sets,
  which have one rule only, go without ``rule`` and ``grams``
- edges:   ``early, late, rule, similarity`` with ``early < late``, verified
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.gestalt import ratio_if, shared_grams_bound, shortest_partner
from tidemark.session import cut_lineage

Verifier = Callable[..., DataFrame]

# Fixed value: a pair with this many items to share must meet this often among the first places
# of both, whose number grows by one less.  One meeting is common between records that are not alike.
MEETINGS = 4


@dataclass(frozen=True)
class Bounds:
    """What a pair must satisfy before it is worth verifying; none of it loses a match."""

    # Least size of the smaller record, as a share of the larger one's.
    min_ratio: float
    # (early size, late size) -> least number of shared items, for each rule and gram length.
    need: Callable[[Column, Column], Column]


def by_merge(side: DataFrame) -> DataFrame:
    """A side that is never broadcast.

    Lists, word sets and pieces repeat so much that their files are a small part of what they
    take in memory, and it is the files that Spark goes by.
    """
    return side.hint("merge")


# Fixed value: that many ids are looked up by broadcast.
_FEW_PAIRS = 1_000_000


def only(side: DataFrame, pairs: DataFrame, column: str, few: bool) -> DataFrame:
    """The rows of a side that pairs name, if these are few: then no others move."""
    return side.join(F.broadcast(pairs.select(column).distinct()), column, "left_semi") if few else side


def coded(items: DataFrame) -> DataFrame:
    """Items as 64-bit codes, distinct between rules and gram lengths.

    Two items that happen to share a code share a list, which costs a comparison and
    loses nothing.
    """
    return items.withColumn("item", F.xxhash64("rule", "grams", "item"))


def item_order(items: DataFrame) -> DataFrame:
    """How often each coded item occurs: (item, freq)."""
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("freq"))


def rare_first_lists(items: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Lists from coded items ``rid, size, rule, grams, prefix, item``.

    Items are distinct per record, rule and gram length; ``prefix`` says how many of
    them, rare ones first, open a list.

    Any order is lossless as long as all records use the same one, so ``order`` may be
    a saved frequency table, with items it does not know first.  Lists made with it
    stay valid when further records arrive.  Items of one record are bounded by its text.
    """
    weighted = _with_frequency(items, cut_lineage(item_order(items)) if order is None else order)
    ordered = weighted.groupBy("rid", "rule", "grams").agg(
        F.first("size").alias("size"),
        F.first("prefix").alias("prefix"),
        F.sort_array(F.collect_list(F.struct("freq", "item"))).alias("ordered"),
    )
    firsts = ordered.select(
        "rid",
        "size",
        "rule",
        "grams",
        F.size("ordered").alias("n"),
        F.posexplode(F.slice("ordered", F.lit(1), F.col("prefix"))).alias("pos", "e"),
    )
    if order is None:
        # An item nobody else has opens no list.
        firsts = firsts.filter(F.col("e.freq") > 1)
    return firsts.select(
        F.col("e.item").alias("list_key"), "rid", "size", "rule", "grams", (F.col("n") - 1 - F.col("pos")).alias("rest")
    )


# Items that make up at least one in this many of all items are looked up by broadcast;
# by that definition there cannot be more of them than this.
_HOT_SHARE = 100_000


def _with_frequency(items: DataFrame, order: DataFrame) -> DataFrame:
    """Add ``freq`` to items, 0 where the order does not know them.

    A frequent item occurs in a large part of all records.  Those items are answered
    by a broadcast of bounded size, and their rows go through the join with the other
    frequencies under keys of their own, which match nothing and spread evenly.
    """
    total = order.agg(F.sum("freq")).scalar()
    hot = order.withColumn("_total", total).filter(F.col("freq") * F.lit(_HOT_SHARE).cast("long") >= F.col("_total"))
    hot = hot.select("item", F.col("freq").alias("_hot"))
    known = items.join(F.broadcast(hot), "item", "left")
    key = F.when(F.col("_hot").isNull(), F.col("item")).otherwise(F.xxhash64("rid", "item", F.lit("hot")))
    rest = order.select(F.col("item").alias("_key"), F.col("freq").alias("_freq"))
    joined = known.withColumn("_key", key).join(rest, "_key", "left")
    freq = F.coalesce("_hot", "_freq", F.lit(0).cast("long")).alias("freq")
    return joined.select(*items.columns, freq)


# --- word sets, Jaccard ---------------------------------------------------------------


# Bits of the cells that words are counted in, and of the codes that go by them.
_CELL_BITS, _CODE_BITS = 22, 56
ORDER = "cell int, level int"
# Fixed value: bytes of word codes handed to Python at once; a larger set is a batch of its own.
_BATCH_BYTES = 16 << 20


def word_string(tokens: Column) -> Column:
    """A set of words as a text, with blanks between them: words have none."""
    return F.array_join(F.sort_array(tokens), " ")


def _codes(records: DataFrame, *others: str) -> DataFrame:
    """``records`` has (rid, size, words); adds the words' 64-bit hashes."""
    records.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    words = F.split("words", " ")
    return records.filter("size > 0").select(*others, F.transform(words, lambda w: F.xxhash64(w)).alias("codes"))


def _cells(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def word_counts(records: DataFrame) -> DataFrame:
    """How often words of each cell occur: (cell, n).  A task sends one row for each cell at most."""

    bits = _CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << bits, np.int64)
        for batch in batches:
            found += np.bincount(_cells(batch["codes"].flatten().to_numpy(), bits), minlength=len(found))
        cells = np.flatnonzero(found)
        for k in range(0, len(cells), 1 << 16):
            some = cells[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], ["cell", "n"])

    return _codes(records).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def word_order(counts: DataFrame) -> DataFrame:
    """An order of words, rare ones first, as ``ORDER``: steps of the logarithm of the counts by cell.

    Any order loses nothing, so words may share a cell.  Its size has a bound, whatever the
    number of words.  Level 1 says that one word occurs once.
    """
    return counts.select("cell", (F.floor(F.log2("n") * 8) + 1).cast("int").alias("level"))


def word_lists(records: DataFrame, threshold: float, order: DataFrame | None = None) -> DataFrame:
    """Lists of records (rid, size, words): (list_key, rid, size, rest).

    Lists made with a saved ``order`` stay valid when further records arrive; it puts words
    of cells it does not know first.  The key of a list is its word's place in the order, so two
    words that share one share a list, which loses nothing.
    """
    found = (word_order(word_counts(records)) if order is None else order).toArrow()
    bits = _CELL_BITS
    levels = np.zeros(1 << bits, np.uint8)
    levels[found["cell"].to_numpy()] = np.minimum(found["level"].to_numpy(), 255)
    # A word nobody else has opens no list.
    lone = 1 if order is None else -1
    mask = np.uint64((1 << _CODE_BITS) - 1)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, size = batch["codes"].flatten().to_numpy(), batch["size"].to_numpy().astype(np.int64)
            places = (levels[_cells(codes, bits)].astype(np.uint64) << np.uint64(_CODE_BITS)) | (codes.view(np.uint64) & mask)
            least = np.ceil(size * threshold - 1e-9).astype(np.int64)
            prefix = np.minimum(size - least + MEETINGS, size)
            ends = np.cumsum(size)
            for start, end in zip((ends - size).tolist(), ends.tolist()):
                places[start:end].sort()
            row = np.repeat(np.arange(len(size)), prefix)
            at = np.arange(len(row)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            keys = places[(ends - size)[row] + at]
            listed = (keys >> np.uint64(_CODE_BITS)).astype(np.int64) > lone
            keys, row, at = keys[listed], row[listed], at[listed]
            columns = [keys.view(np.int64), batch["rid"].take(pa.array(row)), size[row].astype(np.int32), (size[row] - 1 - at).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["list_key", "rid", "size", "rest"])

    kind = records.schema["rid"].dataType.simpleString()
    return _codes(records, "rid", "size").mapInArrow(lists, f"list_key long, rid {kind}, size int, rest int")


def jaccard_bounds(threshold: float) -> Bounds:
    share = threshold / (1 + threshold)
    return Bounds(threshold, lambda a, b: (a + b) * F.lit(share) - F.lit(1e-9))


# Fixed value: 64-bit words of a sketch.  More of them part larger sets and cost 8 bytes a pair each.
_SKETCH_WORDS = 32


def parity_sketch(tokens: str) -> Column:
    """Bits that say whether an odd number of a set's items hash to them.

    A bit that differs between two sets takes an item that only one of them has, so two
    sketches differ in no more bits than the sets do in items, however large these are.
    """
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))

    def word(i: int) -> Column:
        mine = F.filter(hashes, lambda h: F.pmod(h, F.lit(_SKETCH_WORDS)) == i)
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(bit(h)))

    return F.array(*[word(i) for i in range(_SKETCH_WORDS)])


def _shared(early: pd.Series, late: pd.Series) -> pd.Series:
    """Words that two sets share, counted; pairs of one record follow each other."""
    out, last, mine = [], None, set()
    for a, b in zip(early, late):
        if b != last:
            last, mine = b, set(b.split(" "))
        out.append(len(mine.intersection(a.split(" "))))
    return pd.Series(out, dtype="int32")


def jaccard_verifier(records: DataFrame, threshold: float, earlier: DataFrame | None = None) -> Verifier:
    """Pairs -> edges with Jaccard >= threshold; early records come from ``earlier`` if given.

    Both have (rid, size, words).  A record with very many partners makes a hot join key here; the skew
    join of adaptive execution splits it, the record itself being a single row.
    """
    # Declared non-deterministic only to keep Spark from evaluating it once more per use.
    shared = F.pandas_udf(_shared, "int").asNondeterministic()

    def verify(pairs: DataFrame, few: bool = False) -> DataFrame:
        source = records if earlier is None else earlier
        early = source.select(F.col("rid").alias("early"), F.col("size").alias("_na"), F.col("words").alias("_a"))
        late = records.select(F.col("rid").alias("late"), F.col("size").alias("_nb"), F.col("words").alias("_b"))
        early, late = only(early, pairs, "early", few), only(late, pairs, "late", few)
        met = by_merge(by_merge(pairs).join(early, "early")).join(late, "late").withColumn("_n", shared("_a", "_b"))
        scored = met.withColumn("similarity", F.col("_n") / (F.col("_na") + F.col("_nb") - F.col("_n")))
        return scored.filter(F.col("similarity") >= threshold).select("early", "late", F.lit("jaccard").alias("rule"), "similarity")

    return verify


# --- character sequences, gestalt ratio -----------------------------------------------


@dataclass(frozen=True)
class GestaltRule:
    """ratio(late, early) >= threshold (> if strict); scope "same", "other" or "any" day."""

    name: str
    threshold: float
    scope: str = "any"
    strict: bool = False
    grams: tuple[int, ...] = (3, 2, 1)


def safe_length(q: int, threshold: float) -> int:
    """Smallest length from which at least one q-gram is shared with every partner.

    Shared grams are a whole number, so a positive bound means one.  For 1-grams that
    holds from length 1 on.
    """
    share = shortest_partner(threshold)
    n = q
    while shared_grams_bound(n, n * share, q, threshold) < 1e-6:
        n += 1
        if n > 10_000:
            raise ValueError(f"{q}-grams cannot serve threshold {threshold}")
    return n


def code_points(text: str) -> Column:
    """Characters of a text, so that lengths agree with the verifier's."""
    return F.regexp_extract_all(F.col(text), F.lit("(?s)(.)"), 1)


def with_pieces(records: DataFrame) -> DataFrame:
    """Add what the verifier's quick test needs: length, distinct 2-grams, and repeats among them."""
    chars = records.withColumn("_c", code_points("body")).withColumn("length", F.size("_c"))
    starts = F.sequence(F.lit(1), F.greatest(F.col("length") - 1, F.lit(1)))
    pairs = F.transform(starts, lambda i: F.xxhash64(F.get("_c", i - 1), F.get("_c", i)))
    distinct = chars.withColumn("pieces", F.when(F.col("length") > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<bigint>")))
    return distinct.withColumn("spare", F.greatest(F.col("length") - 1, F.lit(0)) - F.size("pieces")).drop("_c")


def gestalt_lists(records: DataFrame, rules: Sequence[GestaltRule]) -> DataFrame:
    """``records`` has (rid, body, day).

    Long texts are listed by long grams, which are selective; short ones by shorter
    grams, with an overlap wide enough that two partners always share a family;
    the shortest by their single characters.  Empty texts, which are like each other
    only, share one list per scope; equal texts of a day being one record, it has at most
    one member a day.
    """
    base = records.select("rid", F.coalesce(F.col("day").cast("string"), F.lit("")).alias("day"), code_points("body").alias("chars"))
    base = base.withColumn("size", F.size("chars"))
    families, empty = [], []
    for rule in rules:
        share, upper = shortest_partner(rule.threshold), math.inf
        scope = F.col("day") if rule.scope == "same" else F.lit("")
        for q in rule.grams:
            lower, n = safe_length(q, rule.threshold), F.col("size").cast("double")
            shared = shared_grams_bound(n, n * share, q, rule.threshold)
            fits = (F.col("size") >= lower) & (F.col("size") <= F.lit(float(upper)))
            family = F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(q).alias("grams"),
                (F.col("size") - q + 1 - F.ceil(shared - 1e-9) + MEETINGS).cast("int").alias("prefix"),
                scope.alias("scope"),
            )
            families.append(F.when(fits, family))
            # A partner of a text too short for this family is at most this long.
            upper = math.ceil(lower / share)
        if upper > math.ceil(1 / share):
            raise ValueError(f"rule {rule.name} needs 1-grams for its shortest texts")
        empty.append(F.when(F.col("size") == 0, F.struct(F.lit(rule.name).alias("rule"), scope.alias("scope"))))
    placed = base.withColumn("_f", F.explode(F.array_compact(F.array(*families)))).select("rid", "size", "chars", "_f.*")
    counted = (
        placed.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("grams") + 1)))
        .withColumn("gram", F.concat_ws("", F.slice("chars", F.col("start"), F.col("grams"))))
        .groupBy("rid", "size", "rule", "grams", "prefix", "scope", "gram")
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
    )
    # The k-th occurrence of a gram is an item of its own.
    numbered = counted.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    item = F.concat_ws("\u0001", "scope", "gram", F.col("k").cast("string"))
    items = coded(numbered.select("rid", "size", "rule", "grams", "prefix", item.alias("item")))
    short = base.withColumn("_t", F.explode(F.array_compact(F.array(*empty)))).select("rid", "size", "_t.*")
    shared_list = short.select(
        F.xxhash64("rule", F.lit("empty"), "scope").alias("list_key"),
        "rid",
        "size",
        "rule",
        F.lit(0).alias("grams"),
        F.col("size").alias("rest"),
    )
    return rare_first_lists(items).unionByName(shared_list)


def gestalt_bounds(rules: Sequence[GestaltRule]) -> Bounds:
    def need(a: Column, b: Column) -> Column:
        out = F.lit(0.0)
        for rule in rules:
            for q in rule.grams:
                either = F.greatest(
                    shared_grams_bound(a, b, q, rule.threshold), shared_grams_bound(b, a, q, rule.threshold)
                )
                out = F.when((F.col("rule") == rule.name) & (F.col("grams") == q), either - 1e-9).otherwise(out)
        return out

    return Bounds(min(shortest_partner(r.threshold) for r in rules), need)


def _ratios(late: pd.Series, early: pd.Series, floor: pd.Series) -> pd.Series:
    return pd.Series([ratio_if(*row) for row in zip(late, early, floor)], dtype="float64")


def gestalt_verifier(records: DataFrame, rules: Sequence[GestaltRule]) -> Verifier:
    """Pairs -> edges that satisfy their rule; the later text is the matcher's first argument.

    ``records`` has the columns of :func:`with_pieces`.
    """
    # Declared non-deterministic only to keep Spark from evaluating it once more per use.
    ratio = F.pandas_udf(_ratios, "double").asNondeterministic()
    columns = {"body": "text", "day": "day", "length": "n", "pieces": "pieces", "spare": "spare"}

    def side(name: str, mark: str) -> DataFrame:
        return records.select(F.col("rid").alias(name), *[F.col(c).alias(f"_{mark}_{to}") for c, to in columns.items()])

    def verify(pairs: DataFrame, few: bool = False) -> DataFrame:
        early, late = only(side("early", "a"), pairs, "early", few), only(side("late", "b"), pairs, "late", few)
        joined = by_merge(by_merge(pairs).join(early, "early")).join(late, "late")
        same = F.col("_a_day").eqNullSafe(F.col("_b_day"))
        # Shared 2-grams, counting those that repeat within a text as shared.
        shared = F.size(F.array_intersect("_a_pieces", "_b_pieces")) + F.least("_a_spare", "_b_spare")
        least, allowed, met = F.lit(2.0), F.lit(False), F.lit(False)
        for rule in rules:
            mine = F.col("rule") == rule.name
            least = F.when(mine, F.lit(float(rule.threshold))).otherwise(least)
            in_scope = {"same": same, "other": ~same, "any": F.lit(True)}[rule.scope]
            reached = F.col("similarity") > rule.threshold if rule.strict else F.col("similarity") >= rule.threshold
            lengths = F.col("_a_n"), F.col("_b_n")
            either = F.greatest(
                shared_grams_bound(*lengths, 2, rule.threshold), shared_grams_bound(*lengths[::-1], 2, rule.threshold)
            )
            allowed = allowed | (mine & in_scope & (shared >= either - 1e-9))
            met = met | (mine & reached)
        # What is left may cost a full match in Python each; the pairs of one text spread.
        left = joined.filter(allowed).repartition("early", "late")
        scored = left.withColumn("similarity", ratio("_b_text", "_a_text", least))
        return scored.filter(met).select("early", "late", "rule", "similarity")

    return verify


# --- meeting in lists -----------------------------------------------------------------


def _meeting(lists: DataFrame) -> list[str]:
    """A pair meets in lists of one rule and gram length at a time."""
    return [c for c in ("list_key", "rule", "grams") if c in lists.columns]


def pairs_within(lists: DataFrame, bounds: Bounds, whole: bool = True) -> DataFrame:
    """Distinct (early, late) pairs that meet in a list.  For lists of bounded length only.

    ``whole`` says that every list place of every record is present.
    """
    a, b = _sides(lists, lists)
    return _promising(by_merge(a).join(b, _meeting(lists)), bounds, F.col("early") < F.col("late"), whole)


def pairs_between(early: DataFrame, late: DataFrame, bounds: Bounds, order: Column | None = None, whole: bool = True) -> DataFrame:
    """Distinct pairs of an early and a late record that meet in a list.

    One side is meant to have few members in each list.  Nothing is repeated to spread long ones: the
    skew join of adaptive execution splits them.  ``order`` replaces the condition early < late and may
    use further columns of ``late``.
    """
    a, b = _sides(early, late)
    return _promising(by_merge(a).join(b, _meeting(late)), bounds, F.col("early") < F.col("late") if order is None else order, whole)


def pairs_with_stored(stored: DataFrame, late: DataFrame, bounds: Bounds) -> DataFrame:
    """Distinct pairs of a stored record and a later one that meet in a list.

    ``stored`` has (list_key, rid, size, rest) and is met where it lies if it is bucketed by
    list; a list's name tells rule and gram length, which the later side brings.
    """
    a = stored.select("list_key", F.col("rid").alias("early"), F.col("size").alias("_sa"), F.col("rest").alias("_ra"))
    b = late.withColumnsRenamed({"rid": "late", "size": "_sb", "rest": "_rb"})
    return _promising(by_merge(b).join(a, "list_key"), bounds, F.col("early") < F.col("late"), whole=True)


def _sides(early: DataFrame, late: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = _meeting(early)
    a = early.select(*keys, F.col("rid").alias("early"), F.col("size").alias("_sa"), F.col("rest").alias("_ra"))
    further = [c for c in late.columns if c not in (*keys, "rid", "size", "rest")]
    # The same columns in the same places: a table that meets itself is dealt out once.
    return a, late.select(*keys, F.col("rid").alias("late"), F.col("size").alias("_sb"), F.col("rest").alias("_rb"), *further)


def _promising(met: DataFrame, bounds: Bounds, order: Column, whole: bool) -> DataFrame:
    """Drop pairs that cannot share enough items.

    What two records share after a place is at most the shorter rest there, so the first of the
    items they must share leaves all others behind it, the second all but two, and so on: a pair
    meets ``MEETINGS`` times among places that leave all but so many.  That asks for whole lists;
    else one meeting is enough.  The meetings among these places are all items shared
    up to the last of them; beyond it the shorter rest bounds what is shared.
    """
    fits = F.least("_sa", "_sb") >= F.greatest("_sa", "_sb") * F.lit(bounds.min_ratio) - F.lit(1e-9)
    need = F.ceil(bounds.need(F.col("_sa"), F.col("_sb")))
    often = F.greatest(F.lit(1), F.least(F.lit(MEETINGS), need)) if whole else F.lit(1)
    near = met.filter(order & fits).filter(F.least("_ra", "_rb") + often >= need)
    keys = ["early", "late", *_meeting(near)]
    keys.remove("list_key")
    if whole:
        shared = near.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(F.least("_ra", "_rb")).alias("_rest"),
            F.first("_sa").alias("_sa"),
            F.first("_sb").alias("_sb"),
        )
        near = shared.filter((F.col("_n") >= often) & (F.col("_n") + F.col("_rest") >= need))
    return near.select(*[c for c in keys if c != "grams"]).distinct()


def list_fronts(lists: DataFrame, depth: int) -> DataFrame:
    """The first ``depth`` records of every list by id.

    Spark cuts each list to ``depth`` rows before the shuffle, so a hot list is
    never gathered whole.
    """
    place = F.row_number().over(W.partitionBy("list_key").orderBy("rid"))
    return lists.withColumn("_place", place).filter(F.col("_place") <= depth).drop("_place")


def longest_list(lists: DataFrame) -> int:
    row = lists.groupBy("list_key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    return row["n"] or 0
