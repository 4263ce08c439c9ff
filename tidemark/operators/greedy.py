"""Greedy near-duplicate filter in id order, as joins over rounds.

A record is kept iff it matches no kept record before it.  That is not the same as
"has an earlier match": in a~b~c with a, c unlike, c stays.  The sequential rule is
equivalent to rounds: keep every undecided record without an undecided earlier
match, drop what matches a kept one, repeat.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import gestalt
from tidemark.operators import similarity as sm
from tidemark.operators.ranking import with_range_bucket
from tidemark.session import cut_lineage


def _without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col("rid").alias(column)).distinct(), column, "left_anti")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def settle_edges(edges: DataFrame) -> DataFrame:
    """Ids dropped by the greedy rule on a complete edge table (early, late)."""
    live = cut_lineage(edges.select("early", "late").distinct())
    dropped = [live.select(F.col("late").alias("rid")).limit(0)]
    while not live.isEmpty():
        firsts = live.select(F.col("early").alias("rid")).distinct()
        winners = firsts.join(live.select(F.col("late").alias("rid")), "rid", "left_anti")
        losers = cut_lineage(
            live.join(winners.select(F.col("rid").alias("early")), "early", "left_semi")
            .select(F.col("late").alias("rid"))
            .distinct()
        )
        dropped.append(losers)
        live = cut_lineage(_without(_without(live, "late", losers), "early", losers))
    return _union(dropped)


# Long lists that a round looks at, the longest first, and how many of their first records.
_LONGEST, _FRONT = 1000, 4


def _edges(pairs: DataFrame, verify: sm.Verifier) -> DataFrame:
    """Verified pairs; if they are few, only the records that they name move to them."""
    pairs = cut_lineage(pairs)
    return verify(pairs, few=pairs.count() <= sm._FEW_PAIRS)


def _meeting(lists: DataFrame, some: DataFrame) -> DataFrame:
    """The lists that some records stand in, whole."""
    return lists.join(some.select("list_key").distinct(), "list_key", "left_semi")


def thin_long_lists(
    lists: DataFrame, verify: sm.Verifier, bounds: sm.Bounds, depth: int
) -> tuple[DataFrame, list[DataFrame]]:
    """Decide crowds: records that stand together in lists of more than ``depth`` members.

    The first records of long lists are compared with all before them, and those without a match are
    kept.  Each is then compared with whole lists, one row per member, so a crowd of copies falls to
    its first member in one round and is never compared with itself.  Rounds go on as long as a list is
    long and they drop more than they keep: lists of records that are not alike are no crowd,
    and to compare these is what is left to do.
    """
    dropped: list[DataFrame] = []
    long = cut_lineage(lists.groupBy("list_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > depth).select("list_key"))
    if long.isEmpty():
        return lists, dropped
    before = None
    while True:
        members = lists.join(long, "list_key", "left_semi").select("list_key", "rid")
        longest = members.groupBy("list_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > depth).orderBy(F.desc("n"), "list_key").limit(_LONGEST)
        heads = cut_lineage(sm.list_fronts(members.join(longest.select("list_key"), "list_key"), _FRONT).select("rid").distinct())
        if heads.isEmpty():
            return lists, dropped
        asked = heads if before is None else heads.unionByName(before).distinct()
        mine = cut_lineage(lists.join(asked, "rid", "left_semi"))
        near = cut_lineage(_meeting(lists, mine))
        earlier = cut_lineage(_edges(sm.pairs_between(near, mine, bounds), verify).select("early", "late"))
        winners = cut_lineage(_without(asked, "rid", earlier.select(F.col("late").alias("rid"))))
        won = winners.count()
        if not won:
            # What stands before them is asked next; there is a first of all.
            before = cut_lineage(asked.unionByName(earlier.select(F.col("early").alias("rid"))).distinct())
            continue
        before = None
        crowd = _edges(sm.pairs_between(mine.join(winners, "rid", "left_semi"), near, bounds), verify)
        losers = cut_lineage(crowd.select(F.col("late").alias("rid")).distinct())
        dropped.append(losers)
        lists = cut_lineage(_without(lists, "rid", winners.unionByName(losers)))
        if losers.count() <= won:
            return lists, dropped


def greedy_drops(
    lists: DataFrame,
    verify: sm.Verifier,
    bounds: sm.Bounds,
    depth: int = 200,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Ids (rid) the greedy rule drops.  ``stored`` (rid) marks records kept from the start."""
    dropped = []
    if stored is not None:
        held = lists.join(stored, "rid", "left_semi")
        lists = _without(lists, "rid", stored)
        hits = _edges(sm.pairs_between(held, lists, bounds), verify)
        losers = cut_lineage(hits.select(F.col("late").alias("rid")).distinct())
        dropped.append(losers)
        lists = cut_lineage(_without(lists, "rid", losers))
    short, thinned = thin_long_lists(lists, verify, bounds, depth)
    edges = _edges(sm.pairs_within(short, bounds), verify)
    return _union([*dropped, *thinned, settle_edges(edges)])


def kept_matches(
    lists: DataFrame, dropped: DataFrame, verify: sm.Verifier, bounds: sm.Bounds, reach: DataFrame | None = None
) -> DataFrame:
    """All edges from a kept record to a dropped one.

    ``reach`` (rid, last) lets a dropped record stand for later copies of itself: kept
    records before ``last`` count too, not only those before the record.
    """
    lost = cut_lineage(lists.join(dropped, "rid", "left_semi"))
    # Only lists with a dropped member matter.
    kept = _without(lists, "rid", dropped).join(lost.select("list_key").distinct(), "list_key", "left_semi")
    if reach is None:
        return _edges(sm.pairs_between(kept, lost, bounds), verify)
    order = F.col("early") < F.col("last")
    return _edges(sm.pairs_between(kept, lost.join(reach, "rid"), bounds, order), verify)


# Characters per text from which on blocks hold fewer texts, and tasks of a meeting of blocks.
_BLOCK_CHARACTERS, _MOST_TASKS = 256, 4000


def _dealt(texts: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """Records dealt by id into blocks of about ``depth`` texts, fewer if they are long."""
    n, characters = texts.agg(F.count(F.lit(1)), F.sum(F.length("body").cast("long"))).first()
    blocks = max(1, math.ceil(n / depth), math.ceil((characters or 0) / (depth * _BLOCK_CHARACTERS)))
    return with_range_bucket(texts, ["rid"], blocks, "block"), blocks


def block_matches(late: DataFrame, early: DataFrame, rules: Sequence[sm.GestaltRule], depth: int) -> DataFrame:
    """Edges between late records (rid, last, body, day) and all early ones (rid, body, day) before their ``last``.

    Grams of texts of one language repeat so much that lists of them bring nearly all texts together:
    blocks of texts meet instead, every late one with every early one.
    """
    (a, after), (b, before) = (_dealt(cut_lineage(side), depth) for side in (late, early))
    columns = [F.col("rid"), F.col("last"), F.col("body"), F.col("day")]
    a = a.select(*columns, F.lit(1).alias("side"), F.col("block").alias("late_block"), F.explode(F.sequence(F.lit(0), F.lit(before - 1))).alias("early_block"))
    b = b.withColumn("last", F.col("rid")).select(
        *columns, F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(after - 1))).alias("late_block"), F.col("block").alias("early_block")
    )
    kind = late.schema["rid"].dataType.simpleString()
    spread = a.unionByName(b).repartition(min(after * before, _MOST_TASKS), "late_block", "early_block")
    edges = gestalt.edges_of_group(rules)
    return spread.groupBy("late_block", "early_block").applyInArrow(edges, f"early {kind}, late {kind}, rule string, similarity double")


# Fixed value: texts of a block for each of the first records that are decided one after the other.
_TEXTS_OF_BLOCK = 20


def block_drops(records: DataFrame, rules: Sequence[sm.GestaltRule], depth: int, stored: DataFrame | None = None) -> DataFrame:
    """Ids (rid) that the greedy rule drops of (rid, body, day).  ``stored`` (rid) marks records kept from the start.

    The first ones by id are decided one after the other in a single task, some thousands by default, and
    what they keep is compared with all others: the larger a crowd of copies, the more likely it falls to one
    of these before its members meet each other.
    """
    texts, width = cut_lineage(records.select("rid", F.col("rid").alias("last"), "body", "day").distinct()), depth * _TEXTS_OF_BLOCK
    dropped = []
    if stored is not None:
        held, texts = texts.join(stored, "rid", "left_semi"), cut_lineage(_without(texts, "rid", stored))
        losers = cut_lineage(block_matches(texts, held, rules, width).select(F.col("late").alias("rid")).distinct())
        dropped.append(losers)
        texts = cut_lineage(_without(texts, "rid", losers))
    firsts = cut_lineage(texts.orderBy("rid").limit(width))
    kept = gestalt.kept_of_group(rules)
    heads = cut_lineage(firsts.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(kept, firsts.select("rid").schema).distinct())
    dropped.append(cut_lineage(_without(firsts.select("rid"), "rid", heads).distinct()))
    others = cut_lineage(_without(texts, "rid", firsts))
    if not others.isEmpty():
        crowd = block_matches(others, firsts.join(heads, "rid", "left_semi"), rules, width)
        losers = cut_lineage(crowd.select(F.col("late").alias("rid")).distinct())
        left = _without(others, "rid", losers)
        dropped += [losers, settle_edges(block_matches(left, left, rules, width))]
    return _union(dropped)


def block_kept_matches(records: DataFrame, dropped: DataFrame, rules: Sequence[sm.GestaltRule], reach: DataFrame, depth: int) -> DataFrame:
    """All edges from a kept record to a dropped one, whose last copy (``reach``) may stand behind it."""
    texts = records.select("rid", "body", "day").distinct()
    lost = texts.join(dropped, "rid", "left_semi").join(reach, "rid")
    return block_matches(lost, _without(texts, "rid", dropped), rules, depth * _TEXTS_OF_BLOCK)


def any_earlier_match(records: DataFrame, rule: sm.GestaltRule, depth: int = 4096) -> DataFrame:
    """Ids (rid) with at least one matching earlier record, kept or not.

    Grams of texts of one language repeat so much that two texts meet in dozens of lists, so
    none are made here: records (rid, body) are dealt by id into blocks of about ``depth`` texts, and
    blocks meet two at a time, every pair once.  What a task holds is bounded; the pairs are not,
    but cost a few operations each.  A block meets itself first, and what has a match then
    meets no other block, so a crowd of copies costs about one comparison each.
    """
    texts = records.select("rid", "body").distinct()
    dealt, blocks = _dealt(texts, depth)
    match, schema, block = gestalt.hits_of_group(rule), dealt.select("rid").schema, F.col("block")

    def hits(placed: DataFrame, cells: int) -> DataFrame:
        # A number of tasks that is not made smaller: cells have few bytes and much to do.
        spread = placed.repartition(min(cells, _MOST_TASKS), "late_block", "early_block")
        return cut_lineage(spread.groupBy("late_block", "early_block").applyInArrow(match, schema).distinct())

    found = hits(dealt.withColumns({"late_block": block, "early_block": block}), blocks)
    if blocks == 1:
        return found
    before, after = F.sequence(F.lit(0), block - 1), F.sequence(block + 1, F.lit(blocks - 1))
    late = _without(dealt, "rid", found).filter(block > 0).select("*", block.alias("late_block"), F.explode(before).alias("early_block"))
    early = dealt.filter(block < blocks - 1).select("*", F.explode(after).alias("late_block"), block.alias("early_block"))
    return _union([found, hits(late.unionByName(early), blocks * (blocks - 1) // 2)])
