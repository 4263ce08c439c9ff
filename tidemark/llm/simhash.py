"""Near-duplicates by SimHash: bit-sliced comparison of fingerprints.

Equal fingerprints are collapsed first.  Two fingerprints within the radius agree in at
least ``blocks - radius`` of ``blocks`` bit blocks, so each is listed under every choice
of that many blocks and only lists are compared.  Within a list, bit planes are stored
vertically, one machine word holding a bit of 64 fingerprints; the differing bits of a
plane are added to carry-save counters, and words whose 64 counters have all passed the
radius are abandoned.  A list gives only the links that span its groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from tidemark.llm.common import key_runs, run_bounds, text_buffers
from tidemark.llm.components import connected_components
from tidemark.session import cut_lineage

#: Query rows whose words are compared at once.
TILE = 256


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 3) -> DataFrame:
    """(key, fingerprint) of every row.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles of
    ``shingle`` words are joined by one space and hashed with XXH64 (seed 42), repeats
    included.  A bit of the fingerprint is 1 if it is set in over half the hashes.  A text
    of fewer words is one shingle; an empty or null text has fingerprint 0.  Rows repeat
    as they do in the input.
    """
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            data = raw.tobytes()
            prints = np.fromiter(
                (fingerprint(data[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["key", "fingerprint"])

    return chosen.mapInArrow(run, f"key {kind}, fingerprint bigint")


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of 255 rows fit a byte.
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_groups(prints: DataFrame, radius: int = 3, blocks: int = 5, longest: int = 20_000) -> DataFrame:
    """(fingerprint, rep, component): the smallest key of each distinct fingerprint, and the
    smallest key that is reachable by links of at most ``radius`` differing bits.

    Lists longer than ``longest`` are listed again under the blocks of the bits that their
    key leaves open, so no list must be compared as a whole; pairs are lost by neither
    step.  Null keys count for nothing; a fingerprint that only null keys have is not in
    the result.
    """
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("key").alias("rep")).where("rep IS NOT NULL"))
    lists = distinct.select("fingerprint", "rep", F.explode(F.array(*_block_keys(blocks, radius))).alias("at"))
    lists = lists.select("fingerprint", "rep", F.col("at.bits").alias("open"), F.col("at.list").alias("list"))
    level = 0
    while (radius + 1) ** level < 64:
        counts = lists.groupBy("list", "open").count()
        hot = cut_lineage(counts.where(F.col("count") > longest).select("list", "open"))
        if hot.isEmpty():
            break
        split = lists.join(hot, ["list", "open"])
        lists = cut_lineage(lists.join(hot, ["list", "open"], "left_anti").unionByName(_relist(split, radius, level)))
        level += 1
    ordered = lists.select("list", "fingerprint", "rep").repartition("list").sortWithinPartitions("list", "rep")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "list"):
            if table is None or not table.num_rows:
                continue
            keys, prints, reps = (table.column(i).to_numpy() for i in range(3))
            bounds = run_bounds(keys)
            a, b = list_links(prints.view(np.uint64), bounds, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(reps[a]), pa.array(reps[b])], ["a", "b"])

    kind = distinct.schema["rep"].dataType.simpleString()
    links = ordered.mapInArrow(run, f"a {kind}, b {kind}").distinct()
    components = connected_components(links)
    return distinct.join(components, distinct["rep"] == components["node"], "left").select(
        "fingerprint", "rep", F.coalesce("component", "rep").alias("component")
    )


def near_duplicates(docs: DataFrame, key: str, text: str, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(key, fingerprint, component) of every row; see the functions above.

    A row with a null key keeps its fingerprint; it joins the component of an equal
    fingerprint, or has a null component.
    """
    prints = cut_lineage(fingerprints(docs, key, text, shingle))
    groups = fingerprint_groups(prints, radius)
    return prints.join(groups.select("fingerprint", "component"), "fingerprint", "left").select("key", "fingerprint", "component")


def _block_keys(blocks: int, radius: int) -> list[Column]:
    """List name and open bits for each choice of ``blocks - radius`` whole blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    out = []
    for number, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        open_bits = F.lit(_signed(((1 << 64) - 1) ^ mask))
        name = F.xxhash64(F.lit(number), F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))))
        out.append(F.struct(open_bits.alias("bits"), name.alias("list")))
    return out


def _relist(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """The rows under each of radius + 1 parts of their open bits: one part is equal in every pair.

    Each level divides the bits across the parts of the level before.
    """
    parts = radius + 1
    options = []
    for i in range(parts):
        pattern = _signed(sum(1 << j for j in range(64) if j // parts**level % parts == i))
        part = F.col("open").bitwiseAND(F.lit(pattern))
        options.append(
            F.struct(
                F.col("open").bitwiseAND(F.bitwise_not(F.lit(pattern))).alias("bits"),
                F.xxhash64("list", F.lit(i), F.col("fingerprint").bitwiseAND(part)).alias("list"),
            )
        )
    again = rows.select("fingerprint", "rep", F.explode(F.array(*options)).alias("at"))
    return again.select("fingerprint", "rep", F.col("at.bits").alias("open"), F.col("at.list").alias("list"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def list_links(prints: np.ndarray, bounds: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of links that span the groups of each list.

    Lists of two, by far the most, are compared together; the others by bit planes.
    """
    sizes = np.diff(bounds)
    twos = bounds[:-1][sizes == 2]
    near = np.bitwise_count(prints[twos] ^ prints[twos + 1]) <= radius
    left, right = [twos[near]], [twos[near] + 1]
    for a, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        root = group_roots(prints[a : a + n], radius)
        other = np.flatnonzero(root != np.arange(n))
        left.append(a + root[other])
        right.append(a + other)
    return np.concatenate(left), np.concatenate(right)


def group_roots(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a list the first row of its group."""
    n = len(prints)
    root = np.arange(n)
    planes = bit_planes(prints)
    for a in range(0, n, TILE):
        near = within_radius(planes, prints[a : a + TILE], radius, n)
        near[np.arange(len(near)), a + np.arange(len(near))] = False
        for row in np.flatnonzero(near.any(axis=1)):
            roots = np.unique(np.append(root[near[row]], root[a + row]))
            if len(roots) > 1:
                root[np.isin(root, roots[1:])] = roots[0]
    return root


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit j of 64 fingerprints in each word of plane j."""
    words = -(-len(prints) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within_radius(planes: np.ndarray, queries: np.ndarray, radius: int, n: int) -> np.ndarray:
    """Boolean (queries, n): at most ``radius`` bits differ."""
    words = planes.shape[1]
    digits = max(1, radius.bit_length())
    query = np.repeat(np.arange(len(queries)), words)
    word = np.tile(np.arange(words), len(queries))
    # Counters start so that they overflow just beyond the radius.
    head = (1 << digits) - 1 - radius
    counters = [np.full(len(query), np.uint64(0xFFFFFFFFFFFFFFFF) if head >> d & 1 else np.uint64(0)) for d in range(digits)]
    over = np.zeros(len(query), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(64):
        ask = np.where((queries >> np.uint64(j)) & np.uint64(1), full, np.uint64(0))
        carry = planes[j][word] ^ ask[query]
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        over |= carry
        if j % 8 == 7:
            alive = over != full
            if not alive.all():
                query, word, over = query[alive], word[alive], over[alive]
                counters = [c[alive] for c in counters]
    out = np.zeros((len(queries), words), np.uint64)
    out[query, word] = ~over
    return np.unpackbits(out.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
