"""Near-duplicate vectors by a pivot-permutation index.

Reference points, the pivots, are a bounded sample of the distinct directions of the vectors.  Every vector is
described by its nearest pivots in order.  Vectors that share at least two of them meet in
the inverted list of a pair of pivots, so the lists of pairs hold exactly the candidates
with a shared-pivot count of two or more; their cosines are then computed in double
precision.  A pair is counted in one list only, that of its first shared pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import key_runs, numbered, run_bounds
from tidemark.llm.components import connected_components
from tidemark.session import cut_lineage

#: Members of a list that one task compares with one another, or with as many others.
SLICE = 2048
#: Directions looked at for each pivot, and the cosine to a pivot over which another is left out.
SPARE, APART = 4, 0.98


def directions(vectors: DataFrame, vector: str, most: int | None = None) -> DataFrame:
    """(h, v): unit vectors of the usable rows with a hash that equal directions share, up to ``most``."""
    chosen = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, units = [], []
            for v in batch.column(0):
                unit = v.values.to_numpy(zero_copy_only=False).astype(float)
                norm = np.linalg.norm(unit)
                # Nulls became NaN on the way.
                if not len(unit) or not np.isfinite(norm) or norm == 0:
                    continue
                unit = unit / norm
                h = xxhash.xxh3_64_intdigest((np.round(unit, 5) + 0.0).tobytes()) >> 1
                if most is None or h <= most:
                    hashes.append(h), units.append(unit if most is not None else None)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(units, pa.list_(pa.float64()))], ["h", "v"])

    return chosen.mapInArrow(run, "h bigint, v array<double>")


def sample_pivots(vectors: DataFrame, vector: str, pivots: int) -> np.ndarray:
    """Up to ``pivots`` unit vectors, none close to another: of the directions with the smallest hashes.

    A direction counts once, however many rows have it.  ``SPARE`` times as many directions
    reach the driver, which bounds it; one with a cosine over ``APART`` to a pivot is left
    out.  Shorter vectors are filled with zeros.
    """
    lowest = directions(vectors, vector).select("h").distinct().orderBy("h").limit(SPARE * pivots).agg(F.max("h").alias("h")).first()["h"]
    if lowest is None:
        return np.zeros((0, 0))
    sample = directions(vectors, vector, lowest).groupBy("h").agg(F.min("v").alias("v")).orderBy("h").collect()
    width = max(max(len(r["v"]) for r in sample), 2)
    found = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        found[i, : len(r["v"])] = r["v"]
    taken, n = np.zeros((pivots, width)), 0
    for v in found:
        if n < pivots and (not n or (taken[:n] @ v).max() <= APART):
            taken[n], n = v, n + 1
    # Up to as many as a vector is described by are shared by all, so few lose nothing; two make a pair.
    return np.concatenate((taken[:n], np.eye(width)[: max(0, 2 - n)]))


def described(vectors: DataFrame, key: str, vector: str, label: str, pivots: np.ndarray, near: int) -> DataFrame:
    """(key, label, v, nearest): usable vectors with their nearest pivots, nearest first.

    Left out are rows with a null label, and vectors that are null, zero or hold null or
    non-finite components.
    """
    kind = vectors.select(F.col(vector)).dtypes[0][1]
    kind = kind if kind == "array<float>" else "array<double>"
    chosen = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast(kind).alias("v")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            rows, nearest = [], []
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            values = flat.to_numpy(zero_copy_only=False)
            begin = np.cumsum(sizes) - sizes
            for size in np.unique(sizes[sizes > 0]).tolist():
                own = np.flatnonzero(sizes == size)
                matrix = values[begin[own][:, None] + np.arange(size)].astype(float)
                # Nulls became NaN on the way.
                norm = np.linalg.norm(matrix, axis=1)
                usable = np.isfinite(matrix).all(axis=1) & (norm > 0) & np.isfinite(norm)
                own, matrix = own[usable], matrix[usable] / norm[usable][:, None]
                fit = min(size, pivots.shape[1])
                score = matrix[:, :fit] @ pivots[:, :fit].T
                count = min(near, len(pivots))
                # Of equally near pivots those with the smallest numbers, for every vector.
                nearest.extend(np.argsort(-score, axis=1, kind="stable")[:, :count].astype(np.int32))
                rows.extend(own.tolist())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), column.take(at), pa.array(nearest, pa.list_(pa.int32()))],
                ["key", "label", "v", "nearest"],
            )

    return chosen.mapInArrow(run, f"key bigint, label string, v {kind}, nearest array<int>")


def near_vectors(
    vectors: DataFrame, key: str, vector: str, label: str, threshold: float = 0.98, pivots: int = 512, near: int = 8
) -> DataFrame:
    """(key, n_links, component) of every row.

    Vectors of equal labels link when their cosine is at least ``threshold``; those that
    are not usable (see :func:`described`), or differ in length, link with nothing.
    ``n_links`` counts the other rows linked with a row, ``component`` is the smallest key
    it reaches.  Rows with equal vectors and labels are compared once, as a class, and
    link with each other.  Rows are told apart by a number, not by their keys: every row comes back
    once, also if it shares its key or has none; a null key is no component's name.

    Pairs that share fewer than two of their ``near`` nearest pivots are not found; that
    is the only approximation.  ``pivots`` and ``near`` set recall against the length of
    the lists; larger corpora take more pivots.
    """
    named = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), F.col(label).alias("label"))
    base, number = numbered(named)
    index = sample_pivots(base, "v", pivots)
    found = described(base, number, "v", "label", index, near).withColumnRenamed("key", "row")
    ids = base.select(F.col(number).alias("row"), "key")
    rows = cut_lineage(found.join(ids, "row"))
    classes = rows.groupBy("label", "v").agg(
        F.min("key").alias("rep"), F.count("*").alias("members"), F.first("nearest").alias("nearest")
    )
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))
    pairs = F.expr(
        "flatten(transform(sequence(0, size(nearest) - 2), i -> transform(sequence(i + 1, size(nearest) - 1),"
        " j -> struct(least(nearest[i], nearest[j]) as p, greatest(nearest[i], nearest[j]) as q))))"
    )
    listed = classes.where("size(nearest) > 1").select("id", "label", F.explode(pairs).alias("pair"))
    list_id = F.xxhash64("label", "pair.p", "pair.q").alias("list")
    entries = listed.select("id", "pair.p", "pair.q", list_id)
    counts = entries.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    # A long list is cut into slices, and each two slices meet in a task of their own.
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    sliced = entries.join(counts, "list").withColumn("slices", slices)
    sliced = sliced.withColumn("own", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    cell = F.explode(F.expr("transform(sequence(0, slices - 1), i -> struct(least(i, own) as a, greatest(i, own) as b))")).alias("cell")
    placed = sliced.select("id", "p", "q", "own", "list", cell)
    placed = placed.select("id", "p", "q", "own", "cell.a", "cell.b", F.xxhash64("list", "cell.a", "cell.b").alias("task"))
    full = placed.join(classes.select("id", "label", "v", "nearest", "members"), "id")
    ordered = full.select("task", "p", "q", "a", "b", "own", "id", "label", "members", "nearest", "v")
    ordered = ordered.repartition("task").sortWithinPartitions("task", "id")
    compare = _comparer(threshold)
    found = cut_lineage(ordered.mapInArrow(compare, "id bigint, links bigint, root bigint"))
    degrees = found.groupBy("id").agg(F.sum("links").alias("links"))
    names = classes.select("id", "rep")
    edges = found.where("root IS NOT NULL").select("id", "root").distinct()
    edges = edges.join(names, "id").select("root", F.col("rep").alias("a")).join(
        names.select(F.col("id").alias("root"), F.col("rep").alias("b")), "root"
    )
    components = connected_components(edges.select("a", "b"))
    known = classes.join(degrees, "id", "left").join(components, classes["rep"] == components["node"], "left")
    known = known.select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    linked = rows.select("key", "label", "v").join(known, ["label", "v"]).select("key", "n_links", "component")
    lone = ids.join(rows.select("row"), "row", "left_anti").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    return linked.unionByName(lone)


def _comparer(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "task"):
            if table is None or not table.num_rows:
                continue
            table = table.combine_chunks()
            bounds = run_bounds(table.column("task").to_numpy())
            ids, links, roots = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a > 1:
                    for got in compared(table.slice(a, b - a), threshold):
                        ids.append(got[0]), links.append(got[1]), roots.append(got[2])
            if ids:
                root = np.concatenate(roots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), pa.array(np.concatenate(links)), pa.array(root, pa.int64(), mask=root < 0)],
                    ["id", "links", "root"],
                )

    return run


def compared(part: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, links, root) of the members of one task of a list that have links.

    ``links`` weighs each linked class by its rows; ``root`` is the first linked member of
    the group that this task sees, -1 for the first itself.
    """
    column = {name: part.column(name).combine_chunks() for name in part.column_names}
    sizes = column["v"].value_lengths().to_numpy()
    labels = column["label"].to_numpy(zero_copy_only=False)
    # A list holds one label and one pair of pivots, but hashes of lists may agree.
    kind = np.array([f"{n} {p} {q} {x}" for n, p, q, x in zip(sizes, column["p"].to_pylist(), column["q"].to_pylist(), labels)])
    for value in np.unique(kind):
        at = pa.array(np.flatnonzero(kind == value))
        if len(at) < 2:
            continue
        own, member = (column[n].take(at).to_numpy() for n in ("own", "members"))
        ids = column["id"].take(at).to_numpy()
        vectors = column["v"].take(at)
        matrix = vectors.flatten().to_numpy().reshape(len(at), -1).astype(float)
        near = column["nearest"].take(at).flatten().to_numpy().reshape(len(at), -1)
        pair = (column["p"][at[0].as_py()].as_py(), column["q"][at[0].as_py()].as_py())
        a, b = column["a"][at[0].as_py()].as_py(), column["b"][at[0].as_py()].as_py()
        unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
        degree, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for c in range(0, len(ids), 256):
            tile = slice(c, min(c + 256, len(ids)))
            cosine = unit[tile] @ unit.T
            i, j = np.nonzero(cosine >= threshold - 1e-9)
            i += c
            keep = i < j
            if a != b:
                keep &= own[i] != own[j]
            i, j = i[keep], j[keep]
            i, j = _counted_here(near, i, j, pair)
            if not len(i):
                continue
            # The products above are rounded in another order; pairs at the edge are summed anew.
            exact = np.einsum("ij,ij->i", matrix[i], matrix[j]) / (
                np.sqrt(np.einsum("ij,ij->i", matrix[i], matrix[i])) * np.sqrt(np.einsum("ij,ij->i", matrix[j], matrix[j]))
            )
            i, j = i[exact >= threshold], j[exact >= threshold]
            np.add.at(degree, i, member[j])
            np.add.at(degree, j, member[i])
            for row in np.unique(i):
                roots = np.unique(np.append(root[j[i == row]], root[row]))
                if len(roots) > 1:
                    root[np.isin(root, roots[1:])] = roots[0]
        linked = np.flatnonzero(degree)
        if len(linked):
            yield ids[linked], degree[linked], np.where(root[linked] == linked, -1, ids[root[linked]])


def _counted_here(near: np.ndarray, i: np.ndarray, j: np.ndarray, pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose two smallest shared pivots are ``pair``: the one list that counts them."""
    keep = np.ones(len(i), bool)
    p, q = pair
    for s in range(0, len(i), 1 << 16):
        x, y = near[i[s : s + (1 << 16)]], near[j[s : s + (1 << 16)]]
        shared = (x[:, :, None] == y[:, None, :]).any(axis=2)
        lower = np.sort(np.where(shared, x, np.iinfo(np.int32).max), axis=1)[:, :2]
        keep[s : s + (1 << 16)] = (lower[:, 0] == p) & (lower[:, 1] == q)
    return i[keep], j[keep]
