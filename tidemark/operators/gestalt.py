"""Which texts of a group of rows are like earlier ones, by gestalt ratio.

The ratio counts matched characters in common order, so two tests bound it from above for
many pairs at once: the 2-grams two texts share, as a product of count vectors, and the length
of their longest common subsequence, in bits.  Only what passes both costs a full match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    from tidemark.operators.similarity import GestaltRule

# Later texts compared at a time, pairs tested in bits at a time, and the places
# of a count vector, of which there are a few per character as long as they fit.
_STRIP, _CHUNK = 256, 65_536
_LEAST_PLACES, _MOST_PLACES, _PLACES_A_CHARACTER = 256, 4096, 16
# Characters are told apart by so many classes; one more stands for no character.
_CLASSES = 512
_WORD = 64


def ratio_if(new: str, stored: str, least: float) -> float | None:
    """The ratio, or None if an upper bound rules out that it reaches ``least``."""
    matcher = SequenceMatcher(None, new, stored)
    if matcher.real_quick_ratio() < least or matcher.quick_ratio() < least:
        return None
    return matcher.ratio()


def shared_grams_bound(n, partner, q: int, threshold: float):
    """Lower bound on the q-grams two texts of the given lengths share.

    A ratio of t means m >= t(n + partner)/2 matched characters in common order.  Each
    unmatched character of the first text destroys at most q of its grams, each
    unmatched one of the second at most q - 1.
    """
    matched = threshold * (n + partner) / 2
    return (n - q + 1) - q * (n - matched) - (q - 1) * (partner - matched)


def shortest_partner(threshold: float) -> float:
    """Length ratio a partner must reach: 2*min/(a+b) >= t."""
    return threshold / (2 - threshold)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pair_counts(texts: list[str], lengths: np.ndarray, places: int) -> np.ndarray:
    """A row per text that counts its 2-grams by hash, the k-th occurrence of one as a gram of its own.

    The product of two rows is at least the number of grams that both texts have, however
    many grams meet in a place.  ``places`` is a power of two.
    """
    codes = _code_points("".join(texts)).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    inside = row[:-1] == row[1:]
    mixed = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    low = np.uint64((1 << 30) - 1)
    key = np.sort((row[:-1][inside] << np.uint64(30)) | (mixed[inside] >> np.uint64(34)))
    at = np.arange(len(key))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    nth = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    item = ((key & low) + nth * np.uint64(0x632BE59B)) * np.uint64(0x9E3779B97F4A7C15)
    place = item >> np.uint64(64 - places.bit_length() + 1)
    cell = (key >> np.uint64(30)).astype(np.int64) * places + place.astype(np.int64)
    return np.bincount(cell, minlength=len(texts) * places).reshape(-1, places).astype(np.float32)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    whole = bits = (1 << len(b)) - 1
    for c in a:
        used = bits & where.get(c, 0)
        bits = ((bits + used) | (bits - used)) & whole
    return len(b) - bits.bit_count()


class CommonLengths:
    """Upper bounds on longest common subsequences of pairs of texts, for many pairs at a time."""

    def __init__(self, texts: list[str], lengths: np.ndarray, share: float):
        self.texts, self.lengths, self.share = texts, lengths, share
        # What may be like a text of one word of bits is no longer than this.
        width = int(_WORD / share) + 1
        short = np.flatnonzero(lengths <= width)
        self.codes = np.full((len(texts), width), _CLASSES, np.uint16)
        self.spots = np.zeros((_CLASSES + 1, len(texts)), np.uint64)
        if len(short) and lengths[short].sum():
            row = np.repeat(short, lengths[short])
            at = np.arange(len(row)) - np.repeat(np.cumsum(lengths[short]) - lengths[short], lengths[short])
            # Classes that hold several characters only add to what is common.
            kind = (_code_points("".join(texts[i] for i in short)) % _CLASSES).astype(np.uint16)
            self.codes[row, at] = kind
            fits = lengths[row] <= _WORD
            np.bitwise_or.at(self.spots, (kind[fits], row[fits]), np.uint64(1) << at[fits].astype(np.uint64))

    def bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, partner = self.lengths[a], self.lengths[b]
        out = np.minimum(n, partner)
        near = out >= np.maximum(n, partner) * self.share - 1e-9
        quick = near & (partner <= _WORD)
        if quick.any():
            out[quick] = self._in_bits(a[quick], b[quick])
        for k in np.flatnonzero(near & ~quick):
            out[k] = common_length(self.texts[a[k]], self.texts[b[k]])
        return out

    def _in_bits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits = np.full(len(a), ~np.uint64(0))
        for i in range(self.lengths[a].max()):
            used = bits & self.spots[self.codes[a, i], b]
            bits = (bits + used) | (bits - used)
        return np.bitwise_count(~bits)


def later_hits(texts: list[str], place: np.ndarray, late: np.ndarray, early: np.ndarray, rule: GestaltRule) -> Iterator[int]:
    """Those rows of ``late`` that match a row of ``early`` of a smaller ``place``."""
    lengths = np.array([len(t) for t in texts], np.int64)
    late, early = (rows[np.argsort(lengths[rows], kind="stable")] for rows in (late, early))
    share = shortest_partner(rule.threshold)
    wanted = int(_PLACES_A_CHARACTER * lengths.mean())
    counts = pair_counts(texts, lengths, min(_MOST_PLACES, max(_LEAST_PLACES, 1 << wanted.bit_length())))
    common = CommonLengths(texts, lengths, share)

    def hopeful(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 2 * common.bounds(a, b) >= rule.threshold * (lengths[a] + lengths[b]) - 1e-9

    def reached(a: int, b: int) -> bool:
        ratio = ratio_if(texts[a], texts[b], rule.threshold)
        return ratio is not None and (ratio > rule.threshold if rule.strict else ratio >= rule.threshold)

    for start in range(0, len(late), _STRIP):
        rows = late[start : start + _STRIP]
        least, most = lengths[rows[0]] * share - 1e-9, lengths[rows[-1]] / share + 1e-9
        cols = early[np.searchsorted(lengths[early], least) : np.searchsorted(lengths[early], most, "right")]
        if not len(cols):
            continue
        shared = counts[rows] @ counts[cols].T
        needed = shared_grams_bound(lengths[rows][:, None], lengths[cols][None], 2, rule.threshold) - 1e-6
        shared[(shared < needed) | (place[cols][None] >= place[rows][:, None])] = -1
        # The partner with the most in common first: in a crowd of copies it is enough.
        best = shared.argmax(axis=1)
        some = np.flatnonzero(shared[np.arange(len(rows)), best] >= 0)
        some = some[hopeful(rows[some], cols[best[some]])]
        hits = {i for i in some.tolist() if reached(rows[i], cols[best[i]])}
        shared[list(hits)] = -1
        i, j = np.nonzero(shared >= 0)
        for k in range(0, len(i), _CHUNK):
            a, b = i[k : k + _CHUNK], j[k : k + _CHUNK]
            left = hopeful(rows[a], cols[b])
            for x, y in zip(a[left].tolist(), b[left].tolist()):
                if x not in hits and reached(rows[x], cols[y]):
                    hits.add(x)
        yield from rows[sorted(hits)].tolist()


def hits_of_group(rule: GestaltRule) -> Callable[[pa.Table], pa.Table]:
    """For rows (rid, body, block, late_block, early_block) of two blocks: ids of the late one's that match an earlier row."""

    def hits(table: pa.Table) -> pa.Table:
        block, late, early = (table[c].to_numpy() for c in ("block", "late_block", "early_block"))
        place = np.asarray(pc.rank(table["rid"], tiebreaker="dense")).astype(np.int64)
        found = later_hits(table["body"].to_pylist(), place, np.flatnonzero(block == late), np.flatnonzero(block == early), rule)
        return table.select(["rid"]).take(pa.array(list(found), pa.int64()))

    return hits


class Matcher:
    """All pairs of texts that satisfy a rule, among rows given by number; days as numbers."""

    def __init__(self, texts: list[str], days: np.ndarray, rules: Sequence[GestaltRule]):
        self.texts, self.days, self.rules = texts, days, rules
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.share = min(shortest_partner(r.threshold) for r in rules)
        wanted = int(_PLACES_A_CHARACTER * self.lengths.mean())
        self.counts = pair_counts(texts, self.lengths, min(_MOST_PLACES, max(_LEAST_PLACES, 1 << wanted.bit_length())))
        self.common = CommonLengths(texts, self.lengths, self.share)

    def pairs(self, late: np.ndarray, early: np.ndarray, first: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(late, early, rule, ratio) where ``first`` of the early row is less than ``before`` of the late one."""
        lengths = self.lengths
        late, early = (rows[np.argsort(lengths[rows], kind="stable")] for rows in (late, early))
        for start in range(0, len(late), _STRIP):
            rows = late[start : start + _STRIP]
            low, high = lengths[rows[0]] * self.share - 1e-9, lengths[rows[-1]] / self.share + 1e-9
            cols = early[np.searchsorted(lengths[early], low) : np.searchsorted(lengths[early], high, "right")]
            cols = cols[first[cols] < before[rows].max()]
            if not len(cols):
                continue
            shared = self.counts[rows] @ self.counts[cols].T
            shared[first[cols][None] >= before[rows][:, None]] = -1e9
            same = self.days[rows][:, None] == self.days[cols][None]
            for k, rule in enumerate(self.rules):
                needed = shared_grams_bound(lengths[rows][:, None], lengths[cols][None], 2, rule.threshold) - 1e-6
                met = shared >= needed
                if rule.scope != "any":
                    met &= same if rule.scope == "same" else ~same
                i, j = np.nonzero(met)
                for at in range(0, len(i), _CHUNK):
                    a, b = rows[i[at : at + _CHUNK]], cols[j[at : at + _CHUNK]]
                    left = 2 * self.common.bounds(a, b) >= rule.threshold * (lengths[a] + lengths[b]) - 1e-9
                    for x, y in zip(a[left].tolist(), b[left].tolist()):
                        ratio = ratio_if(self.texts[x], self.texts[y], rule.threshold)
                        if ratio is not None and (ratio > rule.threshold if rule.strict else ratio >= rule.threshold):
                            yield x, y, k, ratio

    def kept(self, order: np.ndarray) -> list[int]:
        """The rows that the sequential rule keeps: rows meet those kept before them, and few at a time each other."""
        turn = np.argsort(order, kind="stable")
        kept: list[int] = []
        for start in range(0, len(turn), _WORD):
            some = turn[start : start + _WORD]
            gone = {x for x, _, _, _ in self.pairs(some, np.array(kept, np.int64), order, order)} if kept else set()
            left = np.array([x for x in some.tolist() if x not in gone], np.int64)
            earlier: dict[int, list[int]] = {}
            for x, y, _, _ in self.pairs(left, left, order, order):
                earlier.setdefault(x, []).append(y)
            for x in left.tolist():
                if not any(y not in gone for y in earlier.get(x, ())):
                    kept.append(x)
                else:
                    gone.add(x)
        return kept


def _matcher(table: pa.Table, rules: Sequence[GestaltRule]) -> Matcher:
    days = table["day"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return Matcher(table["body"].to_pylist(), days, rules)


def _rank(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    chunks = [c for column in columns for c in column.chunks]
    places = np.asarray(pc.rank(pa.chunked_array(chunks), tiebreaker="dense")).astype(np.int64)
    return np.split(places, len(columns))


def edges_of_group(rules: Sequence[GestaltRule]) -> Callable[[pa.Table], pa.Table]:
    """For rows (rid, last, body, day, side) of two sides: (early, late, rule, similarity) of late rows and the early ones before their ``last``."""

    def edges(table: pa.Table) -> pa.Table:
        late, early = (np.flatnonzero(table["side"].to_numpy() == k) for k in (1, 0))
        found: list[tuple[int, int, int, float]] = []
        if len(late) and len(early):
            first, before = _rank(table["rid"], table["last"])
            if first[early].min() < before[late].max():
                found = [x for x in _matcher(table, rules).pairs(late, early, first, before) if first[x[0]] != first[x[1]]]
        a, b, k, ratio = zip(*found) if found else ((), (), (), ())
        rid = table["rid"]
        return pa.table(
            {
                "early": rid.take(pa.array(b, pa.int64())),
                "late": rid.take(pa.array(a, pa.int64())),
                "rule": pa.array([rules[i].name for i in k], pa.string()),
                "similarity": pa.array(ratio, pa.float64()),
            }
        )

    return edges


def kept_of_group(rules: Sequence[GestaltRule]) -> Callable[[pa.Table], pa.Table]:
    """For rows (rid, body, day): ids of those that the sequential rule keeps."""

    def kept(table: pa.Table) -> pa.Table:
        (order,) = _rank(table["rid"])
        return table.select(["rid"]).take(pa.array(_matcher(table, rules).kept(order), pa.int64()))

    return kept
