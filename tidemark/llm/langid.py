"""Language identification by cross-parsing entropy.

For every language a suffix automaton holds a bounded sample of its labelled text.  A
text is parsed against it greedily into longest matches; the fewer phrases it takes, each
weighted by the bits that name a place in the sample, the closer the text is to it.  The
language with the fewest normalised phrases wins.

The parse needs one table look-up a byte and language: the automaton is stored as a dense
table whose entries hold the following state and whether a phrase begins.  Texts are cut
into blocks that are parsed side by side; a phrase ends with its block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.llm.common import slices_of, text_buffers, worker_state

#: Bytes of a text that are parsed as one block.
BLOCK = 1024
#: Bytes that a task prepares at once.
WORK_BYTES = 1 << 20


@dataclass(frozen=True)
class Profiles:
    """Sample text of each language, in the order of their names."""

    samples: tuple[tuple[str, str], ...]

    @property
    def languages(self) -> list[str]:
        return [name for name, _ in self.samples]


def fit(labelled: DataFrame, text: str, label: str, key: str, windows: int = 128, width: int = 256) -> Profiles:
    """Profiles from a bounded sample of labelled rows.

    At most ``windows`` rows per label give one window of ``width`` characters each; this
    bounds what reaches the driver and the size of the automata.  Rows are picked by the
    hash of ``key``: one per label and hash bucket, so the choice is repeatable and needs
    no sort.  Rows with a null label, key or text, or without a letter, are not used;
    without usable rows the profiles are empty.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(label).cast("string").alias("label"),
        F.pmod(F.xxhash64(key), F.lit(windows)).alias("bucket"),
        F.xxhash64(key, F.lit(1)).alias("pick"),
        F.lower(F.col(text)).alias("text"),
    )
    picked = rows.groupBy("label", "bucket").agg(F.min("pick").alias("pick"))
    start = F.expr(f"1 + pmod(pick, greatest(1, length(text) - {width} + 1))").cast("int")
    found = (
        rows.join(F.broadcast(picked), ["label", "bucket", "pick"])
        .select("label", "bucket", F.substring("text", start, F.lit(width)).alias("part"))
        .groupBy("label", "bucket")
        .agg(F.min("part").alias("part"))
        .collect()
    )
    parts: dict[str, list[str]] = {}
    for row in sorted(found, key=lambda r: (r["label"], r["bucket"])):
        parts.setdefault(row["label"], []).append(row["part"])
    return Profiles(tuple((name, " ".join(own)) for name, own in parts.items()))


def predict(docs: DataFrame, profiles: Profiles, key: str, text: str) -> DataFrame:
    """(key, language, score, phrase_bytes, parsed) of every row of ``docs``, from the text alone.

    ``language`` is ``und`` for null texts, texts without a letter, and if nothing was
    learned; its score is 0.  Otherwise ``score`` is 1 minus the winner's normalised
    phrases over the runner-up's (1 if only one language is known); equal languages give
    0 and the first name wins.  ``phrase_bytes`` is the mean length of the winner's
    phrases, ``parsed`` the bytes they cover.  Letters are compared in lower case; everything else in ASCII is a
    separator.  Rows repeat as they do in the input, keys may be null, and no other
    column of the input is read.
    """
    chosen = docs.select(
        F.col(key).alias("key"),
        F.lower(F.col(text)).alias("text"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    schema = StructType(
        [
            StructField("key", chosen.schema["key"].dataType),
            StructField("language", StringType()),
            StructField("score", DoubleType()),
            StructField("phrase_bytes", DoubleType()),
            StructField("parsed", LongType()),
        ]
    )
    names, samples = profiles.languages, [s.encode() for _, s in profiles.samples]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = worker_state(f"langid_{hash(tuple(samples))}", lambda: Tables(samples)) if names else None
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            n = batch.num_rows
            language, score, mean, parsed = np.full(n, "und", object), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            if tables is not None:
                raw, offsets = text_buffers(batch.column(1))
                for a, b in slices_of(offsets, WORK_BYTES):
                    phrases, size = tables.phrases(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    bits = phrases * tables.bits[:, None]
                    best = bits.argmin(axis=0)
                    least = bits.min(axis=0)
                    bits[best, np.arange(b - a)] = np.inf
                    second = bits.min(axis=0)
                    ok = letters[a:b] & (size > 0)
                    at = a + np.flatnonzero(ok)
                    parsed[a:b] = size
                    language[at] = [names[i] for i in best[ok]]
                    score[at] = 1 - least[ok] / second[ok]
                    mean[at] = size[ok] / np.maximum(phrases[best[ok], np.flatnonzero(ok)], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(language, pa.string()), pa.array(score), pa.array(mean), pa.array(parsed)],
                ["key", "language", "score", "phrase_bytes", "parsed"],
            )

    return chosen.mapInArrow(run, schema)


class Tables:
    """Dense suffix automata over the byte classes that the samples use."""

    def __init__(self, samples: list[bytes]):
        used = sorted({c for s in samples for c in self.plain(np.frombuffer(s, np.uint8)).tolist()} - {32})
        # 0 separates words; the last class is every byte that no sample has.
        self.width = len(used) + 2
        classes = np.full(256, self.width - 1, np.uint8)
        classes[32] = 0
        classes[used] = np.arange(1, len(used) + 1)
        self.classes = classes[self.plain(np.arange(256, dtype=np.uint8))]
        self.tables, sizes = [], []
        for sample in samples:
            raw = np.frombuffer(sample, np.uint8)
            tokens, _ = self.tokens(raw, np.array([0, len(raw)]))
            self.tables.append(automaton(tokens.tolist(), self.width))
            sizes.append(max(2, len(tokens)))
        self.bits = np.log2(np.array(sizes, float))

    @staticmethod
    def plain(raw: np.ndarray) -> np.ndarray:
        letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
        return np.where(letter, raw, np.uint8(32))

    def tokens(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes with runs of separators as one, and the texts' offsets in them."""
        classes = self.classes[raw]
        keep = classes != 0
        keep[1:] |= classes[:-1] != 0
        starts = offsets[:-1][offsets[:-1] < len(raw)]
        keep[starts] = classes[starts] != 0
        count = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
        return classes[keep], count[offsets]

    def phrases(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by language and text, size by text)."""
        flat, offsets = self.tokens(raw, offsets)
        size = np.diff(offsets)
        blocks = -(-size // BLOCK)
        text_of = np.repeat(np.arange(len(size)), blocks)
        within = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[:-1][text_of] + within * BLOCK
        length = np.minimum(BLOCK, offsets[1:][text_of] - start)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], text_of[order]
        out = np.zeros((len(self.tables), len(size)))
        for a in range(0, len(start), 16384):
            s, n = start[a : a + 16384], length[a : a + 16384]
            states = [np.zeros(len(s), np.int32) for _ in self.tables]
            begun = [np.zeros(len(s), np.int32) for _ in self.tables]
            alive = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
            for t, k in enumerate(alive.tolist()):
                token = flat[s[:k] + t]
                for state, count, table in zip(states, begun, self.tables):
                    entry = table[state[:k] + token]
                    count[:k] += entry & 1
                    np.right_shift(entry, 1, out=state[:k])
            for i, count in enumerate(begun):
                out[i] += np.bincount(owner[a : a + 16384], weights=count, minlength=len(size))
        return out, size


def automaton(tokens: list[int], width: int) -> np.ndarray:
    """Flat table: entry[state * width + token] = following state * width * 2 + (1 if a phrase begins).

    A missing transition begins a phrase at the root; a token that the sample lacks is a
    phrase of its own.
    """
    following: list[dict[int, int]] = [{}]
    link, depth = [-1], [0]
    last = 0
    for token in tokens:
        now = len(following)
        following.append({})
        depth.append(depth[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and token not in following[p]:
            following[p][token] = now
            p = link[p]
        if p >= 0:
            q = following[p][token]
            if depth[p] + 1 == depth[q]:
                link[now] = q
            else:
                twin = len(following)
                following.append(dict(following[q]))
                depth.append(depth[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(token) == q:
                    following[p][token] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    if len(following) * width >= 1 << 30:
        raise ValueError("the sample is too large for a dense automaton")
    root = np.ones(width, np.int64)
    for token, target in following[0].items():
        root[token] = target * width * 2 + 1
    table = np.tile(root, (len(following), 1))
    for state, moves in enumerate(following[1:], 1):
        for token, target in moves.items():
            table[state, token] = target * width * 2
    return table.astype(np.int32).ravel()

