"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding.

The corpus is tokenized once and in order of its keys; the ids are counted and replaced by
their rank, so that frequent ids take one byte.  A file is a sequence of blocks:

=========  =====================================================================
bytes      content
=========  =====================================================================
4          ``TDVB``
8 x 5      documents, values, data bytes, shard, values of the shard before (little-endian)
8 x docs   keys
docs       1 where the key is null
8 x docs   values of each document
values/4   control bytes: two bits a value give its length less one, low bits first
data       ranks, least significant byte first, as many bytes as the control says
1          line feed
=========  =====================================================================

Control and data stand apart, so a block is decoded by table look-ups on whole arrays.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices_of, text_buffers, worker_state
from tidemark.session import cut_lineage, work_path

MAGIC = b"TDVB"
#: Values that a block holds before it is closed; a longer document is a block of its own.
BLOCK_VALUES = 1 << 20
#: Blocks that a file holds, which bounds what a reading task loads.
FILE_BLOCKS = 16
#: Words that a worker keeps with their ids, unless told otherwise; they take about 200 bytes each.
KEPT_WORDS = 500_000
#: Bytes of text that are tokenized at once.
WORK_BYTES = 2 << 20

TOKENS = "shard bigint, before bigint, n bigint, keys binary, sizes binary, ids binary"


class KeptWords(dict):
    """Packed ids by word, made when first asked for; started anew when it is full."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        out = self.make(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = out
        return out


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins white-space separated words.

    Words are tokenized by the library and kept; a text that lower-casing or splitting
    ahead of the library could change is tokenized as a whole.  Latin words, with full
    stops or commas behind them or none, go straight to the library's model, if that gives
    the whole library's ids for all of ``PROBES``.
    """

    #: Words of every form that goes to the model, and of some that it must not change.
    PROBES = ("word", "o", "été", "straße", "ñandú.", "end.", "list,", "dots...", "both.,", "über,", "w.,.,", "čaj")

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.code = "I" if self.wide else "H"
        # The library hands out another wrapper of its model at each access.
        self.model = self.library.model
        self.kept = KeptWords(self._word, kept_words)
        self.byte_names = _byte_names()
        self.direct = all(self._direct(w) == self.pack(self.library.encode(w, add_special_tokens=False).ids) for w in self.PROBES)

    def _word(self, word: str) -> bytes:
        packed = self._direct(word, self.kept.__getitem__) if self.direct else None
        return self.whole(word) if packed is None else packed

    def _direct(self, word: str, known: Callable[[str], bytes] | None = None) -> bytes | None:
        """Ids by the model; those of a stem with full stops or commas behind it from ``known``, if given."""
        stem = word.rstrip(".,")
        if not stem.isalpha() or max(stem) > "\u024f":
            return None
        if len(stem) < len(word):
            return (known(stem) if known else self._direct(stem)) + self._model(word[len(stem) :])
        return self._model(stem if stem.isascii() else "".join(map(self.byte_names.__getitem__, stem.encode())))

    def _model(self, raw: str) -> bytes:
        return self.pack([t.id for t in self.model.tokenize(raw)])

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids_of = self.kept.__getitem__
        return [b"".join(map(ids_of, text.lower().split())) if plain(text) else self.whole(text) for text in texts]


def _byte_names() -> list[str]:
    """The character by which byte-level models name each byte: printable bytes themselves,
    the others counted from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


def plain(text: str) -> bool:
    """True if words may be lower-cased and split ahead of the tokenizer."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text or "<|" in text:
        return False
    if text.isascii():
        return True
    if "Σ" in text or "İ" in text or "\x85" in text:
        return False
    # The library normalizes before it lower-cases: small letters may compose where capitals don't (H̱, T̈, W̊, J̌).
    return unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", text.lower())


@dataclass(frozen=True)
class TokenFiles:
    """Written files: their folder, the id of each rank, and the shards (shard, values, offset).

    The folder holds all of it: ``ids`` the blocks, ``ranks`` and ``shards`` the tables.
    """

    folder: str
    id_of: np.ndarray
    shards: DataFrame


def write_tokens(
    docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, folder: str | None = None, kept_words: int = KEPT_WORDS
) -> TokenFiles:
    """Writes the files in ascending order of the key.

    ``tokenizer`` is the path of a tokenizer file that splits at white space; ``end_id``
    closes every document; ``folder`` is new, by default one in the shared folder;
    ``kept_words`` bounds a worker's memory of words, which changes no id.  Null texts are
    empty, null keys come first, and rows with equal keys stand next to each other.
    ``offset`` counts the values of all shards before.  The folder needs nothing beside it to be
    read, see :func:`open_tokens`.
    """
    spark = docs.sparkSession
    folder = folder or work_path(spark, "tokens")
    tokens = cut_lineage(tokenized(docs, key, text, tokenizer, end_id, kept_words))
    counts = id_counts(tokens, tokenizer)
    shards = tokens.groupBy("shard").agg(F.sum("n").alias("values"))
    # One row per shard, so the running sum over all of them is small.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.withColumn("offset", F.coalesce(F.sum("values").over(earlier), F.lit(0))).write.parquet(f"{folder}/shards")
    id_of = np.argsort(-counts, kind="stable").astype(np.uint32)
    rank_of = np.empty_like(id_of)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    coded = tokens.mapInArrow(_encoder(rank_of), "block binary")
    coded.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_BLOCKS).text(f"{folder}/ids")
    # A row for each id of the vocabulary, however much text there is.
    ranks = pa.table({"rank": np.arange(len(id_of), dtype=np.int64), "id": id_of.astype(np.int64)})
    spark.createDataFrame(ranks).coalesce(1).write.parquet(f"{folder}/ranks")
    return open_tokens(spark, folder)


def open_tokens(spark: SparkSession, folder: str) -> TokenFiles:
    """The files that :func:`write_tokens` left in a folder, in any session."""
    ranks = spark.read.schema("rank bigint, id bigint").parquet(f"{folder}/ranks").toPandas()
    id_of = np.empty(len(ranks), np.uint32)
    id_of[ranks["rank"].to_numpy(np.int64)] = ranks["id"].to_numpy(np.uint32)
    return TokenFiles(folder, id_of, spark.read.schema("shard bigint, values bigint, offset bigint").parquet(f"{folder}/shards"))


def tokenized(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Blocks of token ids; shards are ranges of the key, each in ascending order."""
    ordered = (
        docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        .repartitionByRange("key")
        .sortWithinPartitions("key", "text")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state(f"tokenizer_{tokenizer}_{kept_words}", lambda: WordTokenizer(tokenizer, kept_words))
        item, end = (4 if words.wide else 2), words.pack([end_id])
        shard, before = TaskContext.get().partitionId(), 0
        keys, sizes, parts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            row = [shard, before, held, np.concatenate(keys).tobytes(), np.array(sizes, "<i8").tobytes(), b"".join(parts)]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds)], ["shard", "before", "n", "keys", "sizes", "ids"]
            )

        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for a, b in slices_of(offsets, WORK_BYTES):
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                ids = words.encode(texts)
                own = batch.column(0).slice(a, b - a)
                pairs = np.zeros(b - a, dtype=[("key", "<i8"), ("null", "u1")])
                pairs["key"], pairs["null"] = own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False)
                keys.append(pairs)
                for x in ids:
                    sizes.append(len(x) // item + 1)
                    parts += (x, end)
                held += sum(len(x) // item + 1 for x in ids)
                if held >= BLOCK_VALUES:
                    yield block()
                    before += held
                    keys, sizes, parts, held = [], [], [], 0
        if sizes:
            yield block()

    return ordered.mapInArrow(run, TOKENS)


def id_counts(tokens: DataFrame, tokenizer: str) -> np.ndarray:
    """How often each id of the vocabulary occurs in all documents."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    dtype = "<u4" if size > 1 << 16 else "<u2"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), dtype), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for row in counts.collect():
        out[row["id"]] = row["n"]
    return out


def _encoder(ranks: np.ndarray):
    dtype = "<u4" if len(ranks) > 1 << 16 else "<u2"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, before, n, keys, sizes, ids = (column[row] for column in batch.columns)
                pairs = np.frombuffer(keys.as_buffer(), dtype=[("key", "<i8"), ("null", "u1")])
                control, data = encode_values(ranks[np.frombuffer(ids.as_buffer(), dtype)])
                head = np.array([len(pairs), n.as_py(), len(data), shard.as_py(), before.as_py()], "<i8").tobytes()
                whole = b"".join(
                    (MAGIC, head, pairs["key"].tobytes(), pairs["null"].tobytes(), sizes.as_py(), control.tobytes(), data.tobytes())
                )
                yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["block"])

    return run


def encode_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    raw = np.ascontiguousarray(values, "<u4")
    extra = (raw > 0xFF).astype(np.uint8) + (raw > 0xFFFF) + (raw > 0xFFFFFF)
    padded = np.zeros(-(-len(raw) // 4) * 4, np.uint8)
    padded[: len(raw)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control, raw.view(np.uint8).reshape(-1, 4)[keep]


#: For each control byte the lengths of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)
#: For each length the bytes of a four-byte word that count.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The values again: lengths by control byte, then a masked word at each offset."""
    lengths = LENGTHS[control].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.concatenate((data, np.zeros(4, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 4)[at]
    return np.ascontiguousarray(words).view("<u4").ravel() & MASKS[lengths]


Reader = Callable[[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray], list[pa.Array]]


def read_tokens(spark: SparkSession, files: TokenFiles, each: Reader, schema: str) -> DataFrame:
    """Decodes the files and maps each block to rows of ``schema``.

    ``each`` gets the keys, where they are null, the shard, the documents' first value in
    the shard and one more offset, and the ids of the block.
    """
    id_of = files.id_of
    names = [field.split()[0] for field in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for keys, nulls, shard, before, sizes, ids in file_blocks(content.as_buffer(), id_of):
                    bounds = before + np.concatenate(([0], np.cumsum(sizes)))
                    yield pa.RecordBatch.from_arrays(each(keys, nulls, shard, bounds, ids), names)

    return spark.read.format("binaryFile").load(f"{files.folder}/ids").select("content").mapInArrow(run, schema)


def token_digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` counts the ids of all documents before; the checksum is that of the ids as
    little-endian unsigned 32-bit integers.
    """

    def each(keys: np.ndarray, nulls: np.ndarray, shard: int, bounds: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
        raw, at = memoryview(ids.astype("<u4").tobytes()), (4 * (bounds - bounds[0])).tolist()
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
        n = len(keys)
        return [
            pa.array(keys, pa.int64(), mask=nulls),
            pa.array(np.full(n, shard)),
            pa.array(bounds[:-1]),
            pa.array(np.diff(bounds)),
            pa.array(sums, pa.int64()),
        ]

    rows = read_tokens(spark, files, each, "key bigint, shard bigint, first bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(files.shards.select("shard", "offset"), "shard").select(
        "key", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def file_blocks(content, id_of: np.ndarray) -> Iterator[tuple]:
    """(keys, nulls, shard, values of the shard before, sizes, ids) of each block of a file."""
    view, at = memoryview(content), 0

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(view, dtype, n, at)
        at += out.nbytes
        return out

    while at < len(view):
        if bytes(view[at : at + 4]) != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += 4
        docs, n, size, shard, before = take("<i8", 5).tolist()
        keys, nulls, sizes = take("<i8", docs), take("u1", docs), take("<i8", docs)
        control, data = take("u1", -(-n // 4)), take("u1", size)
        at += 1
        yield keys, nulls.astype(bool), shard, before, sizes, id_of[decode_values(control, data, n)]
