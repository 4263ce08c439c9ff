"""Structured Streaming forms of the ingest operators.

Every sink writes a batch to ``<table>/batch_id=<n>`` in overwrite mode, so a batch
that is run again after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions.text import fingerprint, word_set
from tidemark.operators import dedup as dd
from tidemark.operators import greedy
from tidemark.operators import similarity as sm
from tidemark.operators.tables import append_with_ids, table_or_empty
from tidemark.session import apply_runtime_settings, cut_lineage, delete_path, path_exists
from tidemark.streaming.runtable import RUNS_A_BATCH, RunTable

Handler = Callable[[DataFrame, int], None]


def landing_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """New files of a landing folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start(stream: DataFrame, handle: Handler, checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Run ``handle(batch, batch_id)`` per micro-batch: every interval, or once through what is there."""

    def adaptively(batch: DataFrame, batch_id: int) -> None:
        # Streams run in a session of their own, with adaptive execution off; the joins
        # inside a batch are ordinary ones and want it.
        apply_runtime_settings(batch.sparkSession)
        handle(batch, batch_id)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(adaptively)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_once(stream: DataFrame, handle: Handler, checkpoint: str, mode: str = "append") -> None:
    start(stream, handle, checkpoint, mode=mode).awaitTermination()


def write_batch(df: DataFrame, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(os.path.join(table, f"batch_id={batch_id}"))


def read_batches(spark: SparkSession, table: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of a batch-wise table, of earlier batches only if ``before`` is given."""
    rows = table_or_empty(spark, table, f"{schema}, batch_id int")
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def refuse_restart(spark: SparkSession, table: str, schema: str, batch_id: int) -> None:
    """Stop when a later batch is stored already.

    A stream under a new checkpoint counts from 0 again and would replace what it finds.
    """
    if not read_batches(spark, table, schema).filter(F.col("batch_id") > batch_id).isEmpty():
        raise RuntimeError(f"{table} holds batches after {batch_id}; use its old checkpoint or another folder")


def latest_updates(spark: SparkSession, table: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of a table that update-mode batches were written to."""
    rows = read_batches(spark, table, schema)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*rest), "batch_id").alias("_n")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_n.*")


def ignore_known(table: str, schema: str, keys: Sequence[str], order: str, buckets: int = 16) -> Handler:
    """Insert-ignore: first row per key of the batch whose key no earlier batch stored.

    The stored keys lie bucketed beside the table, so a batch is shuffled to them and not
    they to it.  Rows with a null in their key are all stored, one of each batch.
    """
    kinds = {f.name: f for f in T._parse_datatype_string(schema).fields}
    key_schema = ", ".join(f"`{k}` {kinds[k].dataType.simpleString()}" for k in keys)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        refuse_restart(spark, table, schema, batch_id)
        known = RunTable(spark, f"{table}_keys", key_schema, keys, buckets)
        fresh = dd.first_per_key(batch, keys, order).join(known.rows(before=batch_id), list(keys), "left_anti")
        write_batch(fresh, table, batch_id)
        known.add(spark.read.parquet(os.path.join(table, f"batch_id={batch_id}")).select(*keys), batch_id)

    return handle


def changed_feeds(
    state: str, output: str, feed: str, position: str, cols: Sequence[str], capture: str | None = None
) -> Handler:
    """Pass on the entries of feeds whose ordered entry list differs from the last one seen.

    ``capture`` names the column that tells the captures of a feed apart and sorts them by
    time: a batch may then hold several, each compared with the one before it, the first
    with the last stored one.  Without it, the rows of a feed in a batch are one capture.

    ``state`` keeps the last fingerprint of each feed; it grows with the feeds, not with the
    batches.  Feeds without a name are one feed.
    """
    schema = "feed string, fingerprint string, batch bigint"
    # A struct compares a missing capture time as a value and is never null itself.
    taken = F.struct(F.col(capture) if capture else F.lit(0).alias("at"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = RunTable(spark, state, schema, ["feed"], newest="batch")
        if any(run // RUNS_A_BATCH > batch_id for run, _ in table.runs()):
            raise RuntimeError(f"{state} holds batches after {batch_id}; use its old checkpoint or another folder")
        name = F.coalesce(F.concat(F.lit("="), F.col(feed).cast("string")), F.lit(""))
        entries = batch.withColumns({"_feed": name, "_taken": taken})
        prints = cut_lineage(entries.groupBy("_feed", "_taken").agg(fingerprint(position, *cols).alias("fingerprint")))
        last = table.rows(before=batch_id).select(F.col("feed").alias("_feed"), F.col("fingerprint").alias("_last"))
        # One row per capture, not per entry.
        before = F.lag("fingerprint").over(W.partitionBy("_feed").orderBy("_taken"))
        seen = prints.withColumn("_before", before).join(last, "_feed", "left")
        fresh = seen.filter(~F.col("fingerprint").eqNullSafe(F.coalesce("_before", "_last")))
        passed = entries.join(fresh.select("_feed", "_taken"), ["_feed", "_taken"], "left_semi")
        write_batch(passed.drop("_feed", "_taken"), output, batch_id)
        newest = prints.groupBy(F.col("_feed").alias("feed")).agg(F.max_by("fingerprint", "_taken").alias("fingerprint"))
        table.add(newest.withColumn("batch", F.lit(batch_id).cast("long")), batch_id)

    return handle


STATUS = "received bigint, stored bigint, skipped bigint, millis bigint"


def with_status(handle: Handler, table: str, status: str) -> Handler:
    """The handler, which also leaves a row of ``STATUS`` for each batch in the table ``status``.

    ``table`` is where the handler writes its batches; what arrived and isn't there was
    skipped.  Arrivals are counted by the handler's own first pass, which must read the whole
    batch, and stored rows from the footers of the written files.  A batch that is run again
    replaces its row, and one that fails leaves none.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, began = batch.sparkSession, time.monotonic()
        seen = Observation()
        handle(batch.observe(seen, F.count(F.lit(1)).alias("received")), batch_id)
        stored = spark.read.parquet(os.path.join(table, f"batch_id={batch_id}")).count()
        received, millis = seen.get["received"], int((time.monotonic() - began) * 1000)
        row = spark.createDataFrame([(received, stored, received - stored, millis)], STATUS)
        write_batch(row.coalesce(1), status, batch_id)

    return run


class NearDuplicateIngest:
    """Store arriving texts unless they repeat a stored one, exactly or nearly.

    Tables below ``root``: ``stored`` (the kept rows with generated ids), ``word_sets`` (their word
    sets by row) and, for each version of the word order, ``word_lists`` (their candidate lists by
    list) and ``word_order``.  A batch is shuffled to the lists and word sets it meets; these lie in
    bucketed runs and are not moved.

    A word order is lossless as long as all lists follow it, but one taken from few texts
    puts words first that have turned common since, and their lists grow.  So whenever the
    stored texts have doubled since an order was taken, a new one is taken and all lists are made
    anew under it: every stored text is listed a bounded number of times on average.
    """

    STORED = "id bigint, key bigint, text string"
    LISTS = "list_key bigint, rid bigint, size int, rest int"
    WORDS = "rid bigint, size int, words string"
    VERSIONS = "version int, rows bigint"

    def __init__(self, spark: SparkSession, root: str, threshold: float = dd.JACCARD_THRESHOLD, buckets: int = 16):
        self.spark, self.root, self.threshold, self.buckets = spark, root, threshold, buckets
        self._tables: dict[str, RunTable] = {}

    def _path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def stored(self, before: int | None = None) -> DataFrame:
        return read_batches(self.spark, self._path("stored"), self.STORED, before)

    def _table(self, spark: SparkSession, name: str, schema: str, key: str) -> RunTable:
        found = self._tables.setdefault(name, RunTable(spark, self._path(name), schema, [key], self.buckets))
        # Every batch comes in a session of its own.
        found.spark = spark
        return found

    def words(self, spark: SparkSession) -> RunTable:
        return self._table(spark, "word_sets", self.WORDS, "rid")

    def lists(self, spark: SparkSession, version: int) -> RunTable:
        return self._table(spark, f"word_lists/version={version}", self.LISTS, "list_key")

    def order(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.schema(sm.ORDER).parquet(self._path(f"word_order/version={version}"))

    def version(self, batch_id: int | None = None) -> tuple[int, int] | None:
        """(version, stored rows it was taken from) that holds before a batch, or now."""
        rows = read_batches(self.spark, self._path("versions"), self.VERSIONS, batch_id).collect()
        return max(((r["version"], r["rows"]) for r in rows), default=None)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """``batch`` has ``key`` (unique, in arrival order and larger than stored keys) and ``text``."""
        spark = batch.sparkSession
        refuse_restart(spark, self._path("stored"), self.STORED, batch_id)
        if path_exists(spark, self._path("words")):
            raise RuntimeError(f"{self.root} holds lists of an older form, which these do not meet; use another folder")
        bounds = sm.jaccard_bounds(self.threshold)
        words = self.words(spark)
        before = words.total(before=batch_id)
        firsts = self._firsts(batch)
        records = firsts.select(F.col("key").alias("rid"), "size", "words")
        version = self._ordered(spark, batch_id, records, words, before)
        known = self.lists(spark, version)
        lists = cut_lineage(sm.word_lists(records, self.threshold, self.order(spark, version)))
        met = sm.pairs_with_stored(known.rows(before=2 * batch_id + 1), lists, bounds)
        verify = sm.jaccard_verifier(records, self.threshold, earlier=words.rows(before=batch_id))
        repeats = cut_lineage(verify(met).select(F.col("late").alias("rid")).distinct())
        left = cut_lineage(lists.join(repeats, "rid", "left_anti"))
        dropped = greedy.greedy_drops(left, sm.jaccard_verifier(records, self.threshold), bounds)
        kept = firsts.join(repeats.unionByName(dropped).withColumnRenamed("rid", "key"), "key", "left_anti")
        kept = cut_lineage(kept)
        new_rows = append_with_ids(kept.select("key", "text"), spark.range(before, before + 1), "id", "key")
        keys = kept.select(F.col("key").alias("rid"))
        words.add(kept.select(F.col("key").alias("rid"), "size", "words"), batch_id)
        known.add(lists.join(keys, "rid", "left_semi"), 2 * batch_id + 1)
        write_batch(new_rows.select("id", "key", "text"), self._path("stored"), batch_id)

    @staticmethod
    def _firsts(batch: DataFrame) -> DataFrame:
        """The first row of each distinct word set: equal ones match each other, empty ones nothing."""
        fresh = batch.select("key", "text", word_set("text").alias("tokens"))
        words, size = F.coalesce(sm.word_string(F.col("tokens")), F.lit("")), F.greatest(F.size("tokens"), F.lit(0))
        fresh = fresh.select("key", "text", size.alias("size"), words.alias("words"))
        mark = F.when(F.col("size") > 0, F.sha2("words", 256)).otherwise(F.concat(F.lit("id:"), F.col("key").cast("string")))
        return cut_lineage(dd.first_per_key(fresh.withColumn("mark", mark), ["mark"], "key").drop("mark"))

    def _ordered(self, spark: SparkSession, batch_id: int, records: DataFrame, words: RunTable, before: int) -> int:
        """The version of the word order that a batch works under; a rerun takes the same."""
        last = self.version(batch_id)
        if last and before < 2 * max(last[1], 1):
            return last[0]
        stored = words.rows(before=batch_id)
        order = sm.word_order(sm.word_counts(records.unionByName(stored)))
        order.write.mode("overwrite").parquet(self._path(f"word_order/version={batch_id}"))
        anew = self.lists(spark, batch_id)
        # Lists have two numbers a batch: one for those made anew, one for the batch's own.
        anew.add(sm.word_lists(stored, self.threshold, self.order(spark, batch_id)), 2 * batch_id)
        write_batch(spark.createDataFrame([(batch_id, before)], self.VERSIONS).coalesce(1), self._path("versions"), batch_id)
        if last:
            # Only a batch before this one could still ask for lists older than the last version's.
            for old in {r["version"] for r in read_batches(spark, self._path("versions"), self.VERSIONS, batch_id).collect()} - {last[0]}:
                delete_path(spark, self._path(f"word_lists/version={old}"))
        return batch_id
