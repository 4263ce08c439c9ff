"""A keyed table that grows by batches and stays cheap to meet: bucketed runs, merged by size.

A batch is one run: a partition of a Parquet table whose rows are bucketed by the key.  Runs of
about the same size are merged as soon as there are a few of them, so the number of files grows with
the logarithm of the table and every row is rewritten that often.  Since all runs share the
buckets, a join on the key shuffles the other side only.

Which runs are valid after a batch is written down last, in the batch's manifest.  A batch
that is run again starts from the manifest before it, replaces its own runs and needs none that it
removed: runs are deleted one batch after they were merged.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.tables import table_or_empty
from tidemark.session import delete_path, path_exists

#: Runs that one batch may make: its own and the merged ones.
RUNS_A_BATCH = 64
MANIFEST = "run bigint, rows bigint"


@dataclass
class RunTable:
    """``schema`` names the columns; ``key`` the bucket columns, which joins should use all.

    ``buckets`` should hold what one task reads of the grown table; it is fixed with the first
    batch.  At most ``fan`` runs of one size class stay.  With ``newest`` only the row with the largest
    value of that column is kept for each key, on reading and whenever runs are merged.
    """

    spark: SparkSession
    path: str
    schema: str
    key: Sequence[str]
    buckets: int = 16
    fan: int = 4
    newest: str | None = None
    name: str = field(init=False)
    _known: dict[int, list[tuple[int, int]]] | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        self.name = "runs_" + hashlib.sha256(self.path.encode()).hexdigest()[:20]
        self.columns = [f.name for f in T._parse_datatype_string(self.schema).fields]

    def _open(self, spark: SparkSession) -> None:
        """The catalog's entry; the files and manifests are what lasts."""
        if not spark.catalog.tableExists(self.name):
            keys = ", ".join(f"`{k}`" for k in self.key)
            where = os.path.join(self.path, "runs")
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.name} ({self.schema}, run bigint) USING parquet PARTITIONED BY (run) "
                f"CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{where}'"
            )
            if path_exists(spark, where):
                spark.catalog.recoverPartitions(self.name)

    def _manifests(self, spark: SparkSession) -> DataFrame:
        return table_or_empty(spark, os.path.join(self.path, "manifest"), f"{MANIFEST}, batch_id int")

    def runs(self, before: int | None = None) -> list[tuple[int, int]]:
        """(run, rows) of the runs that were valid before a batch, or are now.

        Manifests are read once by each writer of the table; there must be one at a time.
        """
        if self._known is None:
            self._known = {}
            for row in self._manifests(self.spark).collect():
                self._known.setdefault(row["batch_id"], []).append((row["run"], row["rows"]))
        last = max((b for b in self._known if before is None or b < before), default=None)
        return sorted((run, rows) for run, rows in self._known.get(last, ()) if rows)

    def total(self, before: int | None = None) -> int:
        """Stored rows; with ``newest``, rows in all runs."""
        return sum(rows for _, rows in self.runs(before))

    def rows(self, before: int | None = None, spark: SparkSession | None = None) -> DataFrame:
        """The stored rows, hash-partitioned by the key as they lie."""
        return self._read(spark or self.spark, [run for run, _ in self.runs(before)])

    def _read(self, spark: SparkSession, runs: Sequence[int]) -> DataFrame:
        self._open(spark)
        found = spark.table(self.name).where(F.col("run").isin(list(runs))) if runs else spark.table(self.name).where(F.lit(False))
        return self._last(found.select(*self.columns))

    def _last(self, found: DataFrame) -> DataFrame:
        if self.newest is None:
            return found
        rest = [c for c in self.columns if c not in self.key]
        last = F.max_by(F.struct(*rest), self.newest).alias("_last")
        return found.groupBy(*self.key).agg(last).select(*(F.col(c) if c in self.key else F.col(f"_last.{c}") for c in self.columns))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store a batch's rows as a run, merge runs, and write the manifest."""
        spark = rows.sparkSession
        self._open(spark)
        valid = self.runs(before=batch_id)
        self._sweep(spark, {run for run, _ in valid})
        first = batch_id * RUNS_A_BATCH
        size = self._write(spark, rows, first)
        now = [*valid, (first, size)] if size else valid
        for made in range(first + 1, first + RUNS_A_BATCH):
            classes: dict[int, list[tuple[int, int]]] = {}
            for run, n in now:
                classes.setdefault(int(math.log(n, self.fan) + 1e-9), []).append((run, n))
            full = next((runs for _, runs in sorted(classes.items()) if len(runs) >= self.fan), None)
            if full is None:
                break
            # Spark does not let a table be read by its name while a part of it is overwritten.
            paths = [os.path.join(self.path, "runs", f"run={run}") for run, _ in full]
            merged = self._write(spark, self._last(spark.read.schema(self.schema).parquet(*paths)), made)
            now = [r for r in now if r not in full] + [(made, merged)]
        # A table without runs has a manifest too: no batch may look older than it is.
        listed = spark.createDataFrame(now or [(first, 0)], MANIFEST).coalesce(1)
        listed.write.mode("overwrite").parquet(os.path.join(self.path, "manifest", f"batch_id={batch_id}"))
        self._known = {b: runs for b, runs in self._known.items() if b < batch_id} | {batch_id: now or [(first, 0)]}

    def _write(self, spark: SparkSession, rows: DataFrame, run: int) -> int:
        """Rows of the run as written: one file for each bucket that has some."""
        view = f"{self.name}_new"
        seen = Observation()
        dealt = rows.select(*self.columns).repartition(self.buckets, *self.key)
        dealt.observe(seen, F.count(F.lit(1)).alias("n")).createOrReplaceTempView(view)
        spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (run = {run}) SELECT * FROM {view}")
        spark.catalog.dropTempView(view)
        return seen.get["n"]

    def _sweep(self, spark: SparkSession, valid: set[int]) -> None:
        """Delete the runs that the last manifest does not name; no batch can still need them."""
        for row in spark.sql(f"SHOW PARTITIONS {self.name}").collect():
            run = int(row["partition"].removeprefix("run="))
            if run not in valid:
                spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (run = {run})")
                delete_path(spark, os.path.join(self.path, "runs", f"run={run}"))

    def files(self) -> int:
        """How many data files the valid runs have."""
        runs = [run for run, _ in self.runs()]
        self._open(self.spark)
        return len(self.spark.table(self.name).where(F.col("run").isin(runs)).inputFiles()) if runs else 0
