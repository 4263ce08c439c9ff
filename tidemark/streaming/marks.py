"""A table's rows past a high-water id as a stream: the checkpoint is the mark.

The offset of a batch is the largest id it holds, so what a delivery has seen is kept where
Spark keeps it, beside the commit log.  A batch whose delivery fails is delivered again with the
same rows; one that was committed never is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SOURCE = "rows_by_id"


@dataclass
class IdRange(InputPartition):
    """The rows of a file with ``after < id <= upto``."""

    file: str
    after: int
    upto: int


class RowsById(DataSource):
    """Options: ``path`` of a Parquet table, ``id`` its integer column, ``after`` the first mark."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RowsByIdReader(self.options["path"], self.options["id"], int(self.options["after"]), schema.names)


class RowsByIdReader(DataSourceStreamReader):
    """Marks come from the statistics in the files' footers; of each file they are read once.

    A batch has a task for each file that may hold ids of its range, and there the id filter
    skips row groups.
    """

    def __init__(self, path: str, id_col: str, after: int, columns: list[str]):
        self.path, self.id_col, self.after, self.columns = path, id_col, after, columns
        self.ranges: dict[str, tuple[int, int] | None] = {}

    def _files(self) -> dict[str, tuple[int, int]]:
        """Smallest and largest id of every file that has one."""
        files, root = pafs.FileSystem.from_uri(self.path)
        found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        names = [f.path for f in found if f.is_file and f.path.endswith(".parquet") and not _hidden(f.path[len(root) :])]
        for name in names:
            if name not in self.ranges:
                self.ranges[name] = id_range(pq.read_metadata(name, filesystem=files), self.id_col)
        return {name: self.ranges[name] for name in names if self.ranges[name]}

    def initialOffset(self) -> dict:
        return {"id": self.after}

    def latestOffset(self) -> dict:
        return {"id": max([self.after, *(high for _, high in self._files().values())])}

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        after, upto = start["id"], end["id"]
        return [IdRange(name, after, upto) for name, (low, high) in sorted(self._files().items()) if high > after and low <= upto]

    def read(self, partition: IdRange) -> Iterator:
        files, _ = pafs.FileSystem.from_uri(self.path)
        rows, at = ds.dataset(partition.file, filesystem=files, format="parquet"), ds.field(self.id_col)
        yield from rows.to_batches(columns=self.columns, filter=(at > partition.after) & (at <= partition.upto))


def _hidden(path: str) -> bool:
    return any(part.startswith(("_", ".")) for part in path.split("/"))


def id_range(footer: pq.FileMetaData, id_col: str) -> tuple[int, int] | None:
    """Smallest and largest id of a file, none if it has no ids; a file without statistics is refused."""
    column = next(i for i in range(footer.num_columns) if footer.schema.column(i).path == id_col)
    low, high = [], []
    for i in range(footer.num_row_groups):
        group = footer.row_group(i)
        stats = group.column(column).statistics
        if stats is not None and stats.has_min_max:
            low.append(stats.min), high.append(stats.max)
        elif group.num_rows and (stats is None or stats.null_count != group.num_rows):
            raise ValueError(f"no statistics of {id_col}")
    return (min(low), max(high)) if low else None


def rows_after(spark: SparkSession, path: str, schema: str, id_col: str, after: int = 0) -> DataFrame:
    """The rows of a Parquet table with ``id_col`` past ``after``, and later those appended, as a stream.

    Ids must grow from append to append, as :func:`tidemark.operators.tables.append_with_ids` makes
    them: a row that appears with an id below the mark is never delivered, nor is one without an
    id.  ``schema`` names the columns that are read; others stay in the files.  ``path`` is a folder
    that the driver and all executors see, with or without a scheme; hidden files don't count.
    """
    spark.dataSource.register(RowsById)
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    stream = spark.readStream.format(SOURCE).schema(schema)
    return stream.options(path=path, id=id_col, after=str(after)).load()
