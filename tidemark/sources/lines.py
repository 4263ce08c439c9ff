"""Records of several lines, read from byte ranges of large text files.

Spark splits files by bytes and gives every line to one split.  A task puts the records together
that lie inside a split; what reaches over its borders leaves it as pieces, which are joined by
place.  Only pieces are shuffled, at most three a split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (line, state) -> (line belongs to a record, the record ends with it, state)
Step = Callable[[str, int], tuple[bool, bool, int]]

_PIECES = "file string, split bigint, part int, first boolean, text string"
HEAD, WHOLE, TAIL = 0, 1, 2


def split_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """(value, file, split) of every line, in file order inside each split of a task.

    Without ``line_sep`` a line ends with LF, CR or both.
    """
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def multi_line_records(lines: DataFrame, step: Step, start: Column | None = None, known_start: bool = False) -> DataFrame:
    """(file, split, first, text): the records of all files; ``first`` marks the one a file begins with.

    ``step`` follows the lines of a split from the state ``start`` on.  With ``known_start``
    a split that begins in state 0 begins with a record; otherwise the lines before the first
    end belong to the record that the split before left open, if it did.
    """
    marked = lines.select("value", "file", "split", (F.lit(0) if start is None else start).cast("int").alias("state"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple[str, int] | None = None
        held: list[str] = []
        closed, begun, state = False, False, 0
        made: list[tuple[str, int, int, bool, str | None]] = []

        def emit(part: int) -> None:
            # A tail without lines says that nothing is open; others without lines are empty blocks.
            if held or part == TAIL:
                made.append((*place, part, place[1] == 0 and not begun, "\n".join(held) if held else None))

        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(4))
            for value, file, split, at_start in zip(*columns):
                if (file, split) != place:
                    if place:
                        emit(TAIL if closed else HEAD)
                    place, held, state, begun = (file, split), [], at_start, False
                    closed = split == 0 or (known_start and at_start == 0)
                keep, ends, state = step(value, state)
                if keep:
                    held.append(value)
                if ends:
                    emit(WHOLE if closed else HEAD)
                    begun, closed, held = begun or bool(held), True, []
            if made:
                yield _batch(made)
                made = []
        if place:
            emit(TAIL if closed else HEAD)
            yield _batch(made)

    # Whole records are as much as the input; pieces are few.  Both come from one scan each.
    pieces = marked.mapInArrow(run, _PIECES)
    whole = pieces.where(F.col("part") == WHOLE).select("file", "split", "first", "text")
    border = pieces.where(F.col("part") != WHOLE)
    opened = F.sum((F.col("part") == TAIL).cast("int")).over(W.partitionBy("file").orderBy("split", "part").rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = (
        border.withColumn("opened", F.coalesce(opened, F.lit(0)))
        .groupBy("file", "opened")
        .agg(F.sort_array(F.collect_list(F.struct("split", "part", "text"))).alias("parts"), F.max("first").alias("first"))
        .select("file", F.col("parts")[0]["split"].alias("split"), "first", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    )
    return whole.unionByName(joined.where(F.col("text") != ""))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    columns = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "split", "part", "first", "text"])


def blank_ends(value: str, state: int) -> tuple[bool, bool, int]:
    """Blocks of lines end at a blank line, which belongs to none."""
    blank = not value or value.isspace()
    return not blank, blank, state


def even_quotes_end(value: str, state: int) -> tuple[bool, bool, int]:
    """A record ends with the line that closes its last quoted value."""
    inside = (state + value.count('"')) & 1
    return True, not inside, inside


def quote_states(lines: DataFrame) -> DataFrame:
    """(file, split, inside): 1 for the splits that begin inside a quoted value, from the quotes of all splits before."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "split").agg(F.sum(quotes).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    return counts.select("file", "split", F.pmod(F.coalesce(before, F.lit(0)), F.lit(2)).cast("int").alias("inside"))
