"""Review records and manifests from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.labels import require_rows
from tidemark.sources.lines import blank_ends, even_quotes_end, multi_line_records, quote_states, split_lines

# The columns of a review record.
REVIEW_COLUMNS = [
    "product_productId",
    "product_title",
    "product_price",
    "review_userId",
    "review_profileName",
    "review_helpfulness",
    "review_score",
    "review_time",
    "review_summary",
    "review_text",
]
REVIEW_CSV = "Id bigint, Score int, Text string"
MANIFEST = "image string, label int"
# A record line, and the categories that become columns.
_LINE = r"(?s)^(?U)(\w+)/(\w+): (.*)$"
_CATEGORIES = ["product", "review"]
_BLANK = "[ \\t\\x0b\\f\\r\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]*"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line-separated blocks of text files, one row each (column ``block``).

    Files are split by bytes whatever their line ends, which may differ between files or lines;
    no record is cut at a split border.  A line of blanks separates records too.
    """
    found = multi_line_records(split_lines(spark, path), blank_ends)
    return found.select(F.col("text").alias("block"))


def parse_records(blocks: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``category/key: value`` blocks -> one row per record.

    Lines of other categories or shapes are ignored, the last of repeated keys wins,
    missing keys are null, and blocks without any record line give no row.
    """
    names = columns or REVIEW_COLUMNS
    lines = F.transform(
        F.split("block", "\\r?\\n"), lambda x: F.regexp_replace(F.regexp_replace(x, f"^{_BLANK}", ""), f"{_BLANK}$", "")
    )
    entries = F.transform(
        F.filter(lines, lambda x: x.rlike(_LINE)),
        lambda x: F.struct(
            F.regexp_extract(x, _LINE, 1).alias("category"),
            F.regexp_extract(x, _LINE, 2).alias("key"),
            F.regexp_extract(x, _LINE, 3).alias("value"),
        ),
    )
    known = F.filter(entries, lambda e: e["category"].isin(_CATEGORIES))
    rows = blocks.select(known.alias("e")).filter(F.size("e") > 0)

    def last(name: str):
        category, key = name.split("_", 1)
        hits = F.filter("e", lambda e: (e["category"] == category) & (e["key"] == key))
        return F.try_element_at(hits, F.lit(-1))["value"].alias(name)

    return rows.select(*[last(n) for n in names])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(read_blocks(spark, path))


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header; doubled quotes are part of the value.

    With ``multi_line`` quoted newlines are too, and files are still split by bytes: the quotes of
    all splits before tell whether a split begins inside a value.  Records then end with LF or
    CRLF, and a quote stands in quoted values only.
    """
    if not multi_line:
        return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    lines = split_lines(spark, path, "\n")
    # One row per split that begins inside a value: fewer than the splits that Spark's own plan of the
    # scan holds on the driver.  A broadcast also leaves the lines in their order.
    inside = quote_states(lines).where("inside = 1")
    placed = lines.join(F.broadcast(inside), ["file", "split"], "left").na.fill(0, ["inside"])
    found = multi_line_records(placed, even_quotes_end, F.col("inside"), known_start=True)
    text = F.regexp_replace("text", "\r$", "")
    rows = found.where(~F.col("first") & (text != "")).select(F.from_csv(text, schema, {"escape": '"'}).alias("r"))
    return rows.select("r.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Image manifest; an empty one is an error."""
    return require_rows(spark.read.schema(MANIFEST).option("header", True).csv(path), f"manifest {path}")
