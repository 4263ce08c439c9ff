"""A corpus pipeline: language, near-duplicates, benchmark leaks, mixing, token files.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns rows with the columns of ``documents``; the last returns what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, mixing, simhash, tokenbin
from tidemark.llm.common import numbered, prepare, read_table
from tidemark.llm.queries import END_ID, held_out, tokenizer_path
from tidemark.session import cut_lineage

#: A text is in none of the learned languages if its phrases are this short on average.
FEWEST_PHRASE_BYTES = 2.0
#: Words that a tokenizing worker keeps here, where earlier stages have left it less room.
KEPT_WORDS = 60_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, texts without letters, and texts that
    no learned language explains in phrases of more than ``FEWEST_PHRASE_BYTES`` on average.
    A null ``lang`` is filled with the prediction.  Rows are judged by their text alone, so repeated
    rows stay or go together and a null id changes nothing; an empty table gives an empty one.
    """
    prepare(spark)
    profiles = langid.fit(docs.where(~held_out("doc_id")), "text", "lang", "doc_id")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = langid.predict(rows, profiles, "row", "text")
    # A text of one or two bytes has no longer phrases than itself.
    least = F.least(F.lit(FEWEST_PHRASE_BYTES), F.col("parsed") - 0.5)
    kept = found.where((F.col("language") != "und") & (F.col("phrase_bytes") > least))
    return kept.select(
        *(F.coalesce("key.lang", "language").alias(c) if c == "lang" else F.col("key").getField(c).alias(c) for c in docs.columns)
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash group, the one with the smallest doc_id.

    Among rows that share it, or if all have none, the first read stays; a row with an id goes
    before rows without.  Null and empty texts are one group.  Columns of the rows are
    kept as they are; an empty table gives an empty one.
    """
    prepare(spark)
    shared = cut_lineage(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"))
    # Rows that their id names go by it; only the others are written with a number.
    named = docs.where("doc_id IS NOT NULL").join(shared, "doc_id", "left_anti").select(docs.columns)
    others = docs.where("doc_id IS NULL").unionByName(docs.join(shared, "doc_id", "left_semi").select(docs.columns))
    others, number = numbered(others)
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = named.withColumn(number, F.concat(F.lit("id:"), id_text)).unionByName(
        others.withColumn(number, F.concat(F.lit("row:"), F.col(number).cast("string"), F.lit(":"), id_text))
    )
    found = simhash.near_duplicates(rows, number, "text", 3, 3)
    doc_id = F.try_element_at(F.split("key", ":"), F.lit(-1)).try_cast("long")
    place = F.struct(doc_id.isNull().alias("missing"), doc_id.alias("id"), "key")
    kept = found.groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.key").alias(number))
    return rows.join(kept.hint("shuffle_hash"), number, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a passage of the benchmark, whether they have an id or not.

    Repeated rows are judged each, null and empty texts stay, and an empty benchmark or table
    drops nothing.
    """
    prepare(spark)
    # What a text holds depends on the text alone, so its digest names it.
    texts = docs.select("text", F.md5("text").alias("digest"))
    found = decontam.overlaps(texts, read_table(spark, sf_dir, "benchmark"), "digest", "text", "item_id", "text")
    hit = cut_lineage(found.select(F.col("key").alias("digest")).distinct())
    return docs.join(hit, F.md5(docs["text"]) == hit["digest"], "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of their sources takes them: a row for each pass that takes words of one.

    A null source is a source of its own.  Rows without words (null and empty texts) are never
    taken; repeated rows and rows without an id are taken each for itself.  An empty table
    gives an empty one.
    """
    prepare(spark)
    rows, number = numbered(docs)
    mixed = mixing.mix(rows, "doc_id", "text", "source", row=number)
    return mixing.mixed_documents(mixed, rows, number, "text", "n_chars")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left: doc_id, start, n_tokens and ids_crc32 of each row, read from them.

    Rows stand in ascending order of doc_id, null ids as the operator orders them; rows that
    share an id stand each for itself.  A null text is empty and gives the end id alone.
    """
    prepare(spark)
    files = tokenbin.write_tokens(docs, "doc_id", "text", tokenizer_path(), END_ID, kept_words=KEPT_WORDS)
    return tokenbin.token_digests(spark, files).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: SimHash, the parse into phrases and the tokenizer have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
