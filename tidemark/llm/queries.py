"""The registered queries of the corpus operators, over whole tables.

SQL stands beside a query where DuckDB can express it; the others are compared with
brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chunkdedup, decontam, htmltext, langid, mixing, personal, resample, simhash, sourceaudit, suffixdedup, tokenbin, vectordup, warc,
)
from tidemark.llm.common import prepare, read_table
from tidemark.session import work_path

QueryFn = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, QueryFn] = {}
_oracles: dict[str, str] = {}

#: The end-of-document id of the token files.
END_ID = 1


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        _queries[name] = run
        if sql is not None:
            _oracles[name] = sql
        return fn

    return wrap


def queries() -> dict[str, QueryFn]:
    return dict(_queries)


def oracles() -> dict[str, str]:
    return dict(_oracles)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, written to token files and digested from what is read back.

    A null or empty text is the end id alone; rows without an id come first, rows that share one stand
    together; no documents give no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    files = tokenbin.write_tokens(docs, "doc_id", "text", tokenizer_path(), END_ID)
    return tokenbin.token_digests(spark, files).withColumnRenamed("key", "doc_id")


@register("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest overlap of each document with each benchmark item it meets.

    Null and empty texts overlap with nothing; rows without an id are not in the result.
    """
    docs, benchmark = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = decontam.overlaps(docs, benchmark, "doc_id", "text", "item_id", "text")
    return found.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


@register("op3_vector_neardup")
def op3_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the number of vectors it links with and its component.

    Null, zero and non-finite vectors and null labels link with nothing; every row comes back once, also
    without an id or with one that others have.
    """
    vectors = read_table(spark, sf_dir, "embeddings")
    found = vectordup.near_vectors(vectors, "vec_id", "embedding", "label", 0.98)
    return found.select(
        F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept")
    )


@register("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null, empty and textless pages have an empty one, rows repeat as they do."""
    return htmltext.extract_text(read_table(spark, sf_dir, "pages"), "page_id", "url", "html").withColumnRenamed("key", "page_id")


@register("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; null texts have none, and null sources are one source."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    plan = mixed.plan
    sources = spark.createDataFrame(
        list(zip(range(len(plan.sources)), plan.sizes, plan.targets)), "source_no int, source_size long, target double"
    )
    taken = mixing.taken_words(mixed).join(F.broadcast(sources), "source_no")
    return taken.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "taken")


@register(
    "op6_warc_revisits",
    """WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
 m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM d),
 r AS (SELECT *, payload_bytes >= 1000 AND page_id <> original AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN original END AS refers_to FROM r""",
)
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives with resolved revisits, read back.

    Null html is an empty payload; of equal payloads the largest page_id is the response, and rows that share
    even that all are.
    """
    pages = read_table(spark, sf_dir, "pages")
    ids = pages.withColumn("record_id", F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")))
    records = warc.payload_records(ids, "record_id", "url", "html", "page_id")
    folder = work_path(spark, "warc")
    warc.write_archives(warc.resolve_revisits(records, 1000), folder, "2024-01-01T00:00:00Z")
    page_of = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).cast("long")
    return warc.read_archives(spark, folder).select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to")
    )


@register("op7_simhash_neardup")
def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words have fingerprint zero and link like others."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), "doc_id", "text", 3, 3)
    print_ = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(F.col("key").alias("doc_id"), print_.alias("fingerprint"), F.col("component").alias("component_id"))


def held_out(key: str):
    """True for the documents that op8 does not learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1, F.lit(False))


@register("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them; null and letterless texts are ``und``."""
    docs = read_table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(~held_out("doc_id")), "text", "lang", "doc_id")
    found = langid.predict(docs, profiles, "doc_id", "text")
    return found.select(
        F.col("key").alias("doc_id"), held_out("key").alias("held_out"), F.col("language").alias("lang_pred"), "score"
    )


@register("op9_chunk_dedup")
def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunk runs that smaller ids have; null texts are empty, rows without an id stay whole.

    Rows that share an id are not smaller than each other and lose the runs of their own texts.
    """
    docs = read_table(spark, sf_dir, "documents")
    spans = chunkdedup.duplicate_spans(docs, "doc_id", "text")
    kept = chunkdedup.remove_spans(docs, spans, "doc_id", "text", keep_text=False)
    return kept.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "sources")


@register("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that start in smaller ids; null texts are empty.

    Rows without an id stay whole; rows that share an id are not smaller than each other.
    """
    docs = read_table(spark, sf_dir, "documents")
    kept = suffixdedup.remove_repeats(docs, "doc_id", "text", 50, keep_text=False)
    return kept.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op11_target_resampling")
def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark; 5 in 100 of those of 20 words or more are drawn."""
    docs, target = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = resample.resample(docs, target, "doc_id", "text", "text", percent=5, least_words=20, buckets=10_000, seed=42)
    return found.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


@register(
    "op12_source_audit",
    r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
 w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 v AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
 vs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM v GROUP BY lang),
 c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN v USING (lang, term) GROUP BY lang, source, term),
 g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d
   LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source) s USING (lang, source) GROUP BY d.lang, d.source),
 p AS (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c,
   (1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * vs.v)) AS p, (1 + (1000000000::HUGEINT * (v.c + 5)) // (vs.n + 5 * vs.v)) AS q
   FROM g JOIN v USING (lang) JOIN vs USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
 s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
   LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
   UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q),
 k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 50""",
)
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources of a language by divergence, and the terms that each uses most beyond its language."""
    return sourceaudit.divergence(read_table(spark, sf_dir, "documents"), "text", "lang", "source", least_docs=30, smooth=5, top=50)


@register("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of every document, and all spans."""
    docs = read_table(spark, sf_dir, "documents")
    found = personal.detect(docs, "doc_id", "text", personal.fit(docs, "doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(personal.KINDS)]
    digest = F.sha2(personal.span_text("base"), 256).alias("base_sha256")
    return found.select(F.col("key").alias("doc_id"), *counts, digest, personal.span_text("spans").alias("spans"))
