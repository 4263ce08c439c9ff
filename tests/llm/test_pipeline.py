"""The pipeline's stages, and the registered queries, on the small tables."""

import brute
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, docs_of):
    import corpus_pipeline as pipeline
    from tidemark.session import cut_lineage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(9000, None, None, None, None), (9001, "12 34", "en", "src0", 5), (9002, "", "en", None, 0)], docs.schema
    )
    now = docs.unionByName(extra)
    kept = {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        now = cut_lineage(stage(spark, now, SF))
        kept[name] = now
        if i < len(pipeline.STAGES) - 1:
            assert now.columns == docs.columns
    ids = {name: {r[0] for r in df.select("doc_id").collect()} for name, df in kept.items()}
    assert not ids["language"] & {9000, 9001, 9002} and len(ids["language"]) == docs.count()
    rows = [(r["doc_id"], r["text"]) for r in kept["language"].collect()]
    assert ids["near_duplicates"] == {k for k, (_, c) in brute.simhash_rows(rows).items() if k == c}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: " ".join(r["text"].split()) for r in kept["near_duplicates"].collect()}
    leaks = {k for k, t in texts.items() if any(" ".join(i.split()) in t for i in items)}
    assert ids["decontamination"] == ids["near_duplicates"] - leaks
    assert ids["token_files"] == ids["mixture"] <= ids["decontamination"]


def test_run_equals_stages(spark):
    import corpus_pipeline as pipeline

    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = got.collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pipeline.run(spark, SF).collect()))


@pytest.mark.parametrize("number", range(1, 14))
def test_registered(spark, number):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith(f"op{number}_")]
    assert len(names) == 1
    assert entry.queries()[names[0]](spark, SF).count() > 0
