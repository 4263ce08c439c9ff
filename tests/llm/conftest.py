import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source[, lang]]) rows, with columns whose names operators use inside."""
    from tidemark.llm.common import prepare

    prepare(spark)

    def make(rows, parts=3):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        data = [(k, t, lang, s, len(t or ""), "x", 1) for k, t, s, lang in full]
        return spark.createDataFrame(data, DOCS).repartition(parts)

    return make
