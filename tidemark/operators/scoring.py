"""Batch scoring of texts with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import NEGATIVE, NEUTRAL, POSITIVE, head

# A scorer factory runs once per Python worker (a model loads once) and returns a
# function from a list of texts to a list of labels.
ScorerFactory = Callable[[], Callable[[list[str]], list[str]]]

# Small default word lists.
DEFAULT_POSITIVE = ("good", "great", "best", "love", "excellent", "delicious", "perfect", "nice", "happy", "favorite")
DEFAULT_NEGATIVE = ("bad", "worst", "poor", "awful", "terrible", "hate", "disappointed", "stale", "waste", "horrible")


def lexicon_scorer(
    positive: Sequence[str] = DEFAULT_POSITIVE, negative: Sequence[str] = DEFAULT_NEGATIVE
) -> ScorerFactory:
    def load():
        weight = {**{w: 1 for w in positive}, **{w: -1 for w in negative}}

        def score(texts: list[str]) -> list[str]:
            out = []
            for text in texts:
                tokens = text.lower().split()
                total = sum(weight.get(w, 0) for w in tokens)
                out.append(NEUTRAL if not tokens else POSITIVE if total >= 0 else NEGATIVE)
            return out

        return score

    return load


def score_texts(
    df: DataFrame,
    text: str,
    factory: ScorerFactory,
    batch_size: int = 32,
    max_chars: int | None = None,
    out: str = "predicted_sentiment",
) -> DataFrame:
    """Add the label and an ``error`` column.

    Null text counts as "".  A batch the scorer fails on gets a null label and the
    error text, so a broken model cannot pass for a verdict.  ``max_chars`` cuts
    texts first, for models with an input limit; by default whole texts are scored.
    """
    shape = T.StructType([T.StructField("label", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(shape)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = factory()
        for batch in batches:
            labels, errors = [], []
            texts = batch.tolist()
            for i in range(0, len(texts), batch_size):
                part = texts[i : i + batch_size]
                try:
                    labels += list(score(part))
                    errors += [None] * len(part)
                except Exception as failure:  # noqa: BLE001 - reported per row
                    labels += [None] * len(part)
                    errors += [f"{type(failure).__name__}: {failure}"] * len(part)
            yield pd.DataFrame({"label": labels, "error": errors}, dtype=object)

    body = F.coalesce(F.col(text), F.lit(""))
    if max_chars is not None:
        body = head(body, max_chars)
    return df.withColumn("_s", predict(body)).withColumns({out: F.col("_s.label"), "error": F.col("_s.error")}).drop("_s")
