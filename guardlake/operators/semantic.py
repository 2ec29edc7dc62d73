"""Intent scoring of text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import semantic as S


def keyword_scores(df: DataFrame, text: str = "text",
                   threshold: float = C.SEMANTIC_THRESHOLD) -> DataFrame:
    """Add `semantic` from the built-in keyword classifier."""
    return df.withColumn("semantic", S.keyword_verdict(F.col(text), threshold))


def logit_scores(df: DataFrame, logits: str = "logits", text: str | None = None,
                 threshold: float = C.SEMANTIC_THRESHOLD) -> DataFrame:
    """Add `semantic` from a logits column; rows without logits fall back to keywords."""
    scored = S.logits_verdict(F.col(logits), threshold)
    if text is not None:
        scored = F.when(F.col(logits).isNull(), S.keyword_verdict(F.col(text), threshold)
                        ).otherwise(scored)
    return df.withColumn("semantic", scored)


def each_scored(predict: Callable[[list[str]], list], texts: list) -> list:
    """What `predict` gives for each text; None for the texts that it fails on.

    A list that fails is halved until the failing texts stand alone, so k of them among n cost
    about 2 k log n calls and leave the others their scores.
    """
    try:
        out = list(predict(texts))
        if len(out) == len(texts):
            return out
    except Exception:  # noqa: BLE001 - a failing model means "use the fallback"
        pass
    if len(texts) <= 1:
        return [None] * len(texts)
    half = len(texts) // 2
    return each_scored(predict, texts[:half]) + each_scored(predict, texts[half:])


def with_logits(df: DataFrame, load: Callable[[], Callable[[list[str]], list]],
                text: str = "text", out: str = "logits") -> DataFrame:
    """Add logits from a pluggable model.

    `load()` runs once per task and returns a function from a list of texts to a list of five
    logits each (or None where it failed).  If it raises, or returns another number of results, only
    the texts that it fails on alone are without logits.  A null text has none.
    """
    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for batch in batches:
            logits = pd.Series([None] * len(batch), dtype=object)
            given = [i for i, x in enumerate(batch) if x is not None]
            for i, found in zip(given, each_scored(predict, [batch.iloc[i] for i in given])):
                logits.iat[i] = found
            yield logits

    return df.withColumn(out, score(F.col(text)))
