"""Redaction of texts and of provider responses, and reports over what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.functions import redact as R
from guardlake.functions.common import fenced


def redact(df: DataFrame, text: str = "text", out: str = "redacted",
           rules: R.Rules = R.DEFAULT) -> DataFrame:
    """Add the redacted text."""
    return df.withColumn(out, R.redacted(F.col(text), rules))


def filter_text(df: DataFrame, text: str = "text", rules: R.Rules = R.DEFAULT) -> DataFrame:
    """Add `redacted` and `redactions` (one struct per rule that fired)."""
    both = "__filtered"
    df = fenced(df.withColumn(both, R.filtered(F.col(text), rules)), both)
    return (df.withColumn("redacted", F.col(both)["text"])
            .withColumn("redactions", F.col(both)["detections"]).drop(both))


def redaction_hits(df: DataFrame, keys: list[str], text: Column | str = "text",
                   rules: R.Rules = R.DEFAULT) -> DataFrame:
    """Detect only: one row per (text, rule that fires)."""
    text = F.col(text) if isinstance(text, str) else text
    return df.select(*keys, F.inline(R.filtered(text, rules)["detections"]))


def filter_responses(responses: DataFrame, rules: R.Rules = R.DEFAULT) -> DataFrame:
    """Redact every choice of a response in place.

    `choices` is array<struct<index, content>>; choices stay in their row, so nothing is
    shuffled.  Adds `output_sanitized` and `sanitizations`.
    """
    done = F.transform("choices", lambda c: F.struct(
        c["index"].alias("index"), R.filtered(F.coalesce(c["content"], F.lit("")), rules)
        .alias("f"), c["content"].isNull().alias("absent")))
    return (responses.withColumn("__done", done)
            .withColumn("choices", F.transform("__done", lambda d: F.struct(
                d["index"].alias("index"),
                F.when(~d["absent"], d["f"]["text"]).alias("content"))))
            .withColumn("sanitizations", F.flatten(
                F.transform("__done", lambda d: d["f"]["detections"])))
            .withColumn("output_sanitized", F.size("sanitizations") > 0).drop("__done"))


def corpus_report(df: DataFrame, text: str = "text", rules: R.Rules = R.DEFAULT) -> DataFrame:
    """Texts and distinct matches per rule over a whole corpus."""
    return (redaction_hits(df, [], text, rules).groupBy("rule", "category")
            .agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_matches")))
