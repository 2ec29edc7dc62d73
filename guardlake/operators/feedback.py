"""Feedback statistics and threshold tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions.common import pct

ADJUSTMENT_COLUMNS = ("pattern_name", "category", "original_threshold", "adjusted_threshold",
                      "adjustment_reason", "updated_at")


def pattern_stats(feedback: DataFrame, pattern: str | None = None) -> DataFrame:
    """Accuracy per pattern and category; the optional filter runs below the aggregate."""
    df = feedback.filter(F.col("pattern_name").isNotNull())
    if pattern is not None:
        df = df.filter(F.col("pattern_name") == pattern)
    total, good = F.count(F.lit(1)), F.count_if("was_correct")
    return df.groupBy("pattern_name", "category").agg(
        total.alias("total_feedback"), good.alias("correct_count"),
        (total - good).alias("incorrect_count"),
        F.round(good * 100.0 / total, 2).alias("accuracy_percentage"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"),
        F.max("created_at").alias("last_feedback_at"))


def all_pattern_stats(feedback: DataFrame) -> DataFrame:
    return pattern_stats(feedback).orderBy(F.desc("total_feedback"), "pattern_name")


def recent_feedback(feedback: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return feedback.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def feedback_count(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count(F.lit(1)).alias("n_feedback"))


def mark_reviewed(feedback: DataFrame, reviews: DataFrame, as_of: Column) -> DataFrame:
    """Stamp the rows named in `reviews` (id, reviewed_by); one review per id."""
    reviews = reviews.groupBy("id").agg(F.max("reviewed_by").alias("reviewed_by"))
    return (feedback.join(reviews, "id", "left")
            .withColumn("reviewed_at", F.when(F.col("reviewed_by").isNotNull(), as_of)))


def tune_thresholds(stats: DataFrame, adjustments: DataFrame, as_of: Column, *,
                    min_samples: int = C.MIN_SAMPLES) -> DataFrame:
    """New adjustments: patterns with many false positives go down a step, accurate ones up,
    within reach of their original threshold and at most once per cooldown."""
    held = adjustments.select("pattern_name", "original_threshold",
                              F.col("adjusted_threshold").alias("__now"), "updated_at")
    df = stats.filter(F.col("total_feedback") >= min_samples).join(held, "pattern_name", "left")
    since = as_of - F.make_dt_interval(F.lit(C.COOLDOWN_DAYS))
    df = df.filter(F.col("updated_at").isNull() | (F.col("updated_at") <= since))
    base = F.coalesce("original_threshold", F.lit(C.DEFAULT_THRESHOLD))
    now = F.coalesce("__now", base)
    wrong = F.col("incorrect_count") / F.col("total_feedback")
    noisy = wrong > C.HIGH_FP_RATE
    sharp = F.col("accuracy_percentage") >= C.HIGH_ACCURACY_PCT
    down = F.greatest(base - C.MAX_THRESHOLD_MOVE, now - C.THRESHOLD_STEP)
    up = F.least(base + C.MAX_THRESHOLD_MOVE, now + C.THRESHOLD_STEP)
    reason = F.when(noisy, F.concat(
        F.lit("High FP rate: "), pct(wrong, 1), F.lit(" ("), F.col("incorrect_count")
        .cast("string"), F.lit("/"), F.col("total_feedback").cast("string"), F.lit(")"))
        ).otherwise(F.concat(F.lit("High accuracy: "), F.format_string(
            "%.1f%%", "accuracy_percentage")))
    df = (df.filter(noisy | sharp).withColumn("__next", F.when(noisy, down).otherwise(up))
          .withColumn("__prev", now).withColumn("__base", base))
    moved = df.filter(F.abs(F.col("__next") - F.col("__prev")) >= C.MIN_THRESHOLD_MOVE)
    row = F.struct("category", F.col("__base").alias("original_threshold"),
                   F.col("__next").alias("adjusted_threshold"),
                   reason.alias("adjustment_reason"), as_of.alias("updated_at"))
    # A pattern seen under several categories moves once, for the one with most feedback.
    first = F.min_by(row, F.struct(-F.col("total_feedback"), F.col("category")))
    return moved.groupBy("pattern_name").agg(first.alias("r")).select("pattern_name", "r.*")


def upsert_adjustments(current: DataFrame, new: DataFrame) -> DataFrame:
    """Current adjustments with the new ones inserted or laid over them.

    As in an upsert on pattern_name: an existing row keeps its category and original
    threshold.
    """
    cur, upd = current.alias("c"), new.alias("n")
    both = cur.join(upd, F.col("c.pattern_name") == F.col("n.pattern_name"), "full_outer")
    keep = ("pattern_name", "category", "original_threshold")
    fresh = F.col("n.pattern_name").isNotNull()
    exists = F.col("c.pattern_name").isNotNull()
    return both.select(
        *[F.when(exists, F.col(f"c.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in keep],
        *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"c.{c}")).alias(c)
          for c in ADJUSTMENT_COLUMNS if c not in keep])


def with_threshold(df: DataFrame, adjustments: DataFrame, pattern: str = "pattern_name",
                   default: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Add `threshold`: the adjusted one of the pattern, or the default."""
    tuned = adjustments.select(F.col("pattern_name").alias(pattern),
                               F.col("adjusted_threshold").alias("__t"))
    return (df.join(tuned, pattern, "left")
            .withColumn("threshold", F.coalesce("__t", F.lit(default))).drop("__t"))


def reset_adjustments(adjustments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(number of adjustments reset as one row, the emptied table)."""
    return (adjustments.agg(F.count(F.lit(1)).alias("n_reset")), adjustments.limit(0))


def cascade_overrides(overrides: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback plus one 'incorrect' record per FALSE_POSITIVE override."""
    rows = overrides.filter("action = 'FALSE_POSITIVE'").select(
        "request_log_id", F.lit(False).alias("was_correct"),
        F.concat(F.lit(C.OVERRIDE_REASON_PREFIX), F.col("reason")).alias("reason"))
    return feedback.unionByName(rows, allowMissingColumns=True)
