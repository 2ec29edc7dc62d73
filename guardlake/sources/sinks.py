"""Append-only tables.  All writers add files to a folder partitioned by day, so that window
queries prune and retention drops whole partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_by_day(df: DataFrame, path: str, at: str) -> None:
    (df.withColumn("dt", F.to_date(at)).write.mode("append").partitionBy("dt").parquet(path))


def replace_batch(df: DataFrame, path: str, at: str, batch: str) -> None:
    """Rows of one batch of a stream; if the batch runs again, its rows take the place of the
    earlier ones.  Such a table has the batch as a second partition, so it takes no other rows."""
    (df.withColumn("dt", F.to_date(at)).withColumn("batch", F.lit(batch)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").parquet(path))


def append_logs(logs: DataFrame, path: str) -> None:
    append_by_day(logs, path, "created_at")


def append_events(events: DataFrame, path: str, at: str = "created_at") -> None:
    append_by_day(events, path, at)


def append_feedback(feedback: DataFrame, path: str) -> None:
    """Feedback rows; rows without an id get one."""
    if "id" not in feedback.columns:
        feedback = feedback.withColumn("id", F.lit(None).cast("string"))
    append_by_day(feedback.withColumn("id", F.coalesce("id", F.expr("uuid()"))), path,
                  "created_at")


def append_overrides(overrides: DataFrame, path: str) -> None:
    append_by_day(overrides, path, "created_at")


def store_registry(registry: DataFrame, path: str) -> None:
    """Canary registry rows with their expiry."""
    expires = F.timestamp_micros(F.unix_micros("injected_at")
                                 + F.col("ttl_seconds") * F.lit(1_000_000).cast("long"))
    append_by_day(registry.withColumn("expires_at", expires), path, "injected_at")


def append_detections(detections: DataFrame, path: str) -> None:
    append_by_day(detections, path, "detected_at")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by this module, without its partition columns."""
    return spark.read.parquet(path).drop("dt", "batch")
