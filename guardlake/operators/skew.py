"""Ranking and lookups that hold when one key owns a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 8


def ranked(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str],
           out: str) -> DataFrame:
    """1-based position of each row within its key, without one task per key.

    `bucket` must not decrease along `order`.  Rows are numbered within (key, bucket), and
    each bucket is shifted by the size of the buckets before it, taken from a map-side
    combined count.
    """
    slot, shift, size = "__slot", "__shift", "__size"
    group = [*keys, slot]
    df = df.withColumn(slot, bucket)
    before = Window.partitionBy(*keys).orderBy(slot).rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = (df.groupBy(*group).agg(F.count(F.lit(1)).alias(size))
              .withColumn(shift, F.coalesce(F.sum(size).over(before), F.lit(0))).drop(size))
    local = df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return (local.join(shifts, group).withColumn(out, F.col(out) + F.col(shift))
            .drop(slot, shift))


def lookup(big: DataFrame, dim: DataFrame, keys: Sequence[str], spread: Sequence[str],
           how: str = "inner", salts: int = DEFAULT_SALTS) -> DataFrame:
    """Equi-join of `big` with a dimension that has one row per key.

    A hot key of `big` is spread over `salts` tasks by a hash of the `spread` columns; the
    dimension is repeated once per salt.  If the dimension turns out small enough, adaptive
    execution broadcasts it instead.
    """
    salt = "__salt"
    big = big.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    dim = dim.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(dim, [*keys, salt], how).drop(salt)
