"""Evaluation by content: rows that say the same are evaluated once and share the result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from guardlake.session import spread

SALTS = 64  # the bits of a long


def once_per_content(rows: DataFrame, content: Sequence[str],
                     evaluate: Callable[[DataFrame], DataFrame], outputs: Sequence[str],
                     keep: Sequence[str] = ()) -> DataFrame:
    """`rows` without their `content` columns (but for `keep`), with the `outputs` that
    `evaluate` adds to rows of `content`; it must pass other columns through.

    Contents are known by their SHA-256.  Copies combine map-side, so a content that owns most
    rows reaches one task once per map task.  Results travel back without the contents: every
    row has one of 64 salts by its other columns, the aggregate notes which salts of a content
    occur, and a result is repeated for those only, so one that is used once is not multiplied.
    `rows` is read twice: pass a stored table where it is costly to compute.
    """
    key, salt, salts = "__content", "__salt", "__salts"
    rows = rows.withColumn(key, F.sha2(F.to_json(F.struct(*content)), 256))
    other = [f.name for f in rows.schema.fields
             if f.name not in content and isinstance(f.dataType, AtomicType)]
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*other), F.lit(SALTS)).cast("int"))
    once = (rows.groupBy(key).agg(F.first(F.struct(*content)).alias("__said"), F.bit_or(
                F.expr(f"shiftleft(1L, {salt})")).alias(salts))
            .select(key, salts, "__said.*"))
    used = F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit({salts}, s) = 1)")
    done = evaluate(spread(once, key)).select(key, F.explode(used).alias(salt), *outputs)
    gone = [c for c in content if c not in keep]
    return rows.drop(*gone).join(done, [key, salt]).drop(key, salt)
