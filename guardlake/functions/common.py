"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C

# Python's `re` is Unicode-aware on str; these prefixes make java.util.regex so too.
ICASE_DOTALL = "(?isuU)"
ICASE = "(?iuU)"
UNICODE = "(?U)"


def sql_text(text: str) -> str:
    """`text` as a Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it many times inside `body`."""
    return F.transform(F.array(value), body)[0]


def fenced(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns exactly once.

    They pass through a generator of one row.  The optimizer neither merges projections
    across it nor moves a filter on these columns below it, where the filter would repeat
    the whole expression for every use; filters on other columns still move down.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def compact(items: Iterable[Column]) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def any_of(conditions: Iterable[Column]) -> Column:
    out = None
    for condition in conditions:
        out = condition if out is None else (out | condition)
    return F.lit(False) if out is None else out


def level_rank(level: Column) -> Column:
    """0 for safe (or unknown) up to 4 for critical; order by this, never by name."""
    return F.find_in_set(level, F.lit(",".join(C.LEVELS[1:])))


def rank_level(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in C.LEVELS]), rank + 1)


def max_or(array: Column, field: Callable[[Column], Column], default) -> Column:
    """Largest `field` over an array of structs, `default` when it is empty."""
    return F.coalesce(F.array_max(F.transform(array, field)), F.lit(default))


def pct(value: Column, places: int) -> Column:
    """0.8567 -> '85.7%' (places=1)."""
    return F.format_string(f"%.{places}f%%", value * 100.0)
