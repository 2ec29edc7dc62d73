"""Rate limits as analytics over event tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators.skew import ranked

SLICES = 600


def decision(current: Column, epoch: Column, limit, window: int, burst: int) -> list[Column]:
    """allowed / remaining / reset_after_seconds from the running count of a window."""
    cap = (limit if isinstance(limit, Column) else F.lit(limit)) + burst
    return [(current <= cap).alias("allowed"),
            F.greatest(F.lit(0).cast("long"), cap - current).alias("remaining"),
            (F.lit(window) - F.pmod(epoch, F.lit(window))).alias("reset_after_seconds")]


def counted(events: DataFrame, keys: list[str], ts: str, order: str, window: int) -> DataFrame:
    """Add `window_id` and `current`, the running number of the event in its window.

    Windows are numbered in slices of time, so a key that owns most events of a window (the
    global key owns all of them) is still counted by many tasks.
    """
    micros = F.unix_micros(ts)
    width = window * 1_000_000
    df = events.withColumn("window_id", F.floor(micros / width).cast("long"))
    slot = F.floor(F.pmod(micros, F.lit(width)) / max(width // SLICES, 1))
    return ranked(df, [*keys, "window_id"], slot, [F.col(ts), F.col(order)], "current")


def rate_limit(events: DataFrame, key: str, *, limit=C.RATE_PER_KEY,
               window: int = C.RATE_WINDOW_SECONDS, burst: int = C.RATE_BURST,
               ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Fixed-window counter per `key`; `limit` may be a column (per-key limits)."""
    df = counted(events, [key], ts, order, window)
    epoch = F.unix_seconds(ts)
    return df.select("*", *decision(F.col("current"), epoch, limit, window, burst))


def time_bounds(events: DataFrame, ts: str, slots: int) -> list[int]:
    """Microseconds that cut the events into up to `slots` spans of about equal size."""
    shares = [k / slots for k in range(1, slots)]
    if not shares:
        return []
    cuts = events.select(F.percentile_approx(F.unix_micros(ts), shares, 100 * slots)).head()[0]
    return sorted(set(cuts or []))


def slot_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below a value, by two short searches."""
    def at_most(numbers: Column) -> Column:
        return F.size(F.filter(numbers, lambda b: b <= value))

    def longs(numbers: list[int]) -> Column:
        return F.array(*[F.lit(n).cast("long") for n in numbers])

    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    head = at_most(longs([b[0] for b in blocks]))
    inside = F.get(F.array(*[longs(b) for b in blocks]), head - 1)
    return F.when(head == 0, 0).otherwise((head - 1) * step + at_most(inside))


def running_counts(events: DataFrame, tiers: dict[str, Column], ts: str, order: str,
                   window: int, slots: int | None = None) -> DataFrame:
    """Add `window_id` and, for each tier, a column with the running number of the event among
    those of its key and window; a null key has none.

    Events are exchanged once, by spans of time of about equal size (`slots` of them, by default
    two per shuffle partition), and are numbered within a span for all tiers.
    Only windows that a bound cuts need more: their events are counted per span, tier and key,
    which combines map-side, and the sums of the spans before come along as one row per key, so
    events are neither repeated per tier nor joined.  `events` is read three times, twice for
    the times or the cut windows only.  Events without a time are left out.
    """
    slots = slots or 2 * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = time_bounds(events, ts, slots)
    width, at, slot, first = window * 1_000_000, "__at", "__slot", "__first"
    keys, steps = {t: f"__key_{t}" for t in tiers}, {t: f"__step_{t}" for t in tiers}
    rows = (events.filter(F.col(ts).isNotNull()).withColumn(at, F.unix_micros(ts))
            .withColumn("window_id", F.floor(F.col(at) / width).cast("long"))
            .withColumn(slot, slot_of(F.col(at), bounds)))
    for tier, key in tiers.items():
        rows = (rows.withColumn(keys[tier], key.cast("string"))
                .withColumn(steps[tier], F.lit(1).cast("long")))
    cut = sorted({b // width for b in bounds})
    kinds = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(k).alias("key"))
                      for t, k in keys.items()])
    sums = (rows.filter(F.col("window_id").isin(cut)).select(slot, "window_id", F.inline(kinds))
            .filter(F.col("key").isNotNull()).groupBy(slot, "window_id", "tier", "key")
            .agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("window_id", "tier", "key").orderBy(slot).rowsBetween(
        Window.unboundedPreceding, -1)
    heads = sums.withColumn("n", F.sum("n").over(before)).filter("n > 0").select(
        F.lit(True).alias(first), slot, "window_id",
        *[F.when(F.col("tier") == t, F.col("key")).alias(k) for t, k in keys.items()],
        *[F.when(F.col("tier") == t, F.col("n")).alias(s) for t, s in steps.items()])
    both = rows.withColumn(first, F.lit(False)).unionByName(
        heads, allowMissingColumns=True).repartition(slot)
    # Any grouping that holds the slot is already in place.
    for tier in tiers:
        along = (Window.partitionBy(slot, "window_id", keys[tier])
                 .orderBy(F.desc(first), at, order)
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        both = both.withColumn(tier, F.when(F.col(keys[tier]).isNotNull(),
                                            F.sum(steps[tier]).over(along)))
    return both.filter(~F.col(first)).drop(at, slot, first, *keys.values(), *steps.values())


def check_tiers(events: DataFrame, *, ip: str = "client_ip", api_key: str = "api_key_id",
                global_limit: int = C.RATE_GLOBAL, ip_limit: int = C.RATE_PER_IP,
                key_limit: int = C.RATE_PER_KEY, window: int = C.RATE_WINDOW_SECONDS,
                burst: int = C.RATE_BURST, ts: str = "ts", order: str = "event_id",
                slots: int | None = None) -> DataFrame:
    """(event, ts, allowed, exceeded, retry_after_seconds): all tiers count every event, and
    all must allow it.  Events without an address or an API key skip that tier; `global_limit`
    0 turns the global tier off.  Events without a time are left out."""
    given = F.when(F.col(api_key).cast("string") != "", F.col(api_key))
    tiers = {"__ip": (F.col(ip), ip_limit), "__user": (given, key_limit)}
    if global_limit > 0:
        tiers = {"__global": (F.lit("all"), global_limit), **tiers}
    rows = running_counts(events.select(order, ts, ip, api_key), {
        t: key for t, (key, _) in tiers.items()}, ts, order, window, slots)
    over = F.array_compact(F.array(*[F.when(F.col(t) > limit + burst, t.strip("_"))
                                     for t, (_, limit) in tiers.items()]))
    reset_after = F.lit(window) - F.pmod(F.unix_seconds(ts), F.lit(window))
    return (rows.withColumn("exceeded", over).withColumn("allowed", F.size("exceeded") == 0)
            .select(order, ts, "allowed", "exceeded", F.when(
                ~F.col("allowed") & F.col("__ip").isNotNull(), reset_after)
                .alias("retry_after_seconds")))


def violation_windows(events: DataFrame, key: str, *, limit: int = C.RATE_PER_KEY,
                      window: int = C.RATE_WINDOW_SECONDS, burst: int = C.RATE_BURST,
                      ts: str = "ts") -> DataFrame:
    """Windows in which a key exceeded its limit; counts combine map-side."""
    span = F.floor(F.unix_seconds(ts) / window).cast("long")
    return (events.groupBy(F.col(key), span.alias("window_id"))
            .agg(F.count(F.lit(1)).alias("n_events"))
            .filter(F.col("n_events") > limit + burst)
            .withColumn("n_rejected", F.col("n_events") - (limit + burst)))


def reset(events: DataFrame, resets: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Events that still count after identifiers were reset: (key, reset_at) rows.

    Only the latest reset of a key matters.
    """
    latest = resets.groupBy(key).agg(F.max("reset_at").alias("reset_at"))
    e, r = events.alias("e"), latest.alias("r")
    return e.join(r, (F.col(f"e.{key}") == F.col(f"r.{key}"))
                  & (F.col(f"e.{ts}") <= F.col("r.reset_at")), "left_anti")
