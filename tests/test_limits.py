"""Rate limits: repeated events stay rows of their own."""

import random
from bisect import bisect_right
from collections import Counter

from pyspark.sql import functions as F

from guardlake.operators import ratelimit


def test_equal_events_are_not_merged(spark):
    rows = [(1, "2024-01-01 00:00:00", "a", "k")] * 3 + [(2, "2024-01-01 00:00:01", "b", None)]
    events = spark.createDataFrame(rows, "event_id long, ts string, client_ip string, "
                                         "api_key_id string").selectExpr(
        "event_id", "cast(ts as timestamp) as ts", "client_ip", "api_key_id")
    got = ratelimit.check_tiers(events, global_limit=3, ip_limit=2, key_limit=9, burst=0).collect()
    assert len(got) == 4 and sum(r.allowed for r in got) == 2
    assert sorted(r.exceeded for r in got if not r.allowed) == [["global"], ["ip"]]


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, at long, client_ip string, "
                                       "api_key_id string").selectExpr(
        "event_id", "timestamp_micros(at) as ts", "client_ip", "api_key_id")


def test_tiers_equal_a_plain_count(spark):
    draw = random.Random(7)
    window, caps = 10, {"global": 40, "ip": 12, "user": 9}
    rows = [(i, (draw.randrange(50_000_000) if i % 3 else draw.randrange(20_000_000, 21_000_000)),
             draw.choice(["a", "a", "a", "b", None]), draw.choice(["k", "k", "l", "", None]))
            for i in range(600)]
    rows += [(i, -5_000_000 + i, "a", "k") for i in range(600, 640)]
    want, seen = {}, Counter()
    for i, at, ip, key in sorted(rows, key=lambda r: (r[1], r[0])):
        span, over = at // (window * 1_000_000), []
        for tier, one in (("global", "all"), ("ip", ip), ("user", key or None)):
            if one is not None:
                seen[span, tier, one] += 1
                if seen[span, tier, one] > caps[tier]:
                    over.append(tier)
        after = window - (at // 1_000_000) % window
        want[i] = (not over, over, after if over and ip is not None else None)
    for slots in (1, 7, 64, None):
        got = ratelimit.check_tiers(_events(spark, rows), global_limit=40, ip_limit=12,
                                    key_limit=9, burst=0, window=window, slots=slots).collect()
        assert {r.event_id: (r.allowed, r.exceeded, r.retry_after_seconds) for r in got} == want
        assert len(got) == len(rows)


def test_tiers_without_events_or_times(spark):
    assert ratelimit.check_tiers(_events(spark, [])).count() == 0
    got = ratelimit.check_tiers(_events(spark, [(1, None, "a", "k"), (2, 5, None, None)]),
                                global_limit=0).collect()
    assert [(r.event_id, r.allowed, r.exceeded) for r in got] == [(2, True, [])]


def test_slots_count_bounds_at_or_below(spark):
    draw = random.Random(1)
    for n in (0, 1, 2, 5, 16, 17, 100):
        bounds = sorted(draw.sample(range(-50, 200), n))
        got = spark.range(-60, 210).select("id", ratelimit.slot_of(F.col("id"), bounds)
                                           .alias("slot")).collect()
        assert all(r.slot == bisect_right(bounds, r.id) for r in got)


def test_events_are_exchanged_once(spark):
    rows = [(i, i * 1_000_000, "a", "k") for i in range(50)]
    plan = ratelimit.check_tiers(_events(spark, rows), slots=4)._jdf.queryExecution(
    ).executedPlan().toString()
    # The others move counts per span and key.
    assert plan.count("REPARTITION_BY_COL") == 1 and "Join" not in plan
    assert "Expand" not in plan
