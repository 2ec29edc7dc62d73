"""Queries: rate limits over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.operators import ratelimit as L
from guardlake.plans import checks as K
from guardlake.plans.inputs import Tables
from guardlake.plans.registry import query

DAY = 86400
# Events are sparse: one-day windows with small limits reject some of them.
_TIERS = dict(window=DAY, burst=5, global_limit=300, ip_limit=20, key_limit=25)


def _ranked(key: str, source: str = K.LOGS) -> str:
    return (f"(select *, epoch_us(ts) // {DAY * 1000000} as window_id, row_number() over (partition by {key}, "
            f"epoch_us(ts) // {DAY * 1000000} order by ts, event_id) as current from ({source}))")


query("l1_fixed_window", f"""
select event_id, current::bigint as current, current <= 25 as allowed,
  greatest(0, 25 - current)::bigint as remaining,
  ({DAY} - (epoch_us(ts) // 1000000) % {DAY})::bigint as reset_after_seconds
from {_ranked('api_key_id')}""")(
    lambda t: L.rate_limit(t.logs(), "api_key_id", limit=20, window=DAY, burst=5).select(
        "event_id", "current", "allowed", "remaining", "reset_after_seconds"))

_ALL = f"""(select g.event_id, g.ts, g.current <= 305 as g_ok, i.current <= 25 as i_ok, k.current <= 30 as k_ok
  from {_ranked("'all'")} g join {_ranked('client_ip')} i on g.event_id = i.event_id
  join {_ranked('api_key_id')} k on g.event_id = k.event_id)"""
_OK = "(g_ok and i_ok and k_ok)"

query("l2_three_tiers", f"""
select event_id, {_OK} as allowed, array_to_string(list_filter([case when not g_ok then 'global' end,
  case when not i_ok then 'ip' end, case when not k_ok then 'user' end], lambda x: x is not null), ',') as exceeded
from {_ALL}""")(
    lambda t: L.check_tiers(t.logs(), **_TIERS).select(
        "event_id", "allowed", F.array_join("exceeded", ",").alias("exceeded")))

query("l3_violation_windows", f"""
select api_key_id, (epoch_us(ts) // {DAY * 1000000})::bigint as window_id, count(*)::bigint as n_events,
  (count(*) - 25)::bigint as n_rejected from ({K.LOGS}) group by 1, 2 having count(*) > 25""")(
    lambda t: L.violation_windows(t.logs(), "api_key_id", limit=20, window=DAY, burst=5))

query("l4_retry_after", f"""
select event_id, ({DAY} - (epoch_us(ts) // 1000000) % {DAY})::bigint as retry_after_seconds
from {_ALL} where not {_OK}""")(
    lambda t: L.check_tiers(t.logs(), **_TIERS).filter(~F.col("allowed")).select(
        "event_id", "retry_after_seconds"))

_RESETS = ("select api_key_id, max(ts) as reset_at from ({logs}) where event_id % 50 = 0 "
           "and api_key_id <> 'key-1' group by api_key_id")
_KEPT = (f"select * from ({K.LOGS}) e where not exists (select 1 from ({_RESETS.format(logs=K.LOGS)}) r "
         "where r.api_key_id = e.api_key_id and e.ts <= r.reset_at)")


@query("l5_after_reset", f"""
select event_id, current::bigint as current, current <= 25 as allowed from {_ranked('api_key_id', _KEPT)}""")
def after_reset(t: Tables) -> DataFrame:
    logs = t.logs()
    resets = (logs.filter((F.col("event_id") % 50 == 0) & (F.col("api_key_id") != "key-1"))
              .groupBy("api_key_id").agg(F.max("ts").alias("reset_at")))
    kept = L.reset(logs, resets, "api_key_id")
    return L.rate_limit(kept, "api_key_id", limit=20, window=DAY, burst=5).select(
        "event_id", "current", "allowed")
