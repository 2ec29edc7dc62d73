"""Queries: audit log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators import audit as A
from guardlake.plans import checks as K
from guardlake.plans import inputs as I
from guardlake.plans.inputs import AS_OF, Tables, for_check
from guardlake.plans.registry import query
from guardlake.session import new_folder
from guardlake.sources import sinks

HOURS = 240


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


_IN = f"created_at >= timestamp '{AS_OF}' - interval '{HOURS}' hour"
_T = "strftime({x}, '%Y-%m-%d %H:%M:%S')"

query("p13_retained_window", f"select id from ({K.LOGS}) where {_IN}")(
    lambda t: A.in_window(t.logs(), HOURS, _as_of()).select("id"))

query("a1_dashboard_summary", f"""
select cast({HOURS} as int) as window_hours, count(*)::bigint as total_requests,
  count(*) filter (status = 'blocked')::bigint as blocked_requests,
  count(*) filter (status = 'sanitized')::bigint as sanitized_requests,
  coalesce(round(count(*) filter (status = 'blocked') / count(*)::double, 4), 0e0) as blocked_rate,
  round(coalesce(avg(total_ms),0e0),2) as avg_latency_ms,
  round(coalesce(avg(processing_ms),0e0),2) as avg_processing_ms,
  {_T.format(x=f"coalesce(max(created_at), timestamp '{AS_OF}')")} as last_event_at
from ({K.LOGS}) where {_IN}""")(
    lambda t: A.dashboard_summary(t.logs(), HOURS, _as_of()).withColumn(
        "last_event_at", _stamp("last_event_at")))

query("a2_top_threat_categories", f"""
select coalesce(x->>'category','unknown') as category, count(*)::bigint as count from (
  select unnest(from_json(threats_json, '["json"]')) as x from ({K.LOGS}) where {_IN})
group by 1 order by 2 desc, 1 limit 8""")(
    lambda t: A.top_threat_categories(t.logs(), HOURS, _as_of()))

_WEIGHT = "case threat_level when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end"
_TOTALS = ", ".join(f"count(*) filter (status = '{s}')::bigint as {s}"
                    for s in ("blocked", "sanitized", "allowed"))

query("a3_compliance_totals", f"""
select greatest(count(*),1)::bigint as total_requests, {_TOTALS} from ({K.LOGS})""")(
    lambda t: A.compliance_stats(t.logs()).drop("health_score"))

query("a4_blocked_by_level", f"""
select threat_level, count(*)::bigint as n from ({K.LOGS}) where status = 'blocked'
group by threat_level""")(lambda t: A.blocked_by_level(t.logs()))

query("a5_health_score", f"""
select greatest(0e0, round((1 - coalesce(sum(case when status = 'blocked' then {_WEIGHT} else 0 end),0)::double
  / (greatest(count(*),1) * 4)) * 100, 1)) as health_score from ({K.LOGS})""")(
    lambda t: A.compliance_stats(t.logs()).select("health_score"))

query("a8_request_counters", f"""
select status, provider, count(*)::bigint as n from ({K.LOGS}) group by status, provider""")(
    lambda t: A.request_counters(t.logs()))

query("a8_redaction_counters", f"""
select rule, count(*)::bigint as n from {K.redaction_hits(K.DOCS, 'doc_id')} group by rule""")(
    lambda t: _redaction_counters(t))


def _redaction_counters(t: Tables) -> DataFrame:
    from guardlake.operators.redact import filter_text

    return A.redaction_counters(filter_text(t.attack_docs()))


def _histogram(value: str, buckets, label: str | None) -> str:
    keys = f"{label}, " if label else ""
    rows = " union all ".join(
        f"select {keys}'{le}' as le, count(*) filter ({value} <= {cut})::bigint as n, "
        f"count({value})::bigint as total, round(sum({value}),6) as sum from ({K.LOGS}) "
        + (f"group by {label}" if label else "")
        for le, cut in [*((f"{b:g}", repr(float(b))) for b in buckets), ("+Inf", "1e300")])
    return f"select {keys}le, n, total, round(sum,3) as sum from ({rows})"


query("a9_request_histogram", _histogram("(total_ms / 1e3)", C.REQUEST_SECONDS_BUCKETS,
                                         "endpoint"))(
    lambda t: A.histogram(t.logs().withColumn("seconds", F.col("total_ms") / F.lit(1e3)),
                          "seconds", C.REQUEST_SECONDS_BUCKETS, ("endpoint",))
    .withColumn("sum", F.round("sum", 3)))

query("a9_analysis_histogram", _histogram("processing_ms", C.ANALYSIS_MS_BUCKETS, None))(
    lambda t: A.histogram(t.logs(), "processing_ms").withColumn("sum", F.round("sum", 3)))

query("a10_key_attribution", f"""
select c.request_id, k.id as api_key_id, k.name from ({for_check(I.KEY_CALLS)}) c join ({for_check(I.API_KEYS)}) k
  on substr(c.raw_key,1,12) = k.key_prefix where k.is_active and (k.expires_at is null or k.expires_at >= c.ts)""")(
    lambda t: A.attribute_keys(t.sql(I.KEY_CALLS), t.sql(I.API_KEYS)).select(
        "request_id", "api_key_id", "name"))

query("a11_last_used", f"""
select k.id, k.key_prefix, {_T.format(x='l.used')} as last_used_at from ({for_check(I.API_KEYS)}) k
left join (select api_key_id, max(created_at) as used from ({K.LOGS}) group by 1) l on k.id = l.api_key_id""")(
    lambda t: A.touch_keys(t.sql(I.API_KEYS), t.logs()).select(
        "id", "key_prefix", _stamp("last_used_at")))

# Logs whose threats are strings, objects with and without a type, and nulls.
_MIXED = """
select id, event_id, status, threat_level, client_ip, model, provider, created_at,
  case event_id % 3 when 0 then '["dan_attack",{{"category":"jailbreak"}},null]'
    when 1 then '[{{"type":"leak","category":"exfiltration"}},"two words"]'
    else threats_json end as threats_json from ({logs})"""

query("p11_violations", f"""
select concat('VIO-', strftime(created_at,'%Y%m%d'), '-', lpad(cast(row_number() over (order by created_at desc, id desc) - 1 as varchar),4,'0')) as violation_id,
  id as request_log_id, threat_level, array_to_string(list_transform(list_filter(
    from_json(threats_json, '["json"]'), lambda x: json_type(x) <> 'NULL'), lambda x: coalesce(
    x->>'type', x->>'category', x->>'name',
    case when json_type(x) = 'VARCHAR' then x->>'$' end)), '|') as threats,
  client_ip, model, provider, {_T.format(x='created_at')} as created_at
from ({_MIXED.format(logs=K.LOGS)}) where status = 'blocked' and threat_level = 'high'
order by created_at desc, id desc limit 50""")(
    lambda t: A.violations(t.spark.sql(_MIXED.replace("({logs})", "{logs}"), logs=t.logs()),
                           threat_level="high").select(
        "violation_id", "request_log_id", "threat_level", F.array_join("threats", "|")
        .alias("threats"), "client_ip", "model", "provider", _stamp("created_at")))


@query("s6_audit_log", f"""
select cast(created_at as date)::varchar as day, status, count(*)::bigint as n from ({K.LOGS}) group by 1, 2""")
def stored_logs(t: Tables) -> DataFrame:
    """Log rows appended in two batches, read back and counted per day."""
    path = new_folder(t.spark, "logs")
    logs = t.logs()
    sinks.append_logs(logs.filter("event_id % 2 = 0"), path)
    sinks.append_logs(logs.filter("event_id % 2 = 1"), path)
    return (t.spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("day"), "status")
            .agg(F.count(F.lit(1)).alias("n")))


@query("s7_security_events", f"""
select 'attack_blocked' as event_type, count(*)::bigint as n from ({K.LOGS}) where status = 'blocked'""")
def stored_events(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "events")
    rows = t.logs().withColumn("threats", A.logged_threats(t.logs())).select(
        F.col("id").alias("request_id"), "status", F.lit(1.0).alias("confidence"), "threats",
        "client_ip")
    events = A.security_events(rows).withColumn("created_at", _as_of())
    sinks.append_events(events, path)
    return sinks.read_table(t.spark, path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"))
