"""Audit log: building it from verdicts, and the analytics over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import verdict as V
from guardlake.operators.skew import lookup

LOGGED_THREAT = "struct<category:string,name:string,type:string>"


def in_window(logs: DataFrame, hours: int, as_of: Column, at: str = "created_at") -> DataFrame:
    """Rows of the last `hours` (1..720) before `as_of`."""
    if not 1 <= hours <= C.MAX_WINDOW_HOURS:
        raise ValueError(f"hours must be between 1 and {C.MAX_WINDOW_HOURS}")
    return logs.filter(F.col(at) >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def dashboard_summary(logs: DataFrame, hours: int, as_of: Column) -> DataFrame:
    total = F.count(F.lit(1))
    blocked = _n(F.col("status") == "blocked")
    return in_window(logs, hours, as_of).agg(
        F.lit(hours).alias("window_hours"), total.alias("total_requests"),
        blocked.alias("blocked_requests"),
        _n(F.col("status") == "sanitized").alias("sanitized_requests"),
        F.coalesce(F.round(F.try_divide(blocked, total), 4), F.lit(0.0)).alias("blocked_rate"),
        F.round(F.coalesce(F.avg("total_ms"), F.lit(0.0)), 2).alias("avg_latency_ms"),
        F.round(F.coalesce(F.avg("processing_ms"), F.lit(0.0)), 2).alias("avg_processing_ms"),
        F.coalesce(F.max("created_at"), as_of).alias("last_event_at"))


def logged_threats(logs: DataFrame, json: str = "threats_json") -> Column:
    """The threats of a log row as structs; an entry that is a plain string is its type.

    Entries are read one by one, so that one kind does not cost the others; nulls are left out.
    """
    def entry(x: Column) -> Column:
        plain = F.struct(F.lit(None).cast("string").alias("category"),
                         F.lit(None).cast("string").alias("name"), x.alias("type"))
        return F.when(F.json_object_keys(x).isNotNull(), F.from_json(x, LOGGED_THREAT)
                      ).otherwise(plain)

    return F.transform(F.array_compact(F.from_json(F.col(json), "array<string>")), entry)


def top_threat_categories(logs: DataFrame, hours: int, as_of: Column,
                          limit: int = 8) -> DataFrame:
    rows = in_window(logs, hours, as_of).select(F.inline(logged_threats(logs)))
    return (rows.groupBy(F.coalesce("category", F.lit("unknown")).alias("category"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "category").limit(limit))


def compliance_stats(logs: DataFrame) -> DataFrame:
    """Totals per status with the health score, as one row."""
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    weight = reduce(lambda rest, kv: F.when(F.col("threat_level") == kv[0], kv[1])
                    .otherwise(rest), C.HEALTH_WEIGHTS.items(), F.lit(0))
    burden = F.sum(F.when(F.col("status") == "blocked", weight).otherwise(0))
    health = F.round((1 - F.coalesce(burden, F.lit(0)) / (total * 4)) * 100, 1)
    return logs.agg(
        total.alias("total_requests"),
        *[_n(F.col("status") == s).alias(s) for s in ("blocked", "sanitized", "allowed")],
        F.greatest(F.lit(0.0), health).alias("health_score"))


def blocked_by_level(logs: DataFrame) -> DataFrame:
    return (logs.filter((F.col("status") == "blocked") & F.col("threat_level").isNotNull())
            .groupBy("threat_level").agg(F.count(F.lit(1)).alias("n")))


def violations(logs: DataFrame, limit: int = 50, threat_level: str | None = None) -> DataFrame:
    """Newest blocked requests with a violation id by position; logs without a model or provider
    column have null there.

    The top rows come from a distributed top-k; only those few are numbered.
    """
    df = logs.filter("status = 'blocked'")
    if threat_level is not None:
        df = df.filter(F.col("threat_level") == threat_level)
    newest = [F.desc("created_at"), F.desc("id")]
    top = df.orderBy(*newest).limit(limit)
    at = F.row_number().over(Window.orderBy(*newest)) - 1
    day = F.date_format("created_at", "yyyyMMdd")
    names = F.transform(logged_threats(logs), lambda t: F.coalesce(
        t["type"], t["category"], t["name"]))
    used = [F.col(c) if c in logs.columns else F.lit(None).cast("string").alias(c)
            for c in ("model", "provider")]
    return top.select(
        F.format_string("VIO-%s-%04d", day, at).alias("violation_id"),
        F.col("id").alias("request_log_id"),
        F.coalesce("threat_level", F.lit("unknown")).alias("threat_level"),
        names.alias("threats"), "client_ip", *used, "created_at")


def audit_rows(verdicts: DataFrame) -> DataFrame:
    """Log rows from verdicts and whatever else is known about the request.

    Columns that the input lacks are filled with the defaults of the log.
    """
    defaults = {"api_key_id": F.lit(None).cast("string"), "client_ip": F.lit("unknown"),
                "provider": F.lit(C.DEFAULT_PROVIDER), "model": F.lit(None).cast("string"),
                "message_count": F.lit(0), "input_tokens": F.lit(0), "output_tokens": F.lit(0),
                "output_sanitized": F.lit(False), "sanitization_json": F.lit("[]"),
                "processing_ms": F.lit(0.0), "provider_ms": F.lit(0.0),
                "total_ms": F.lit(0.0), "created_at": F.lit(None).cast("timestamp")}
    filled = {k: F.col(k) if k in verdicts.columns else v for k, v in defaults.items()}
    return verdicts.select(
        F.col("request_id").cast("string").alias("id"),
        *[filled[k].alias(k) for k in ("api_key_id", "client_ip", "provider", "model",
                                       "message_count", "input_tokens")],
        "status", V.top_level(F.col("threats")).alias("threat_level"), "confidence",
        F.to_json("threats").alias("threats_json"),
        *[filled[k].alias(k) for k in ("output_tokens", "output_sanitized", "sanitization_json",
                                       "processing_ms", "provider_ms", "total_ms",
                                       "created_at")])


def _event(df: DataFrame, kind: str, severity: str, details: Column) -> DataFrame:
    log_id = F.col("request_id").cast("string") if "request_id" in df.columns else F.lit(None)
    ip = F.col("client_ip") if "client_ip" in df.columns else F.lit("unknown")
    at = [F.col("created_at")] if "created_at" in df.columns else []
    return df.select(log_id.cast("string").alias("request_log_id"),
                     F.lit(kind).alias("event_type"), F.lit(severity).alias("severity"),
                     F.to_json(details).alias("details"), ip.alias("client_ip"), *at)


def security_events(verdicts: DataFrame, limited: DataFrame | None = None,
                    filtered: DataFrame | None = None) -> DataFrame:
    """Events from blocked verdicts, rejected rate checks and redacted responses.

    A `created_at` of the rows goes with them.
    """
    out = _event(verdicts.filter("status = 'blocked'"), "attack_blocked", "high", F.struct(
        "confidence", F.slice("threats", 1, C.EVENT_THREATS_KEPT).alias("threats")))
    if limited is not None:
        out = out.unionByName(_event(limited.filter(~F.col("allowed")), "rate_limited",
                                     "medium", F.struct("exceeded")), allowMissingColumns=True)
    if filtered is not None:
        out = out.unionByName(_event(filtered.filter(F.size("redactions") > 0), "pii_detected",
                                     "low", F.struct(F.lit("output").alias("direction"),
                                                     F.col("redactions").alias("detections"))),
                              allowMissingColumns=True)
    return out


def request_counters(logs: DataFrame) -> DataFrame:
    return logs.groupBy("status", "provider").agg(F.count(F.lit(1)).alias("n"))


def threat_counters(verdicts: DataFrame) -> DataFrame:
    return (verdicts.select(F.inline("threats")).groupBy("category", "threat_level")
            .agg(F.count(F.lit(1)).alias("n")))


def redaction_counters(filtered: DataFrame) -> DataFrame:
    return (filtered.select(F.inline("redactions")).groupBy("rule")
            .agg(F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, value: str, buckets=C.ANALYSIS_MS_BUCKETS,
              labels: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative buckets in long form (labels, le, n, total, sum), '+Inf' last."""
    cuts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = df.groupBy(*labels).agg(*cuts, F.count(value).alias("total"),
                                   F.round(F.sum(value), 6).alias("sum"))
    rows = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n"))
            for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return wide.select(*labels, F.inline(F.array(*rows)), "total", "sum")


def attribute_keys(requests: DataFrame, keys: DataFrame, raw_key: str = "raw_key",
                   ts: str = "ts", spread: str = "request_id") -> DataFrame:
    """Attach the active, unexpired key record whose prefix the presented key has.

    `keys` has one active row per prefix; a key that sends most requests is spread out.
    """
    live = keys.filter("is_active").select("key_prefix", F.col("id").alias("api_key_id"),
                                           "name", "expires_at")
    left = requests.withColumn("key_prefix", F.substring(raw_key, 1, C.KEY_PREFIX_CHARS))
    joined = lookup(left, live, ["key_prefix"], [spread])
    return joined.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.col(ts)))


def touch_keys(keys: DataFrame, logs: DataFrame) -> DataFrame:
    """Keys with `last_used_at` moved to their latest logged request."""
    used = (logs.filter(F.col("api_key_id").isNotNull()).groupBy("api_key_id")
            .agg(F.max("created_at").alias("__used")))
    return (keys.join(used, keys["id"] == used["api_key_id"], "left")
            .withColumn("last_used_at", F.coalesce("__used", "last_used_at"))
            .select(*keys.columns))

