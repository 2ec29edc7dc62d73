"""Queries: feedback and threshold tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators import feedback as B
from guardlake.plans import checks as K
from guardlake.plans.inputs import AS_OF, Tables
from guardlake.plans.registry import query
from guardlake.session import new_folder
from guardlake.sources import sinks


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


_T = "strftime({x}, '%Y-%m-%d %H:%M:%S')"
_STATS = f"""(select pattern_name, category, count(*)::bigint as total_feedback,
  count(*) filter (was_correct)::bigint as correct_count,
  count(*) filter (not was_correct)::bigint as incorrect_count,
  round(count(*) filter (was_correct) * 100e0 / count(*), 2) as accuracy_percentage,
  round(avg(confidence),6) as avg_confidence, max(created_at) as last_at
  from ({K.FEEDBACK}) group by pattern_name, category)"""
_COLS = ("pattern_name, category, total_feedback, correct_count, incorrect_count, "
         f"accuracy_percentage, avg_confidence, {_T.format(x='last_at')} as last_feedback_at")

query("f1_pattern_stats", f"select {_COLS} from {_STATS}")(
    lambda t: B.all_pattern_stats(t.feedback()).withColumn(
        "last_feedback_at", _stamp("last_feedback_at")))

query("f2_stats_of_pattern", f"select {_COLS} from {_STATS} where pattern_name = 'pattern_4'")(
    lambda t: B.pattern_stats(t.feedback(), "pattern_4").withColumn(
        "last_feedback_at", _stamp("last_feedback_at")))

query("f3_recent_feedback", f"""
select id, pattern_name, was_correct, {_T.format(x='created_at')} as created_at from ({K.FEEDBACK})
order by feedback_order.created_at desc limit 30 offset 20""".replace("feedback_order.", ""))(
    lambda t: B.recent_feedback(t.feedback(), limit=30, offset=20).select(
        "id", "pattern_name", "was_correct", _stamp("created_at")))

query("f4_feedback_count", f"select count(*)::bigint as n_feedback from ({K.FEEDBACK})")(
    lambda t: B.feedback_count(t.feedback()))

query("f5_mark_reviewed", f"""
select id, case when cast(id as int) % 10 = 0 then concat('rev-', cast(id as int) % 3) end as reviewed_by,
  case when cast(id as int) % 10 = 0 then '{AS_OF}' end as reviewed_at from ({K.FEEDBACK})""")(
    lambda t: B.mark_reviewed(
        t.feedback(), t.feedback().filter(F.col("id").cast("int") % 10 == 0).select(
            "id", F.concat(F.lit("rev-"), (F.col("id").cast("int") % 3).cast("string"))
            .alias("reviewed_by")), _as_of()).select("id", "reviewed_by", _stamp("reviewed_at")))

_TUNED = f"""(select pattern_name, category, original_threshold, adjusted_threshold, adjustment_reason from (
  select s.pattern_name, s.category, total_feedback, coalesce(a.original_threshold, 7e-1) as original_threshold,
    coalesce(a.adjusted_threshold, 7e-1) as now_at,
    case when incorrect_count / total_feedback::double > 0.3
         then greatest(coalesce(a.original_threshold, 7e-1) - 3e-1, coalesce(a.adjusted_threshold, 7e-1) - 5e-2)
         else least(coalesce(a.original_threshold, 7e-1) + 3e-1, coalesce(a.adjusted_threshold, 7e-1) + 5e-2) end as adjusted_threshold,
    case when incorrect_count / total_feedback::double > 0.3
         then concat('High FP rate: ', printf('%.1f%%', incorrect_count * 100e0 / total_feedback), ' (', incorrect_count, '/', total_feedback, ')')
         else concat('High accuracy: ', printf('%.1f%%', accuracy_percentage)) end as adjustment_reason
  from {_STATS} s left join ({K.ADJUSTMENTS}) a on s.pattern_name = a.pattern_name
  where total_feedback >= 30 and (incorrect_count / total_feedback::double > 0.3 or accuracy_percentage >= 95)
    and (a.updated_at is null or a.updated_at <= timestamp '{AS_OF}' - interval '7' day))
  where abs(adjusted_threshold - now_at) >= 0.01
  qualify row_number() over (partition by pattern_name order by total_feedback desc, category) = 1)"""


def _tuned(t: Tables) -> DataFrame:
    return B.tune_thresholds(B.pattern_stats(t.feedback()), t.adjustments(), _as_of(),
                             min_samples=30)


query("f6_tuned_thresholds", f"""
select pattern_name, category, original_threshold, round(adjusted_threshold,6) as adjusted_threshold,
  adjustment_reason from {_TUNED}""")(
    lambda t: _tuned(t).select("pattern_name", "category", "original_threshold",
                               F.round("adjusted_threshold", 6).alias("adjusted_threshold"),
                               "adjustment_reason"))

query("f7_upserted_adjustments", f"""
select coalesce(a.pattern_name, n.pattern_name) as pattern_name,
  case when a.pattern_name is not null then a.category else n.category end as category,
  round(coalesce(n.adjusted_threshold, a.adjusted_threshold),6) as adjusted_threshold,
  case when n.pattern_name is not null then '{AS_OF}' else {_T.format(x='a.updated_at')} end as updated_at
from ({K.ADJUSTMENTS}) a full join {_TUNED} n on a.pattern_name = n.pattern_name""")(
    lambda t: B.upsert_adjustments(t.adjustments(), _tuned(t)).select(
        "pattern_name", "category", F.round("adjusted_threshold", 6).alias("adjusted_threshold"),
        _stamp("updated_at")))

query("f8_effective_thresholds", f"""
select h.doc_id, h.name, round(coalesce(a.adjusted_threshold, 7e-1),6) as threshold
from {K.hits(K.DOCS, 'doc_id')} h left join (select concat('dan_at','tack') as pattern_name, adjusted_threshold
  from ({K.ADJUSTMENTS}) where pattern_name = 'pattern_0') a on h.name = a.pattern_name""")(
    lambda t: _effective(t))


def _effective(t: Tables) -> DataFrame:
    from guardlake.operators.scan import pattern_hits

    tuned = (t.adjustments().filter("pattern_name = 'pattern_0'")
             .withColumn("pattern_name", F.lit("dan_attack")))
    hits = pattern_hits(t.attack_docs(), ["doc_id"])
    return B.with_threshold(hits, tuned, "name").select(
        "doc_id", "name", F.round("threshold", 6).alias("threshold"))


@query("f9_reset", f"""
select count(*)::bigint as n_reset, 0::bigint as n_left from {_TUNED}""")
def reset(t: Tables) -> DataFrame:
    counted, empty = B.reset_adjustments(_tuned(t))
    left = empty.agg(F.count(F.lit(1)).alias("n_left"))
    return counted.unionByName(left, allowMissingColumns=True).agg(
        F.max("n_reset").alias("n_reset"), F.max("n_left").alias("n_left"))


_OVERRIDES = """select id as request_log_id,
  case when event_id % 3 = 0 then 'FALSE_POSITIVE' else 'LEGAL_HOLD' end as action,
  concat('reviewed ', id) as reason, created_at from ({logs}) where status = 'blocked'"""


def _overrides(t: Tables) -> DataFrame:
    action = F.when(F.col("event_id") % 3 == 0, "FALSE_POSITIVE").otherwise("LEGAL_HOLD")
    return t.logs().filter("status = 'blocked'").select(
        F.col("id").alias("request_log_id"), action.alias("action"),
        F.concat(F.lit("reviewed "), F.col("id")).alias("reason"), "created_at")


query("f10_cascaded_overrides", f"""
select id, null as request_log_id, was_correct, null as reason from ({K.FEEDBACK})
union all select null, request_log_id, false, concat('{C.OVERRIDE_REASON_PREFIX}', reason)
from ({_OVERRIDES.format(logs=K.LOGS)}) where action = 'FALSE_POSITIVE'""")(
    lambda t: B.cascade_overrides(_overrides(t), t.feedback()).select(
        "id", "request_log_id", "was_correct", "reason"))


@query("s8_stored_feedback", f"""
select pattern_name, count(*)::bigint as n, count(*)::bigint as n_ids from ({K.FEEDBACK}) group by 1""")
def stored_feedback(t: Tables) -> DataFrame:
    """Feedback appended without ids gets unique ones."""
    path = new_folder(t.spark, "feedback")
    sinks.append_feedback(t.feedback().drop("id"), path)
    return sinks.read_table(t.spark, path).groupBy("pattern_name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


@query("s9_stored_overrides", f"""
select action, count(*)::bigint as n from ({_OVERRIDES.format(logs=K.LOGS)}) group by action""")
def stored_overrides(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "overrides")
    sinks.append_overrides(_overrides(t), path)
    return sinks.read_table(t.spark, path).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
