"""Queries: policy rules and guardrails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators import policy as P
from guardlake.operators import scan
from guardlake.plans import checks as K
from guardlake.plans import inputs as I
from guardlake.plans.inputs import Tables, for_check
from guardlake.plans.registry import query
from guardlake.session import new_folder
from guardlake.sources.readers import read_guardrails

_OUT = for_check(I.POLICY_OUTPUTS)
_FIELDS = ("rule_id", "regulation", "category", "description", "severity")
_RULES = f"""(select source_document, chunk, cast(i - 1 as int) as pos, {', '.join(f"x->>'{f}' as {f}" for f in _FIELDS)}
  from (select source_document, chunk, unnest(js) as x, generate_subscripts(js,1) as i from (
    select source_document, chunk, from_json(regexp_extract(content,'\\[.*\\]',0,'s'), '["json"]') as js from ({_OUT}))))"""


def _rules(t: Tables) -> DataFrame:
    return P.parse_rules(t.sql(I.POLICY_OUTPUTS))


query("k1_parsed_rules", f"""
select source_document, chunk, pos, {', '.join(_FIELDS)} from {_RULES}""")(
    lambda t: _rules(t).select("source_document", "chunk", "pos", *_FIELDS))

_FIRST = f"""(select * from {_RULES} qualify row_number() over (
  partition by source_document, rule_id order by chunk, pos) = 1)"""

query("k2_first_rules", f"select source_document, rule_id, chunk, description from {_FIRST}")(
    lambda t: P.first_rules(_rules(t)).select("source_document", "rule_id", "chunk",
                                              "description"))

query("k3_rule_guardrails", f"""
select rule_id as name, coalesce(regulation,'UNKNOWN') as regulation, coalesce(category,'General') as category,
  case when lower(coalesce(severity,'MEDIUM')) in ('critical','high') then 'block' else 'log' end as action,
  case lower(coalesce(severity,'MEDIUM')) when 'critical' then 95e-2 when 'high' then 85e-2
    when 'medium' then 7e-1 when 'low' then 55e-2 else 7e-1 end as confidence,
  concat_ws(chr(10), concat('  - name: ', rule_id), concat('    description: "', description, '"'),
    concat('    regulation: ', coalesce(regulation,'UNKNOWN')), concat('    category: "', coalesce(category,'General'), '"'),
    concat('    action: ', case when lower(coalesce(severity,'MEDIUM')) in ('critical','high') then 'block' else 'log' end),
    concat('    confidence: ', case lower(coalesce(severity,'MEDIUM')) when 'critical' then '0.95' when 'high' then '0.85'
    when 'medium' then '0.7' when 'low' then '0.55' else '0.7' end),
    concat('    severity: ', lower(coalesce(severity,'MEDIUM')))) as yaml
from {_FIRST}""")(
    lambda t: P.rule_guardrails(P.first_rules(_rules(t))).select(
        "name", "regulation", "category", "action", "confidence",
        "yaml"))

_ACTION = """case when category in ('direct_injection','jailbreak') and confidence >= 0.8 then 'block'
  when category = 'data_exfiltration' and confidence >= 0.7 then 'block'
  when category = 'obfuscation' and confidence >= 0.6 then 'log' else 'allow' end"""
_NAME = """case when category in ('direct_injection','jailbreak') and confidence >= 0.8 then 'block-critical-injection'
  when category = 'data_exfiltration' and confidence >= 0.7 then 'block-credential-theft'
  when category = 'obfuscation' and confidence >= 0.6 then 'log-obfuscation' else '' end"""

query("k4_guarded_detections", f"""
select doc_id, name, {_ACTION} as action, {_NAME} as guardrails from {K.hits(K.DOCS, 'doc_id')}""")(
    lambda t: P.apply_guardrails(scan.pattern_hits(t.attack_docs(), ["doc_id"])).select(
        "doc_id", "name", "action", F.array_join("guardrails", ",").alias("guardrails")))

_LOCAL = (C.Guardrail("log-everything", "log", 0.0, (), ("chat",)),
          C.Guardrail("block-files", "block", 0.7, ("file_system",), ("upload",)),
          C.Guardrail("off", "block", 0.0, (), (), None, False))

query("k4_guarded_channel", f"""
select doc_id, name, 'log' as action, 'log-everything' as guardrails from {K.hits(K.DOCS, 'doc_id')}""")(
    lambda t: P.apply_guardrails(scan.pattern_hits(t.attack_docs(), ["doc_id"]), _LOCAL, "chat")
    .select("doc_id", "name", "action", F.array_join("guardrails", ",").alias("guardrails")))


_LOADED = f"""(select case category when 'retention' then 'jailbreak' end as category,
  case when lower(coalesce(severity,'MEDIUM')) in ('critical','high') then 'block' else 'log' end as action,
  case lower(coalesce(severity,'MEDIUM')) when 'critical' then 95e-2 when 'high' then 85e-2
    when 'low' then 55e-2 else 7e-1 end as least from {_FIRST})"""


@query("k4_loaded_guardrails", f"""
select h.doc_id, h.name, case when count(r.action) = 0 then 'allow' when bool_or(r.action = 'block') then 'block'
  else 'log' end as action, count(r.action)::int as n_rules
from {K.hits(K.DOCS, 'doc_id')} h left join {_LOADED} r
  on coalesce(r.category, h.category) = h.category and h.confidence >= r.least
group by h.doc_id, h.name""")
def loaded_guardrails(t: Tables) -> DataFrame:
    """The rules of all policies, written as a rule file, loaded and applied: retention rules to
    jailbreaks, others to any category."""
    path = new_folder(t.spark, "guardrails")
    none = F.array().cast("array<string>")
    P.rule_guardrails(P.first_rules(_rules(t))).select("name", "action", "confidence", F.when(
        F.col("category") == "retention", F.array(F.lit("jailbreak"))).otherwise(none)
        .alias("categories")).write.json(path)
    hits = scan.pattern_hits(t.attack_docs(), ["doc_id"])
    return P.apply_guardrails(hits, read_guardrails(t.spark, path)).select(
        "doc_id", "name", "action", F.size("guardrails").alias("n_rules"))


# A rule per document and a detection per event, nearly all with a confidence of their own.
_MANY_RULES = """select cast(doc_id as varchar(20)) as name,
  case doc_id % 3 when 0 then 'allow' when 1 then 'log' else 'block' end as action,
  (doc_id * 7919 % 100003) / 100003e0 as confidence,
  case when doc_id % 5 = 0 then 'error' when doc_id % 5 = 1 then 'purchase' end as category,
  doc_id % 11 <> 0 as enabled from {documents}"""
_MANY_FOUND = """select event_id, event_type as category,
  (event_id * 104729 % 1000003) / 1000003e0 as confidence from {events}"""


@query("k4_many_guardrails", f"""
select event_id, case max(case r.action when 'block' then 3 when 'log' then 2 else 1 end) when 3 then 'block'
  when 2 then 'log' else 'allow' end as action, count(r.action)::bigint as n_guardrails
from ({for_check(_MANY_FOUND)}) d left join (select * from ({for_check(_MANY_RULES)}) where enabled) r
  on coalesce(r.category, d.category) = d.category and d.confidence >= r.confidence
group by event_id""")
def many_guardrails(t: Tables) -> DataFrame:
    """As many rules as documents, looked up as step functions of confidence."""
    none = F.array().cast("array<string>")
    rules = t.sql(_MANY_RULES).select(
        "name", "action", "confidence", F.when(F.col("category").isNull(), none).otherwise(
            F.array("category")).alias("categories"), none.alias("channels"), "enabled")
    return P.guardrail_actions(t.sql(_MANY_FOUND), rules).select(
        "event_id", "action", "n_guardrails")


@query("p10_applicable_rules", f"""
with r as (select rule_id as name, severity <> 'LOW' as enabled,
  case when chunk % 2 = 0 then '' when chunk % 3 = 0 then 'chat' else 'upload' end as channel from {_RULES})
select name, channel, count(*)::bigint as n from r where enabled and channel in ('', 'chat') group by all""")
def applicable_rules(t: Tables) -> DataFrame:
    """Guardrails made from policy rules, those that apply to a channel."""
    even, third = F.col("chunk") % 2 == 0, F.col("chunk") % 3 == 0
    none = F.array().cast("array<string>")
    rules = _rules(t).select(
        F.col("rule_id").alias("name"), (F.col("severity") != "LOW").alias("enabled"),
        F.when(even, none).when(third, F.array(F.lit("chat"))).otherwise(
            F.array(F.lit("upload"))).alias("channels"))
    return (P.applicable(rules, "chat")
            .groupBy("name", F.array_join("channels", ",").alias("channel"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("s12_stored_guardrails", f"""
select rule_id as name, case when lower(coalesce(severity,'MEDIUM')) in ('critical','high') then 'block' else 'log' end as action,
  true as enabled from {_FIRST}""")
def stored_guardrails(t: Tables) -> DataFrame:
    """The rules of all policies written as a rule file and loaded as guardrails."""
    path = new_folder(t.spark, "guardrails")
    rules = P.rule_guardrails(P.first_rules(_rules(t)))
    rules.select("name", "action", "confidence",
                 F.array("category").alias("categories")).write.json(path)
    return read_guardrails(t.spark, path).select("name", "action", "enabled")
