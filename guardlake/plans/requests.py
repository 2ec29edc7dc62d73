"""Queries: requests, validation and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import verdict as V
from guardlake.functions.context import features
from guardlake.operators import audit, scan
from guardlake.operators import requests as Q
from guardlake.operators.context import with_history
from guardlake.operators.ratelimit import check_tiers
from guardlake.operators.verdict import analyze_distinct, analyze_requests, requests_from_texts
from guardlake.plans import checks as K
from guardlake.plans.decoding_sql import peeled
from guardlake.plans import limits
from guardlake.plans.detection import _URL_SQL, _url_requests
from guardlake.plans.inputs import Tables
from guardlake.plans.multiturn import context_sql
from guardlake.plans.registry import query
from guardlake.session import new_folder
from guardlake.sources.readers import read_wire_requests

# ---------------------------------------------------------------- messages


def _requests(t: Tables, **limits) -> DataFrame:
    return Q.from_messages(t.messages(), **limits)


query("s1_requests", f"""
select request_id, max(model) as model, count(*)::bigint as n_messages,
  count(*) filter (role = 'user')::bigint as n_user from ({K.MESSAGES}) group by request_id""")(
    lambda t: _requests(t, max_chars=10 ** 9).select(
        "request_id", "model", F.col("stats.n_messages").alias("n_messages"),
        F.size(F.filter("messages", lambda m: m["role"] == "user")).cast("long")
        .alias("n_user")))

# Requests as JSON lines: a third of the contents are strings, a third lists of parts, and a third
# strings that look like lists of parts.
_LISTED = """concat('[{{"type":"text","text":"', {x}, '"}}]')"""
_CLEAN = "regexp_replace({x}, '[^a-zA-Z0-9 .]', ' '{g})"


@query("s1_wire_requests", f"""
select request_id, pos, case pos % 3 when 0 then t when 2 then {_LISTED.format(x='t')} end as text,
  case when pos % 3 = 1 then t else '' end as parts from (select request_id, pos,
  {_CLEAN.format(x='text', g=", 'g'")} as t from ({K.MESSAGES}))""")
def wire_requests(t: Tables) -> DataFrame:
    """Requests written as JSON lines and read by the JSON type of their contents."""
    folder = new_folder(t.spark, "wire")
    clean = F.expr(_CLEAN.format(x="text", g=""))
    listed = F.to_json(F.array(F.struct(F.lit("text").alias("type"), clean.alias("text"))))

    def quoted(x):
        return F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)

    kind = F.col("pos") % 3
    content = F.when(kind == 0, quoted(clean)).when(kind == 1, listed).otherwise(quoted(listed))
    message = F.concat(F.lit('{"role":'), quoted(F.col("role")), F.lit(',"content":'), content,
                       F.lit("}"))
    rows = t.messages().select("request_id", "pos", message.alias("m")).groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ms"))
    rows.select(F.concat(
        F.lit('{"request_id":"'), "request_id", F.lit('","model":"gpt-4","messages":['),
        F.array_join(F.transform("ms", lambda x: x["m"]), ","), F.lit("]}"))).write.text(folder)
    return read_wire_requests(t.spark, folder).select(
        "request_id", F.posexplode("messages").alias("pos", "m")).select(
        "request_id", "pos", "m.text", F.coalesce(F.array_join(F.transform(
            "m.parts", lambda p: p["text"]), ""), F.lit("")).alias("parts"))


_STATS = f"""(select request_id, max(model) as model, count(*) as n,
  sum(length(text)) + count(*) - 1 as chars,
  sum(len(regexp_extract_all(text,'[^\\p{{L}}\\p{{N}}\\s]'))) as special,
  sum(len(regexp_extract_all(text,'[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'))) as control,
  count(*) filter (role in ('user','system') and text <> '') as spoken
  from ({K.MESSAGES}) group by request_id)"""


def _errors(max_messages: int, max_chars: int) -> str:
    return f"""array_to_string(list_filter([
    case when n > {max_messages} then concat('Too many messages: ', n, ' (max {max_messages})') end,
    case when chars > {max_chars} then concat('Total text length ', chars, ' exceeds max {max_chars}') end,
    case when spoken = 0 then 'Request contains no user/system content' end,
    case when model = '' or length(model) > 100 then 'Invalid or missing model field' end
    ], lambda x: x is not null), '; ')"""


query("p5_validation", f"""
select request_id, e = '' as is_valid, e as errors, w as warnings from (
  select request_id, {_errors(6, 3000)} as e, array_to_string(list_filter([
    case when special / chars > 0.05 then concat('High special character ratio: ',
      printf('%.2f%%', special / chars * 100), ' (threshold 5%)') end,
    case when control > 0 then concat('Input contains ', control, ' control characters') end
    ], lambda x: x is not null), '; ') as w from {_STATS})""")(
    lambda t: Q.validate(_requests(t, max_messages=6, max_chars=3000), max_messages=6,
                         max_chars=3000, max_special=0.05).select(
        "request_id", "validation.is_valid",
        F.array_join("validation.errors", "; ").alias("errors"),
        F.array_join("validation.warnings", "; ").alias("warnings")))

_VALID = f"(select request_id from {_STATS} where {_errors(C.MAX_MESSAGES, C.MAX_CHARS)} = '')"

query("p1_request_text", f"""
select request_id, string_agg(text, chr(10) order by pos) as text from ({K.MESSAGES})
where request_id in {_VALID} group by request_id""")(
    lambda t: Q.request_texts(_requests(t)))

query("p2_tool_contents", f"""
select request_id, coalesce('tool:' || nullif(name,''), concat('tool_msg[',pos,']')) as source, text as content
from ({K.MESSAGES}) where role = 'tool' and regexp_matches(text,'\\S')""")(
    lambda t: Q.tool_contents(Q.single_messages(t.messages())))

query("p3_labelled_contents", f"""
select request_id, concat('msg[',pos,']:',role) as source, text as content
from ({K.MESSAGES}) where regexp_matches(text,'\\S')""")(
    lambda t: Q.labelled_contents(Q.single_messages(t.messages())))

query("p4_urls", _URL_SQL)(lambda t: Q.urls(_url_requests(t)))

_MODELS = """select o_orderkey, case when o_orderkey % 9 = 0 then upper(o_orderpriority) end as override,
  case o_orderkey % 8 when 0 then 'GPT-4o' when 1 then 'claude-3-opus' when 2 then 'gemini-pro'
  when 3 then 'palm-2' when 4 then 'Mixtral-8x7b' when 5 then 'o3-mini' when 6 then 'gemma-7b'
  else 'unknown' end as model from {orders}"""
_PROVIDER = " ".join(f"when starts_with(lower(model),'{p}') then '{n}'"
                     for p, n in C.PROVIDER_PREFIXES)

query("p9_providers", f"""
select o_orderkey, case when coalesce(override,'') <> '' then lower(override) {_PROVIDER}
  else 'openai' end as provider from ({_MODELS.format(orders='orders')})""")(
    lambda t: Q.with_provider(t.sql(_MODELS), override="override").select(
        "o_orderkey", "provider"))

# ---------------------------------------------------------------- verdicts

query("v5_status_by_category", f"""
with h as (select * from {K.hits(K.DOCS, 'doc_id')}),
s as (select doc_id, max(confidence) as conf, max({K.rank('threat_level')}) as r from h group by doc_id)
select case when r >= 3 and conf > 0.4 then 'blocked' when r = 2 and conf >= 0.7 then 'blocked'
    when r = 2 then 'sanitized' else 'allowed' end as status,
  category, count(distinct h.doc_id)::bigint as n_docs, count(*)::bigint as n_hits
from h join s on h.doc_id = s.doc_id group by all""")(
    lambda t: status_by_category(t.attack_docs()))


def status_by_category(docs: DataFrame) -> DataFrame:
    """Documents scanned for patterns, judged, and counted by status and category."""
    hits = F.col("detections")
    judged = (scan.with_detections(docs.select("text")).filter(F.size(hits) > 0)
              .select(V.decide(V.top_confidence(hits), V.top_rank(hits), F.size(hits))
                      .alias("status"), hits))
    per = F.transform(F.array_distinct(F.transform("detections", lambda h: h["category"])),
                      lambda c: F.struct(c.alias("category"), F.size(F.filter(
                          "detections", lambda h: h["category"] == c)).alias("n")))
    return (judged.select("status", F.inline(per)).groupBy("status", "category")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_hits")))


def threats_sql(messages: str, valid: str, with_semantic: bool, decode: bool = False) -> str:
    """All threats of the valid requests, in order (stage, a, b)."""
    msgs = f"(select * from ({messages}) where request_id in {valid} and regexp_matches(text,'\\S'))"
    texts = (f"select request_id, string_agg(text, chr(10) order by pos) as text from ({messages}) "
             f"where request_id in {valid} group by request_id")
    comments = ("select request_id, pos, unnest(cs) as text, generate_subscripts(cs,1) as i from ("
                "select request_id, pos, list_filter(list_transform(regexp_extract_all(text,"
                f"'<!--(.*?)-->',1,'s'), lambda x: trim(x)), lambda x: length(x) > 10) as cs from {msgs})")
    tool = f"select * from {msgs} where role = 'tool'"
    found = ""
    if decode:
        whole, outputs = peeled(texts, "request_id"), peeled(tool, "request_id, pos")
        found = f"""
select request_id, 0 as stage, 0 as a, 0 as b, 'obfuscation' as category,
  'multi_layer_encoding' as name, 'medium' as threat_level, least(9e-1, 3e-1 * layers) as confidence
from {whole} where layers > 0
union all select request_id, 1, pos, -1, 'indirect_injection', 'obfuscated_tool_output', 'high',
  least(95e-2, 4e-1 * layers) from {outputs} where layers > 0 union all"""
        texts = f"select request_id, decoded as text from {whole}"
        tool = f"select request_id, pos, decoded as text from {outputs}"
    out = f"""{found}
select request_id, 1 as stage, pos as a, 0 as b, 'indirect_injection' as category,
  'injection_in_external_content' as name,
  case when max({K.rank('threat_level')}) = 4 then 'critical' else 'high' end as threat_level,
  least(1e0, max(confidence) + 15e-2) as confidence from {K.hits(tool, 'request_id, pos')} group by request_id, pos
union all select request_id, 2, pos, i, 'indirect_injection', 'hidden_html_comment', 'high',
  least(1e0, max(confidence) + 1e-1) from {K.hits(comments, 'request_id, pos, i')} group by request_id, pos, i
union all select request_id, 2, pos, 1000, 'indirect_injection', 'instruction_prefix_in_tool_output', 'high', 8e-1
  from {msgs} where role = 'tool' and regexp_matches(text,{K.re2(C.INSTRUCTION_PREFIX)},'i')
union all select request_id, 2, pos, 1001, 'indirect_injection', 'markdown_injection', 'medium', 7e-1
  from {msgs} where regexp_matches(text,{K.re2(C.MARKDOWN_INJECTION)},'i')
union all select request_id, 3, ord, 0, category, name, threat_level, confidence from {K.hits(texts, 'request_id')}"""
    if with_semantic:
        level = ("case label when 'jailbreak' then 'critical' when 'obfuscation' then 'medium' "
                 "else 'high' end")
        out += f"""
union all select request_id, 4, 0, 0, 'semantic', 'intent_classification', {level}, score
  from {K.semantic(texts, 'request_id')} where score >= 0.75"""
    return out


def verdict_sql(messages: str, stats: str, with_semantic: bool = True,
                decode: bool = False) -> str:
    """Verdict per request of `messages`."""
    errors = _errors(C.MAX_MESSAGES, C.MAX_CHARS)
    valid = f"(select request_id from {stats} where {errors} = '')"
    return f"""
with t as materialized ({threats_sql(messages, valid, with_semantic, decode)}),
lead as (select * from t qualify row_number() over (partition by request_id
  order by {K.rank('threat_level')} desc, stage, a, b) = 1),
s as (select request_id, max(confidence) as conf, max({K.rank('threat_level')}) as r,
  count(*) as n from t group by request_id)
select v.request_id,
  case when v.request_id not in {valid} then 'blocked' when s.n is null then 'allowed'
       when r >= 3 and conf > 0.4 then 'blocked' when r = 2 and conf >= 0.7 then 'blocked'
       when r = 2 then 'sanitized' else 'allowed' end as status,
  case when v.request_id not in {valid} then 1e0 else round(coalesce(conf,0e0),3) end as confidence,
  case when v.request_id not in {valid} then 'high' else coalesce({K.level_name('r')},'safe') end as threat_level,
  cast(case when v.request_id not in {valid} then 1 else coalesce(s.n,0) end as int) as n_threats,
  case when v.request_id not in {valid} then {K.lit(C.LEVEL_SUGGESTIONS['high'])} when s.n is null then null
       else {K.suggestion('lead.category', 'lead.name', 'lead.threat_level')} end as suggestion
from {stats} v left join s on v.request_id = s.request_id left join lead on v.request_id = lead.request_id"""


def _flat(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("request_id", "status", "confidence", "threat_level",
                           F.size("threats").alias("n_threats"), "suggestion")


query("v3_verdict_without_decoding", verdict_sql(K.MESSAGES, _STATS))(
    lambda t: _flat(analyze_requests(_requests(t), decode=False, semantic=True)))

_DOC_MESSAGES = (f"select cast(doc_id as varchar) as request_id, 0 as pos, 'user' as role, text, "
                 f"'analyze-only' as model, null as name from ({K.DOCS})")
_DOC_STATS = (f"(select request_id, model, 1 as n, length(text) as chars, "
              f"cast(regexp_matches(text,'\\S') as int) as spoken from ({_DOC_MESSAGES}))")


def _documents(t: Tables) -> DataFrame:
    docs = t.attack_docs().select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return requests_from_texts(docs, "doc_id")


query("v8_full_verdict_words", verdict_sql(_DOC_MESSAGES, _DOC_STATS))(
    lambda t: _flat(analyze_requests(_documents(t), decode=False, semantic=True)))

query("v8_full_verdict", verdict_sql(K.MESSAGES, _STATS, decode=True))(
    lambda t: _flat(analyze_requests(_requests(t), semantic=True)))

query("v8_full_verdict_texts", verdict_sql(_DOC_MESSAGES, _DOC_STATS, decode=True))(
    lambda t: _flat(analyze_requests(_documents(t), semantic=True)))


COPIES = 10


@query("v8_full_verdict_copies", f"""
select concat(v.request_id, '-', copy) as request_id, v.* exclude (request_id)
from ({verdict_sql(_DOC_MESSAGES, _DOC_STATS, decode=True)}) v, range({COPIES}) r(copy)""")
def full_verdict_copies(t: Tables) -> DataFrame:
    """Every document ten times; each content is decoded and judged once."""
    docs = t.attack_docs().select("doc_id", "text", F.explode(F.sequence(
        F.lit(0), F.lit(COPIES - 1))).alias("copy")).withColumn(
        "doc_id", F.concat_ws("-", "doc_id", "copy"))
    return _flat(analyze_distinct(requests_from_texts(docs, "doc_id"), semantic=True))


@query("v1_invalid_requests", f"""
select request_id, 'blocked' as status, 1e0 as confidence, 'invalid_input' as name, e as details
from (select request_id, {_errors(C.MAX_MESSAGES, C.MAX_CHARS)} as e from {_STATS}) where e <> ''""")
def invalid_requests(t: Tables) -> DataFrame:
    v = analyze_requests(_requests(t), decode=False).filter(~F.col("input_valid"))
    first = F.col("threats")[0]
    return v.select("request_id", "status", "confidence", first["name"].alias("name"),
                    first["details"].alias("details"))


@query("v2_obfuscation_threat", f"""
select doc_id, cast(1 as int) as n, true as sure,
  'encoding layer(s): base64' as details from ({K.DOCS})""")
def obfuscation_threat(t: Tables) -> DataFrame:
    """Whole documents under base64, which is named first; what else they hold may follow."""
    from guardlake.functions.decode import with_decoded

    said = F.concat(F.lit("some words "), "text")
    hidden = F.regexp_replace(F.base64(F.encode(said, "UTF-8")), "\\s", "")
    df = with_decoded(t.attack_docs().select("doc_id", hidden.alias("h")), "h", "d")
    found = V.obfuscation_threat(F.col("d"), "multi_layer_encoding")
    return df.select("doc_id", F.size(found).alias("n"), F.inline(found)).select(
        "doc_id", "n", (F.col("confidence") >= 0.3).alias("sure"), F.regexp_extract(
            "details", r"encoding layer\(s\): base64", 0).alias("details"))


_TALK_CTX = context_sql(K.TALKS)
_USER_TURNS = f"select conv_id, turn, text from ({K.TALKS}) where role = 'user'"


@query("v4_context_boost", f"""
with p as (select conv_id, turn, max(confidence) as conf, max({K.rank('threat_level')}) as r, count(*) as n
  from {K.hits(_USER_TURNS, 'conv_id, turn')} group by conv_id, turn),
c as (select *, case when issues = '' then 0 else len(string_split(issues,'; ')) end as k from {_TALK_CTX}),
m as (select c.conv_id, c.turn, c.k, coalesce(p.n,0) + c.k as n_threats,
  case when c.k = 0 then coalesce(conf,0e0) when p.n is not null then least(1e0, conf + confidence * 2e-1)
       else greatest(coalesce(conf,0e0), confidence) end as conf,
  greatest(coalesce(r,0), case when c.k = 0 then 0 when confidence > 0.8 then 3 else 2 end) as r
  from c left join p on c.conv_id = p.conv_id and c.turn = p.turn)
select conv_id, turn, round(conf,3) as confidence, cast(n_threats as int) as n_threats,
  case when n_threats = 0 then 'allowed' when r >= 3 and conf > 0.4 then 'blocked'
       when r = 2 and conf >= 0.7 then 'blocked' when r = 2 then 'sanitized' else 'allowed' end as status
from m""")
def context_boost(t: Tables) -> DataFrame:
    talks = with_history(t.talks(), "conv_id", "turn", features(F.col("role"), F.col("text"))
                         ).filter("role = 'user'")
    key = F.struct("conv_id", "turn")
    reqs = (talks.withColumn("key", key).select(
        F.col("key").alias("request_id"), F.lit("analyze-only").alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("text"),
                         F.lit(None).cast("array<struct<type:string,text:string>>").alias("parts"),
                         F.lit(None).cast("string").alias("name"))).alias("messages"),
        "history"))
    v = analyze_requests(reqs, decode=False, history="history")
    return v.select("request_id.*", "confidence", F.size("threats").alias("n_threats"), "status")


query("v6_suggestions", f"""
select doc_id, name, {K.suggestion('category', 'name', 'threat_level')} as suggestion
from {K.hits(K.DOCS, 'doc_id')}""")(
    lambda t: t.attack_docs().select("doc_id", F.inline(V.with_suggestions(V.pattern_threats(
        _scan(F.col("text")))))).select("doc_id", "name", "suggestion"))


def _scan(text):
    from guardlake.functions.patterns import scan as scan_text

    return scan_text(text)


query("v7_primary_threat", f"""
select doc_id, category, name, threat_level, {K.suggestion('category', 'name', 'threat_level')} as suggestion
from {K.hits(K.DOCS, 'doc_id')} qualify row_number() over (partition by doc_id
  order by {K.rank('threat_level')} desc, ord) = 1""")(
    lambda t: t.attack_docs().select("doc_id", V.pattern_threats(_scan(F.col("text"))).alias("t"))
    .select("doc_id", V.primary(F.col("t")).alias("p")).filter("p is not null")
    .select("doc_id", "p.category", "p.name", "p.threat_level", V.suggestion(
        F.col("p.category"), F.col("p.name"), F.col("p.threat_level")).alias("suggestion")))

_FLAT = verdict_sql(K.MESSAGES, _STATS, with_semantic=False)
_FLAT_DECODED = verdict_sql(K.MESSAGES, _STATS, with_semantic=False, decode=True)

query("p12_flat_verdicts", f"""
select request_id, status = 'blocked' as is_malicious, confidence, n_threats from ({_FLAT})""")(
    lambda t: Q.flat_verdicts(analyze_requests(_requests(t), decode=False)).select(
        "request_id", "is_malicious", "confidence", F.size("threats").alias("n_threats")))

query("a6_audit_rows", f"""
select request_id as id, status, threat_level, confidence, n_threats from ({_FLAT})""")(
    lambda t: audit.audit_rows(analyze_requests(_requests(t), decode=False)).select(
        "id", "status", "threat_level", "confidence",
        F.json_array_length("threats_json").alias("n_threats")))

query("a8_threat_counters", f"""
select category, threat_level, count(*)::bigint as n
from ({threats_sql(K.MESSAGES, _VALID, False)}) group by all
union all select 'input_validation', 'high', count(*) from {_STATS} where request_id not in {_VALID}
having count(*) > 0""")(
    lambda t: audit.threat_counters(analyze_requests(_requests(t), decode=False)))

query("a7_security_events", f"""
select 'attack_blocked' as event_type, 'high' as severity, count(*)::bigint as n
from ({_FLAT}) where status = 'blocked'
union all select 'pii_detected', 'low', count(distinct doc_id) from {K.redaction_hits(K.DOCS, 'doc_id')}""")(
    lambda t: _events(t))


def _events(t: Tables) -> DataFrame:
    from guardlake.operators.redact import filter_text

    verdicts = analyze_requests(_requests(t), decode=False)
    filtered = filter_text(t.attack_docs())
    return (audit.security_events(verdicts, filtered=filtered).groupBy("event_type", "severity")
            .agg(F.count(F.lit(1)).alias("n")))


@query("a7_rate_limited_events", f"""
select 'rate_limited' as event_type, 'medium' as severity, concat('{{"exceeded":["',
  array_to_string(list_filter([case when not g_ok then 'global' end, case when not i_ok then 'ip' end,
  case when not k_ok then 'user' end], lambda x: x is not null), '","'), '"]}}') as details, count(*)::bigint as n
from {limits._ALL} where not {limits._OK} group by all""")
def rate_limited_events(t: Tables) -> DataFrame:
    """Events of the requests that the three tiers reject."""
    limited = check_tiers(t.logs(), **limits._TIERS)
    verdicts = analyze_requests(_requests(t), decode=False)
    return (audit.security_events(verdicts, limited).filter("event_type = 'rate_limited'")
            .groupBy("event_type", "severity", "details").agg(F.count(F.lit(1)).alias("n")))
