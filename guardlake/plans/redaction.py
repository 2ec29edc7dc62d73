"""Queries: redaction of texts and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions.redact import DEFAULT
from guardlake.operators import redact as R
from guardlake.plans import checks as K
from guardlake.plans.inputs import Tables
from guardlake.plans.registry import query
from guardlake.sources.readers import parse_responses

_LAST = f"t{len(C.RULES)}"

query("r1_redacted_text", f"select doc_id, {_LAST} as redacted from {K.redaction(K.DOCS, 'doc_id')}")(
    lambda t: R.redact(t.attack_docs()).select("doc_id", "redacted"))

query("r2_redaction_hits", f"select * from {K.redaction_hits(K.DOCS, 'doc_id')}")(
    lambda t: R.redaction_hits(t.attack_docs(), ["doc_id"]).select(
        "doc_id", "rule", "category", "n", F.array_join("samples", "|").alias("samples")))

query("r3_detect_only", f"""
select doc_id, array_to_string(list_sort(list(rule)), ',') as rules
from {K.redaction_hits(K.DOCS, 'doc_id')} group by doc_id""")(
    lambda t: R.filter_text(t.attack_docs()).filter(F.size("redactions") > 0).select(
        "doc_id", F.array_join(F.array_sort(F.transform("redactions", lambda r: r["rule"])), ",")
        .alias("rules")))

_CUSTOM = C.Rule("order_number", r"\border[ #:]+[0-9]+\b|the\s+of", "<order>", "", "custom", True)

query("r4_custom_rule", f"""
select doc_id, t{len(C.RULES) + 1} as redacted
from {K.redaction(K.DOCS, 'doc_id', rules=(*C.RULES, _CUSTOM))}""")(
    lambda t: R.redact(t.attack_docs(), rules=DEFAULT.with_rule(
        _CUSTOM.name, _CUSTOM.regex, _CUSTOM.replacement)).select("doc_id", "redacted"))

_NO_PII = tuple(r for r in C.RULES if r.category != "pii")

query("r5_without_pii", f"""
select doc_id, t{len(_NO_PII)} as redacted from {K.redaction(K.DOCS, 'doc_id', rules=_NO_PII)}""")(
    lambda t: R.redact(t.attack_docs(), rules=DEFAULT.without_pii()).select(
        "doc_id", "redacted"))


def _responses(t: Tables) -> DataFrame:
    """Provider bodies with two choices each, as JSON."""
    docs = t.attack_docs()
    message = lambda c: F.struct(c.alias("content"))
    body = F.to_json(F.struct(
        F.array(F.struct(F.lit(0).alias("index"), message(F.col("text")).alias("message")),
                F.struct(F.lit(1).alias("index"),
                         message(F.lit("mail me: x@example.com")).alias("message")))
        .alias("choices"),
        F.when(F.col("doc_id") % 2 == 0, F.struct(
            F.length("text").alias("prompt_tokens"), F.lit(7).alias("completion_tokens")))
        .alias("usage")))
    return docs.select("doc_id", body.alias("body"))


query("s5_provider_responses", f"""
select doc_id, length(text)::bigint as content_chars, cast(2 as int) as n_choices,
  cast(case when doc_id % 2 = 0 then length(text) else 0 end as int) as prompt_tokens,
  cast(case when doc_id % 2 = 0 then 7 else 0 end as int) as completion_tokens
from ({K.DOCS})""")(
    lambda t: parse_responses(_responses(t)).select(
        "doc_id", F.length(F.col("choices")[0]["content"]).cast("long").alias("content_chars"),
        F.size("choices").alias("n_choices"), "prompt_tokens", "completion_tokens"))

query("r6_filtered_choices", f"""
select doc_id, {_LAST} as first, 'mail me: [EMAIL_REDACTED]' as second, true as output_sanitized
from {K.redaction(K.DOCS, 'doc_id')}""")(
    lambda t: R.filter_responses(parse_responses(_responses(t))).select(
        "doc_id", F.col("choices")[0]["content"].alias("first"),
        F.col("choices")[1]["content"].alias("second"), "output_sanitized"))

query("r7_corpus_report", f"""
select rule, category, count(*)::bigint as n_texts, sum(n)::bigint as n_matches
from {K.redaction_hits(K.DOCS, 'doc_id')} group by rule, category""")(
    lambda t: R.corpus_report(t.attack_docs()))
