"""Queries: multi-turn context of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators.context import conversation_context
from guardlake.plans import checks as K
from guardlake.plans.inputs import Tables
from guardlake.plans.registry import query


def _words(x: str) -> str:
    return (f"list_transform(regexp_extract_all({x},'[\\p{{L}}\\p{{N}}_]{{3,}}'), "
            "lambda w: lower(w))")


_PROBE = " or ".join(f"regexp_matches(x,{K.re2(p)},'i')" for p in C.PROBES)


def _marks(x: str) -> str:
    return "+".join(f"cast(contains(lower(array_to_string({x},' ')),'{m}') as int)"
                    for m in C.ESCALATION_MARKERS)


_MARKERS = "[" + ",".join(f"'{m}'" for m in C.ESCALATION_MARKERS) + "]"
_COMMON = ("list_sum(list_transform(list_distinct(cur), lambda w: least("
           "len(list_filter(cur, lambda y: y = w)), len(list_filter(p, lambda y: y = w)))))")


def context_sql(source: str) -> str:
    """Scores of the four signals, confidence and issues per user turn of `source`."""
    return f"""(
with framed as (select *, list({{'role': role, 'text': text}}) over (partition by conv_id
    order by turn rows between 10 preceding and 1 preceding) as h from ({source})),
turns as (select conv_id, turn, text, len(coalesce(h,[])) as nh,
    list_transform(list_filter(coalesce(h,[]), lambda x: x.role = 'user'), lambda x: x.text) as us,
    {_words('text')} as cur from framed where role = 'user'),
more as (select *, list_distinct(cur) as dcur,
    list_distinct(flatten(list_transform(us[-3:], lambda x: {_words('x')}))) as seen,
    list_append(us, text) as talk from turns),
halves as (select *, talk[1:len(talk)//2] as first, talk[len(talk)//2+1:] as second from more),
raw as (select *, {_marks('first')} as a, {_marks('second')} as b,
    len(list_filter(talk, lambda x: {_PROBE})) / len(talk) as share,
    len(list_filter(list_transform(us[-5:], lambda x: {_words('x')}), lambda p:
        len(p) > 0 and len(cur) > 0 and
        {_COMMON} / (len(cur) + len(p) - {_COMMON}) > 0.7)) as alike from halves),
scored as (select conv_id, turn,
    case when len(us) = 0 or len(dcur) = 0 or len(seen) = 0 then 0e0
         when len(list_intersect(dcur, seen)) / len(dcur) < 0.15 and list_has_any(dcur, {_MARKERS}) then 85e-2
         when len(list_intersect(dcur, seen)) / len(dcur) < 0.1 then 6e-1 else 0e0 end as topic,
    case when nh = 0 then 0e0 when share >= 0.6 then 8e-1 when share >= 0.3 then 5e-1 else 0e0 end as probe,
    case when nh = 0 or len(talk) < 3 then 0e0 when a = 0 and b >= 3 then 85e-2
         when b > a * 2 and b >= 2 then 7e-1 else 0e0 end as escalation,
    case when alike >= 3 then 9e-1 when alike >= 2 then 6e-1 else 0e0 end as retry from raw)
select *, greatest(case when topic > 0.5 then topic else 0e0 end, case when probe > 0.4 then probe else 0e0 end,
      case when escalation > 0.4 then escalation else 0e0 end, case when retry > 0.5 then retry else 0e0 end) as confidence,
  array_to_string(list_filter([
    case when topic > 0.5 then concat('Sudden topic change detected (score=', printf('%.2f', topic), ')') end,
    case when probe > 0.4 then concat('Probing behaviour detected (score=', printf('%.2f', probe), ')') end,
    case when escalation > 0.4 then concat('Escalation pattern detected (score=', printf('%.2f', escalation), ')') end,
    case when retry > 0.5 then concat('Repetitive retry pattern detected (score=', printf('%.2f', retry), ')') end
    ], lambda x: x is not null), '; ') as issues from scored)"""


_SQL = context_sql(K.TALKS)


def _context(t: Tables) -> DataFrame:
    return conversation_context(t.talks()).select("conv_id", "turn", "context.*")


for _name, _column in (("x1_topic_change", "topic"), ("x2_probing", "probe"),
                       ("x3_escalation", "escalation"), ("x4_retries", "retry")):
    query(_name, f"select conv_id, turn, {_column} from {_SQL}")(
        lambda t, column=_column: _context(t).select("conv_id", "turn", column))

query("x5_context", f"select conv_id, turn, confidence, issues from {_SQL}")(
    lambda t: _context(t).select("conv_id", "turn", "confidence",
                                 F.array_join("issues", "; ").alias("issues")))

_PLAIN = "select conv_id, turn, role, text from conversations"

query("x5_context_plain", f"select conv_id, turn, confidence, issues from {context_sql(_PLAIN)}")(
    lambda t: conversation_context(t.read("conversations")).select(
        "conv_id", "turn", "context.confidence",
        F.array_join("context.issues", "; ").alias("issues")))
