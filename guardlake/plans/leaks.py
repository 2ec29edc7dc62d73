"""Queries: canary tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators import canary
from guardlake.plans import inputs as I
from guardlake.plans.inputs import Tables, for_check
from guardlake.plans.registry import query
from guardlake.session import new_folder
from guardlake.sources import sinks

_PROMPTS = ("select concat(cast(conv_id as varchar(20)), '-', cast(turn as varchar(20))) as "
            "request_id, text as prompt from {conversations}")
_AT = "2024-01-01 00:05:00"


def _injected(t: Tables, stealth: bool = False) -> DataFrame:
    return canary.inject(t.sql(_PROMPTS), salt="pepper-", stealth=stealth)


_TOKEN = "substr(sha256('pepper-' || request_id),1,16)"

query("c1_inject", f"""
select request_id, {_TOKEN} as token, substr(sha256(prompt),1,16) as prompt_hash,
  concat(prompt, chr(10), chr(10), '{C.CANARY_INJECTED.split("{h}")[0]}', {_TOKEN}, ']') as protected_prompt
from ({for_check(_PROMPTS)})""")(
    lambda t: _injected(t).select("request_id", "token", "prompt_hash", "protected_prompt"))

query("c2_inject_stealth", f"""
select request_id, concat(prompt, chr(10), chr(10), '<!-- Internal reference: ', substr({_TOKEN},1,8), '-',
  substr({_TOKEN},9,8), ' -->') as protected_prompt from ({for_check(_PROMPTS)})""")(
    lambda t: _injected(t, stealth=True).select("request_id", "protected_prompt"))

_REG = for_check(I.CANARY_REGISTRY)
_RESP = for_check(I.CANARY_RESPONSES)
_PRE = C.CANARY_PRIMARY.replace("[", "\\[").replace("]", "\\]").replace("{h}", "([0-9a-f]{16})")
_ALIVE = ("epoch_us(ts) - epoch_us(injected_at) between 0 and ttl_seconds * 1000000")
# Token and the marker it came in, per response and format.
_SEEN = f"""(select conv_id, turn, ts, text, unnest(regexp_extract_all(text,'{_PRE}',1)) as token, 'primary' as format,
    unnest(regexp_extract_all(text,'{_PRE}',0)) as marker from ({_RESP})
  union all select conv_id, turn, ts, text, replace(x,'-',''), 'ref_id', concat('[REF-ID: ', x, ']') from (
    select *, unnest(regexp_extract_all(text,'\\[REF-ID: ([0-9a-f]{{8}}-[0-9a-f]{{8}})\\]',1)) as x from ({_RESP})))"""
_LEAK = (f"(select s.*, r.request_id, r.injected_at from {_SEEN} s join ({_REG}) r on s.token = r.token "
         f"where {_ALIVE})")
_STAMP = "strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.sql(I.CANARY_RESPONSES), t.sql(I.CANARY_REGISTRY)


query("c3_detect", f"""
select conv_id, turn, token, request_id, {_STAMP.format(x='injected_at')} as injected_at, format
from {_LEAK} qualify row_number() over (partition by conv_id, turn
  order by format = 'primary' desc, injected_at, token) = 1""")(
    lambda t: canary.detect(*_tables(t), ["conv_id", "turn"]).select(
        "conv_id", "turn", "token", "request_id", _stamp("injected_at"), "format"))

query("c4_detect_stealth", f"""
select conv_id, turn, token, request_id, format from {_LEAK}""")(
    lambda t: canary.detect_all(*_tables(t), ["conv_id", "turn"]).select(
        "conv_id", "turn", "token", "request_id", "format"))

query("c5_partial_hits", f"""
select conv_id, turn, r.token, request_id, 'warning' as severity from (
  select conv_id, turn, ts, unnest(list_distinct(regexp_extract_all(text,'\\b([0-9a-f]{{16}})\\b',1))) as token
  from ({_RESP})) s join ({_REG}) r on s.token = r.token where {_ALIVE}""")(
    lambda t: canary.detect_all(*_tables(t), ["conv_id", "turn"], formats=(), partial=True)
    .select("conv_id", "turn", "token", "request_id", "severity"))

query("c6_leak_context", f"""
select conv_id, turn, format, substr(text, greatest(1, instr(text, marker) - 100),
  instr(text, marker) + length(marker) + 100 - greatest(1, instr(text, marker) - 100)) as leaked_content
from {_LEAK}""")(
    lambda t: canary.detect_all(*_tables(t), ["conv_id", "turn"]).select(
        "conv_id", "turn", "format", "leaked_content"))

_AS_OF_SQL = f"timestamp '{_AT}'"
_LIVE = f"epoch_us({_AS_OF_SQL}) - epoch_us(injected_at) between 0 and ttl_seconds * 1000000"


def _at():
    return F.lit(_AT).cast("timestamp")


@query("c7_active_after_removal", f"""
select token, request_id from ({_REG}) where {_LIVE} and request_id not like '%3'""")
def active_tokens(t: Tables) -> DataFrame:
    """Tokens alive at a moment, without those removed (requests ending in 3)."""
    registry = t.sql(I.CANARY_REGISTRY)
    gone = registry.filter(F.col("request_id").endswith("3")).select("token")
    return canary.active(canary.remove(registry, gone), _at()).select("token", "request_id")


# late enough for the older tokens to be past their time
_LATER = "2024-01-01 00:05:50"

query("c7_expired", f"""
select token from ({_REG}) where not ({_LIVE.replace(_AT, _LATER)})""")(
    lambda t: canary.expired(t.sql(I.CANARY_REGISTRY), F.lit(_LATER).cast("timestamp"))
    .select("token"))


def _recorded(t: Tables) -> DataFrame:
    return canary.detect_all(*_tables(t), ["conv_id", "turn"]).withColumnRenamed(
        "ts", "detected_at")


query("c8_list_detections", f"""
select token, request_id, {_STAMP.format(x='ts')} as detected_at from {_LEAK}
order by ts desc, token limit 20""")(
    lambda t: canary.list_detections(_recorded(t), limit=20).select(
        "token", "request_id", _stamp("detected_at")))

query("c8_detections_of_request", f"""
select token, {_STAMP.format(x='ts')} as detected_at from {_LEAK} where request_id = '5'""")(
    lambda t: canary.list_detections(_recorded(t), request_id="5").select(
        "token", _stamp("detected_at")))

query("c9_stats", f"""
select (select count(*) from ({_REG}) where {_LIVE})::bigint as active_tokens,
  (select count(*) from {_LEAK})::bigint as total_detections""")(
    lambda t: canary.stats(t.sql(I.CANARY_REGISTRY), _recorded(t), _at()))


@query("s10_registry", f"""
select token, request_id, {_STAMP.format(x="injected_at + interval '300' second")} as expires_at
from ({_REG})""")
def stored_registry(t: Tables) -> DataFrame:
    """Registry written, read back, and looked up by request and by token."""
    path = new_folder(t.spark, "registry")
    sinks.store_registry(t.sql(I.CANARY_REGISTRY), path)
    stored = sinks.read_table(t.spark, path)
    found = canary.find_token(canary.find_request(stored, stored), stored)
    return found.select("token", "request_id", _stamp("expires_at"))


@query("s11_retained_detections", f"""
select token, {_STAMP.format(x='ts')} as detected_at from {_LEAK}
where ts >= timestamp '2024-01-31 00:04:00' - interval '30' day""")
def retained_detections(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "detections")
    sinks.append_detections(_recorded(t), path)
    kept = canary.retained(sinks.read_table(t.spark, path),
                           F.lit("2024-01-31 00:04:00").cast("timestamp"))
    return kept.select("token", _stamp("detected_at"))
