"""Canary tokens: tagging prompts, finding leaks in responses, registry upkeep.

A token is 16 hex characters `h`; the registry has one row per token:
(token, request_id, injected_at, ttl_seconds, prompt_hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators.skew import lookup

FORMATS = {
    "primary": C.CANARY_PRIMARY,
    "ref_id": C.CANARY_REF_ID,
    "comment": C.CANARY_COMMENT,
    "injected": C.CANARY_INJECTED,
    "injected_stealth": C.CANARY_INJECTED_STEALTH,
}
# Formats the detector looks for; the other two are the markers that tagging writes.
SEARCHED = ("primary", "ref_id", "comment")
_HEX16 = "(?<![0-9a-f])[0-9a-f]{16}(?![0-9a-f])"


def marker(token: Column, fmt: str) -> Column:
    """The marker text of a token in one of the FORMATS."""
    template = FORMATS[fmt]
    values = {"{h}": token, "{a}": F.substring(token, 1, 8), "{b}": F.substring(token, 9, 8)}
    out, rest = [], template
    while rest:
        at = min((rest.find(k) for k in values if k in rest), default=-1)
        if at < 0:
            out.append(F.lit(rest))
            break
        out.append(F.lit(rest[:at]))
        out.append(values[rest[at:at + 3]])
        rest = rest[at + 3:]
    return F.concat(*out)


def _regex(fmt: str) -> str:
    text = FORMATS[fmt]
    for ch in "[]-":
        text = text.replace(ch, "\\" + ch)
    for key, group in (("{h}", "([0-9a-f]{16})"), ("{a}", "([0-9a-f]{8})"),
                       ("{b}", "([0-9a-f]{8})")):
        text = text.replace(key, group)
    return text


def token_of(key: Column, salt: str) -> Column:
    """Repeatable token of a request: keyed hash instead of a random draw."""
    return F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 16)


def inject(prompts: DataFrame, *, salt: str, stealth: bool = False, prompt: str = "prompt",
           key: str = "request_id") -> DataFrame:
    """Add `token`, `prompt_hash` and the prompt with the marker appended."""
    fmt = "injected_stealth" if stealth else "injected"
    return (prompts.withColumn("token", token_of(F.col(key), salt))
            .withColumn("prompt_hash", F.substring(F.sha2(F.col(prompt), 256), 1, 16))
            .withColumn("protected_prompt", F.concat(
                F.col(prompt), F.lit("\n\n"), marker(F.col("token"), fmt))))


def registry(injected: DataFrame, injected_at: Column, ttl_seconds: int = C.CANARY_TTL_SECONDS,
             key: str = "request_id") -> DataFrame:
    """Registry rows of tagged prompts."""
    return injected.select("token", F.col(key).alias("request_id"),
                           injected_at.alias("injected_at"),
                           F.lit(ttl_seconds).alias("ttl_seconds"), "prompt_hash")


def _alive(at: Column) -> Column:
    age = F.unix_micros(at) - F.unix_micros("injected_at")
    return (age >= 0) & (age <= F.col("ttl_seconds") * F.lit(1_000_000).cast("long"))


def active(registry: DataFrame, as_of: Column) -> DataFrame:
    return registry.filter(_alive(as_of))


def expired(registry: DataFrame, as_of: Column) -> DataFrame:
    return registry.filter(~_alive(as_of))


def remove(registry: DataFrame, tokens: DataFrame) -> DataFrame:
    """Registry without the listed tokens."""
    return registry.join(tokens.select("token").distinct(), "token", "left_anti")


def find_token(registry: DataFrame, tokens: DataFrame) -> DataFrame:
    return registry.join(tokens.select("token").distinct(), "token", "left_semi")


def find_request(registry: DataFrame, requests: DataFrame) -> DataFrame:
    return registry.join(requests.select("request_id").distinct(), "request_id", "left_semi")


def context(text: Column, marker: Column, chars: int = C.CANARY_CONTEXT_CHARS) -> Column:
    """The marker with up to `chars` characters on either side."""
    at = F.position(marker, text)
    start = F.greatest(at - chars, F.lit(1))
    stop = at + F.length(marker) + chars
    return F.when(at > 0, F.substring(text, start, stop - start)).otherwise("")


def mentions(responses: DataFrame, keys: list[str], text: str = "text",
             formats: tuple[str, ...] = SEARCHED, partial: bool = False) -> DataFrame:
    """(keys, token, format, marker, leaked_content) of every marker-shaped string, one row per
    distinct one, with its surroundings cut out here: the text goes no further.

    With `partial`, bare 16-hex runs that are not part of a searched marker count too.
    """
    body = F.col(text)

    def mention(token: Column, fmt: str, m: Column) -> Column:
        return F.struct(token.alias("token"), F.lit(fmt).alias("format"), m.alias("marker"),
                        context(body, m).alias("leaked_content"))

    def marked(fmt: str) -> Column:
        raw = F.regexp_extract_all(body, F.lit(_regex(fmt)), 0)
        digits = F.lit("(?<=[-: ])[0-9a-f]{8}(?:[0-9a-f]{8})?(?=[-\\] ])")
        return F.transform(F.array_distinct(raw), lambda m: mention(
            F.array_join(F.regexp_extract_all(m, digits, F.lit(0)), ""), fmt, m))

    found = [marked(fmt) for fmt in formats]
    if partial:
        bare = F.array_distinct(F.regexp_extract_all(body, F.lit(_HEX16), F.lit(0)))
        found.append(F.transform(bare, lambda m: mention(m, "partial", m)))
    return responses.select(*keys, F.inline(F.concat(*found)))


def detect_all(responses: DataFrame, registry: DataFrame, keys: list[str], at: str = "ts",
               text: str = "text", formats: tuple[str, ...] = SEARCHED,
               partial: bool = False) -> DataFrame:
    """One row per (response, format, live token): an equi-join on tokens cut from the text.

    A token that leaks everywhere is spread by response; the registry has one row per token.
    """
    seen = mentions(responses.select(*keys, at, text), [*keys, at], text, formats, partial)
    joined = lookup(seen, registry, ["token"], keys)
    return (joined.filter(_alive(F.col(at)))
            .withColumn("severity", F.when(F.col("format") == "partial", "warning")
                        .otherwise("critical"))
            .select(*keys, at, "token", "request_id", "injected_at", "format", "severity",
                    "leaked_content"))


def detect(responses: DataFrame, registry: DataFrame, keys: list[str], at: str = "ts",
           text: str = "text", formats: tuple[str, ...] = SEARCHED) -> DataFrame:
    """First leak of each response: the primary format before the others, then the token
    that was registered first."""
    order = F.struct(
        F.when(F.col("format") == "primary", 0).otherwise(1).alias("alt"),
        F.col("injected_at"), F.col("token"),
        F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("format")).alias("f"))
    cols = [at, "token", "request_id", "injected_at", "format", "leaked_content"]
    hits = detect_all(responses, registry, keys, at, text, formats)
    return (hits.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("d"))
            .select(*keys, "d.*"))


def retained(detections: DataFrame, as_of: Column,
             days: int = C.CANARY_RETENTION_DAYS, at: str = "detected_at") -> DataFrame:
    return detections.filter(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))


def list_detections(detections: DataFrame, request_id=None, limit: int = 100,
                    at: str = "detected_at") -> DataFrame:
    """Newest detections, optionally of one request."""
    df = detections if request_id is None else detections.filter(
        F.col("request_id") == request_id)
    return df.orderBy(F.desc(at), "token").limit(limit)


def stats(registry: DataFrame, detections: DataFrame, as_of: Column) -> DataFrame:
    """Active tokens and recorded detections, as one row."""
    kinds = registry.select(F.lit(1).alias("t"), F.lit(0).alias("d")).where(_alive(as_of))
    kinds = kinds.unionByName(detections.select(F.lit(0).alias("t"), F.lit(1).alias("d")))
    return kinds.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("active_tokens"),
                     F.coalesce(F.sum("d"), F.lit(0)).alias("total_detections"))
