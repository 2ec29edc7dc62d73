"""Requests: assembly from message rows, text extraction, validation, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import messages as M
from guardlake.operators.skew import lookup

MESSAGE_FIELDS = ("role", "text", "parts", "name", "tool_call_id")
_PARTS = "array<struct<type:string,text:string>>"


def _complete(df: DataFrame) -> DataFrame:
    """Add the optional message columns that are missing."""
    for name, kind in (("parts", _PARTS), ("name", "string"), ("tool_call_id", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def from_messages(messages: DataFrame, *, max_messages: int = C.MAX_MESSAGES,
                  max_chars: int = C.MAX_CHARS) -> DataFrame:
    """One row per request from one row per message (request_id, pos, role, text, ...).

    Validation needs sums only, which combine map-side.  Requests within the limits carry all
    their messages in order of `pos`; those past a limit carry none, since their verdict comes
    from the sums in `stats`, so that no group outgrows the limits however many rows share a
    request id.  What looks at single messages takes `single_messages` and needs no assembly.
    """
    df = _complete(messages)
    one = F.struct(*[F.col(c) for c in MESSAGE_FIELDS])
    facts = M.message_stats(one)
    model = F.max("model") if "model" in df.columns else F.lit("unknown")
    sums = df.groupBy("request_id").agg(
        model.alias("model"), F.count(F.lit(1)).alias("n_messages"),
        *[F.sum(v).alias(k) for k, v in facts.items()])
    small = sums.filter((F.col("n_messages") <= max_messages) & (F.col("n_chars") <= max_chars))
    carried = lookup(df.select("request_id", "pos", one.alias("m")),
                     small.select("request_id"), ["request_id"], ["pos"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m")),
                                       lambda a, b: a["pos"] - b["pos"]), lambda k: k["m"])
    whole = carried.groupBy("request_id").agg(ordered.alias("messages"))
    none = F.array().cast(whole.schema["messages"].dataType)
    return sums.join(whole, "request_id", "left").select(
        "request_id", "model", F.coalesce("messages", none).alias("messages"),
        F.struct("n_messages", *M.STAT_NAMES).alias("stats"))


def single_messages(messages: DataFrame) -> DataFrame:
    """(request_id, pos, messages): every message row as a request of that message alone.

    For whatever looks at messages one by one: nothing is grouped, and nothing left out.
    """
    one = F.struct(*[F.col(c) for c in MESSAGE_FIELDS])
    return _complete(messages).select("request_id", "pos", F.array(one).alias("messages"))


def first_position(requests: DataFrame) -> Column:
    """Position of the first message that a row carries."""
    return F.col("pos") if "pos" in requests.columns else F.lit(0)


def with_stats(requests: DataFrame) -> DataFrame:
    """Add `stats` to requests that carry their whole messages."""
    if "stats" in requests.columns:
        return requests
    return requests.withColumn("stats", M.request_stats(F.col("messages")))


def validate(requests: DataFrame, **limits) -> DataFrame:
    """Add `validation`: struct<is_valid, errors, warnings>."""
    return with_stats(requests).withColumn(
        "validation", M.validation(F.col("stats"), F.col("model"), **limits))


def request_texts(requests: DataFrame) -> DataFrame:
    """(request_id, text) of the requests that pass validation, one line per text piece."""
    ok = validate(requests).filter("validation.is_valid")
    return ok.select("request_id", M.flat_text(F.col("messages")).alias("text"))


def _long(requests: DataFrame, items: Column) -> DataFrame:
    return requests.select("request_id", F.inline(items))


def tool_contents(requests: DataFrame) -> DataFrame:
    """(request_id, source, content) of tool and function output."""
    return _long(requests, M.tool_contents(F.col("messages"), first_position(requests)))


def labelled_contents(requests: DataFrame) -> DataFrame:
    """(request_id, source, content) of every non-blank message."""
    return _long(requests, M.contents(F.col("messages"), first_position(requests)))


def urls(requests: DataFrame) -> DataFrame:
    """(request_id, url), each URL once per request."""
    found = requests.select("request_id", F.explode(M.urls(F.col("messages"))).alias("url"))
    return found.distinct() if "pos" in requests.columns else found


def with_provider(df: DataFrame, model: str = "model", override: str | None = None,
                  out: str = "provider") -> DataFrame:
    return df.withColumn(out, M.provider(
        F.col(model), F.col(override) if override else None))


def flat_verdicts(verdicts: DataFrame) -> DataFrame:
    """Verdicts reduced to what a caller acts on."""
    return verdicts.select(
        "request_id", (F.col("status") == "blocked").alias("is_malicious"), "confidence",
        F.transform("threats", lambda t: F.struct(
            t["category"].alias("category"), t["name"].alias("name"),
            t["threat_level"].alias("level"))).alias("threats"),
        F.coalesce(F.get(F.col("threats"), F.lit(0))["suggestion"], F.lit(""))
        .alias("suggestion"))
