"""The full verdict on a request, as one chain of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import context as X
from guardlake.functions import messages as M
from guardlake.functions import patterns as P
from guardlake.functions import semantic as S
from guardlake.functions import verdict as V
from guardlake.functions.common import fenced
from guardlake.operators import requests as Q
from guardlake.operators.content import once_per_content
from guardlake.operators.indirect import decode_texts, request_threats

_TEMP = ("__text", "__tools", "__contents", "__deobs", "__deob", "__hits", "__found", "__ctx",
         "__sem", "__threats", "__conf")


VERDICT = ("status", "confidence", "threat_level", "input_valid", "suggestion", "threats")


def conclude(df: DataFrame, *, valid: Column, errors: Column, catalog: P.Catalog = P.DEFAULT,
             indirect: bool = True, context: Column | None = None, semantic: Column | None = None,
             raw: Column | None = None, semantic_threshold: float = C.SEMANTIC_THRESHOLD,
             threshold: float = C.MEDIUM_THRESHOLD, block: bool = True) -> DataFrame:
    """Add status, confidence, threats, input_valid and suggestion.

    Expects __deob (decoded text), __contents and, if there can be tool output, __tools with
    __deobs (decoded tool contents).
    `context` is a context struct; `semantic` a verdict struct to use instead of the keyword
    classifier (None: no semantic layer; the string column 'keywords': the classifier).
    """
    deob = F.col("__deob")
    hits = P.scan(deob["decoded"], catalog)
    if raw is not None:
        # Option: patterns that decoding destroys are still reported, once each.
        seen = F.transform("__hits", lambda h: h["name"])
        df = df.withColumn("__hits", hits)
        more = F.filter(P.scan(raw, catalog), lambda h: ~F.array_contains(seen, h["name"]))
        hits = F.concat("__hits", more)
    df = df.withColumn("__hits", hits)
    base = [V.obfuscation_threat(deob, "multi_layer_encoding")]
    if indirect:
        tools = (F.col("__tools"), F.col("__deobs")) if "__tools" in df.columns else ()
        base.append(request_threats(F.col("__contents"), *tools, catalog=catalog))
    base.append(V.pattern_threats(F.col("__hits")))
    df = df.withColumn("__found", F.concat(*base))
    conf, threats = V.top_confidence(F.col("__found")), [F.col("__found")]
    if context is not None:
        df = df.withColumn("__ctx", context)
        ctx = F.col("__ctx")
        level = F.when(ctx["confidence"] > 0.8, "high").otherwise("medium")
        some = F.coalesce(F.size(ctx["issues"]) > 0, F.lit(False))
        threats.append(F.when(some, F.transform(ctx["issues"], lambda i: V.threat(
            "context", "multi_turn_anomaly", level, ctx["confidence"], i)))
            .otherwise(V.no_threats()))
        conf = V.boosted(conf, F.size("__hits") > 0, ctx["confidence"], some)
    if semantic is not None:
        df = df.withColumn("__sem", S.keyword_verdict(deob["decoded"], semantic_threshold)
                           if isinstance(semantic, str) else semantic)
        sem = F.col("__sem")
        threats.append(V.when_threat(sem["is_malicious"], V.threat(
            "semantic", "intent_classification", sem["threat_level"], sem["confidence"],
            sem["reasoning"])))
        conf = F.greatest(conf, F.when(sem["is_malicious"], sem["confidence"]).otherwise(0.0))
    invalid = F.array(V.threat("input_validation", "invalid_input", "high", 1.0,
                               F.array_join(errors, "; ")))
    df = (df.withColumn("__threats", F.when(valid, F.concat(*threats)).otherwise(invalid))
          .withColumn("__conf", F.when(valid, conf).otherwise(1.0)))
    found = F.col("__threats")
    lead = V.primary(found)
    done = (df.withColumn("status", F.when(valid, V.decide(
                F.col("__conf"), V.top_rank(found), F.size(found), threshold=threshold,
                block=block)).otherwise("blocked"))
            .withColumn("confidence", F.round("__conf", 3))
            .withColumn("threat_level", V.top_level(found))
            .withColumn("input_valid", valid)
            .withColumn("suggestion", F.when(F.size(found) > 0, V.suggestion(
                lead["category"], lead["name"], lead["threat_level"])))
            .withColumn("threats", V.with_suggestions(found))
            .drop(*_TEMP))
    return fenced(done, *VERDICT)


def analyze_requests(requests: DataFrame, *, decode: bool = True, leet: str = "parity",
                     scan: str = "decoded", indirect: bool = True, semantic: bool = False,
                     semantic_threshold: float = C.SEMANTIC_THRESHOLD,
                     history: str | None = None, max_history: int = C.MAX_HISTORY,
                     catalog: P.Catalog = P.DEFAULT, threshold: float = C.MEDIUM_THRESHOLD,
                     block: bool = True) -> DataFrame:
    """Verdict per request; other columns of `requests` pass through.

    `history` names an array<struct<role, content>> column with earlier messages, oldest
    first, or an array of their features (`functions.context.features`), which is what should
    travel where a window gathers them.  Invalid requests get their verdict from validation alone: their texts are null
    from there on, so neither the decoder nor the scans see them.  `scan='both'` also
    reports patterns of the text before decoding.
    """
    df = Q.validate(requests)
    valid = F.col("validation")["is_valid"]
    pair = "array<struct<source:string,content:string>>"
    none = F.array().cast(pair)
    messages = F.col("messages")
    df = (df.withColumn("__text", F.when(valid, M.flat_text(messages)))
          .withColumn("__tools", F.when(valid, M.tool_contents(messages)).otherwise(none))
          .withColumn("__contents", F.when(valid, M.contents(messages)).otherwise(none)))
    if not indirect:
        df = df.withColumn("__tools", none)
    texts = F.when(valid, F.concat(F.array("__text"), F.transform(
        "__tools", lambda t: t["content"]))).otherwise(F.array().cast("array<string>"))
    df = decode_texts(df, texts, "__deobs", decode, leet)
    df = (df.withColumn("__deob", F.get(F.col("__deobs"), F.lit(0)))
          .withColumn("__deobs", F.slice("__deobs", 2, F.greatest(
              F.size("__deobs") - 1, F.lit(0)))))
    context = None
    if history is not None:
        ready = "mask" in df.schema[history].dataType.elementType.names
        past = F.col(history) if ready else F.transform(
            history, lambda h: X.features(h["role"], h["content"]))
        context = F.when(valid & (F.size(history) > 0), X.context(
            X.features(F.lit("user"), F.col("__text")), past, max_history))
    df = conclude(df, valid=valid, errors=F.col("validation")["errors"], catalog=catalog,
                  indirect=indirect, context=context,
                  semantic="keywords" if semantic else None,
                  semantic_threshold=semantic_threshold,
                  raw=F.col("__text") if scan == "both" else None,
                  threshold=threshold, block=block)
    return df.drop("validation", "stats")


def analyze_distinct(requests: DataFrame, *, history: str | None = None, **options) -> DataFrame:
    """What `analyze_requests` gives, with requests of equal content judged once.

    Content is all that a verdict depends on: model, messages, sums for validation and history.
    The messages and the history are left out of the result.  Worth its shuffle where requests
    repeat; where they don't, `analyze_requests` moves no text.
    """
    content = [c for c in ("model", "messages", "stats", history) if c in requests.columns]
    return once_per_content(requests, content, lambda df: analyze_requests(
        df, history=history, **options), VERDICT, keep=("model",)).drop("stats")


def requests_from_texts(texts: DataFrame, key: str, text: str = "text",
                        model: str = "analyze-only") -> DataFrame:
    """Single-message user requests, one per text."""
    message = F.struct(
        F.lit("user").alias("role"), F.col(text).alias("text"),
        F.lit(None).cast("array<struct<type:string,text:string>>").alias("parts"),
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("tool_call_id"))
    return texts.select(F.col(key).alias("request_id"), F.lit(model).alias("model"),
                        F.array(message).alias("messages"))

