"""Queries: streaming operators, run over files until everything available is processed.

Sources and sinks lie below the shared folder, so a restarted query finds its checkpoint.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators import requests as Q
from guardlake.plans import checks as K
from guardlake.plans import inputs as I
from guardlake.plans.inputs import Tables
from guardlake.plans.limits import DAY
from guardlake.plans.multiturn import context_sql
from guardlake.plans.redaction import _LAST
from guardlake.plans.registry import query
from guardlake.plans.requests import _FLAT, _FLAT_DECODED
from guardlake.session import new_folder
from guardlake.sources import sinks
from guardlake.sources.readers import parse_sse, stream_responses
from guardlake.streaming import live
from guardlake.streaming import redaction as R

PIECE = 40


def _source(t: Tables, rows: DataFrame, name: str, files: int | None = None, *keys: str) -> str:
    """Rows as files, as many as there are cores unless told; those with equal `keys` in one."""
    path = new_folder(t.spark, name)
    rows.repartition(files or t.spark.sparkContext.defaultParallelism, *keys).write.parquet(path)
    return path


def _arriving(t: Tables, rows: DataFrame, name: str, of: str | None = None) -> str:
    """Rows as files, as many as there are cores, each with the `seq` that follow those of the one before.

    Streams run side by side, and of each the pieces come about in order, as from a provider.
    Dealt at random, half of all pieces would wait in the state for those of a later micro-batch.
    The file source takes files by their times, which are set in this order.  Where `of` has the
    number of rows of a stream, each file gets its part of every stream; no ranges are sampled.
    """
    path = new_folder(t.spark, name)
    files = t.spark.sparkContext.defaultParallelism
    if of:
        part = F.floor(F.col("seq") * files / F.col(of)).cast("int")
        dealt = rows.repartitionById(files, part).drop(of)
    else:
        dealt = rows.repartitionByRange(files, "seq", F.xxhash64("stream_id"))
    dealt.write.parquet(path)
    folder = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    written = sorted((f.getPath() for f in fs.listStatus(folder)), key=lambda f: f.getName())
    now = int(time.time()) - len(written)
    for i, file in enumerate(written):
        fs.setTimes(file, 1000 * (now + i), -1)
    return path


def _read_stream(t: Tables, path: str, per_trigger: int | None = None) -> DataFrame:
    """The files as a stream; a micro-batch takes half as many as there are cores."""
    per_trigger = per_trigger or max(1, t.spark.sparkContext.defaultParallelism // 2)
    schema = t.spark.read.parquet(path).schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _finish(t: Tables, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input into a table and read the table."""
    folder = new_folder(t.spark, name)
    # State is partitioned once and for all by this setting; small inputs need few.
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _cut(text: str) -> Column:
    """The pieces of a text, one if it is empty or null."""
    return F.when(F.length(text) > 0, F.regexp_extract_all(
        text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)).otherwise(F.array(text))


def _pieces(docs: DataFrame) -> DataFrame:
    """Documents cut into pieces of 40 characters: (stream_id, seq, delta, done, ts)."""
    cut = docs.select(F.col("doc_id").cast("string").alias("stream_id"), _cut("text").alias("pieces"))
    return cut.select(
        "stream_id", F.posexplode("pieces").alias("seq", "delta"),
        F.size("pieces").alias("n")).select(
        "stream_id", F.col("seq").cast("long").alias("seq"), "delta",
        (F.col("seq") == F.col("n") - 1).alias("done"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"))


@query("s3_response_stream", f"""
select cast(doc_id as varchar) as stream_id, length(text)::bigint as n_chars,
  greatest(1, ceil(length(text) / {PIECE}))::bigint as n_chunks from ({K.DOCS})""")
def response_stream(t: Tables) -> DataFrame:
    path = _source(t, _pieces(t.attack_docs()), "pieces")
    rows = _finish(t, stream_responses(t.spark, path), "responses")
    return rows.groupBy("stream_id").agg(F.sum(F.length("delta")).alias("n_chars"),
                                         F.count(F.lit(1)).alias("n_chunks"))


def _redacted(t: Tables) -> DataFrame:
    path = _arriving(t, _pieces(t.attack_docs()), "pieces")
    return _finish(t, R.redact_stream(stream_responses(t.spark, path)), "redacted")


_WHOLE = f"select cast(doc_id as varchar) as stream_id, {_LAST} as redacted from {K.redaction(K.DOCS, 'doc_id')}"


@query("w1_streaming_redaction", _WHOLE)
def streaming_redaction(t: Tables) -> DataFrame:
    """Pieces released by the stream, joined: the same as redacting the whole text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "safe"))),
                          lambda x: x["safe"])
    return _redacted(t).groupBy("stream_id").agg(F.array_join(ordered, "").alias("redacted"))


query("w2_flushed_streams", f"""
select cast(doc_id as varchar) as stream_id, 1::bigint as n_done from ({K.DOCS})""")(
    lambda t: _redacted(t).groupBy("stream_id").agg(
        F.count_if("done").alias("n_done")))

# Matches counted before anything is replaced, rule by rule.
_RAW_HITS = "+".join(
    f"len(regexp_extract_all(text,{K.re2(r.regex)},0,'{'i' if r.ignore_case else 'c'}'))"
    for r in C.RULES)

query("w3_stream_summary", f"""
select cast(doc_id as varchar) as stream_id, ({_RAW_HITS})::bigint as total_detections
from ({K.DOCS})""")(
    lambda t: R.stream_summary(_redacted(t)).select("stream_id", "total_detections"))


def _sse(docs: DataFrame) -> DataFrame:
    """SSE lines of the pieces: a comment, the data lines, [DONE]; `of` is the number of lines."""
    marks = F.array(F.lit(""))
    rows = docs.select(F.col("doc_id").cast("string").alias("stream_id"),
                       F.concat(marks, _cut("text"), marks).alias("pieces"))
    rows = rows.select("stream_id", F.posexplode("pieces").alias("seq", "delta"),
                       F.size("pieces").cast("long").alias("of"))
    body = F.to_json(F.struct(F.lit("c1").alias("id"), F.array(F.struct(
        F.lit(0).alias("index"), F.struct(F.col("delta").alias("content")).alias("delta")))
        .alias("choices")))
    line = (F.when(F.col("seq") == 0, ": open").when(F.col("seq") == F.col("of") - 1, "data: [DONE]")
            .otherwise(F.concat(F.lit("data: "), body)))
    return rows.select("stream_id", F.col("seq").cast("long").alias("seq"), line.alias("line"), "of")


query("s4_sse_transcript", f"""
select cast(doc_id as varchar) as stream_id, 2::bigint as n_other,
  greatest(1, ceil(length(text) / {PIECE}))::bigint as n_data, length(text)::bigint as n_chars
from ({K.DOCS})""")(
    lambda t: parse_sse(_sse(t.attack_docs())).groupBy("stream_id").agg(
        F.count_if(F.col("kind") != "data").alias("n_other"),
        F.count_if(F.col("kind") == "data").alias("n_data"),
        F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("n_chars")))


@query("w4_streaming_sse", _WHOLE)
def streaming_sse(t: Tables) -> DataFrame:
    """Contents of the filtered lines, joined."""
    path = _arriving(t, _sse(t.attack_docs()), "sse", "of")
    lines = _finish(t, R.redact_sse(_read_stream(t, path)), "sse-out")
    # A flushed remainder shares its row with the [DONE] line.
    events = F.when(F.col("line").contains("\n\ndata: "), F.split("line", "\n\n(?=data: )")).otherwise(
        F.array("line"))
    parsed = parse_sse(lines.select("stream_id", "seq", F.posexplode(events).alias("part", "line")))
    # Only data lines have content.  A filter before the lists would parse every line once more.
    said = F.collect_list(F.when(F.col("content").isNotNull(), F.struct("seq", "part", "content")))
    texts = F.transform(F.sort_array("said"), lambda x: x["content"])
    return (parsed.groupBy("stream_id").agg(said.alias("said")).filter(F.size("said") > 0)
            .select("stream_id", F.array_join(texts, "").alias("redacted")))


@query("w5_finished_streams", _WHOLE)
def finished_streams(t: Tables) -> DataFrame:
    """Streams that have ended, redacted in order of their pieces."""
    parts = R.redact_finished(_pieces(t.attack_docs()))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "redacted"))),
                          lambda x: x["redacted"])
    return parts.groupBy("stream_id").agg(F.array_join(ordered, "").alias("redacted"))


@query("w6_live_request_scan", f"""
select status, threat_level, count(*)::bigint as n from ({_FLAT_DECODED}) group by all""")
def live_scan(t: Tables) -> DataFrame:
    """Requests scanned as a stream into log and event tables; log rows per status."""
    logs, _ = _scanned(t)
    return logs.groupBy("status", "threat_level").agg(F.count(F.lit(1)).alias("n"))


@query("w6_live_scan_without_decoding", f"""
select 'log' as kind, status, threat_level, count(*)::bigint as n from ({_FLAT}) group by all
union all select 'event', 'attack_blocked', 'high', count(*) from ({_FLAT}) where status = 'blocked'""")
def live_scan_plain(t: Tables) -> DataFrame:
    """Rows of both tables per status and level, or per type and severity."""
    logs, events = _scanned(t, decode=False)
    return logs.select(F.lit("log").alias("kind"), "status", "threat_level").unionByName(
        events.select(F.lit("event").alias("kind"), F.col("event_type").alias("status"),
                      F.col("severity").alias("threat_level"))).groupBy(
        "kind", "status", "threat_level").agg(F.count(F.lit(1)).alias("n"))


def _scanned(t: Tables, **options) -> tuple[DataFrame, DataFrame]:
    """The log and event tables that a stream of all requests is scanned into."""
    rows = Q.from_messages(t.messages()).withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp"))
    path = _source(t, rows, "requests")
    folder = new_folder(t.spark, "live")
    live.scan_requests(_read_stream(t, path), f"{folder}/logs", f"{folder}/events",
                       f"{folder}/checkpoint", **options).awaitTermination()
    return (sinks.read_table(t.spark, f"{folder}/logs"),
            sinks.read_table(t.spark, f"{folder}/events"))


@query("w7_live_window_counts", f"""
select api_key_id, strftime(to_timestamp((epoch_us(ts) // {DAY * 1000000}) * {DAY}),'%Y-%m-%d') as day,
  count(*)::bigint as n_events, greatest(0, count(*) - 25)::bigint as n_rejected
from ({K.LOGS}) group by 1, 2""")
def live_window_counts(t: Tables) -> DataFrame:
    """Every window, open ones too: each micro-batch writes the windows that it changed, and the
    last count of a window, its largest, holds."""
    path = _source(t, t.logs(), "events")
    counts = live.window_counts(_read_stream(t, path), "api_key_id", window=DAY, limit=20,
                                burst=5, lateness="60 days")
    folder = new_folder(t.spark, "window-counts")
    q = (counts.writeStream.outputMode("update").foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(
                f"{folder}/out/batch={number}"))
         .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    day = F.date_format("window_start", "yyyy-MM-dd").alias("day")
    return (t.spark.read.schema(counts.schema).parquet(f"{folder}/out")
            .groupBy("api_key_id", day).agg(F.max("n_events").alias("n_events"),
                                            F.max("n_rejected").alias("n_rejected")))


@query("w7_live_decisions", f"""
select api_key_id as key, count(*)::bigint as n_events, count(*) filter (current <= 25)::bigint as n_allowed
from (select api_key_id, row_number() over (partition by api_key_id, epoch_us(ts) // {DAY * 1000000}
  order by ts, event_id) as current from ({K.LOGS})) group by 1""")
def live_decisions(t: Tables) -> DataFrame:
    path = _source(t, t.logs(), "events")
    rows = live.limit_events(_read_stream(t, path), "api_key_id", window=DAY, limit=20, burst=5,
                             lateness="60 days")
    return _finish(t, rows, "decisions").groupBy("key").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if("allowed").alias("n_allowed"))


@query("w8_live_context", f"select conv_id, turn, confidence, issues from {context_sql(K.TALKS)}")
def live_context(t: Tables) -> DataFrame:
    path = _source(t, t.talks(), "talks", None, "conv_id")
    return _finish(t, live.live_context(_read_stream(t, path)), "contexts").select(
        "conv_id", "turn", "context.confidence",
        F.array_join("context.issues", "; ").alias("issues"))


@query("w9_live_canaries", f"""
select conv_id, turn, token, request_id from (
  select s.conv_id, s.turn, s.token, r.request_id from (
    select conv_id, turn, ts, unnest(regexp_extract_all(text,'{C.CANARY_PRIMARY.replace("[", chr(92) + "[").replace("]", chr(92) + "]").replace("{h}", "([0-9a-f]{16})")}',1)) as token from ({I.for_check(I.CANARY_RESPONSES)})
    union all select conv_id, turn, ts, replace(unnest(regexp_extract_all(text,'\\[REF-ID: ([0-9a-f]{{8}}-[0-9a-f]{{8}})\\]',1)),'-','') from ({I.for_check(I.CANARY_RESPONSES)})
  ) s join ({I.for_check(I.CANARY_REGISTRY)}) r on s.token = r.token
  and s.ts >= r.injected_at and s.ts <= r.injected_at + interval '1' minute * (1 + cast(r.request_id as bigint) % 4))""")
def live_canaries(t: Tables) -> DataFrame:
    """Tokens with times to live of their own: one to four minutes."""
    said = _source(t, t.sql(I.CANARY_RESPONSES), "responses")
    registry = t.sql(I.CANARY_REGISTRY).withColumn(
        "ttl_seconds", 60 * (1 + F.col("request_id").cast("long") % 4))
    tokens = _source(t, registry, "tokens")
    rows = live.match_canaries(_read_stream(t, said), _read_stream(t, tokens),
                               ["conv_id", "turn"], lateness="60 days")
    return _finish(t, rows, "leaks").select("conv_id", "turn", "token", "request_id")
