"""Live request scanning, rate limits, conversation history and canary matching."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from guardlake import catalog as C
from guardlake.functions import context as X
from guardlake.operators import audit, canary
from guardlake.operators.verdict import analyze_requests
from guardlake.sources import sinks

EMITTED_ROWS, TOKEN_SALTS = 10_000, 8


def scan_requests(requests: DataFrame, logs: str, events: str, checkpoint: str,
                  **options) -> StreamingQuery:
    """Scan a stream of requests (with created_at) into tables of logs and security events.

    A batch is a partition of its own, named by the stream's checkpoint and the number of the
    batch, so one that runs again after a failure replaces its rows.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    verdicts = analyze_requests(requests, **options)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        name = f"{stream}-{batch_id}"
        sinks.replace_batch(audit.audit_rows(batch), logs, "created_at", name)
        sinks.replace_batch(audit.security_events(batch), events, "created_at", name)
        batch.unpersist()

    return (verdicts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def window_counts(events: DataFrame, key: str, *, ts: str = "ts",
                  window: int = C.RATE_WINDOW_SECONDS, limit: int = C.RATE_PER_KEY,
                  burst: int = C.RATE_BURST, lateness: str = "2 minutes") -> DataFrame:
    """Requests per key and window on a stream, with the number over the limit."""
    span = F.window(ts, f"{window} seconds")
    return (events.withWatermark(ts, lateness).groupBy(span.alias("w"), F.col(key))
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(key, F.col("w.start").alias("window_start"), "n_events",
                    F.greatest(F.lit(0).cast("long"), F.col("n_events") - (limit + burst))
                    .alias("n_rejected")))


def limit_events(events: DataFrame, key: str, *, ts: str = "ts", event: str = "event_id",
                 window: int = C.RATE_WINDOW_SECONDS, limit: int = C.RATE_PER_KEY,
                 burst: int = C.RATE_BURST, lateness: str = "2 minutes") -> DataFrame:
    """Decision per event, counted in order of arrival, and of time within a micro-batch.

    Ids and times of a micro-batch's events of one window are sorted together.  State is one counter per (key, window), dropped when the watermark passes the window.
    """
    cap = limit + burst
    rows = (events.withWatermark(ts, lateness)
            .select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"),
                    F.col(event).cast("long").alias("event_id"),
                    F.floor(F.unix_seconds(ts) / window).cast("long").alias("window_id")))

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
            ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = int(state.get[0]) if state.exists else 0
        window_id = int(group[1])
        rows = pd.concat([b[["ts", "event_id"]] for b in batches]).sort_values(
            ["ts", "event_id"], ignore_index=True)
        for start in range(0, len(rows), EMITTED_ROWS):
            part = rows.iloc[start:start + EMITTED_ROWS]
            current = seen + 1 + part.index.to_numpy()
            yield pd.DataFrame({"key": group[0], "window_id": window_id,
                                "event_id": part["event_id"], "current": current,
                                "allowed": current <= cap})
        seen += len(rows)
        state.update((int(seen),))
        end = (window_id + 1) * window * 1000
        state.setTimeoutTimestamp(max(end, int(state.getCurrentWatermarkMs()) + 1))

    return rows.groupBy("key", "window_id").applyInPandasWithState(
        run, "key string, window_id long, event_id long, current long, allowed boolean",
        "seen long", "append", GroupStateTimeout.EventTimeTimeout)


def conversation_history(messages: DataFrame, size: int = C.MAX_HISTORY,
                         idle_ms: int | None = None) -> DataFrame:
    """Each message of a stream (conv_id, turn, role, text) with the messages before it.

    State per conversation: its last `size` messages; with `idle_ms`, forgotten after that
    much silence (such a stream never runs out of batches, so give it a running trigger).
    Turns of one conversation must arrive in order from batch to batch.
    """
    entry = "array<struct<role:string,content:string>>"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
            ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = [] if not state.exists else list(zip(*state.get))
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"]):
            out.append((key[0], turn, role, text,
                        [{"role": r, "content": t} for r, t in past]))
            past = [*past, (role, text)][-size:]
        state.update(([r for r, _ in past], [t for _, t in past]))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "history"])

    timeout = (GroupStateTimeout.ProcessingTimeTimeout if idle_ms
               else GroupStateTimeout.NoTimeout)
    return (messages.select("conv_id", "turn", "role", "text").groupBy("conv_id")
            .applyInPandasWithState(
                run, f"conv_id long, turn long, role string, text string, history {entry}",
                "roles array<string>, texts array<string>", "append", timeout))


def live_context(messages: DataFrame, max_history: int = C.MAX_HISTORY) -> DataFrame:
    """Context of every user message of a stream."""
    df = conversation_history(messages, max_history)
    past = F.transform("history", lambda h: X.features(h["role"], h["content"]))
    return df.filter("role = 'user'").select(
        "conv_id", "turn", X.context(X.features(F.lit("user"), F.col("text")), past,
                                     max_history).alias("context"))


def match_canaries(responses: DataFrame, registry: DataFrame, keys: list[str], *,
                   ts: str = "ts", text: str = "text", max_ttl_seconds: int = C.CANARY_TTL_SECONDS,
                   lateness: str = "10 minutes", salts: int = TOKEN_SALTS) -> DataFrame:
    """Stream-stream join of leaked markers with tokens injected within their TTL before.

    A row's own `ttl_seconds` counts, up to `max_ttl_seconds`, for which state is kept.  A token
    that leaks everywhere is spread over `salts` tasks.
    """
    seen = canary.mentions(responses.withWatermark(ts, lateness), [*keys, ts], text).withColumn(
        "salt", F.pmod(F.xxhash64(*keys, ts), F.lit(salts)).cast("int"))
    own = F.col("ttl_seconds") if "ttl_seconds" in registry.columns else F.lit(max_ttl_seconds)
    tokens = registry.select(
        F.col("token").alias("r_token"), "request_id", "injected_at", own.alias("ttl")
    ).withWatermark("injected_at", lateness).withColumn(
        "r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    near = F.expr(f"token = r_token AND salt = r_salt AND {ts} >= injected_at AND "
                  f"{ts} <= injected_at + INTERVAL {max_ttl_seconds} SECONDS AND "
                  f"unix_micros({ts}) <= unix_micros(injected_at) + ttl * 1000000L")
    return seen.join(tokens, near).select(*keys, ts, "token", "request_id", "injected_at",
                                          "format")
