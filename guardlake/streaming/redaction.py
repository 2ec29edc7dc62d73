"""Stateful redaction of response streams, and its batch twin."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby
from json.decoder import scanstring
from json.encoder import encode_basestring_ascii as encode_string

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from guardlake import catalog as C
from guardlake.functions import redact as R
from guardlake.session import stored
from guardlake.streaming.redactor import BODY, TAIL, Block, Pieces, for_streams

BLOCK_PIECES = 4096

OUT = ("stream_id string, seq long, safe string, categories array<string>, done boolean, "
       "gap boolean")
STATE = "buffer string, next_seq long, waiting string"
# Some lines of a stream in a row: rows of Python are dear.
SSE_OUT = "stream_id string, seqs array<long>, lines array<string>"
SSE_STATE = "streams string"
SSE_GROUPS = 2048
# Lines, and characters of them, that are looked at together.
SSE_LINES, SSE_CHARS = 1 << 16, 1 << 24
# Rows are gathered by their number, so one with long lines has few of them.
ROW_LINES, ROW_CHARS = 64, 1 << 14
_CONTENT = re.compile(r'"content"\s*:\s*"')


def redact_stream(chunks: DataFrame, rules: R.Rules = R.DEFAULT,
                  window: int = C.STREAM_WINDOW_CHARS, idle_ms: int | None = None,
                  match_words: int | None = None) -> DataFrame:
    """Redacted text of a stream of (stream_id, seq, delta, done), a row per stream and batch.

    The pieces whose turn it is are joined and looked at as one text; `seq` is the last of them.
    State per stream: the text held back, the next sequence number and early arrivals.  The
    row with `done` flushes and forgets the stream; with `idle_ms` so does silence, which also
    lets out the pieces that waited for a missing one (`gap`).  Rules of one's own need `match_words`,
    the most words that a match of theirs spans.
    """
    redactor = for_streams(rules.rules, match_words)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
            ) -> Iterator[pd.DataFrame]:
        pieces = Pieces(redactor, window, state.get if state.exists else None)
        out, ended = [], False

        def release(ready: list, last: bool, gap: bool) -> None:
            safe, cats = pieces.push("".join(text for _, (text, _) in ready))
            if last:
                rest, more = pieces.flush()
                safe, cats = safe + rest, cats + more
            if safe or last:
                at = ready[-1][0] if ready else pieces.next_seq
                out.append((key[0], at, safe, cats, last, gap))

        if state.hasTimedOut:
            missed = pieces.drain()
            release(missed, True, bool(missed))
            ended = True
        for batch in batches:
            ready = []
            for seq, delta, done in zip(batch["seq"], batch["delta"], batch["done"]):
                ready += pieces.add(int(seq), (delta or "", bool(done)))
            if ready:
                last = any(done for _, (_, done) in ready)
                release(ready, last, False)
                ended = ended or last
        if ended:
            state.remove()
        else:
            state.update(pieces.state())
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "safe", "categories", "done",
                                         "gap"])

    timeout = (GroupStateTimeout.ProcessingTimeTimeout if idle_ms
               else GroupStateTimeout.NoTimeout)
    return (chunks.select("stream_id", "seq", "delta", "done").groupBy("stream_id")
            .applyInPandasWithState(run, OUT, STATE, "append", timeout))


class Deltas:
    """Reads the delta contents of SSE lines and puts others in their place.

    A body to `write` is parsed JSON, or the texts before and after its content.  Of lines that
    are alike but for the content one is parsed: then `known` is what stands around the content,
    and the body.
    """

    MARK = "\ue000content\ue000"

    def __init__(self):
        self.known = None

    def read(self, line: str) -> tuple | None:
        """(content, body to `write`), None for a line without content."""
        if not line.startswith("data: "):
            return None
        try:
            body = json.loads(line[6:])
            text = body["choices"][0]["delta"].get("content")
        except (ValueError, LookupError, TypeError, AttributeError):
            return None
        if not text:
            return None
        body["choices"][0]["delta"]["content"] = self.MARK
        around = tuple(json.dumps(body).split(encode_string(self.MARK)))
        if len(around) != 2:
            body["choices"][0]["delta"]["content"] = text
            return text, body
        self.known = self._around(line, text, body, around)
        return text, around

    def _around(self, line: str, text: str, body, around: tuple) -> tuple | None:
        """What stands in the line before and after the content, None if that can't be told."""
        for quote in _CONTENT.finditer(line):
            head = line[:quote.end()]
            try:
                said, end = scanstring(line, len(head))
                same = said == text and body == json.loads(
                    head[6:] + encode_string(self.MARK)[1:] + line[end:])
            except ValueError:
                continue
            if same:
                return head, line[end:], around
        return None

    @staticmethod
    def write(body: tuple | dict, text: str) -> str:
        if type(body) is tuple:
            return f"data: {body[0]}{encode_string(text)}{body[1]}\n\n"
        body["choices"][0]["delta"]["content"] = text
        return f"data: {json.dumps(body)}\n\n"


def _sent(pieces: Pieces, deltas: Deltas, ready: list) -> tuple[list, list, bool]:
    """(seqs and lines that go out for those whose turn it is, whether [DONE] was among them)."""
    out, found, texts, ended = [], [], [], False

    def send() -> None:
        safe = iter(pieces.push_each(texts))
        out.extend([body if type(body) is str else Deltas.write(body, next(safe))
                    for body in found])
        found.clear()
        texts.clear()

    for _, line in ready:
        # As `Deltas.read` for a line like the one before, without a call.
        if deltas.known and line.startswith(deltas.known[0]):
            try:
                text, end = scanstring(line, len(deltas.known[0]))
            except ValueError:
                found.append(line)
                continue
            if text and line[end:] == deltas.known[1]:
                texts.append(text)
                found.append(deltas.known[2])
                continue
        if delta := deltas.read(line):
            texts.append(delta[0])
            found.append(delta[1])
        elif line.startswith("data: ") and line[6:].strip() == "[DONE]":
            send()
            out.append(_held(pieces) + line)
            ended = True
        else:
            found.append(line)
    send()
    return [at for at, _ in ready], out, ended


def _held(pieces: Pieces) -> str:
    """A data line with what is held back, if there is any."""
    rest = pieces.rest()
    tail = {"choices": [{"index": 0, "delta": {"content": rest}}]}
    return f"data: {json.dumps(tail)}\n\n" if rest else ""


def redact_sse(lines: DataFrame, rules: R.Rules = R.DEFAULT,
               window: int = C.STREAM_WINDOW_CHARS, idle_ms: int | None = None,
               match_words: int | None = None, groups: int = SSE_GROUPS) -> DataFrame:
    """SSE lines (stream_id, seq, line) with their delta contents redacted.

    Lines that carry no content pass through unchanged.  What is held back is sent as one
    more data line before the [DONE] line; with `idle_ms` also where a stream falls silent without
    one, after the lines that waited for a missing one.

    A call of Python and a row of state serve a group of streams, not a stream each: a batch costs
    per line then, not per stream.  The row has the open streams of the group, about as many as
    there are in all, divided by `groups`; a batch reads and writes those of the groups that it has
    lines of.  A checkpoint goes on only with the `groups` that it began with.
    """
    redactor = for_streams(rules.rules, match_words)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
            ) -> Iterator[pd.DataFrame]:
        # stream -> buffer, next seq, waiting lines, time of its last lines
        kept = {name: rest for name, *rest in json.loads(state.get[0])} if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if idle_ms else 0
        opened, ended, deltas = {}, set(), Deltas()

        def pieces_of(name: str | None) -> Pieces:
            if name not in opened:
                opened[name] = Pieces(redactor, window, kept[name][:3] if name in kept else None)
            return opened[name]

        def frame(sent: dict) -> pd.DataFrame:
            out = []
            for name, (seqs, lines) in sent.items():
                step = max(1, min(ROW_LINES, ROW_CHARS // max(map(len, lines), default=1)))
                out += [(name, seqs[i:i + step], lines[i:i + step])
                        for i in range(0, len(lines), step)]
            return pd.DataFrame(out, columns=["stream_id", "seqs", "lines"])

        def taken(rows: dict) -> pd.DataFrame:
            sent = {}
            for name, some in rows.items():
                pieces = pieces_of(name)
                some.sort()
                *sent[name], last = _sent(pieces, deltas, pieces.add_each(some))
                if last:
                    ended.add(name)
            return frame(sent)

        rows, size, n = {}, 0, 0
        for batch in batches:
            seqs, lines = batch["seq"].astype("int64").tolist(), batch["line"].tolist()
            for name, row in zip(batch["stream_id"].tolist(), zip(seqs, lines)):
                if name in rows:
                    rows[name].append(row)
                else:
                    rows[name] = [row]
            size += sum(map(len, lines))
            n += len(lines)
            if n >= SSE_LINES or size >= SSE_CHARS:
                yield taken(rows)
                rows, size, n = {}, 0, 0
        if rows:
            yield taken(rows)
        for name, pieces in opened.items():
            kept[name] = [*pieces.state(), now]
        for name in ended:
            del kept[name]
        silent = [name for name, (*_, seen) in kept.items() if idle_ms and seen + idle_ms <= now]
        sent = {}
        for name in silent:
            pieces = pieces_of(name)
            *sent[name], _ = _sent(pieces, deltas, pieces.drain())
            if rest := _held(pieces):
                sent[name][0].append(pieces.next_seq)
                sent[name][1].append(rest)
            del kept[name]
        if sent:
            yield frame(sent)
        if kept:
            state.update((json.dumps([[name, *rest] for name, rest in kept.items()]),))
            if idle_ms:
                first = min(seen for *_, seen in kept.values())
                state.setTimeoutDuration(max(1, first + idle_ms - now))
        elif state.exists:
            state.remove()

    timeout = (GroupStateTimeout.ProcessingTimeTimeout if idle_ms
               else GroupStateTimeout.NoTimeout)
    stream = F.col("stream_id").cast("string").alias("stream_id")
    group = F.pmod(F.xxhash64("stream_id"), F.lit(groups)).alias("group")
    return (lines.select(stream, "seq", "line").select(group, "stream_id", "seq", "line")
            .groupBy("group").applyInPandasWithState(run, SSE_OUT, SSE_STATE, "append", timeout)
            .select("stream_id", F.inline(F.arrays_zip(
                F.col("seqs").alias("seq"), F.col("lines").alias("line")))))


def stream_summary(pieces: DataFrame) -> DataFrame:
    """Detections, redacted pieces and categories per stream."""
    return pieces.groupBy("stream_id").agg(
        F.sum(F.size("categories")).alias("total_detections"),
        F.count_if(F.size("categories") > 0).alias("total_redactions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories"))))
        .alias("categories_detected"))


def _part(block: int, kind: int, number: int) -> int:
    return (block << 24) + (kind << 22) + number


def redact_finished(chunks: DataFrame, rules: R.Rules = R.DEFAULT,
                    window: int = C.STREAM_WINDOW_CHARS, match_words: int | None = None,
                    block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """(stream_id, part, redacted) of finished streams.

    The parts of a stream, joined in order, are its redacted text.  Pieces without stream_id are
    one stream, pieces without seq come first.

    A stream is cut by `seq` into blocks of `block_pieces`, which tasks work on side by side.  A
    block finds a first place of its own that no match reaches across, redacts from there on and
    leaves the text before it, and what it holds back at its end, raw (stored, with the rest).
    Each held end is then redacted with the beginnings that follow it, up to the next such place.
    Where matches stand so close that blocks have none, these blocks are one text, which passes
    through one task in order.  Tasks hold one buffer, not a block.  Only one narrow row per block
    meets the others of its stream in one task, to find the place before it.
    """
    redactor = for_streams(rules.rules, match_words)
    stream, block = F.col("stream_id").cast("string"), F.floor(F.col("seq") / block_pieces)
    rows = chunks.select(
        F.coalesce(F.concat(F.lit("="), stream), F.lit("")).alias("key"),
        F.greatest(F.coalesce(block, F.lit(0)), F.lit(0)).cast("long").alias("block"),
        "seq", "delta")
    shape = "key string, block long, kind int, number long, said string"

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, work, number = None, None, 0

        def numbered(found: list) -> list:
            nonlocal number
            out = [(*current, kind, number + i, said) for i, (kind, said) in enumerate(found)]
            number += len(out)
            return out

        for batch in batches:
            out = []
            for at, group in groupby(zip(batch["key"], batch["block"], batch["delta"]),
                                     lambda row: row[:2]):
                if at != current:
                    out += numbered(work.end()) if work else []
                    # The block 0 of a stream begins where the stream begins.
                    current, work, number = at, Block(redactor, window, at[1] == 0), 0
                out += numbered(work.push("".join(delta or "" for *_, delta in group)))
            yield pd.DataFrame(out, columns=["key", "block", "kind", "number", "said"])
        if work:
            yield pd.DataFrame(numbered(work.end()),
                               columns=["key", "block", "kind", "number", "said"])

    done = stored(rows.repartition("key", "block").sortWithinPartitions("key", "block", "seq")
                  .mapInPandas(blocks, shape), "stream-blocks")
    ends = done.filter(F.col("kind") != BODY)
    before = Window.partitionBy("key").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    cuts = (ends.groupBy("key", "block").agg(F.max("kind").alias("most"))
            .select("key", "block", F.last(F.when(F.col("most") == TAIL, F.col("block")),
                                           ignorenulls=True).over(before).alias("last")))
    seams = ends.join(cuts, ["key", "block"]).withColumn("chain", F.when(
        F.col("kind") == TAIL, F.col("block")).otherwise(F.coalesce("last", F.lit(-1))))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, pieces, part = None, None, 0
        for batch in batches:
            out = []
            for key, chain, at, kind, number, said in zip(*(batch[c] for c in (
                    "key", "chain", "block", "kind", "number", "said"))):
                if (key, chain) != current:
                    if pieces is not None:
                        out.append((current[0], part + 1, pieces.flush()[0]))
                    current, pieces = (key, chain), Pieces(redactor, window)
                part = _part(at, kind, number)
                out.append((key, part, pieces.push(said)[0]))
            yield pd.DataFrame(out, columns=["key", "part", "redacted"])
        if pieces is not None:
            yield pd.DataFrame([(current[0], part + 1, pieces.flush()[0])],
                               columns=["key", "part", "redacted"])

    order = ["key", "chain", "block", "number"]
    rest = (seams.select(*order, "kind", "said").repartition("key", "chain")
            .sortWithinPartitions(*order)
            .mapInPandas(joined, "key string, part long, redacted string"))
    part = F.shiftleft("block", 24) + F.lit(BODY << 22) + F.col("number")
    bodies = done.filter(F.col("kind") == BODY).select("key", part.alias("part"),
                                                       F.col("said").alias("redacted"))
    return bodies.unionByName(rest).select(
        F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("stream_id"), "part",
        "redacted")
