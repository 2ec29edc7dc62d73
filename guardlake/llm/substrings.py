"""Removal of word sequences that an earlier document has, by seed and extend.

Seeds: of the word grams in every window, the one of smallest hash is its anchor (winnowing).  Equal
windows have equal anchors at the same place, so documents that share a window meet when they are
joined on anchors; one anchor serves the run of windows around it.  Within a task a run that an
earlier document had as well is settled at once and does not travel as a seed.

Extend: occurrences of an anchor, in order of documents, are extended to both sides as far as the
windows of their run agree with those of an earlier document.  Grams, windows and runs are compared
by hashes: 64 bits of the anchor and 48 of the window.  What is found on neighbouring anchors is put
together to maximal repeats, in one pass over the texts.

An anchor with very many different windows is settled by its windows instead, as a grouped minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.llm.common import bounded_batches, word_blocks
from guardlake.operators.skew import lookup
from guardlake.session import stored

WINDOW_WORDS = 13
HELD_HASHES, HELD_RUNS, HELD_WINDOWS, SEGMENT_WORDS, ROWS = (
    200_000, 300_000, 2_000_000, 1 << 20, 1 << 16)
HELD, WIDTH = -1, 6
_LOW = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
SEED = "anchor long, doc long, print long, start int, runs int, windows binary"
FOUND = "doc long, print long, start int, runs int, anchor long, window long"


class WordHashes(dict):
    """Hashes of words, asked for once each while they are held."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 13)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > HELD_HASHES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def segments(text: str, hashes: WordHashes, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first word, hashes of words): parts that overlap by a window less one word."""
    held, size, start = [], 0, 0
    for words in word_blocks(text.encode("utf-8", "surrogatepass")):
        held.append(hashes.of(words))
        size += len(words)
        if size >= SEGMENT_WORDS:
            part = np.concatenate(held)
            yield start, part
            start += size - (window - 1)
            held, size = [part[size - (window - 1):]], window - 1
    if size >= window:
        yield start, np.concatenate(held)


def anchored(words: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, windows) per run of windows with one anchor, and all window hashes."""
    gram = window // 2 + 1
    grams = words[:len(words) - gram + 1].copy()
    for i in range(1, gram):
        grams = grams * _ODD + words[i:len(words) - gram + 1 + i]
    grams = mixed(grams)
    count = len(words) - window + 1
    # Two grams cover a window.
    windows = mixed(grams[:count] * _ODD + grams[window - gram:window - gram + count])
    best, at = grams[:count].copy(), np.arange(count)
    for i in range(1, window - gram + 1):
        later = grams[i:i + count]
        lower = later <= best
        best[lower] = later[lower]
        at[lower] = np.flatnonzero(lower) + i
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return best[first], first, np.diff(first, append=count), windows


def seeds(docs: DataFrame, window: int) -> DataFrame:
    """Rows of SEED for `docs` (doc, print, text); `windows` is null where a run is settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, earlier = WordHashes(), {}
        rows, size = [], 0
        for batch in batches:
            docs, prints = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, mark, text in zip(docs, prints, batch.column(2)):
                for start, words in segments(text.as_py(), hashes, window):
                    anchor, first, runs, windows = anchored(words, window)
                    whole = mixed(np.add.reduceat(windows, first) * _ODD + anchor) + runs.view(
                        np.uint64)
                    known = np.zeros(len(first), bool)
                    for i, key in enumerate(whole.tolist()):
                        known[i] = earlier.setdefault(key, doc) < doc
                        if earlier[key] > doc:
                            earlier[key] = doc
                    if len(earlier) > HELD_RUNS:
                        earlier = {}
                    # Settled runs meet nothing, so they are dealt by their place.
                    anchor = np.where(known, mixed(anchor + np.uint64(doc * int(_ODD) & _LOW)), anchor)
                    rows.append((anchor, doc, mark, start + first, runs, windows, known))
                    size += len(first)
                    if size > ROWS:
                        yield table(rows)
                        rows, size = [], 0
        if rows:
            yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        anchor, doc, mark, start, runs, windows, known = zip(*rows)
        counts = [len(a) for a in anchor]
        runs, known = np.concatenate(runs), np.concatenate(known)
        travels = np.where(known, 0, runs)
        values = np.concatenate(windows)[np.repeat(~known, runs)].astype("<u8")
        values = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :WIDTH])
        offsets = np.concatenate([[0], np.cumsum(WIDTH * travels)]).astype(np.int32)
        bits = np.packbits(~known, bitorder="little")
        column = pa.Array.from_buffers(pa.binary(), len(runs), [
            pa.py_buffer(bits), pa.py_buffer(offsets), pa.py_buffer(values)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(anchor).view(np.int64)),
             pa.array(np.repeat(np.array(doc, np.int64), counts)),
             pa.array(np.repeat(np.array(mark, np.int64), counts)),
             pa.array(np.concatenate(start).astype(np.int32)),
             pa.array(runs.astype(np.int32)), column],
            ["anchor", "doc", "print", "start", "runs", "windows"])

    return docs.mapInArrow(run, SEED)


def extended(found: DataFrame, most: int = HELD_WINDOWS) -> DataFrame:
    """Rows of FOUND: runs of windows that an earlier document has, and windows still open.

    `found` has rows of SEED, all of an anchor in one partition in order of documents.  What comes
    after the first `most` different windows of an anchor comes back with `anchor` and `window`, and
    those first ones do with their first documents and HELD as place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last anchor, its windows so far and the first document of each
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                out, held = extend(part, held)
                yield from out

    def rows(doc, mark, start, runs, anchor=None, window=None) -> pa.RecordBatch:
        none = pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(mark, pa.int64()),
             pa.array(start.astype(np.int32)), pa.array(runs.astype(np.int32)),
             none if anchor is None else pa.array(anchor), none if window is None
             else pa.array(window.view(np.int64))],
            ["doc", "print", "start", "runs", "anchor", "window"])

    def extend(batch: pa.RecordBatch, held):
        settled = batch.column(5).is_null().to_numpy(zero_copy_only=False)
        out = []
        columns = [batch.column(i).to_numpy() for i in range(5)]
        if settled.any():
            out.append(rows(*(c[settled] for c in columns[1:])))
        anchor, doc, mark, start, runs = (c[~settled] for c in columns)
        data = np.frombuffer(b"".join(batch.column(5).filter(pa.array(~settled)).to_pylist()),
                             np.uint8).reshape(-1, WIDTH)
        windows = np.pad(data, ((0, 0), (0, 8 - WIDTH))).view("<u8").ravel()
        if held and held[1] is None and len(anchor) and anchor[0] == held[0]:
            n = int(np.searchsorted(anchor != held[0], True))
            size = int(runs[:n].sum())
            of = np.repeat(np.arange(n), runs[:n])
            at = np.arange(size) - np.repeat(np.cumsum(runs[:n]) - runs[:n], runs[:n])
            out.append(rows(doc[of], mark[of], start[of] + at, np.ones(size), anchor[of],
                            windows[:size]))
            anchor, doc, mark, start, runs = (c[n:] for c in (anchor, doc, mark, start, runs))
            windows = windows[size:]
        if not len(anchor):
            return out, held
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        ends = np.append(edge[1:], len(anchor))
        group = np.repeat(np.arange(len(edge)), ends - edge)
        goes_on = held is not None and held[0] == anchor[0]
        before, firsts = (held[1], held[2]) if goes_on else (np.empty(0, np.uint64),
                                                             np.empty(0, np.int64))
        many = doc[edge] != doc[ends - 1]
        many[0] |= goes_on
        many[-1] = True  # its windows are held
        of = np.repeat(np.arange(len(anchor)), runs)
        at = np.arange(len(windows)) - np.repeat(np.cumsum(runs) - runs, runs)
        inside = many[group][of]
        of, own, at = of[inside], windows[inside], at[inside]
        by_group = np.concatenate([np.zeros(len(before), np.int64), group[of]])
        by_window = np.concatenate([before, own])
        by_doc = np.concatenate([firsts, doc[of]])
        order = np.lexsort((by_window, by_group))  # keeps the order of documents
        by_group, by_window, by_doc = by_group[order], by_window[order], by_doc[order]
        new = np.concatenate([[True], (by_window[1:] != by_window[:-1])
                              | (by_group[1:] != by_group[:-1])])
        first = by_doc[new][np.cumsum(new) - 1]
        again = np.zeros(len(order), bool)
        again[order] = by_doc > first
        again = again[len(before):]
        last = new & (by_group == len(edge) - 1)
        held = (anchor[-1], by_window[last], by_doc[last])
        if len(held[1]) > most:
            n = len(held[1])
            out.append(rows(held[2], np.zeros(n, np.int64), np.full(n, HELD), np.ones(n),
                            np.full(n, held[0]), held[1]))
            held = (held[0], None, None)
        of, at = of[again], at[again]
        if len(of):
            # Neighbouring windows of a run that an earlier document has are one row.
            cut = np.flatnonzero(np.concatenate(
                [[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)]))
            out.append(rows(doc[of[cut]], mark[of[cut]], start[of[cut]] + at[cut],
                            np.diff(cut, append=len(of))))
        return out, held

    return found.mapInArrow(run, FOUND)


def repeated(docs: DataFrame, window: int) -> DataFrame:
    """(doc, print, spans) of `docs` (doc, print, text): spans of words in windows of earlier ones."""
    met = seeds(docs.where("doc is not null and text is not null"), window)
    found = stored(extended(met.repartition("anchor").sortWithinPartitions("anchor", "doc")),
                   "substrings-found")
    # Windows of anchors with very many: a minimum per window, which is combined before the shuffle.
    many = found.where("anchor is not null")
    firsts = many.groupBy("anchor", "window").agg(F.min("doc").alias("first"))
    late = lookup(many.where(F.col("start") != HELD), firsts, ["anchor", "window"],
                  ["doc", "print", "start"]).where("doc > first")
    columns = ["doc", "print", "start", "runs"]
    hits = found.where("anchor is null").select(columns).unionByName(late.select(columns))
    return hits.groupBy("doc", "print").agg(F.collect_list(F.struct(
        F.col("start").alias("start"),
        (F.col("start") + F.col("runs") + F.lit(window - 1)).alias("end"))).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row of `docs` (doc_id, text); kept is the words left,
    joined by one space.

    A word goes if it lies in a window of `window` words that also starts in a row with a smaller
    doc_id; windows are those of the input.  The first document with a window keeps it, also where it
    repeats it itself, and so do rows that share its doc_id.  A row without doc_id has no smaller one
    and is no smaller one: it stays whole.  A null text has no words.  Other columns are ignored.
    Texts of any length are read whole, in blocks.  An empty table gives no rows.
    """
    return _cut(docs, window, "kept string")


def repeats_removed(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """As `without_repeats`, with the SHA-256 of the words left (kept_sha256) instead of them."""
    return _cut(docs, window, "kept_sha256 string")


def _cut(docs: DataFrame, window: int, last: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    # The print tells rows that share a doc_id apart; rows without one never meet anything.
    marked = docs.select(F.col("doc_id").cast("long").alias("doc"), F.when(
        F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(
        F.xxhash64("text")).alias("print"), F.col("text"))
    spans = repeated(marked, window)
    rows = marked.join(spans, ["doc", "print"], "left").select("doc", "text", "spans.start",
                                                               "spans.end")
    whole = last.startswith("kept ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [kept(text.as_py() or "", start.as_py(), end.as_py(), whole)
                      for text, start, end in zip(*(batch.column(i) for i in (1, 2, 3)))]
            n, removed, left = zip(*counts) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(left, pa.string())],
                ["doc_id", "n_words", "n_removed", last.split()[0]])

    return rows.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last}")


def kept(text: str, starts: list[int] | None, ends: list[int] | None,
         whole: bool = False) -> tuple[int, int, str]:
    """(words, words removed, the words outside the spans or their SHA-256)."""
    starts, ends = np.sort(starts or []).astype(int), np.sort(ends or []).astype(int)
    n = removed = 0
    sha, parts = hashlib.sha256(), []
    for words in word_blocks(text.encode("utf-8", "surrogatepass")):
        size = len(words)
        if len(starts):
            # A word is covered if more spans have started up to it than have ended.
            places = np.arange(n, n + size)
            stays = (np.searchsorted(starts, places, "right")
                     == np.searchsorted(ends, places, "right"))
            words = [words[i] for i in np.flatnonzero(stays).tolist()]
        if words:
            part = b" ".join(words)
            sha.update(b" " + part if removed < n else part)
            if whole:
                parts.append(part)
        n, removed = n + size, removed + size - len(words)
    return n, removed, b" ".join(parts).decode() if whole else sha.hexdigest()


ORACLE = f"""
with d as (select row_number() over () as r, doc_id,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select r, doc_id, unnest(range(1, len(w) - {WINDOW_WORDS - 2})) as i,
        unnest([array_to_string(w[i:i + {WINDOW_WORDS - 1}], ' ')
                for i in range(1, len(w) - {WINDOW_WORDS - 2})]) as gram
      from d where len(w) >= {WINDOW_WORDS}),
f as (select md5(gram) as gram, min(doc_id) as first from g group by md5(gram)),
c as (select distinct r, i + k as i from g join f on md5(g.gram) = f.gram and first < doc_id,
      unnest(range({WINDOW_WORDS})) as u(k)),
x as (select r, list(i) as gone from c group by r)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(array_to_string(case when gone is null then w else [w[i] for i in range(1, len(w) + 1)
    if not list_contains(gone, i)] end, ' ')) as kept_sha256
from d left join x using (r)"""
