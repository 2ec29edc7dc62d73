"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Lengths are whole numbers up to the size of a sequence, so documents and gaps sorted by size are a
few thousand runs, however many rows there are: (size, how many).  Each round takes the longest
documents left.  A sweep over the sorted gaps finds their successors, the smallest gaps that
hold them; all documents of the length are matched at once, by rank against the ranks of the gaps;
the gaps are updated; and the next round follows.  Where no gap is left, new sequences open.

Spark does the rest: tokenising, counting lengths, ranking the documents of a length (by hash
buckets, so that no length meets in one task), and giving every document its place by joining its
length and rank with the matched ranges of ranks.  The driver holds runs of sizes, never documents.
"""

from __future__ import annotations

import bisect
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.llm.common import bounded_batches
from guardlake.operators.skew import ranked
from guardlake.session import stored

SEQUENCE_TOKENS, END_ID, BUCKET_ROWS, BLOCK_CHARS = 4096, 1, 4096, 1 << 18
KEPT_WORDS, WORKER = 250_000, "guardlake_packing_worker"


class Kept:
    """The values of the keys that were asked for last: two generations, of which the older goes."""

    def __init__(self, ask: Callable[[list[str]], Iterable[bytes]], most: int = KEPT_WORDS):
        self.ask, self.most, self.young, self.old = ask, most, {}, {}

    def __call__(self, keys: list[str]) -> list[bytes]:
        found = list(map(self.young.get, keys))
        missing = {key for key, value in zip(keys, found) if value is None}
        if missing:
            if len(self.young) > self.most:
                self.young, self.old = {}, self.young
                missing = set(keys)
            new = list(missing)
            if self.old:
                before = list(map(self.old.get, new))
                self.young.update(x for x in zip(new, before) if x[1] is not None)
                new = [key for key, value in zip(new, before) if value is None]
            if new:
                self.young.update(zip(new, self.ask(new)))
            found = list(map(self.young.__getitem__, keys))
        return found


class WordTokens:
    """The ids of a text by a word-level tokenizer, as little-endian bytes.

    Texts of plain characters are cut at white space and these pieces into words here, and the ids of
    each piece and word are asked for once; any other text goes to the tokenizer whole.  Plain are
    characters below U+0250, where composing changes nothing, without those whose lower case is
    more than one character and those that only Python takes for white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        low = [chr(i) for i in range(0x250)]
        kinds = {c: unicodedata.category(c)[0] for c in low}
        spaces = "\t\n\x0b\x0c\r \x85\xa0"
        odd = {c for c in low if len(c.lower()) != 1 or ord(c.lower()) >= 0x250
               or unicodedata.normalize("NFC", c) != c or (c.isspace() and c not in spaces)}

        def of(chars) -> str:
            return "".join(re.escape(c) for c in chars)

        letters = of(c for c in low if kinds[c] == "L")
        numbers = of(c for c in low if kinds[c] == "N")
        # How the tokenizer cuts words.
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]"
                               f"|[^{of(spaces)}{letters}{numbers}]+")
        self.other = re.compile(f"[^{of(c for c in low if c not in odd)}]")
        self.odd = sorted(c for c in odd if c.isascii())
        self.space = re.compile(f"[{of(spaces)}]")
        self.words, self.pieces = Kept(self._of_words), Kept(self._of_pieces)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    @classmethod
    def of_worker(cls, path: str) -> WordTokens:
        """The one of this process, which outlives a task; code is sent anew with every task."""
        kept = sys.modules.setdefault(WORKER, types.ModuleType(WORKER)).__dict__
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def plain(self, text: str) -> bool:
        if "<|" in text:
            return False
        if text.isascii():
            return not any(c in text for c in self.odd)
        return not self.other.search(text)

    def __call__(self, text: str) -> bytes:
        if not self.plain(text):
            return self.ids(text)
        return b"".join(self.pieces(text.lower().split()))

    def _of_pieces(self, pieces: list[str]) -> Iterator[bytes]:
        cut = [self.word.findall(piece) for piece in pieces]
        # A piece of one word is held as a piece, so only words of longer ones are held as words.
        single = [words[0] for words in cut if len(words) == 1]
        alone = iter(self._of_words(single) if single else ())
        ids = iter(self.words([w for words in cut if len(words) > 1 for w in words]))
        return (next(alone) if len(words) == 1 else b"".join(islice(ids, len(words)))
                for words in cut)

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ask for the ids of words in one text; each word's last id says that a word ends."""
        found = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids,
                         "<u4")
        ends = np.flatnonzero(self.ends[found]) + 1
        if len(ends) != len(words):
            return [self.ids(word) for word in words]
        data, ends = found.tobytes(), [0, *(4 * ends).tolist()]
        return [data[start:end] for start, end in zip(ends, ends[1:])]

    def ids(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in found)

    def blocks(self, text: str, size: int = BLOCK_CHARS) -> Iterator[bytes]:
        """The ids of a text in blocks that end at white space, where no word goes on."""
        start = 0
        while start < len(text):
            space = self.space.search(text, start + size)
            end = space.start() if space else len(text)
            yield self(text[start:end])
            start = end


def cut(blocks: Iterator[bytes], limit: int, end_id: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the pieces of a document's ids, with `end_id` at the end."""
    held, piece, start = b"", 0, 0
    for block in chain(blocks, [end_id.to_bytes(4, "little")]):
        held += block
        at = 0
        while len(held) - at > 4 * limit:
            yield piece, start, limit, zlib.crc32(held[at:at + 4 * limit])
            piece, start, at = piece + 1, start + limit, at + 4 * limit
        held = held[at:]
    yield piece, start, len(held) // 4, zlib.crc32(held)


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE_TOKENS,
           end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): every document, cut if longer than `limit`.

    `row` tells rows that repeat a doc_id apart.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of_worker(tokenizer_path)
        for batch in batches:
            at, found = [], []
            for number, text in enumerate(batch.column(2)):
                for piece in cut(tokens.blocks(text.as_py() or ""), limit, end_id):
                    at.append(number)
                    found.append(piece)
            of = [pa.array(x, pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * 4
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take),
                 of[0].cast(pa.int32()), *of[1:]],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, "
                                "ids_crc32 long")


class Gaps:
    """Open sequences as runs of equal gaps: numbers first, first + 1, ... with one gap."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.runs:
                bisect.insort(self.sizes, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, count))

    def successor(self, size: int) -> int | None:
        at = bisect.bisect_left(self.sizes, size)
        return self.sizes[at] if at < len(self.sizes) else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        """Up to `most` sequences with this gap: (first, count)."""
        runs = self.runs[gap]
        first, count = runs.pop()
        if count > most:
            runs.append((first + most, count - most))
            count = most
        if not runs:
            del self.runs[gap]
            self.sizes.remove(gap)
        return first, count


def matched(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, each, first, offset): the places of all documents.

    The documents of a length with ranks in [rank_from, rank_to) lie `each` to a sequence, from
    sequence `first` on, one behind the other from `offset`.  There are at most as many rows as
    pairs of sizes, whatever the number of documents.
    """
    gaps, out, opened = Gaps(), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            gap = gaps.successor(length)
            if gap is None:
                gap, each = limit, limit // length
                first, count = opened, -(-left // each)
                opened += count
            else:
                each = gap // length
                first, count = gaps.take(gap, -(-left // each))
            placed = min(left, count * each)
            out.append((length, rank, rank + placed, each, first, limit - gap))
            full, rest = divmod(placed, each)
            gaps.add(gap - each * length, first, full)
            gaps.add(gap - rest * length, first + full, count - full)
            rank, left = rank + placed, left - placed
    return out


def packed(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE_TOKENS,
           end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of a document.

    A null or empty text is the end id alone.  Rows that repeat a doc_id are packed each.  Only
    documents longer than `limit` are cut.  An empty table gives none.
    """
    spark = docs.sparkSession
    cut_up = stored(pieces(docs, tokenizer_path, limit, end_id), "packing-pieces")
    counts = {r[0]: r[1] for r in cut_up.groupBy("length").count().collect()}
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(buckets))
    placed = ranked(cut_up, ["length"], bucket, ["doc_id", "row", "piece"], "rank")
    schema = ("length long, rank_from long, rank_to long, each long, first long, "
              "base long")
    plan = spark.createDataFrame(matched(counts, limit), schema)
    found = F.expr("p.length = m.length and p.rank > m.rank_from and p.rank <= m.rank_to")
    nth = F.col("rank") - 1 - F.col("rank_from")
    return placed.alias("p").join(F.broadcast(plan).alias("m"), found).select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("base") + nth % F.col("each") * F.col("p.length")).alias("offset"))
