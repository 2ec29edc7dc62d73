"""Spelling variants, found with asymmetric q-chunks.

Two words one edit apart: the longer (or either, if equally long) contributes two disjoint chunks,
its halves; the edit preserves one of them.  It lies in the other half then, which is again cut into
two disjoint chunks, of which it preserves one.  The other word contributes its positional grams: a
preserved chunk before the edit stands where it stood, one behind it there or one place earlier
(shift one), so only grams at these places can meet a chunk and only they are made.  Words are joined
on their chunks kept, three quarters of a word, and a pair is verified by its edit distance, in the
join itself.  What a join key fixes leaves few letters open, so no key is shared by many words.

Words are counted where they are read; only counts of words are shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm.common import bounded_batches
from guardlake.operators.skew import lookup
from guardlake.session import stored

LEAST_LENGTH, LEAST_COUNT, FORM_TIMES, DAMAGE, QUARTERS = 7, 2, 10, 31, 4
HELD_WORDS = 150_000


def _lowered_letters() -> bytes:
    """Latin-1 bytes: letters (A-Z lower-cased, U+00C0 to U+00FF) as they are, all else a space."""
    keep = {c: c for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))}
    keep |= {c: c + 0x20 for c in range(0x41, 0x5B)}
    return bytes(keep.get(c, 0x20) for c in range(256))


_LETTERS = _lowered_letters()


def document_words(doc_id: int | None, text: str, least: int = LEAST_LENGTH,
                   damage: int = DAMAGE) -> Iterator[tuple[bytes, int]]:
    """(word in Latin-1, places) of a text: runs of letters, some of them with a letter deleted."""
    prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    # Characters above U+00FF become "?", which is no letter, so a byte is a code point here.
    runs = text.encode("latin-1", "replace").translate(_LETTERS).split()
    for word, n in Counter(runs).items():
        if len(word) >= least:
            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
            if damage and h % damage == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            if len(word) >= least:
                yield word, n


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
            damage: int = DAMAGE) -> DataFrame:
    """(word, n) of all words of `docs` (doc_id, text) with at least `least_count` places."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in document_words(number, text.as_py(), least_length, damage):
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield table(held)
                    held = {}
        yield table(held)

    def table(held: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())],
                                          ["word", "n"])

    return (docs.where("text is not null").select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def _kept_chunks(word: str, extra: int) -> list[Column]:
    """Join keys of a word as one of its own length (extra 0) or of a word one longer (extra 1).

    For each quarter of the longer word: the chunks that an edit in this quarter preserves.
    """
    length = F.char_length(word) + extra
    keys = []
    for i in range(QUARTERS):
        start = F.floor(length * i / QUARTERS).cast("int")
        behind = length - F.floor(length * (i + 1) / QUARTERS).cast("int")
        keys.append(F.xxhash64(length, F.lit(i), F.left(F.col(word), start),
                               F.right(F.col(word), behind)))
    return keys


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): pairs of `words` (word, n) exactly one edit apart, each pair once."""
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"),
                          F.explode(F.array(_kept_chunks("word", 0))).alias("key"))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(F.array(
        _kept_chunks("word", 0) + _kept_chunks("word", 1))).alias("key"))
    once = (F.char_length("a") > F.char_length("b")) | (F.col("a") < F.col("b"))
    near = F.levenshtein("a", "b", 1) == 1
    # A letter deleted from a run of equal ones may lie in either of two quarters.
    return (chunks.alias("c").join(grams.alias("g"), (F.col("c.key") == F.col("g.key"))
                                   & once & near)
            .select("a", "n_a", "b", "n_b").distinct())


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root) of `links` (word, form): forms followed to the last, by pointer doubling.

    A form has several times the places of its word, so a chain has as many links as the largest
    count has digits, and the rounds are the logarithm of that.
    """
    up = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stored(lookup(up.select("word", "root"), step, ["root"], ["word"], "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not up.where("moved").limit(1).count():
            return up.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             times: int = FORM_TIMES, damage: int = DAMAGE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word, and the common word it is one edit from.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, that have at
    least `least_length` letters and `least_count` places in all texts; a run whose CRC-32 with its
    document is divisible by `damage` loses one letter first (0: none does).  Its form is the near
    word with most places (ties: the first by code points) if these are at least `times` its own;
    its root is the last of its form's forms, or itself.

    A null or empty text has no words.  A null doc_id counts as an empty one.  Rows that repeat count
    each.  Texts of any length are read whole.  Other columns are ignored.  No words: no rows.
    """
    words = stored(counted(docs, least_length, least_count, damage), "spelling-words")
    pairs = stored(near_pairs(words), "spelling-pairs")
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n"))))
        .alias("s")).select("s.*")
    best = sides.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    # Rows are words, one each, on both sides.
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= F.lit(times) * F.col("n"), F.col("best")).alias("best"))
    found = stored(found.select("word", "n", "n_near", F.col("best.form").alias("form"),
                                (-F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = last_forms(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
