"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton gives all vocabulary pieces that end at each character.  Dynamic
programming keeps, per character, the best score and the number of tokens on the best path, and no
path.  Ties go to the piece that starts first, as in the tokenizer, which replaces a path only by a
better one and comes to the pieces in order of their start.  An unknown character costs ten
less than the lowest score and counts its bytes.

Text is cut before every space mark, as the tokenizer does; each task keeps the counts of the words
it has seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.common import bounded_batches

SPACE_MARK, UNKNOWN_PENALTY, BLOCK_CHARS = "▁", 10.0, 1 << 20
KEPT_WORDS, KEPT_CHARS = 500_000, 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter:
    """Counts tokens of words by the pieces of a vocabulary with byte fallback."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.longest = max(len(p) for p, _ in pieces)
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        """Tokens of a word; only as many places as the longest piece spans are held."""
        span = self.longest + 1
        score, tokens = [0.0] * span, [0] * span
        matches = self.automaton.iter(word)  # by their end, the longest first
        match = next(matches, None)
        for end, char in enumerate(word):
            best, steps = None, 0
            while match is not None and match[0] == end:
                length, own = match[1]
                start = (end + 1 - length) % span
                total = own + score[start]
                if best is None or total > best:
                    best, steps = total, tokens[start] + 1
                match = next(matches, None)
            if char not in self.single:
                total = self.unknown + score[end % span]
                if best is None or total > best:
                    best = total
                    steps = tokens[end % span] + len(char.encode("utf-8", "surrogatepass"))
            score[(end + 1) % span], tokens[(end + 1) % span] = best, steps
        return tokens[len(word) % span]


def text_blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """A text in pieces of about `size` characters, cut before spaces."""
    start = 0
    while start < len(text):
        end = text.find(" ", start + size) if start + size < len(text) else -1
        yield text[start:end if end >= 0 else len(text)]
        start = end if end >= 0 else len(text)


def words_of(block: str, first: bool) -> list[str]:
    """The words of a block, each with the space mark that the tokenizer puts before it."""
    marked = block.replace(" ", SPACE_MARK)
    if first and not marked.startswith(SPACE_MARK):
        marked = SPACE_MARK + marked
    return re.findall(f"{SPACE_MARK}[^{SPACE_MARK}]*", marked)


def with_token_count(df: DataFrame, text: str, model_path: str, out: str = "n_tokens",
                     keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of `df` and the number of tokens of its texts as a long column.

    Null and empty texts have 0 tokens.  Rows that repeat are counted each.  A word without a space
    is held whole; all else of a text is handled in blocks.
    """
    bounded_batches(df.sparkSession)
    pieces = vocabulary(model_path)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = PieceCounter(pieces), {}

        def total(text: str | None) -> int:
            sum_ = 0
            for number, block in enumerate(text_blocks(text or "")):
                for word, times in Counter(words_of(block, number == 0)).items():
                    n = known.get(word)
                    if n is None:
                        if len(known) >= KEPT_WORDS:
                            known.clear()
                        n = counter.count(word)
                        if len(word) <= KEPT_CHARS:
                            known[word] = n
                    sum_ += n * times
            return sum_

        for batch in batches:
            counts = pa.array([total(x.as_py()) for x in batch.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), counts],
                                             [*keep, out])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def document_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens) per document."""
    sized = docs.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long")
                        .alias("n_chars"))
    return with_token_count(sized, "text", model_path, keep=("doc_id", "n_chars"))
