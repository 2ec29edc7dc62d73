import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from guardlake.llm import packing
from tests.llm.helpers import FOLDER, docs_of

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = packing.WordTokens(PATH)


def ids_of(text):
    return [*WORDS.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text([chr(i) for i in range(0x250)]),
                 st.text("aB 's're\n\x1c\x85\xa0İßŒ<|endoftext|>9½ª²ºǅ€’"), st.text("the we'll 42! ")))
def test_ids_equal_the_tokenizer(text):
    got = b"".join(WORDS.blocks(text, 5))
    want = ids_of(text)[:-1]
    assert got == b"".join(i.to_bytes(4, "little") for i in want)


@pytest.mark.parametrize("text, plain", [
    ("", True), ("aB 's\t42!", True), ("é ñ's ß", True), ("a < | b", True), ("a<|b", False), ("é<|", False),
    ("a\x1cb", False), ("a\x1fb", False), ("a b\x1d", False), ("İ", False), ("a € b", False), ("e\u0301", False)])
def test_plain_texts(text, plain, monkeypatch):
    assert WORDS.plain(text) is plain
    if text.isascii():  # these are not looked through one character after the other
        monkeypatch.setattr(WORDS, "other", None)
        assert WORDS.plain(text) is plain
    assert b"".join(WORDS.blocks(text)) == b"".join(i.to_bytes(4, "little") for i in ids_of(text)[:-1])


def test_kept_values_are_asked_once():
    asked = []
    kept = packing.Kept(lambda keys: (asked.extend(keys), [k.encode() for k in keys])[1], 3)
    for keys in (["a", "b", "a"], ["b", "c", "d", "d"], ["d", "e", "a"], ["f", "e"], ["f"]):
        assert kept(keys) == [k.encode() for k in keys]
    assert sorted(asked) == ["a", "b", "c", "d", "e", "f"]


def check(docs, rows, limit=4096):
    got = packing.packed(docs, PATH, limit).collect()
    want = Counter()
    for r in rows:
        ids = ids_of(r.text)
        for n, at in enumerate(range(0, len(ids), limit)):
            part = ids[at:at + limit]
            want[(str(r.doc_id), n, at, len(part), zlib.crc32(
                b"".join(i.to_bytes(4, "little") for i in part)))] += 1
    assert Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    total = sum(r.length for r in got)
    return len(held), -(-total // limit)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    used, least = check(docs, docs.collect())
    assert used <= least * 1.01 + 1


def test_odd_rows(spark):
    docs = docs_of(spark, [(1, None, "a"), (2, "", "a"), (None, "some words", "a"), (3, "x y", None),
                           (3, "x y", None), (4, "long text " * 40, "b"), (5, "<|endoftext|>", "b")])
    assert check(docs.selectExpr("*", "1 as rank", "2 as length"), docs.collect(), 16)[0] < 10
    assert not packing.packed(docs.where("false"), PATH).collect()


def best_fit(lengths, limit):
    """Gaps after plain best-fit decreasing, one document at a time."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(limit - length)
        else:
            gaps.remove(fit)
            gaps.append(fit - length)
    return gaps


@pytest.mark.parametrize("seed", range(6))
def test_rounds_against_one_document_at_a_time(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, rng.choice((5, 33, 65))) for _ in range(400)]
    plan = packing.matched(Counter(lengths), 64)
    fill, ranks = Counter(), Counter()
    for length, low, high, each, first, offset in plan:
        assert ranks[length] == low
        ranks[length] = high
        for n in range(high - low):
            sequence = first + n // each
            assert fill[sequence] == offset + n % each * length
            fill[sequence] += length
    assert ranks == Counter(lengths) and max(fill.values()) <= 64
    assert Counter(64 - f for f in fill.values()) == Counter(best_fit(lengths, 64))
