import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram
from tokenizers.pre_tokenizers import Metaspace

from guardlake.llm import token_counts
from tests.llm.helpers import FOLDER, docs_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = token_counts.vocabulary(PATH)


def tokenizer(pieces=PIECES):
    out = Tokenizer(Unigram(pieces, 0, True))
    out.pre_tokenizer = Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return out


REFERENCE = tokenizer()
COUNTER = token_counts.PieceCounter(PIECES)


def count(counter, text):
    return sum(counter.count(w) for n, b in enumerate(token_counts.text_blocks(text, 7))
               for w in token_counts.words_of(b, n == 0))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("ab e▁\n\t<s>0x41é漢😀'the ")))
def test_counts_equal_the_tokenizer(text):
    assert count(COUNTER, text) == len(REFERENCE.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=30))
def test_ties(text):
    pieces = [("<unk>", 0.0), *((f"<0x{i:02X}>", -50.0) for i in range(256)), ("▁", -1.0),
              ("a", -1.0), ("b", -1.0), ("aa", -2.0), ("ab", -2.0), ("ba", -2.0), ("aab", -3.0),
              ("bb", -1.5), ("▁a", -2.0), ("abab", -4.0)]
    assert count(token_counts.PieceCounter(pieces), text) == len(
        tokenizer(pieces).encode(text, add_special_tokens=False).ids)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.document_tokens(docs, PATH).collect():
        assert r.n_tokens == len(REFERENCE.encode(texts[r.doc_id], add_special_tokens=False).ids)


@pytest.mark.parametrize("size", [token_counts.BLOCK_CHARS])
def test_odd_rows(spark, size):
    docs = docs_of(spark, [(1, None, "a"), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"),
                           (None, "word " * 300_000, None)])
    got = sorted((str(r.doc_id), r.n_chars, r.n_tokens)
                 for r in token_counts.document_tokens(docs.selectExpr("*", "1 as n_tokens"),
                                                       PATH).collect())
    words = len(REFERENCE.encode("word " * 1000, add_special_tokens=False).ids) - 1
    assert got[:2] == [("1", 0, 0), ("2", 0, 0)] and got[2] == got[3]
    assert got[4] == ("None", 1_500_000, 300 * words + 1)
    assert not token_counts.document_tokens(docs.where("false"), PATH).collect()
