import random

import numpy as np
import pytest
import xxhash

from guardlake.llm import simhash
from tests.llm.helpers import docs_of, roots


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    shingles = shingles or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "É a b \x1c c d",
                                  "a b c d e " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == signed(plain(text))


def test_long_text_in_blocks(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice("alpha Beta gamma δ e".split()) for _ in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "word_blocks", lambda data: (
        data.split()[i:i + n] for n in (1,) for i in range(len(data.split()))))
    assert whole == simhash.fingerprint(text) == signed(plain(text))


def test_hash_is_sparks_own(spark):
    got = spark.sql("select xxhash64('a b c')").first()[0]
    assert got == signed(xxhash.xxh64_intdigest(b"a b c", 42))


@pytest.mark.parametrize("chunk_rows", [4, 2048])
def test_links_against_all_pairs(spark, chunk_rows):
    rng = random.Random(5)
    prints = {0, signed((1 << 64) - 1)}
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            value = centre
            for bit in rng.sample(range(64), rng.randrange(0, 6)):
                value ^= 1 << bit
            prints.add(signed(value))
    prints = sorted(prints)
    rows = [(i, p) for i, p in enumerate(prints)] + [(1000 + i, p) for i, p in enumerate(prints[:9])]
    df = spark.createDataFrame(rows + [(None, prints[0]), (None, 12345)], "doc_id long, print long")
    got = simhash.near_duplicates(df, chunk_rows=chunk_rows).collect()
    bits = np.array([p for _, p in rows], np.int64).view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    root = roots([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(near))])
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == root[r.doc_id]
        else:
            assert r.component_id == (root[0] if r.print == prints[0] else None)


def test_table_of_given_documents(spark):
    from guardlake.llm.queries import op4_simhash
    from tests.llm.helpers import FOLDER

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    prints = {i: plain(t) for i, t in docs.items()}
    bits = np.array([prints[i] for i in docs], np.uint64)
    ids = list(docs)
    near = np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3)
    root = roots(ids, [(ids[a], ids[b]) for a, b in zip(*near)])
    got = op4_simhash(spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{prints[i]:016x}", root[i]) for i in ids}


def test_one_per_group(spark):
    docs = docs_of(spark, [(5, "x y z w", "a"), (3, "X y z w", "b"), (3, "X y z w", "b"),
                           (9, None, "a"), (8, "", None), (7, "quite another text", "a"),
                           (None, "x y z w", "a"), (None, "lonely words", "a"),
                           (None, "lonely words", "c")])
    got = simhash.one_per_group(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got.collect()) == [
        (False, 3, "X y z w"), (False, 7, "quite another text"), (False, 8, ""),
        (True, None, "lonely words")]
    assert not simhash.one_per_group(docs.where("false")).collect()
