import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from guardlake.llm import substrings
from tests.llm.helpers import docs_of


def plain(rows):
    first, out = {}, []
    words = [re.findall("[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    for r, w in zip(rows, words):
        for i in range(len(w) - 12):
            if r.doc_id is not None:
                key = tuple(w[i:i + 13])
                first[key] = min(first.get(key, r.doc_id), r.doc_id)
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - 12):
            if r.doc_id is not None and first[tuple(w[i:i + 13])] < r.doc_id:
                gone.update(range(i, i + 13))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(r.doc_id), len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def check(docs):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256)
                 for r in substrings.repeats_removed(docs).collect())
    assert got == plain(docs.collect())
    return got


def mixture(seed, n=60, vocabulary=4):
    """Short texts over few words, so that windows repeat everywhere, with shared passages."""
    chance = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[chance.choice(words) + str(chance.randrange(9)) for _ in range(k)]
                for k in (12, 13, 14, 25, 60)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(chance.randrange(5)):
            text += chance.choice(passages)[chance.randrange(3):]
            text += [chance.choice(words) for _ in range(chance.randrange(25))]
        rows.append((chance.randrange(n), " ".join(text), "s"))
    return rows


def test_given_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    got = check(spark.read.parquet(path))
    assert any(r[2] for r in got)
    db = duckdb.connect()
    db.execute(f"create view documents as from '{path}'")
    assert sorted((str(r[0]), *r[1:]) for r in db.execute(substrings.ORACLE).fetchall()) == got


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages(spark, seed):
    check(docs_of(spark, mixture(seed)).repartition(5))


@pytest.mark.parametrize("most, rows", [(0, 7), (5, 3), (40, 50)])
def test_anchors_with_many_windows(spark, monkeypatch, most, rows):
    monkeypatch.setattr(substrings, "ROWS", rows)
    full = substrings.extended
    monkeypatch.setattr(substrings, "extended", lambda found: full(found, most))
    phrase = " ".join(f"p{i}" for i in range(9))
    texts = [f"a{i % 7} b{i % 5} c{i % 3} {phrase} x{i % 4} y z{i % 6} u v w" for i in range(80)]
    check(docs_of(spark, texts).repartition(4))
    check(docs_of(spark, mixture(9)).repartition(4))


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT_WORDS", 50)
    chance = random.Random(5)
    long = [f"n{chance.randrange(10 ** 6)}" for _ in range(300_000)]
    texts = [" ".join(long), " ".join(long[1000:1400] + ["x"] + long[200_000:260_000]),
             "word " * 500, "word " * 700 + "end", " ".join(long[-13:]), " ".join(long[-12:])]
    check(docs_of(spark, texts))


def test_odd_rows(spark):
    words = " ".join(f"q{i}" for i in range(30))
    check(docs_of(spark, [(1, words, "s"), (1, words, "s"), (1, words + " more", "s"),
                          (2, None, "s"), (3, "", "s"), (4, words.replace(" ", "\t\n  "), "s"),
                          (4, words.replace(" ", "\x0b"), "s"), (None, words, "s"),
                          (None, words, "s"), (5, "x " + words, "s"), (0, words[:80], "s")]))


def test_no_rows_other_columns_and_kept_words(spark):
    words = " ".join(f"q{i}" for i in range(13))
    docs = docs_of(spark, [words, f"before {words} after"])
    extra = docs.selectExpr("*", "1 as print", "2 as spans", "3 as start", "4 as n_words")
    got = {r.doc_id: r.kept for r in substrings.without_repeats(extra).collect()}
    assert got == {0: words, 1: "before after"}
    assert not substrings.repeats_removed(docs.where("false")).collect()


def test_equal_windows_have_equal_anchors():
    chance = np.random.default_rng(1)
    words = chance.integers(0, 3, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    anchor, first, runs, windows = substrings.anchored(words, 13)
    of = np.repeat(anchor, runs)
    by_window = {}
    for w, a in zip(windows.tolist(), of.tolist()):
        assert by_window.setdefault(w, a) == a
    assert len(by_window) < len(windows) and len(first) < len(windows)
