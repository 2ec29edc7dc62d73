import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from guardlake.llm import divergence
from tests.llm.helpers import DOCS


def plain(rows):
    groups, total, seen = {}, {}, {}
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        terms = re.findall(divergence.TERM, r["text"] or "")
        terms = ["".join(c.lower() if c.isascii() else c for c in t) for t in terms]
        groups.setdefault((lang, source), Counter()).update(terms)
        total.setdefault(lang, Counter()).update(terms)
        seen.setdefault(lang, Counter()).update(set(terms))
    out = []
    for (lang, source), counts in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= 10)

        def shares(own):
            n = sum(own[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (own[t] + 2) // n for t in kept}

        def price(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = shares(counts), shares(total[lang])
        found = {"pair": [], "term": [(price(p[t], q[t]), t) for t in kept
                                      if counts[t] and p[t] > q[t]]}
        for (other_lang, other), own in groups.items():
            if other_lang == lang and other != source:
                o = shares(own)
                found["pair"].append((sum(price(p[t], o[t]) for t in kept), other))
        for part, items in found.items():
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item)
                    in enumerate(items[:10] if part == "term" else items, 1)]
    return sorted(out)


def check(docs):
    got = sorted(map(tuple, divergence.source_audit(docs).collect()))
    assert got == plain(docs.collect())
    return got


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], DOCS)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = check(docs)
    db = duckdb.connect()
    db.execute("create view documents as from '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(db.execute(divergence.ORACLE).fetchall()) == got


@pytest.mark.parametrize("terms, chunk", [(3, 2), (64, 3)])
def test_small_blocks_and_chunks(spark, monkeypatch, terms, chunk):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    monkeypatch.setattr(divergence, "CHUNK_SOURCES", chunk)
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_odd_rows(spark):
    rows = [("alpha beta ALPHA İx " * (i % 4), "en", f"s{i % 3}") for i in range(30)]
    rows += [(None, "en", "empty"), ("", "en", None), ("12 34", "en", "s0"), ("x y", None, "a"),
             ("x y", None, None), ("one two", "lonely", "only"), ("a1b2c3", "", "a")]
    rows += [("same tie " * 2, "xx", s) for s in "abc" for _ in range(11)]
    check(frame(spark, rows))


def test_ties_follow_the_items(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "éàzb"]
    check(frame(spark, [(" ".join(words[k % 2::2]), "en", f"s{k % 2}") for k in range(40)]))


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 100)
    check(frame(spark, [("word" + chr(97 + i) + " common " * 3000, "en", f"s{i % 3}")
                        for i in range(24)]))


def test_no_rows_and_other_columns(spark):
    docs = frame(spark, [("a b", "en", "s")] * 12 + [("a c", "en", "t")] * 12)
    extra = docs.selectExpr("*", "1 as term", "2 as block", "3 as number", "4 as n")
    assert sorted(divergence.source_audit(extra).collect()) == sorted(
        divergence.source_audit(docs).collect())
    assert not divergence.source_audit(docs.where("false")).collect()


def test_shares_of_large_counts():
    n = np.array([0, 7, 10 ** 11, 9 * 10 ** 13])
    for total in (3, 10 ** 6 + 1, 4 * 10 ** 14 - 1):
        if total > n[-1]:
            assert divergence.share(n, total).tolist() == [
                1 + 10 ** 9 * (int(x) + 2) // total for x in n]


def test_equal_subtrees_are_one_node():
    counts = np.tile(np.array([[1, 2, 0, 0]]), (6, 8))
    trees = divergence.Trees(counts)
    assert [len(first) for first, _ in trees.children] == [2, 1, 1, 1, 1]
