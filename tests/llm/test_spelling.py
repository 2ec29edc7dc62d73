import re
import zlib
from collections import Counter

import pytest

from guardlake.llm import spelling
from tests.llm.helpers import FOLDER, docs_of


def near_words(word):
    """All strings one edit away, by the letters that words have."""
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out.add(word[:i] + word[i + 1:])
            out |= {word[:i] + c + word[i + 1:] for c in letters}
    return out - {word}


def plain(rows):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: near_words(w) & counts.keys() for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w]) or 0)
                  for w, n in counts.items())


def check(docs):
    got = spelling.variants(docs).collect()
    want = plain(docs.collect())
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0)
                  for r in got) == want
    return got


def test_given_documents(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert any(r.form for r in got)


@pytest.mark.parametrize("edited", ["xdeparture", "departurex", "epartur", "departu", "depaarture",
                                    "dearture", "debarture", "Departurf", "éparture"])
def test_edits_at_every_place(spark, edited):
    check(docs_of(spark, ["departure " * 40 + f"{edited} {edited} eparture eparture"]))


def test_chains_ties_and_runs(spark):
    docs = docs_of(spark, ["aaaaaaaa " * 2, "aaaaaaa " * 40, "aaaaaab " * 500, "baaaaab " * 500,
                           "aaaaaac " * 6000, "aaaaaaaaa " * 3, "zzzzzzz zzzzzzy " * 2,
                           "zzzzzzx zzzzzzw " * 30])
    got = {r.word: r for r in check(docs)}
    assert got["aaaaaaaa"].root != got["aaaaaaaa"].form


def test_odd_rows(spark):
    check(docs_of(spark, [None, "", "short words only", "İstanbul İstanbul stanbul stanbul",
                          "caféèêbar CAFÉèêbar caféèêbar", "x×÷yzabc " * 3,
                          (7, "repeated repeated", "s"), (7, "repeated repeated", "s"),
                          (None, "nullnumber nullnumber", None)]))


def test_no_rows_and_other_columns(spark):
    docs = docs_of(spark, ["together together"]).selectExpr("*", "1 as n", "2 as word", "3 as root")
    assert [r.word for r in spelling.variants(docs).collect()] == ["together"]
    assert not spelling.variants(docs.where("false")).collect()
    assert not spelling.variants(docs_of(spark, [None])).collect()


def test_very_long_texts(spark):
    words = ["alphabet", "alphabets", "alphabe"]
    docs = docs_of(spark, [" ".join(words[i % 3] for i in range(300_000)), "alphabex " * 2])
    check(docs)


def test_pairs_of_many_words(spark):
    words = [r.word for r in spelling.counted(spark.read.parquet(f"{FOLDER}/documents.parquet"))
             .collect()]
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = sorted((r.a, r.b) if r.a < r.b else (r.b, r.a)
                 for r in spelling.near_pairs(frame).collect())
    known = set(words)
    want = sorted({tuple(sorted((w, o))) for w in words for o in near_words(w) & known})
    assert got == want
