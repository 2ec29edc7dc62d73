import hashlib
import math
import re

import pytest

from guardlake.llm import mixing
from tests.llm.helpers import FOLDER, docs_of


def plain_targets(sizes):
    """{source: target} by sharing, capping and sharing the excess until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    order += [None] if None in sizes else []
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in order}
        capped |= above


def hashed(value, digits):
    return int(hashlib.md5(value.encode()).hexdigest()[:digits], 16)


def check(spark, docs, rows):
    size = [len(re.findall(mixing.WORD, r.text or "")) for r in rows]
    sizes, counts = {}, {}
    for r, n in zip(rows, size):
        sizes[r.source] = sizes.get(r.source, 0) + n
        counts[r.source] = counts.get(r.source, 0) + 1
    targets = plain_targets(sizes)
    want = []
    for source in sizes:
        def slot(item):
            r, n = item
            head = n.bit_length() or 1
            part = hashed("" if r.doc_id is None else str(r.doc_id), 8)
            return (head * 8 + (n >> max(head - 3, 0)),
                    part % math.ceil(counts[source] / mixing.SLOT_ROWS), n,
                    r.doc_id is not None, r.doc_id)

        ratio = targets[source] / sizes[source] if sizes[source] else 0
        start = hashed(f"{mixing.SEED}:" + ("\0" if source is None else source), 12) / (1 << 48)
        own = sorted(((r, n) for r, n in zip(rows, size) if r.source == source), key=slot)
        for i, (r, n) in enumerate(own, 1):
            copies = math.floor(i * ratio + start) - math.floor((i - 1) * ratio + start)
            want.append((str(r.doc_id), n, sizes[source], copies * n))
    got = mixing.taken(docs).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size, r.taken) for r in got) == sorted(want)
    by_size = {r.source_size: r.target for r in got}
    for source, n in sizes.items():
        assert by_size[n] == pytest.approx(targets[source])
    assert all(0 <= r.taken <= 3 * r.size for r in got)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check(spark, docs, docs.collect())


def test_taken_words_are_near_the_targets(spark):
    rows = mixing.mixed(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
                        .select("doc_id", "text", "source")).selectExpr(
        "source", "target", "copies * size as taken").groupBy("source", "target").sum().collect()
    for r in rows:
        assert r["sum(taken)"] == pytest.approx(r["target"], rel=0.1)


def test_odd_rows(spark):
    docs = docs_of(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None),
                           (4, "d " * 40, None), (None, "e f", "é"), (5, "g", "z"), (6, None, "q")])
    check(spark, docs, docs.collect())


def test_columns_and_empty_tables(spark):
    docs = docs_of(spark, ["a b", "c d e"])
    extra = docs.selectExpr("*", "1 as size", "2 as target", "3 as copies")
    assert mixing.taken(extra).count() == 2
    assert mixing.emitted(docs).columns == docs.columns
    through = mixing.emitted(extra).collect()
    assert through and {(r["size"], r["target"], r["copies"]) for r in through} == {(1, 2, 3)}
    assert not mixing.taken(docs.where("false")).collect()
    assert not mixing.emitted(docs.where("false")).collect()


def test_no_python_in_the_plan(spark):
    plan = mixing.taken(spark.read.parquet(f"{FOLDER}/documents.parquet"))._jdf.queryExecution()
    assert not re.search("Python|Arrow|Pandas", plan.executedPlan().toString())


def test_emitted_as_often_as_taken(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {r.doc_id: r.copies for r in mixing.mixed(docs).where("copies > 0").collect()}
    got = {r.doc_id: r["count"] for r in mixing.emitted(docs).groupBy("doc_id").count().collect()}
    assert got == want
