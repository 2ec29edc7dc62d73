import zlib
from collections import Counter, defaultdict

import pytest

from guardlake.llm import sharding
from tests.llm.helpers import FOLDER, docs_of


def check(got, rows, spread):
    """One row per row, right sizes, gapless slots, shards within `spread` of their share."""
    want = Counter((str(r.doc_id), len((r.text or "").encode()) + 1,
                    zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(held.values()) / 8
    assert all(abs(held[s] - share) <= spread for s in range(8)), held
    return held


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id")
    got, rows = sharding.sharded(docs).collect(), docs.collect()
    check(got, rows, max(len(r.text.encode()) for r in rows) + 1)
    text, shards = {r.doc_id: r.text for r in rows}, defaultdict(set)
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_a_group_larger_than_a_shard(spark):
    docs = docs_of(spark, ["copy of one text"] * 3000 + [f"text {i} of all" for i in range(5000)])
    got = sharding.sharded(docs).collect()
    check(got, docs.collect(), 400)
    of_group = Counter(r.shard for r in got if r.doc_id < 3000)
    # the shards that it fills hold nearly all of it
    assert sum(n for _, n in of_group.most_common(4)) > 0.9 * 3000


def test_odd_rows(spark):
    docs = docs_of(spark, [(1, None, "a"), (2, None, None), (3, "", "a"), (None, "x", "a"),
                           (4, "x", "a"), (4, "x", "a"), (5, "é" * 5000, "b")])
    got = sharding.sharded(docs.selectExpr("*", "1 as shard", "2 as size")).collect()
    check(got, docs.collect(), 10_001)
    assert not sharding.sharded(docs.where("false")).collect()


def test_same_result_again(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert sorted(sharding.sharded(docs).collect()) == sorted(sharding.sharded(docs).collect())


@pytest.mark.parametrize("quota", [1000.0, 400.0])
def test_quota_is_never_passed(spark, quota):
    rows = [(f"g{i % 7}", 1 + i % 9, i % 8, i) for i in range(300)]
    linked = spark.createDataFrame(rows, "group string, size long, shard int, spread long")
    before, after = Counter(), Counter()
    for r in rows:
        before[r[2]] += r[1]
    for r in sharding.propagate(linked, quota).collect():
        after[r.shard] += r.size
    assert sum(after.values()) == sum(before.values())
    assert all(after[s] <= max(quota, before[s]) for s in range(8))


@pytest.mark.parametrize("singles, split", [(8000, 0), (0, 16)])
def test_copies_meet_where_most_rows_are_copies(spark, singles, split):
    """No group is left in several shards; without single rows, only the few at the ends are."""
    docs = docs_of(spark, [f"group {g} " + "x" * (g % 50) for g in range(2000)
                           for _ in range(2 + g % 9)] + [f"text {i} of all" for i in range(singles)])
    got, rows = sharding.sharded(docs).collect(), docs.collect()
    check(got, rows, 65)
    text, shards = {r.doc_id: r.text for r in rows}, defaultdict(set)
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= split


def test_groups_near_the_size_of_a_shard(spark):
    docs = docs_of(spark, [f"{g} copies" for g in range(8) for _ in range(900)]
                   + [f"{i:6d} s" for i in range(800)])
    got = sharding.sharded(docs).collect()
    check(got, docs.collect(), 9)
    assert all(len({r.shard for r in got if r.doc_id // 900 == g}) == 1 for g in range(8))


def test_scattered_groups_meet_and_full_shards_give_groups_away(spark):
    rows = [(f"g{i % 50}", 1 + i % 3, (i // 50) % 8 if i % 50 < 25 else 0, i) for i in range(1000)]
    linked = spark.createDataFrame(rows, "group string, size long, shard int, spread long")
    got = sharding.propagate(linked, 400.0).collect()
    held, shards = Counter(), defaultdict(set)
    for r in got:
        held[r.shard] += r.size
        shards[r.group].add(r.shard)
    assert len(got) == 1000 and max(held.values()) <= 400
    assert all(len(s) == 1 for s in shards.values())
