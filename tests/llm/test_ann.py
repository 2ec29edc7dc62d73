import numpy as np
import pytest

from guardlake.llm import ann
from guardlake.llm.queries import op5_neighbours


def exact(ids, vectors, nearest, divisor=20):
    vectors = np.asarray(vectors, float)
    out = {}
    for i, v in zip(ids, vectors):
        if i % divisor == 0:
            score = vectors @ v
            order = sorted((-s, j) for s, j in zip(score, ids) if j != i)
            out[i] = [(j, -s) for s, j in order[:nearest]]
    return out


def test_recall_on_given_vectors(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want = exact([r.vec_id for r in rows], [r.embedding for r in rows], 20)
    got = {}
    for r in op5_neighbours(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = [len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want]
    assert np.mean(hits) / 20 > 0.95
    product = {r.vec_id: np.array(r.embedding, float) for r in rows}
    for i, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - product[i] @ product[j]) < 1e-12 for j, s in found)


def test_several_shards_and_lengths_that_differ(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 16)) * rng.uniform(0.2, 3, (900, 1))
    members = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)],
                                    "rep long, embedding array<double>")
    index = ann.build_index(members, shard_rows=200)
    assert index.count() == 900 and index.select("shard").distinct().count() == 5
    queries = members.where("rep % 20 = 0").selectExpr(
        "rep as query_id", "rep as own", "embedding as vector")
    got = ann.search_index(index, queries, 11, query_rows=20).collect()
    want = exact(range(900), vectors, 10)
    hits = [len({r.rep for r in got if r.query_id == i} & {j for j, _ in want[i]}) for i in want]
    assert np.mean(hits) / 10 > 0.9


def test_copies_ties_and_odd_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100, [2.0, 1.0]), (101, None), (120, None),
            (140, [0.0, 0.0]), (160, [nan, 1.0]), (180, [1.0]), (None, [5.0, 5.0]), (100, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn(
        "rank", ann.F.lit(1))
    got = {}
    for r in ann.nearest_neighbours(df, ann.F.col("vec_id") % 20 == 0).orderBy(
            "query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 20, 40, 100}
    for query in (0, 20, 40):
        assert got[query] == [i for i in range(22) if i != query][:20]
    assert got[100] == list(range(20))


def test_fewer_candidates_than_wanted(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [-1.0, 0.0])],
                               "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(df, ann.F.col("vec_id") % 20 == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [
        (1, 1, 0.5), (2, 2, -1.0)]
    assert not ann.nearest_neighbours(df.where("false"), ann.F.lit(True)).collect()


def test_every_length_meets_its_own(spark):
    rng = np.random.default_rng(7)
    sizes = [4] * 120 + [6] * 60 + [9] * 3
    vectors = [rng.normal(size=n).tolist() for n in sizes]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    df = df.unionByName(df.where("vec_id = 5").selectExpr("140L as vec_id", "embedding"))
    got = {}
    for r in ann.nearest_neighbours(df, ann.F.col("vec_id") % 20 == 0).orderBy(
            "query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for n in (4, 6, 9):
        ids = [i for i, m in enumerate(sizes) if m == n]
        want = exact(ids, [vectors[i] for i in ids], 20)
        for i in want:
            if i != 140:  # a repeated id asks with both of its vectors
                near = [j for j, _ in want[i] if j != 140]
                assert [j for j in got[i] if j != 140][:15] == near[:15]
    assert {sizes[j] for j in got[140] if j != 140} <= {4, 6} and 180 in got


@pytest.mark.parametrize("scale, huge", [*((s, None) for s in (
    1e-300, 1e-150, 1e-25, 1.0, 1e20, 1e150)), (1e-25, 1e25), (1.0, 1e25), (1e20, 1e25)])
def test_vectors_of_any_size(spark, scale, huge):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 12)) * scale
    if huge:
        vectors[7] *= huge
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)],
                               "vec_id long, embedding array<double>")
    want = exact(range(300), vectors, 20)
    got = {}
    for r in ann.nearest_neighbours(df, ann.F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = [len(set(got[i]) & {j for j, _ in want[i]}) for i in want]
    assert np.mean(hits) / 20 > 0.9
