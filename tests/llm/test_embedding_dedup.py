import math
import random

import numpy as np
import pytest

from guardlake.llm.common import components
from guardlake.llm.embedding_dedup import Quantised, near_duplicates, tile_links  # noqa: F401
from tests.llm.helpers import roots


def plain(rows, threshold=0.95):
    def ok(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, float)) for i, v in rows if i is not None and ok(v)]
    links, pairs = {i: 0 for i, _ in rows if i is not None}, []
    for n, (i, v) in enumerate(good):
        for j, w in good[n + 1:]:
            if len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    return links, roots(links, pairs)


def check(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = near_duplicates(df).collect()
    if kind == "float":
        rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v])
                for i, v in rows]
    links, root = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id) == (links[r.vec_id], root[r.vec_id]), r
            assert r.kept == (r.vec_id == r.component_id)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for group in range(25):
        centre = rng.normal(size=24)
        for noise in rng.uniform(0.02, 0.4, rng.integers(1, 9)):
            rows.append(centre * rng.uniform(0.1, 50) + noise * rng.normal(size=24))
    rows += [rows[0]] * 12 + [rows[5] * 3.7]
    check(spark, [(i * 3, [float(x) for x in v]) for i, v in enumerate(rows)], "double")
    check(spark, [(i * 3, [float(x) for x in v]) for i, v in enumerate(rows)])


def test_near_the_threshold(spark):
    rows, angle = [], math.acos(0.95)
    for i, off in enumerate((-1e-3, -1e-6, -1e-9, 1e-9, 1e-6, 1e-3)):
        a, b = np.zeros(12), np.zeros(12)
        a[2 * i] = 1
        b[2 * i], b[2 * i + 1] = math.cos(angle + off), math.sin(angle + off)
        rows += [(2 * i, a.tolist()), (2 * i + 1, b.tolist())]
    check(spark, rows, "double")


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
                  (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]),
                  (10, [1.0, 0.0]), (11, [1.0]), (12, [1e-30, 1e-32]), (None, [1.0, 0.0])])


def test_empty_table(spark):
    assert not near_duplicates(spark.createDataFrame(
        [], "vec_id long, embedding array<float>, label int")).collect()


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    x = Quantised(rng.standard_t(2, size=(300, 70)))
    product = (x.factors.astype(float) @ x.factors.T) * x.scale[:, None] * x.scale[None, :]
    bound = (x.error[:, None] * x.held[None] + x.held[:, None] * x.error[None]
             + x.error[:, None] * x.error[None])
    assert (np.abs(product - x.units @ x.units.T) <= bound).all()


@pytest.mark.parametrize("kind", ["chain", "random"])
def test_components(spark, kind):
    rng = random.Random(3)
    nodes = list(range(300))
    if kind == "chain":
        order = nodes[:]
        rng.shuffle(order)
        pairs = list(zip(order, order[1:]))
    else:
        pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    edges = spark.createDataFrame([*pairs, (None, 1), (5, None), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "test").collect()}
    want = {n: r for n, r in roots(nodes, pairs).items() if n != r}
    assert got == want
