"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt into shards of a bounded size.  In each shard points are put in by batches: a
greedy search in the graph so far proposes neighbours, and relaxed distance pruning keeps those
that no kept neighbour is much nearer to, so that edges point in different directions.  Edges
back are added and pruned likewise.  The graphs are a table, one row per vector.  A beam search
answers all queries in every shard, and the best of all shards are kept.

Nearness is the inner product.  For the graph each vector gets one more component that makes all
lengths equal, so that the nearest by distance is the one with the largest inner product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm.embedding_dedup import matrix, usable
from guardlake.session import stored

NEAREST, SHARD_ROWS, QUERY_BLOCK_ROWS, MEMBER_SALTS = 20, 4096, 16384, 32
LARGEST, SPAN, EXACT_BATCH = 1e120, 1e3, 256
DEGREE, BUILD_BEAM, QUERY_BEAM, SLACK, BUILD_BATCH, QUERY_BATCH = 40, 64, 96, 1.2, 256, 512


class Graph:
    """Vectors of one shard with the edges of each; -1 stands for no edge."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, start: int = 0,
                 degree: int = DEGREE):
        self.vectors = np.vstack([vectors, np.zeros(vectors.shape[1])])
        # Single precision holds what is left once the largest component is 1.
        vectors = vectors / np.abs(vectors).max()
        norms = (vectors * vectors).sum(axis=1)
        rest = np.sqrt(np.maximum(norms.max() - norms, 0))
        level = np.hstack([vectors, rest[:, None]]).astype(np.float32)
        self.points = np.vstack([level, np.zeros(level.shape[1], np.float32)])
        self.square = float(norms.max())
        self.size, self.start = len(vectors), start
        self.edges = np.full((self.size + 1, degree), self.size, np.int32)
        if edges is not None:
            self.edges[:-1] = np.where(edges < 0, self.size, edges)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` points nearest to each query by greedy beam search: (points, -product).

        Queries have one component more than the vectors.  Missing points are `size`.
        """
        n, nothing = len(queries), self.size
        rows = np.arange(n)
        found = np.full((n, beam), nothing, np.int32)
        far = np.full((n, beam), np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        seen = np.zeros((n, nothing + 1), bool)
        seen[:, nothing] = True
        seen[:, self.start] = True
        found[:, 0] = self.start
        far[:, 0] = -(queries @ self.points[self.start])
        open_[:, 0] = True
        while len(rows):
            pick = open_[rows].argmax(axis=1)
            open_[rows, pick] = False
            near = self.edges[found[rows, pick]]
            fresh = ~seen[rows[:, None], near]
            seen[rows[:, None], near] = True
            gap = -np.einsum("rd,rkd->rk", queries[rows], self.points[near])
            gap[~fresh] = np.inf
            both = np.concatenate([far[rows], gap], axis=1)
            keep = np.argpartition(both, beam - 1, axis=1)[:, :beam]
            values = np.take_along_axis(both, keep, axis=1)
            order = values.argsort(axis=1)
            keep = np.take_along_axis(keep, order, axis=1)
            far[rows] = np.take_along_axis(values, order, axis=1)
            found[rows] = np.take_along_axis(
                np.concatenate([found[rows], near], axis=1), keep, axis=1)
            open_[rows] = np.take_along_axis(
                np.concatenate([open_[rows], fresh], axis=1), keep, axis=1) & (far[rows] < np.inf)
            rows = rows[open_[rows].any(axis=1)]
        found[~np.isfinite(far)] = nothing
        return found, far

    def prune(self, points: np.ndarray, near: np.ndarray, slack: float) -> np.ndarray:
        """For each point, the neighbours kept of its proposed ones (rows of `near`)."""
        degree = self.edges.shape[1]
        own = self.points[points]
        near = np.where(near == points[:, None], self.size, near)
        gap = 2 * (self.square - np.einsum("pd,pkd->pk", own, self.points[near]))
        gap[near == self.size] = np.inf
        order = gap.argsort(axis=1)
        near, gap = np.take_along_axis(near, order, axis=1), np.take_along_axis(gap, order, axis=1)
        vectors, left = self.points[near], np.isfinite(gap)
        kept = np.full((len(points), degree), self.size, np.int32)
        at = np.arange(len(points))
        for place in range(degree):
            if not left.any():
                break
            pick = left.argmax(axis=1)
            some = left[at, pick]
            kept[some, place] = near[at, pick][some]
            between = 2 * (self.square - np.einsum(
                "pd,pkd->pk", vectors[at, pick], vectors))
            left &= slack * slack * between > gap
            left[at, pick] = False
        return kept

    def build(self, beam: int = BUILD_BEAM, slack: float = SLACK, batch: int = BUILD_BATCH,
              seed: int = 3) -> None:
        """Put in all points in a random order, in batches that double up to `batch`."""
        mean = self.points[:-1].mean(axis=0)
        self.start = int(((self.points[:-1] - mean) ** 2).sum(axis=1).argmin())
        order = np.random.default_rng(seed).permutation(self.size)
        order = order[order != self.start]
        at, step = 0, 1
        while at < len(order):
            points = order[at:at + step]
            near, _ = self.search(self.points[points], beam)
            self.edges[points] = self.prune(points, near, slack)
            self._back(points, slack)
            at, step = at + step, min(2 * step, batch)

    def _back(self, points: np.ndarray, slack: float) -> None:
        """Edges back from the neighbours of the points, pruned where they are too many."""
        degree = self.edges.shape[1]
        to = self.edges[points]
        from_, to = np.repeat(points, degree)[to.reshape(-1) < self.size], to[to < self.size]
        order = np.argsort(to, kind="stable")
        from_, to = from_[order], to[order]
        ends, first, more = np.unique(to, return_index=True, return_counts=True)
        added = np.full((len(ends), int(more.max(initial=0))), self.size, np.int32)
        added[np.repeat(np.arange(len(ends)), more),
              np.arange(len(to)) - np.repeat(first, more)] = from_
        new = np.where((added[:, :, None] == self.edges[ends][:, None, :]).any(axis=2),
                       self.size, added)
        both = np.sort(np.concatenate([self.edges[ends], new], axis=1), axis=1)
        used = (both < self.size).sum(axis=1)
        small = used <= degree
        self.edges[ends[small]] = both[small, :degree]
        if (~small).any():
            self.edges[ends[~small]] = self.prune(
                ends[~small], both[~small, :used.max()], slack)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, node, rep, embedding, edges, start) per vector of (rep, embedding), as a table.

    Vectors are usable ones without repeats; every one is in the index.  A shard holds vectors of
    one length.
    """
    length = F.size("embedding")
    shards, before, places = _parts(vectors, length, shard_rows), 0, {}
    for n, many in shards.items():
        places[n], before = before, before + many
    dealt = vectors.select("rep", "embedding", (_of(places, length) + F.pmod(
        F.xxhash64("rep", F.lit(9)), _of(shards, length))).cast("int").alias("shard"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        graph = Graph(matrix(table.column("embedding")))
        graph.build()
        edges = np.where(graph.edges[:-1] == graph.size, -1, graph.edges[:-1])
        nodes = np.arange(graph.size, dtype=np.int32)
        return pa.table({
            "shard": table.column("shard"), "node": nodes, "rep": table.column("rep"),
            "embedding": table.column("embedding"),
            "edges": pa.ListArray.from_arrays(
                np.arange(0, edges.size + 1, DEGREE, dtype=np.int32), edges.reshape(-1)),
            "start": nodes == graph.start})

    kind = vectors.schema["embedding"].dataType.simpleString()
    return stored(dealt.groupBy("shard").applyInArrow(
        build, f"shard int, node int, rep long, embedding {kind}, edges array<int>, "
               "start boolean"), "ann-index")


def _parts(rows: DataFrame, length: Column, most: int) -> dict[int, int]:
    """{length: number of parts of about `most` rows}."""
    counts = rows.groupBy(length.alias("length")).count().orderBy("length").collect()
    return {r[0]: -(-r[1] // most) for r in counts}


def _of(values: dict[int, int], length: Column) -> Column:
    """The value of a length, or null."""
    pairs = values or {-1: 1}
    return F.element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), length)


def in_range(size: np.ndarray) -> np.ndarray:
    """Whether products of vectors of this size neither overflow nor vanish in double precision."""
    return (size > 1 / LARGEST) & (size < LARGEST)


def ordered_in_single(vectors: np.ndarray) -> bool:
    """Whether single precision can tell the vectors of a shard apart once they are scaled."""
    size = np.abs(vectors).max(axis=1)
    return bool(in_range(size).all() and size.max() < SPAN * size.min())


def batched(rows: np.ndarray, size: int) -> list[np.ndarray]:
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def search_index(index: DataFrame, queries: DataFrame, nearest: int, beam: int = QUERY_BEAM,
                 query_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """(query_id, own, length, rep, score): the `nearest` vectors found for each of (query_id, own,
    vector).

    Blocks of queries of a length meet each shard of that length; scores are inner products in double
    precision.  Shards whose vectors differ in size by more than SPAN, and vectors outside 1 / LARGEST
    to LARGEST, are searched without the graph, by all products in double precision.
    """
    blocks = _parts(queries, F.size("vector"), query_rows)
    shards = index.select(F.col("shard").alias("to"), F.size("embedding").alias("length")).distinct()
    queries = queries.withColumn("length", F.size("vector"))
    block = F.pmod(F.xxhash64("query_id", "own"), _of(blocks, F.col("length"))).cast("int")

    def every(length: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), _of(blocks, length) - 1))

    tasks = shards.select("to", "length", every(F.col("length")).alias("block"))
    asked = queries.withColumn("block", block).join(tasks, ["length", "block"])
    graphs = index.withColumn("block", every(F.size("embedding")))

    def answer(key: tuple, points: pa.Table, ask: pa.Table) -> pa.Table:
        if not points.num_rows or not ask.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "own": pa.array([], pa.int64()),
                             "length": pa.array([], pa.int32()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        points = points.sort_by("node")
        rep, vectors = points.column("rep").to_numpy(), matrix(ask.column("vector"))
        own = matrix(points.column("embedding"))
        size = np.abs(vectors).max(axis=1)
        by_graph = in_range(size) if ordered_in_single(own) else np.zeros(len(size), bool)
        at, to, scores = [], [], []

        def keep(rows: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
            """The best of the points found for some queries; ties go to the smaller rep."""
            best = np.lexsort((np.append(rep, np.iinfo(np.int64).max)[found], -score))[:, :nearest]
            row, column = np.nonzero(np.take_along_axis(found, best, axis=1) < len(rep))
            at.append(rows[row])
            to.append(found[row, best[row, column]])
            scores.append(score[row, best[row, column]])

        if by_graph.any():
            edges = points.column("edges").combine_chunks().flatten().to_numpy()
            start = int(points.column("start").to_numpy().argmax())
            graph = Graph(own, edges.reshape(-1, DEGREE), start)
        for rows in batched(np.flatnonzero(by_graph), QUERY_BATCH):
            wide = np.hstack([vectors[rows] / size[rows, None], np.zeros((len(rows), 1))])
            found, _ = graph.search(wide.astype(np.float32), max(beam, nearest))
            score = np.einsum("qd,qkd->qk", vectors[rows], graph.vectors[found])
            score[found == graph.size] = -np.inf
            keep(rows, found, score)
        for rows in batched(np.flatnonzero(~by_graph), EXACT_BATCH):
            with np.errstate(over="ignore", invalid="ignore"):
                score = vectors[rows] @ own.T
            score[np.isnan(score)] = -np.inf
            keep(rows, np.broadcast_to(np.arange(len(rep)), score.shape), score)
        take = pa.array(np.concatenate(at))
        return pa.table({"query_id": ask.column("query_id").take(take),
                         "own": ask.column("own").take(take),
                         "length": ask.column("length").take(take),
                         "rep": rep[np.concatenate(to)], "score": np.concatenate(scores)})

    found = graphs.groupBy("shard", "block").cogroup(
        asked.groupBy("to", "block")).applyInArrow(
        answer, "query_id long, own long, length int, rep long, score double")
    best = Window.partitionBy("query_id", "own", "length").orderBy(F.col("score").desc(), "rep")
    return found.withColumn("place", F.row_number().over(best)).where(
        F.col("place") <= nearest).drop("place")


def nearest_neighbours(vectors: DataFrame, is_query: Column, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each query row of `vectors`.

    Rows have vec_id and embedding; those with null vec_id, or with a vector that is null, zero, or
    holds null or non-finite components, take no part.  Neighbours have the query's length.  Equal vectors are one point of the index, with the smallest ids that a result
    can need.  Rows that repeat a vec_id are candidates each for others; a row is no candidate for
    a query with its own id.  Vectors may be of any finite size: products that overflow or vanish in
    double precision count as that, infinite or 0.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", "embedding")
    wanted = nearest + 1

    def smallest(ids: Column) -> Column:
        return F.slice(F.array_sort(ids), 1, wanted)

    # a vector's ids are cut to the smallest ones in parts, so that many copies meet nowhere
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(MEMBER_SALTS))
    parts = rows.groupBy("embedding", salt.alias("salt")).agg(
        smallest(F.collect_list("vec_id")).alias("ids"))
    members = stored(parts.groupBy("embedding").agg(
        smallest(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn(
        "rep", F.element_at("ids", 1)), "ann-members")
    index = build_index(members.select("rep", "embedding"))
    queries = (rows.where(is_query).join(members.select("embedding", "rep"), "embedding")
               .select(F.col("vec_id").alias("query_id"), F.col("rep").alias("own"),
                       F.col("embedding").alias("vector")).distinct())
    found = stored(search_index(index, stored(queries, "ann-queries"), wanted), "ann-found")
    of_rep = members.select("rep", F.size("embedding").alias("length"), "ids")
    rows = (found.join(of_rep, ["rep", "length"])
            .select("query_id", "score", F.explode("ids").alias("vec_id"))
            .where("vec_id <> query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= nearest).select(
        "query_id", "rank", "vec_id", "score")
