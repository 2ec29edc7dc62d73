"""Helpers shared by the operators: tables, words, connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.session import stored

WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Let batches for Python workers end by size, so that long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text (cut at ASCII white space), in lists of about `size` bytes."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            space = _SPACE.search(data, end)
            end = space.start() if space else len(data)
        yield data[start:end].split()
        start = end


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a-b and, for each, the smallest node it is connected with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[:len(a)], place[len(a):]
    root = np.arange(len(nodes))
    while not np.array_equal(root[u], root[v]):
        low = np.minimum(root[u], root[v])
        joined = root.copy()
        np.minimum.at(joined, root[u], low)
        np.minimum.at(joined, root[v], low)
        while not np.array_equal(joined, joined[joined]):
            joined = joined[joined]
        root = joined[root]
    return nodes, nodes[root]


class Forest:
    """Edges met in one task, contracted to (node, smallest node) whenever many have come."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.size, self.parts = limit, 0, []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.size += len(a)
        if self.size >= 2 * self.limit:
            self.parts = [self.edges()]
            self.size = len(self.parts[0][0])
            self.limit = max(self.limit, self.size)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        node, root = local_roots(*(np.concatenate(x) for x in zip(*self.parts)))
        apart = node != root
        return node[apart], root[apart]


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node that is not the smallest of its component.

    `edges` has long columns a and b.  Large-star and small-star steps hang each node below the
    smallest of its neighbours until nothing moves; each round is a table in the shared folder.
    Rows with a null or with a = b add nothing.
    """
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                               F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        mark = state.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == before or not mark[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (both.where("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), "low")
        state = stored(small.union(low).distinct().toDF("a", "b"), name)


def contracted(edges: DataFrame) -> DataFrame:
    """The edges a-b with each partition's own connections reduced to a forest."""
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            forest.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest.edges()], ["a", "b"])

    return edges.select("a", "b").mapInArrow(contract, "a long, b long")
