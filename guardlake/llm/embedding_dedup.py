"""Near-duplicate embeddings by int8 tile products with error bounds.

A unit vector u is held as s * q with int8 codes q; e = u - s * q is its quantisation error.  For
two vectors the product of the codes differs from the cosine by at most
|e1| * |s2 q2| + |s1 q1| * |e2| + |e1| * |e2|, so only pairs whose product comes that close to the
threshold are computed again in double precision; all others are surely below it.

Equal vectors are one class.  Classes are dealt into blocks by hash, and each pair of blocks is a
tile, multiplied piece by piece.  A tile returns, per class, how many vectors it links with and
the smallest class of its connections there; it never returns pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm.common import Forest, components
from guardlake.session import stored

THRESHOLD, BLOCK_ROWS, MIN_BLOCKS, PIECE_ROWS = 0.95, 32768, 8, 1024
ROUNDING = 1e-9  # of sums in double precision
EXACT_DIMENSIONS = (1 << 24) // (127 * 127)  # up to here float32 sums of int8 products are exact


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, and not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one length in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1)


class Quantised:
    """Unit vectors with int8 codes, scales and error bounds."""

    def __init__(self, vectors: np.ndarray):
        self.units = unit(vectors)
        self.scale = np.abs(self.units).max(axis=1) / 127
        self.codes = np.rint(self.units / self.scale[:, None]).astype(np.int8)
        held = self.codes * self.scale[:, None]
        self.held = np.sqrt((held * held).sum(axis=1)) + ROUNDING
        self.error = np.sqrt(((self.units - held) ** 2).sum(axis=1)) + ROUNDING
        kind = np.float32 if vectors.shape[1] <= EXACT_DIMENSIONS else np.float64
        self.factors = self.codes.astype(kind)

    def part(self, rows: slice) -> Quantised:
        out = object.__new__(Quantised)
        for name, values in vars(self).items():
            setattr(out, name, values[rows])
        return out

    def near(self, at: slice, other: Quantised, threshold: float):
        """Positions (in all of self, in other) of pairs with cosine >= threshold."""
        product = self.factors[at] @ other.factors.T
        product *= other.scale.astype(product.dtype)[None, :]
        # The widest bound of the piece first (float32 may round), then each pair's own.
        reach = (self.error[at].max() * (other.held + other.error).max()
                 + self.held[at].max() * other.error.max()) + 1e-5
        a, b = np.nonzero(product >= ((threshold - reach) / self.scale[at])[:, None])
        a = a + at.start
        exact = np.einsum("ij,ij->i", self.codes[a].astype(np.float64),
                          other.codes[b].astype(np.float64)) * self.scale[a] * other.scale[b]
        bound = (self.error[a] * other.held[b] + self.held[a] * other.error[b]
                 + self.error[a] * other.error[b])
        maybe = exact + bound >= threshold
        a, b = a[maybe], b[maybe]
        sure = np.einsum("ij,ij->i", self.units[a], other.units[b]) >= threshold
        return a[sure], b[sure]


def tile_links(table: pa.Table, threshold: float) -> pa.Table:
    """(node, links, root) for the rows (rep, copies, block, embedding) of one or two blocks."""
    block = table.column("block").to_numpy()
    rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    lengths = table.column("embedding").combine_chunks().value_lengths().to_numpy()
    links, forest = np.zeros(len(rep), np.int64), Forest()
    for length in np.unique(lengths):
        sides = [np.flatnonzero((block == b) & (lengths == length)) for b in np.unique(block)]
        sides = [(s, Quantised(matrix(table.column("embedding").take(pa.array(s)))))
                 for s in sides if len(s)]
        if len(sides) < len(np.unique(block)):
            continue
        (left, x), (right, y) = sides[0], sides[-1]
        for start in range(0, len(left), PIECE_ROWS):
            for from_ in range(0, len(right), 8 * PIECE_ROWS):
                part = slice(from_, from_ + 8 * PIECE_ROWS)
                a, b = x.near(slice(start, min(start + PIECE_ROWS, len(left))),
                              y.part(part), threshold)
                b = b + from_
                if len(sides) == 1:
                    a, b = a[a < b], b[a < b]
                a, b = left[a], right[b]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                forest.add(a, b)
    node, root = forest.edges()
    smallest = np.arange(len(rep))
    smallest[node] = root
    # rows are not in the order of their reps: name each connection by its smallest rep
    low = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(low, smallest, rep)
    linked = links > 0
    return pa.table({"node": rep[linked], "links": links[linked],
                     "root": low[smallest][linked]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors` (vec_id, embedding).

    Vectors of one length link at cosine >= threshold in double precision, whatever else the rows
    hold.  Null vectors, zero vectors and those with null or non-finite components link with
    nothing: n_links 0, and they are their own component.  Rows that repeat a vector are copies of
    each other and linked; rows that repeat a vec_id are one node, whose links add up.  Rows without
    vec_id link with nothing.
    """
    ok = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = vectors.select("vec_id", "embedding")
    classes = stored(rows.where(ok).groupBy("embedding").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "embedding-classes")
    blocks = max(MIN_BLOCKS, -(-classes.count() // BLOCK_ROWS))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    tiles = (classes.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
             .withColumn("tile", F.explode(F.transform(others, lambda other: F.least(
                 "block", other) * blocks + F.greatest("block", other)))))

    def compare(table: pa.Table) -> pa.Table:
        return tile_links(table, threshold)

    found = stored(tiles.groupBy("tile").applyInArrow(
        compare, "node long, links long, root long"), "embedding-links")
    above = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")),
                       "embedding-components")
    linked = (found.groupBy("node").agg(F.sum("links").alias("links"))
              .join(above, "node", "left"))
    per_class = classes.join(linked, classes.rep == linked.node, "left").select(
        "embedding", F.coalesce("component", "rep").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    plain = rows.where(~F.coalesce(ok, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    all_rows = rows.where(ok).join(per_class, "embedding").select(
        "vec_id", "n_links", "component_id").unionByName(plain)
    return all_rows.withColumn("kept", F.coalesce(
        F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = f"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
      and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(a, b) as (select a, b from p union select r.a, p.b from r join p on r.b = p.a),
c as (select a, min(b) as low from r group by a),
n as (select a, count(*) as n from p group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links,
  least(e.vec_id, coalesce(c.low, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) as kept
from embeddings e left join c on c.a = e.vec_id left join n on n.a = e.vec_id"""
