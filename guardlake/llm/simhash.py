"""SimHash near-duplicates, searched with tables of distances to reference fingerprints.

Each fingerprint is cut into blocks.  For every block there is a table of its Hamming distances to
the blocks of many references; the sum over the blocks is the distance to the whole reference.

* Two fingerprints that differ in at most `distance` bits agree in all but `distance` blocks at
  least, and so have equal table rows there: the rows of the agreeing blocks are the join key.
* Within a key, pairs whose distances to some reference differ by more than `distance` are
  discarded (triangle inequality), one coordinate after another.
* Survivors are verified bit by bit.

Keys with many fingerprints are cut into chunks, and each pair of chunks is a tile of its own.
A tile gives a forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.common import Forest, bounded_batches, components, word_blocks
from guardlake.session import stored

SHINGLE_WORDS, HASH_SEED = 3, 42
REFERENCES, BLOCKS, DISTANCE, CHUNK_ROWS, GROUP_ROWS = 16, 5, 3, 2048, 1 << 17


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of a text, repeats included; 0 if it has no word."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    for block in word_blocks(data):
        block = tail + block
        tail = block[-(words - 1):] if words > 1 else []
        n = len(block) - words + 1
        if n > 0:
            runs = zip(*(block[i:] for i in range(words)))
            hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(run), HASH_SEED)
                                  for run in runs), np.uint64, n)
            ones += _bit_sums(hashes)
            total += n
    if not total and tail:
        ones, total = _bit_sums(np.array([xxhash.xxh64_intdigest(b" ".join(tail), HASH_SEED)],
                                         np.uint64)), 1
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<i8")[0])


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    return np.add.reduce(bits, axis=0, dtype=np.uint32).astype(np.int64)


def with_fingerprint(df: DataFrame, text: str, out: str, drop_text: bool = True) -> DataFrame:
    """`df` with the signed 64-bit fingerprint of a text column as column `out`."""
    bounded_batches(df.sparkSession)
    keep = [c for c in df.columns if not (drop_text and c == text)]
    schema = T.StructType([*(f for f in df.schema.fields if f.name in keep),
                           T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(x.as_py()) for x in batch.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), prints],
                                             [*keep, out])

    return df.mapInArrow(run, schema)


class Pivots:
    """Distance tables: per block, the distances of each block value to each reference."""

    def __init__(self, references: int = REFERENCES, blocks: int = BLOCKS,
                 distance: int = DISTANCE):
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        self.distance = distance
        self.shifts = [np.uint64(c) for c in cuts[:-1]]
        self.masks = [np.uint64((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]
        pivots = np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(references)],
                          np.uint64)
        self.tables, self.rows = [], []
        for shift, mask in zip(self.shifts, self.masks):
            values = np.arange(int(mask) + 1, dtype=np.uint64)
            near = np.bitwise_count(values[:, None] ^ ((pivots >> shift) & mask)[None, :])
            self.tables.append(near.astype(np.int8))
            self.rows.append(np.unique(near, axis=0, return_inverse=True)[1].astype(np.int64))
        self.joins = list(combinations(range(blocks), blocks - distance))

    def _blocks(self, prints: np.ndarray) -> list[np.ndarray]:
        bits = prints.view(np.uint64)
        return [((bits >> s) & m).astype(np.int64) for s, m in zip(self.shifts, self.masks)]

    def distances(self, prints: np.ndarray) -> np.ndarray:
        """Distances to the references, one row per reference."""
        parts = self._blocks(prints)
        return np.ascontiguousarray(sum(t[p] for t, p in zip(self.tables, parts)).T)

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """One key per set of blocks that may agree, from the blocks' table rows."""
        row = [r[p] for r, p in zip(self.rows, self._blocks(prints))]
        out = []
        for number, chosen in enumerate(self.joins):
            key = np.full(len(prints), number, np.int64)
            for block in chosen:
                key = key * (int(self.masks[block]) + 1) + row[block]
            out.append(key)
        return np.stack(out, axis=1)

    def links(self, group: np.ndarray, chunk: np.ndarray, crossed: np.ndarray,
              prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of linked pairs within runs of equal `group`.

        Where `crossed`, only pairs of different chunks are compared.
        """
        last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
        left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(group))
        table = self.distances(prints)
        lag, at = 1, np.flatnonzero(left >= 1)
        while len(at):
            a = at[~(crossed[at] & (chunk[at] == chunk[at + lag]))]
            for row in table:
                a = a[np.abs(row[a] - row[a + lag]) <= self.distance]
            bits = np.bitwise_count((prints[a] ^ prints[a + lag]).view(np.uint64))
            a = a[bits <= self.distance]
            if len(a):
                yield a, a + lag
            lag += 1
            at = at[left[at] >= lag]


def fingerprint_links(reps: DataFrame, chunk_rows: int = CHUNK_ROWS,
                      pivots: Pivots | None = None) -> DataFrame:
    """Edges a-b (a forest per task) between rows (rep, print) with near fingerprints.

    Fingerprints must be distinct.
    """
    pivots = pivots or Pivots()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pivots.keys(batch.column(1).to_numpy())
            times = np.repeat(np.arange(len(keys)), keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1)), batch.column(0).take(pa.array(times)),
                 batch.column(1).take(pa.array(times))], ["key", "rep", "print"])

    keyed = stored(reps.select("rep", "print").mapInArrow(
        spread, "key long, rep long, print long"), "simhash-keys")
    large = (keyed.groupBy("key").count().where(F.col("count") > chunk_rows)
             .select("key", F.ceil(F.col("count") / chunk_rows).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
    with_tile = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(
        F.least("chunk", other).alias("i"), F.greatest("chunk", other).alias("j")))
    tiles = (keyed.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
             .withColumn("chunk", chunk).withColumn("tile", F.explode(with_tile))
             .select("key", "tile.i", "tile.j", "chunk", "rep", "print"))
    tiles = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, rows = Forest(), [], 0

        def close(batch: pa.Table) -> None:
            key, i, j, chunk, rep, bits = (batch.column(c).to_numpy() for c in range(6))
            change = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            group = np.append(0, np.cumsum(change))
            for a, b in pivots.links(group, chunk, i != j, bits):
                forest.add(rep[a], rep[b])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= GROUP_ROWS:  # all but the last tile are complete
                all_rows = pa.Table.from_batches(held)
                same = np.ones(rows, bool)
                for c in range(3):
                    values = all_rows.column(c).to_numpy()
                    same &= values == values[-1]
                end = int(np.argmax(same))
                if end:
                    close(all_rows.slice(0, end))
                    all_rows = all_rows.slice(end).combine_chunks()
                held, rows = all_rows.to_batches(), all_rows.num_rows
        if rows:
            close(pa.Table.from_batches(held))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest.edges()], ["a", "b"])

    return tiles.mapInArrow(compare, "a long, b long")


def near_duplicates(prints: DataFrame, **options) -> DataFrame:
    """(doc_id, print, component_id) for rows (doc_id, print).

    Equal fingerprints are linked, and fingerprints that differ in at most three bits.  The
    component is the smallest doc_id reachable.  Repeated rows stay repeated; rows whose doc_id is
    null link nothing together by themselves and take the component of their fingerprint, null if
    no other row has it.
    """
    reps = stored(prints.where("doc_id is not null").groupBy("print")
                  .agg(F.min("doc_id").alias("rep")), "simhash-reps")
    above = components(fingerprint_links(reps, **options), "simhash-components")
    found = reps.join(above, reps.rep == above.node, "left").select(
        "print", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(found, "print", "left").select("doc_id", "print", "component_id")


def as_hex(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents with one row kept of each group of near-duplicates: its smallest doc_id.

    Rows that repeat a doc_id in one group are reduced to one; rows without doc_id stay only where
    no row of their fingerprint has one, and then once per fingerprint.
    """
    columns = docs.columns
    marked = stored(with_fingerprint(docs, "text", "__print", drop_text=False), "simhash-docs")
    small = marked.select("doc_id", F.col("__print").alias("print"))
    groups = stored(near_duplicates(small), "simhash-groups")
    alone = F.when(F.col("component_id").isNull(), F.col("print"))
    kept = (groups.where("doc_id <=> component_id")
            .groupBy("doc_id", "component_id", alone.alias("alone"))
            .agg(F.min("print").alias("print"), F.count("*").alias("n")))
    rows = marked.alias("d").join(kept.alias("k"), F.expr(
        "d.doc_id <=> k.doc_id and d.__print = k.print")).select(
        "d.*", F.col("k.n").alias("__n"))
    single = rows.where("__n = 1 and doc_id is not null").select(columns)
    several = rows.where("__n > 1 or doc_id is null").dropDuplicates(["doc_id", "__print"])
    return single.unionByName(several.select(columns))
