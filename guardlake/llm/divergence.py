"""How far the sources of a language diverge in their words, by hash-consed segment trees.

The kept terms of a language are dealt into blocks by hash, and numbered within a block.  In a block
every group (a source, and the language itself) is a segment tree over term ids whose leaves are
counts.  Trees are hash-consed level by level: equal count subtrees, within a tree or of different
trees, are one node.
A pair of groups is priced by walking both trees at once from their roots; equal pairs of nodes that
are met on a level are one entry with how often they were met, so each is expanded and priced once.
Terms that stand out in a source are found on the pair of its tree and the language's.

Sources of a block are cut into chunks, and each pair of chunks is a tile of its own, so a group of
rows is bounded by chunk times block.  Counts are summed where texts are read; what is shuffled are
counts per term and source.  Arithmetic is in whole numbers throughout.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm.common import bounded_batches
from guardlake.operators.skew import lookup
from guardlake.session import stored

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, UNIT, TOP_TERMS = 10, 1_000_000_000, 10
BLOCK_TERMS, CHUNK_SOURCES, HELD_TERMS, BLOCK_BYTES = 2048, 32, 400_000, 1 << 20
LANGUAGE, SUM = -1, -1
TILE = "lang string, block int, a int, b int, id int, value long"


def _lowered_terms() -> bytes:
    """UTF-8 bytes: letters (A-Z lower-cased) and all that is not ASCII stay, all else is a space."""
    keep = {c: c for c in (*range(0x61, 0x7B), *range(0x80, 0x100))}
    keep |= {c: c + 0x20 for c in range(0x41, 0x5B)}
    return bytes(keep.get(c, 0x20) for c in range(256))


_TERMS = _lowered_terms()


def term_blocks(text: str, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about `size` bytes."""
    data = text.encode("utf-8", "surrogatepass").translate(_TERMS)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + size)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents) with places and documents of every term, and a row of the
    term '' per group."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for text, lang, source in zip(batch.column(0), langs, sources):
                n, documents = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
                seen: set[bytes] = set()
                for terms in term_blocks(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                documents.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from tables(held)
                held = {}
        yield from tables(held)

    def tables(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n)), pa.array([source] * len(n)),
                 pa.array(list(n), pa.string()), pa.array(n.values(), pa.int64()),
                 pa.array([documents[t] for t in n], pa.int64())],
                ["lang", "source", "term", "n", "documents"])

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                          for c in ("text", "lang", "source")))
    return (texts.mapInArrow(run, "lang string, source string, term string, n long, documents long")
            .groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))


def share(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / total), divided in two steps so that 64 bits hold any count."""
    high, rest = np.divmod((n + 2) * 100_000, total)
    return 1 + high * (UNIT // 100_000) + rest * (UNIT // 100_000) // total


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Trees:
    """Hash-consed segment trees, one per row of `counts`; -1 is a place without a term."""

    def __init__(self, counts: np.ndarray):
        leaves = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        padded = np.full((len(counts), leaves), -1, np.int64)
        padded[:, :counts.shape[1]] = counts
        self.leaf, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while nodes.shape[1] > 1:
            span = int(nodes.max()) + 1
            pairs, parents = np.unique(nodes[:, ::2] * span + nodes[:, 1::2], return_inverse=True)
            self.children.append(np.divmod(pairs, span))
            nodes = parents.reshape(len(counts), -1)
        self.roots = nodes[:, 0]

    def prices(self, a: int, others: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Summed divergence of tree `a` and each of `others`."""
        pair = np.arange(len(others))
        left, right = np.full(len(others), self.roots[a]), self.roots[others]
        times = np.ones(len(others), np.int64)
        for first, second in reversed(self.children):
            pair = np.concatenate([pair, pair])
            left = np.concatenate([first[left], second[left]])
            right = np.concatenate([first[right], second[right]])
            wide, span = int(left.max()) + 1, int(right.max()) + 1
            met, at = np.unique((pair * wide + left) * span + right, return_inverse=True)
            often = np.zeros(len(met), np.int64)
            np.add.at(often, at, np.concatenate([times, times]))
            rest, right = np.divmod(met, span)
            pair, left = np.divmod(rest, wide)
            times = often
        n, m = self.leaf[left], self.leaf[right]
        real = (n >= 0) & (m >= 0)
        pair, times = pair[real], times[real]
        price = divergence(share(n[real], totals[a]), share(m[real], totals[others[pair]]))
        out = np.zeros(len(others), np.int64)
        np.add.at(out, pair, times * price)
        return out

    def standing_out(self, a: int, whole: int, totals: np.ndarray, order: np.ndarray,
                     most: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, values) of the `most` terms of tree `a` with p > q against tree `whole`.

        The walk goes down only where tree `a` has counts; pairs of leaves are priced once.
        """
        ids, left, right = np.zeros(1, np.int64), self.roots[a:a + 1], self.roots[whole:whole + 1]
        live = self._with_counts()
        for level in range(len(self.children) - 1, -1, -1):
            first, second = self.children[level]
            ids = np.concatenate([2 * ids, 2 * ids + 1])
            left = np.concatenate([first[left], second[left]])
            right = np.concatenate([first[right], second[right]])
            keep = live[level][left]
            ids, left, right = ids[keep], left[keep], right[keep]
        span = len(self.leaf)
        met, at = np.unique(left * span + right, return_inverse=True)
        n, m = self.leaf[met // span], self.leaf[met % span]
        p, q = share(n, totals[a]), share(m, totals[whole])
        value = np.where((n > 0) & (p > q), divergence(p, q), -1)[at]
        ids, value = ids[value >= 0], value[value >= 0]
        best = np.lexsort((order[ids], -value))[:most]
        return ids[best], value[best]

    def _with_counts(self) -> list[np.ndarray]:
        """Per level from the leaves up: which nodes have a count above 0 below them."""
        live = [self.leaf > 0]
        for first, second in self.children[:-1]:
            live.append(live[-1][first] | live[-1][second])
        return live


def _tile(key: tuple, rows: pa.Table, top: int) -> pa.Table:
    """Prices of the pairs of sources between two chunks of a block, and the top terms of a chunk.

    Rows are (number, id, n, place): counts per source number and term id; with id -1 each
    source's denominator and the terms in the block.  LANGUAGE is the whole language's number.
    """
    lang, block, i, j = (k.as_py() for k in key)
    number, ids, n, place = (rows.column(c).to_numpy() for c in ("number", "id", "n", "place"))
    heads = ids < 0
    numbers, first = np.unique(number[heads], return_index=True)
    totals, size = n[heads][first], int(place[heads].max())
    counts = np.zeros((len(numbers), size), np.int64)
    row = np.searchsorted(numbers, number[~heads])
    counts[row, ids[~heads]] = n[~heads]
    a, b, item, value = [], [], [], []
    if size:
        trees = Trees(counts)
        sources = np.flatnonzero(numbers != LANGUAGE)
        chunk = numbers // CHUNK_SOURCES
        for s in sources[chunk[sources] == i]:
            others = sources[(chunk[sources] == j) & (numbers[sources] > numbers[s])]
            if len(others):
                a.append(np.full(len(others), numbers[s]))
                b.append(numbers[others])
                item.append(np.full(len(others), SUM))
                value.append(trees.prices(s, others, totals))
        if i == j:
            whole = int(np.flatnonzero(numbers == LANGUAGE)[0])
            order = np.zeros(size, np.int64)
            of_language = (number == LANGUAGE) & ~heads
            order[ids[of_language]] = place[of_language]
            for s in sources:
                best, worth = trees.standing_out(s, whole, totals, order, top)
                a.append(np.full(len(best), numbers[s]))
                b.append(np.full(len(best), LANGUAGE))
                item.append(best)
                value.append(worth)
    a, b, item, value = (np.concatenate(x) if x else np.empty(0, np.int64)
                         for x in (a, b, item, value))
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()),
                     "block": pa.array([block] * len(a), pa.int32()),
                     "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()),
                     "id": pa.array(item, pa.int32()), "value": pa.array(value, pa.int64())})


def source_audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS,
                 top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of how the sources of each language diverge.

    Part `pair`: every other source of the language as item, by the divergence of term shares
    summed over the language's kept terms (those in at least `least_documents` of its documents).
    Part `term`: the `top` kept terms whose share in the source is above the language's.  Ranks
    are by value, largest first, then by item.

    Null text, lang and source count as ''.  A group without terms takes part with counts of 0; a
    language without kept terms has pairs of value 0; one with a single source has no pairs.  Rows
    that repeat count each; the doc_id and other columns are ignored.  Texts of any length are read
    whole, in blocks, with the distinct terms of one document in memory.  An empty table: no rows.
    """
    entries = stored(counted(docs), "divergence-counts")
    terms = stored(entries.where("term <> ''").groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("documents").alias("documents"))
        .where(F.col("documents") >= least_documents).drop("documents"), "divergence-terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    blocks = F.ceil(F.col("kept") / F.lit(BLOCK_TERMS))
    dealt = lookup(terms, langs, ["lang"], ["term"]).withColumn(
        "block", F.pmod(F.xxhash64("term"), blocks).cast("int"))
    # About BLOCK_TERMS rows in a window: frequent terms first, so that trees share their rare ends.
    in_block = Window.partitionBy("lang", "block")
    placed = stored(dealt.select(
        "lang", "term", "n", "block",
        (F.row_number().over(in_block.orderBy(F.desc("n"), "term")) - 1).alias("id"),
        F.row_number().over(in_block.orderBy("term")).cast("long").alias("place")),
        "divergence-places")

    kept = entries.where("term <> ''").join(placed.select("lang", "term", "block", "id"),
                                            ["lang", "term"])
    kept = stored(kept.select("lang", "source", "block", "id", "n"), "divergence-kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # One row per source from here on.
    sources = entries.where("term = ''").select("lang", "source").join(
        sums, ["lang", "source"], "left").join(langs.select("lang", "kept"), "lang", "left")
    sources = stored(sources.select(
        "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source"))
                           - 1).alias("number"),
        (F.coalesce("total", F.lit(0)) + 2 * F.coalesce("kept", F.lit(0))).alias("total")),
        "divergence-sources")

    sizes = placed.groupBy("lang", "block").agg(F.count("*").alias("place"))
    columns = ["lang", "block", "number", "id", "n", "place"]
    chunks = sources.groupBy("lang").agg(
        F.floor(F.max("number") / F.lit(CHUNK_SOURCES)).cast("int").alias("last"))
    counts = lookup(kept, sources.select("lang", "source", "number"), ["lang", "source"],
                    ["block", "id"]).withColumn("place", F.lit(0).cast("long"))
    heads = sizes.join(sources, "lang").select(
        "lang", "block", "number", F.lit(-1).alias("id"), F.col("total").alias("n"), "place")
    of_language = placed.withColumn("number", F.lit(LANGUAGE)).select(columns).unionByName(
        lookup(sizes, langs, ["lang"], ["block"]).select(
            "lang", "block", F.lit(LANGUAGE).alias("number"), F.lit(-1).alias("id"),
            (F.col("total") + 2 * F.col("kept")).alias("n"), "place"))
    chunk = F.floor(F.col("number") / F.lit(CHUNK_SOURCES)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    tiles = lookup(counts.select(columns).unionByName(heads), chunks, ["lang"], ["block", "number"])
    tiles = tiles.select(*columns, chunk.alias("chunk"), other.alias("other")).select(
        *columns, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    tiles = tiles.unionByName(lookup(of_language, chunks, ["lang"], ["block", "id"]).select(
        *columns, other.alias("i")).withColumn("j", F.col("i")))

    def price(key: tuple, rows: pa.Table) -> pa.Table:
        return _tile(key, rows, top)

    priced = stored(tiles.groupBy("lang", "block", "i", "j").applyInArrow(price, TILE),
                    "divergence-priced")

    one = sources.select("lang", F.col("source"), F.col("number").alias("a"))
    two = sources.select("lang", F.col("source").alias("item"), F.col("number").alias("b"))
    summed = priced.where(F.col("id") == SUM).groupBy("lang", "a", "b").agg(
        F.sum("value").alias("value"))
    both = summed.unionByName(summed.select("lang", F.col("b").alias("a"), F.col("a").alias("b"),
                                            "value"))
    # Languages without kept terms have no blocks; every pair of sources is in the result.
    every = one.join(two, "lang").where("a <> b")
    pairs = every.join(both, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        F.coalesce("value", F.lit(0)).alias("value"))
    names = placed.select("lang", "block", "id", F.col("term").alias("item"))
    best = priced.where(F.col("id") != SUM).join(names, ["lang", "block", "id"]).join(
        one, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(
        F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(
        best.withColumn("rank", rank).where(F.col("rank") <= top))


ORACLE = f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang,
        coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') as w
      from documents),
t as (select lang, source, r, unnest(w) as term from d),
k as (select lang, term, count(*) as n from t group by lang, term
      having count(distinct r) >= {LEAST_DOCUMENTS}),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t join k using (lang, term)
      group by lang, source, term),
v as (select lang, count(*) as v, sum(n) as n from k group by lang),
s as (select lang, source, coalesce(sum(n), 0) as n from g left join c using (lang, source)
      group by lang, source),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
        1 + ({UNIT}::hugeint * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v) as p,
        1 + ({UNIT}::hugeint * (k.n + 2)) // (v.n + 2 * v.v) as q
      from s join k using (lang) join v using (lang)
      left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
x as (select a.lang, a.source, b.source as item,
        sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source
      group by a.lang, a.source, b.source),
y as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source
      left join x on x.lang = a.lang and x.source = a.source and x.item = b.source
      union all
      select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank::integer as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item)
        as rank from y)
where part = 'pair' or rank <= {TOP_TERMS}"""
