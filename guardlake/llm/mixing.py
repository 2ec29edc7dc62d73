"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

The documents of a source stand in a fixed order.  Each adds its expected number of copies (target
over size of the source) to a prefix sum that starts at one random offset per source; a document is
emitted once per integer boundary its step crosses.  The order goes by size within slots, so that
the words taken follow the target closely.

A large source is never ranked by one task: rows are numbered within slots of a few thousand
documents, and each slot is shifted by the number of documents in the slots before it.  Only the
table of sources (one row each) and the table of slot counts per source meet in one task each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm.common import WORD

WEIGHTS, MAX_COPIES, SLOT_ROWS, SEED = (1, 2, 3), 3, 4096, 17


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(value: Column, digits: int) -> Column:
    """A fixed random integer below 16 ** digits for a string; the same in other SQL engines."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, rows, target) for rows (source, size).

    Sources by code point, null last, take the weights in turn and share all words by them.  A
    target stops at `max_copies` times the source's size, and the excess goes to the others by
    weight: with sources sorted by cap per weight, those before the fitting place are capped.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                          F.count("*").alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turns = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sources.withColumn("weight", F.element_at(
        turns, ((place - 1) % len(weights) + 1).cast("int")))
    every = Window.partitionBy()
    cap = F.col("source_size") * max_copies
    by_cap = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = weighed.withColumn("total", F.sum("source_size").over(every)).withColumn(
        "words_left", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0))).withColumn(
        "weight_left", F.sum("weight").over(every)
        - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level is the first share per weight that the next source's cap does not undercut.
    level = F.col("words_left") / F.col("weight_left")
    fits = F.when(cap / F.col("weight") >= level, level)
    return left.withColumn("level", F.first(fits, ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(
        "source", "source_size", "rows",
        F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, size: Column | None = None, weights=WEIGHTS,
          max_copies: int = MAX_COPIES, slot_rows: int = SLOT_ROWS, seed: int = SEED) -> DataFrame:
    """The rows of `docs` with columns size, source_size, target and copies.

    Needs doc_id, text and source; `size` replaces the number of words of the text (null: 0).
    Null sources are one source, placed last.  Rows that repeat a doc_id are rows of their own and
    stand next to each other, interchangeable if all else is equal.  A source of size 0 has target
    0 and no copies.  An empty table gives an empty one.
    """
    size = size_in_words(F.col("text")) if size is None else size
    own = ("size", "source_size", "target", "copies")
    keep = [c for c in docs.columns if c not in own]
    rows = docs.withColumn("__size", size).select(*keep, F.col("__size").alias("size"))
    targets = source_targets(rows.select("source", "size"), weights, max_copies).select(
        F.col("source").alias("__source"), "source_size", "target",
        F.ceil(F.col("rows") / slot_rows).alias("__parts"))
    rows = rows.join(F.broadcast(targets) if targets_are_few(targets) else targets,
                     F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    length = F.length(F.bin("size"))
    head = F.expr("shiftright(size, cast(greatest(length(bin(size)) - 3, 0) as int))")
    part = F.pmod(hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 8),
                  F.col("__parts"))
    rows = rows.withColumn("__slot", F.struct((length * 8 + head).alias("size"),
                                              part.alias("part")))
    source = F.struct(F.col("source").isNull().alias("missing"),
                      F.coalesce("source", F.lit("")).alias("name"))
    rows = rows.withColumn("__source", source)
    counts = rows.groupBy("__source", "__slot").agg(F.count("*").alias("__n"))
    before = (Window.partitionBy("__source").orderBy("__slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__source", "__slot").orderBy("size", "doc_id"))
    ranked = rows.withColumn("__place", place).join(
        shifts.drop("__n"), ["__source", "__slot"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = hashed(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\u0000"))),
                    12) / F.lit(float(1 << 48))
    last = F.col("__place") + F.col("__shift")
    copies = F.floor(last * ratio + offset) - F.floor((last - 1) * ratio + offset)
    return ranked.select(*keep, "size", "source_size", "target", copies.alias("copies"))


def targets_are_few(targets: DataFrame, limit: int = 100_000) -> bool:
    """Whether the table of sources is small enough to be sent to every task."""
    return targets.limit(limit + 1).count() <= limit


def emitted(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, in the columns of `docs`.

    The columns travel as one value, so those named like the mix's own come back as they were.
    """
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("__doc"))
    times = F.sequence(F.lit(1), F.col("copies"))
    return (mixed(rows, size_in_words(F.col("__doc")["text"])).where("copies > 0")
            .withColumn("__copy", F.explode(times)).select("__doc.*"))


def taken(docs: DataFrame) -> DataFrame:
    """Per document: size, its source's size and target, and the words that the mix takes."""
    return mixed(docs.select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size
  from documents),
s as (select source, sum(size)::bigint as source_size, count(*) as n from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3
        when 0 then 1.0::double when 1 then 2.0::double else 3.0::double end as weight from s),
l as (select *, 3 * source_size as cap,
        row_number() over (order by 3 * source_size / weight, source nulls last) as k,
        sum(source_size) over ()
          - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last
              rows between unbounded preceding and 1 preceding), 0) as words_left,
        sum(weight) over ()
          - coalesce(sum(weight) over (order by 3 * source_size / weight, source nulls last
              rows between unbounded preceding and 1 preceding), 0) as weight_left from w),
t as (select l.source, source_size, n, least(cap::double, weight *
        (select min_by(words_left / weight_left, k) from l
         where cap / weight >= words_left / weight_left)) as target from l),
r as (select d.doc_id, d.size, t.source_size, t.target, d.source,
        ('0x' || substr(md5('{SEED}:' || coalesce(d.source, chr(0))), 1, 12))::bigint
          / {float(1 << 48)} as u,
        case when t.source_size > 0 then t.target / t.source_size else 0 end as ratio,
        row_number() over (partition by d.source order by
          length(bin(d.size)) * 8 + (d.size >> greatest(length(bin(d.size)) - 3, 0)),
          ('0x' || substr(md5(d.doc_id::varchar), 1, 8))::bigint
            % ceil(n / {SLOT_ROWS}.0)::bigint, d.size, d.doc_id) as place
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  ((floor(place * ratio + u) - floor((place - 1) * ratio + u)) * size)::bigint as taken from r"""
