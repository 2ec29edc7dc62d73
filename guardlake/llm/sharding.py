"""Shards by balanced label propagation: linked documents meet, and sizes stay even.

Documents are linked through the groups they share.  A group that a shard can hold starts whole, in
a shard by its hash; rows of a larger one fill shards one after another.  In each round a group that
is in several shards asks to move whole to the fullest one with room for the rest of it, and a shard
above its quota asks others with room to take groups of it whole.  A shard admits the groups that
its room holds in the order of a hash.  Every admitted move raises the weight of links inside shards
or lowers what shards hold above their quota, and nothing lowers the one or raises the other, so the
rounds end; the last is the one in which no group fits elsewhere.  Groups that stand above a quota
then are dealt by rows.  Documents without links fill the shards up to the same size by their place
in one running sum, which is taken per bucket and shifted.

Only counts per shard reach the driver.
"""

from __future__ import annotations

from itertools import accumulate, count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.operators.skew import lookup, ranked
from guardlake.session import stored

SHARDS, BUCKET_ROWS, UNIT = 8, 4096, 1 << 30


def propagate(linked: DataFrame, quota: float, shards: int = SHARDS) -> DataFrame:
    """Rows (group, size, shard, spread) with `shard` changed by label propagation.

    `quota` is the most bytes a shard may be given.  Groups of more than that stay where they are.
    `spread` is a long that differs between rows of a group.
    """
    state = stored(linked, "shard-start")
    parts = stored(state.groupBy("group", F.col("shard").alias("first")).agg(
        F.sum("size").alias("inside")).withColumn("shard", F.col("first")), "shard-parts")
    buckets = max(1, parts.count() // BUCKET_ROWS // shards)
    for turn in count():
        room = [quota - x for x in _held(parts, "inside", shards)]
        moves = stored(_admitted(parts, room, quota, turn, buckets), "shard-moves")
        if moves.isEmpty():
            break
        parts = stored(parts.join(moves, "group", "left").withColumn(
            "shard", F.coalesce("to", "shard")).drop("to"), "shard-parts")
    to = parts.select("group", F.col("first").alias("shard"), F.col("shard").alias("to"))
    return (lookup(state, to, ["group", "shard"], ["spread"]).withColumn("shard", F.col("to"))
            .drop("to"))


def _held(rows: DataFrame, size: str, shards: int) -> list[int]:
    held = {r[0]: r[1] for r in rows.groupBy("shard").agg(F.sum(size)).collect()}
    return [held.get(s, 0) for s in range(shards)]


def _admitted(parts: DataFrame, room: list[float], quota: float, turn: int,
              buckets: int) -> DataFrame:
    """(group, to) of the groups that move, whole, in this round."""
    shards = range(len(room))
    inside = [F.col(f"in_{s}") for s in shards]
    groups = parts.groupBy("group").agg(F.sum("inside").alias("all"), *(F.sum(F.when(
        F.col("shard") == s, F.col("inside")).otherwise(0)).alias(f"in_{s}") for s in shards))
    # of a group in one shard only: that shard
    home = F.coalesce(*(F.when(x == F.col("all"), F.lit(s)) for s, x in zip(shards, inside)))
    by_room = [F.pmod(F.xxhash64("group", F.lit(turn), F.lit(s)), F.lit(UNIT)) * max(room[s], 0.0)
               for s in shards]
    place = F.array_max(F.filter(F.array(*(F.when(
        (x < F.col("all")) & (F.col("all") - x <= room[s]),
        F.struct(x.alias("inside"), by_room[s].alias("order"), F.lit(s).alias("to")))
        for s, x in zip(shards, inside))), lambda x: x.isNotNull()))
    asked = (groups.where(F.col("all") <= quota).withColumn("home", home)
             .where(F.col("home").isNull() | F.col("home").isin(
                 [s for s in shards if room[s] < 0]))
             .withColumn("place", place).where("place is not null")
             .select("group", "home", F.col("place.to").alias("to"),
                     (F.col("all") - F.col("place.inside")).alias("need")))
    order = [F.xxhash64("group", F.lit(turn), F.lit("order")), F.col("group")]
    # no more groups leave a shard than it takes to come down to the quota
    above = F.element_at(F.array(*(F.lit(-float(x)) for x in room)),
                         F.coalesce("home", F.lit(0)) + 1)
    asked = _running(asked, "home", "need", order, buckets).where(
        F.col("home").isNull() | (F.col("upto") - F.col("need") < above)).drop("upto")
    left = F.element_at(F.array(*(F.lit(float(x)) for x in room)), F.col("to") + 1)
    return _running(asked, "to", "need", order, buckets).where(
        F.col("upto") <= left).select("group", "to")


def _running(rows: DataFrame, key: str, size: str, order: list[Column], buckets: int) -> DataFrame:
    """Rows with `upto`, the sum of sizes up to each within its key, taken per bucket and shifted."""
    rows = rows.withColumn("key", F.coalesce(key, F.lit(-1))).withColumn(
        "bucket", F.pmod(order[0], F.lit(buckets)))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = (rows.groupBy("key", "bucket").agg(F.sum(size).alias("sum"))
              .withColumn("shift", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum"))
    within = Window.partitionBy("key", "bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    return (rows.withColumn("upto", F.sum(size).over(within)).join(shifts, ["key", "bucket"])
            .withColumn("upto", F.col("upto") + F.col("shift")).drop("key", "bucket", "shift"))


def _too_much(linked: DataFrame, quota: float, shards: int) -> DataFrame:
    """(group): of the groups that no shard has room for, enough to bring each to its quota."""
    groups = linked.groupBy("group").agg(F.sum("size").alias("all"), F.min("shard").alias("home"),
                                         F.max("shard").alias("last"))
    over = [max(x - quota, 0) for x in _held(linked, "size", shards)]
    groups = groups.where((F.col("home") == F.col("last")) & (F.col("all") <= quota))
    above = F.element_at(F.array(*(F.lit(float(x)) for x in over)), F.col("home") + 1)
    buckets = max(1, linked.count() // BUCKET_ROWS // shards)
    return _running(groups.where(above > 0), "home", "all", [F.xxhash64("group"), F.col("group")],
                    buckets).where(F.col("upto") - F.col("all") < above).select("group")


def filled(single: DataFrame, room: list[float], rows: int,
           first: Column | None = None) -> DataFrame:
    """Rows (size, spread) with `shard` given so that the sizes in the shards stand as `room`.

    `first` has few values; rows are dealt in its order.
    """
    buckets = max(1, rows // BUCKET_ROWS)
    single = single.withColumn("bucket", F.struct(
        (F.lit(0) if first is None else first).cast("long").alias("first"),
        F.pmod(F.xxhash64("spread", F.lit(1)), F.lit(buckets)).alias("slot")))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (single.groupBy("bucket").agg(F.sum("size").alias("all"))
              .withColumn("shift", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all"))
    upto = F.sum("size").over(Window.partitionBy("bucket").orderBy("spread", "size").rowsBetween(
        Window.unboundedPreceding, 0))
    middle = F.col("upto") + F.col("shift") - F.col("size") / 2
    ends = list(accumulate(max(x, 0) for x in room))[:-1]
    shard = sum((F.when(middle > end, 1).otherwise(0) for end in ends), F.lit(0))
    return (single.withColumn("upto", upto).join(shifts, "bucket")
            .withColumn("shard", shard.cast("int")).drop("bucket", "upto", "shift"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot and grown_shard (law `bytes`).

    Linked are documents with equal texts; null texts are linked with each other.  Size: bytes of
    the text (null: none) plus 1.  A group is in several shards only if it is larger than a shard
    may hold, when it fills shards one after another, or if no shard has room for it whole.
    Rows that repeat a doc_id are rows of their own.  An empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = stored(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.when(F.col("text").isNull(), "n").otherwise("t"), F.md5(text)).alias("group"),
        F.monotonically_increasing_id().alias("row")), "shard-docs")
    base = base.withColumn("spread", F.xxhash64("doc_id", "row"))
    groups = base.groupBy("group").agg(F.count("*").alias("copies"), F.sum("size").alias("all"))
    marked = stored(lookup(base, groups, ["group"], ["spread"]), "shard-marked")
    totals = marked.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows, quota = totals[0], totals[1] / shards
    marked = marked.withColumn("large", F.col("all") > quota).drop("all")
    links = marked.where("copies > 1").drop("copies")
    by_group = F.xxhash64("group")
    large = stored(filled(links.where("large"), [quota] * shards, rows, by_group), "shard-large")
    ends = list(accumulate(max(quota - x, 0) for x in _held(large, "size", shards)))
    at = F.pmod(by_group, F.lit(UNIT)) / float(UNIT) * float(ends[-1])
    first = sum((F.when(at >= float(end), 1).otherwise(0) for end in ends[:-1]), F.lit(0))
    start = links.where("not large").withColumn("shard", first.cast("int"))
    linked = stored(propagate(large.unionByName(start), quota, shards), "shard-linked")
    if max(_held(linked, "size", shards)) > quota:
        apart = stored(_too_much(linked, quota, shards), "shard-apart")
        kept = stored(linked.join(apart, "group", "left_anti"), "shard-kept")
        dealt = filled(linked.join(apart, "group", "left_semi").drop("shard"),
                       [quota - x for x in _held(kept, "size", shards)], rows, by_group)
        linked = stored(kept.unionByName(dealt), "shard-linked")
    single = filled(marked.where("copies = 1").drop("copies"),
                    [quota - x for x in _held(linked, "size", shards)], rows)
    placed = stored(linked.unionByName(single), "shard-placed")
    buckets = max(1, rows // BUCKET_ROWS // shards)
    placed = ranked(placed, ["shard"], F.pmod(F.xxhash64("spread", F.lit(2)), F.lit(buckets)),
                    ["doc_id", "spread"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         (F.col("slot") - 1).cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
