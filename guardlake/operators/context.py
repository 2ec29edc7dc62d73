"""Multi-turn analysis over conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import context as X
from guardlake.operators.skew import ranked

BLOCK = 1000


def with_history(df: DataFrame, key: str, turn: str, item, out: str = "history",
                 size: int = C.MAX_HISTORY, dense: bool = False, block: int = BLOCK) -> DataFrame:
    """Add the array of `item` over the `size` rows before each row of its conversation.

    Conversations are cut into blocks of `block` turns; the last rows of a block are repeated
    at the head of the next one, so the window of a conversation of any length is computed by
    many tasks.  Blocks need gap-free positions: pass `dense=True` if `turn` has them (0, 1,
    2, ...), otherwise they are computed.
    """
    at, blk, halo = "__at", "__blk", "__halo"
    if dense:
        df = df.withColumn(at, F.col(turn).cast("long"))
    else:
        df = ranked(df, [key], F.floor(F.col(turn) / block), [F.col(turn)], at)
        df = df.withColumn(at, F.col(at) - 1)
    mine = F.floor(F.col(at) / block)
    later = F.floor((F.col(at) + size) / block)
    df = (df.withColumn("__item", item)
          .withColumn(blk, F.explode(F.when(later > mine, F.array(mine, later))
                                     .otherwise(F.array(mine))))
          .withColumn(halo, F.col(blk) > mine))
    frame = Window.partitionBy(key, blk).orderBy(at).rowsBetween(-size, -1)
    return (df.withColumn(out, F.collect_list("__item").over(frame))
            .filter(~F.col(halo)).drop(at, blk, halo, "__item"))


def conversation_context(conversations: DataFrame, key: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text",
                         max_history: int = C.MAX_HISTORY, dense: bool = False) -> DataFrame:
    """`context` of every user turn against the messages before it."""
    slim = conversations.select(key, turn, role, X.features(F.col(role), F.col(text)).alias("me"))
    framed = with_history(slim, key, turn, F.col("me"), size=max_history, dense=dense)
    return (framed.filter(F.col(role) == "user")
            .select(key, turn, X.context(F.col("me"), F.col("history"), max_history)
                    .alias("context")))
