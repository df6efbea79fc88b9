"""Chat history: the last messages, and what follows a reset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(messages: DataFrame, *keys: str, order: str) -> DataFrame:
    """One row for each repeated turn, the first by ``order``."""
    return messages.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_nth = 1").drop("_nth")


def last_messages(messages: DataFrame, conversation: str, turn: str, tie: str, n: int = 10) -> DataFrame:
    """The last ``n`` messages of each conversation. Null turns come first, so they fall out first."""
    order = Window.partitionBy(conversation).orderBy(F.col(turn).desc_nulls_last(), F.col(tie).desc())
    return messages.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def after_reset(messages: DataFrame, conversation: str, turn: str, tie: str, is_reset: Column) -> DataFrame:
    """What each conversation says after its last reset; all of it where there was none."""
    # the last reset of each conversation is a plain aggregate, so a very long one isn't one task's window
    place = F.struct(F.coalesce(F.col(turn).cast("bigint"), F.lit(-(2**62))).alias("turn"), F.col(tie).alias("tie"))
    reset = F.coalesce(is_reset, F.lit(False))
    last = messages.where(reset).groupBy(F.col(conversation).alias("_conversation")).agg(F.max(place).alias("_last"))
    joined = messages.where(~reset).join(last, F.col(conversation).eqNullSafe(F.col("_conversation")), "left")
    return joined.where(F.col("_last").isNull() | (place > F.col("_last"))).drop("_conversation", "_last")
