"""Results within a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import whole_lines


def blocks_within(hits: DataFrame, trim: int = 600, budget: int = 3000) -> DataFrame:
    """(query_id, position, block, kept, total): each hit as ``{i}. [{path}]`` over its first whole lines; ``kept`` until the budget is spent.

    ``hits``: query_id, position from 1, path, text. Once a block doesn't fit, those after it don't come either.
    """
    block = F.concat(F.col("position").cast("string"), F.lit(". ["), F.coalesce("path", F.lit("")), F.lit("]\n"), whole_lines(F.coalesce("text", F.lit("")), trim))
    w = Window.partitionBy("query_id").orderBy("position")
    made = hits.select("query_id", "position", block.alias("block"))
    made = made.withColumn("kept", F.sum(F.length("block")).over(w.rowsBetween(Window.unboundedPreceding, 0)) <= budget)
    return made.withColumn("total", F.count("*").over(Window.partitionBy("query_id")))


def rendered(hits: DataFrame, trim: int = 600, budget: int = 3000) -> DataFrame:
    """(query_id, shown, total, answer): the kept blocks with an empty line between, and a note where some are left out."""
    made = blocks_within(hits, trim, budget)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("position", "block")))), lambda x: x["block"]), "\n\n")
    out = made.groupBy("query_id").agg(F.sum(F.col("kept").cast("int")).alias("shown"), F.max("total").alias("total"), joined.alias("answer"))
    note = F.concat(F.lit("[shown "), F.col("shown").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit("]"))
    whole = F.when(F.col("shown") == F.col("total"), F.col("answer")).when(F.col("shown") == 0, note).otherwise(F.concat("answer", F.lit("\n\n"), note))
    return out.withColumn("answer", whole)
