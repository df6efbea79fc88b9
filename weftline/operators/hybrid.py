"""Hybrid search: reciprocal rank fusion of two rankings, with demotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import extension
from weftline.sources.tables import durable

# Endings of documentation, and what marks a prompt's example.
DOCUMENTATION = (".md", ".rst", ".txt")
DEMOTION = 0.3
K = 60


def pool_size(n: int) -> int:
    """How many candidates each ranking gives before fusion."""
    return max(4 * n, 20)


def contribution(rank: Column, k: int = K) -> Column:
    """1 / (k + rank), 0 for no rank."""
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))


def is_documentation(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*DOCUMENTATION), F.lit(False))


def is_prompt_example(text: Column) -> Column:
    """Holds ``observation from`` and ``assistant:`` or ``user:``, in any case."""
    low = F.lower(text)
    return F.coalesce(F.contains(low, F.lit("observation from")) & (F.contains(low, F.lit("assistant:")) | F.contains(low, F.lit("user:"))), F.lit(False))


def demotion(path: Column, text: Column) -> Column:
    """The factor for a hit: 0.3 for documentation, 0.3 for a prompt's example, their product for both."""
    return F.when(is_documentation(path), DEMOTION).otherwise(1.0) * F.when(is_prompt_example(text), DEMOTION).otherwise(1.0)


def fuse(vector: DataFrame, lexical: DataFrame, mode: str = "hybrid", k: int = K) -> DataFrame:
    """(query_id, id, vector_rank, bm25_rank, vector_score, bm25_score, rrf) of a full outer join of two rankings.

    ``vector``: query_id, id, distance, rank; ``lexical``: query_id, id, score, rank. A missing side gives no rank and 0. ``mode``: ``vector`` or
    ``bm25`` take one side only; an unknown mode finds nothing.
    """
    v = vector.select("query_id", "id", F.col("rank").alias("vector_rank"), (1 - F.col("distance")).alias("vector_score"))
    b = lexical.select("query_id", "id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    if mode == "vector":
        b = b.where(F.lit(False))
    elif mode == "bm25":
        v = v.where(F.lit(False))
    elif mode != "hybrid":
        v, b = v.where(F.lit(False)), b.where(F.lit(False))
    both = v.join(b, ["query_id", "id"], "full_outer")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("vector_score", "bm25_score")]
    return both.select("query_id", "id", "vector_rank", "bm25_rank", *zero, (contribution(F.col("vector_rank"), k) + contribution(F.col("bm25_rank"), k)).alias("rrf"))


def ranked(fused: DataFrame, details: DataFrame, n: int = 5, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The ``n`` best hits of each query after demotion, with ``position`` from 1; of each value of the columns ``by``.

    The fused candidates are written first: being few, they are broadcast by their measured size and no text is shuffled. ``details``: id, path, text. Ties by vector rank, then lexical rank, missing ones last, then id.
    """
    fused = durable(fused)
    known = details.select("id", "path", "text").join(fused.select("id").distinct(), "id", "left_semi")
    found = fused.join(known, "id", "left")
    found = found.withColumn("score", F.round(F.col("rrf") * demotion(F.col("path"), F.col("text")), 9))
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), "id")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
