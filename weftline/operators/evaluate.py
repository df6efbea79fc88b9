"""Retrieval quality: first relevant rank, hit rate and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_relevant(hits: DataFrame, cases: DataFrame, modes: list[str]) -> DataFrame:
    """(mode, query_id, rank): the position of the first hit whose path is expected, for every case and mode; null where none is.

    ``hits``: mode, query_id, path, position; ``cases``: query_id, expected. A case that expects nothing (null) has no rank.
    """
    spark = hits.sparkSession
    every = cases.select("query_id", "expected").crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in modes], "mode string")))
    joined = every.join(hits, ["mode", "query_id"], "left")
    return joined.groupBy("mode", "query_id").agg(F.min(F.when(F.array_contains("expected", F.col("path")), F.col("position"))).alias("rank"))


def quality(ranks: DataFrame) -> DataFrame:
    """(mode, hits, total, hit_rate, mrr); a miss adds 0 to the mean."""
    found = F.col("rank").isNotNull().cast("int")
    return ranks.groupBy("mode").agg(
        F.sum(found).alias("hits"), F.count("*").alias("total"), F.round(F.avg(found.cast("double")), 9).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 9).alias("mrr")
    )


def deltas(qualities: DataFrame, against: str = "vector") -> DataFrame:
    """(mode, hit_rate_delta, mrr_delta): what each other mode gains over one."""
    base = qualities.where(F.col("mode") == against).select(F.col("hit_rate").alias("h"), F.col("mrr").alias("m"))
    others = qualities.where(F.col("mode") != against).crossJoin(F.broadcast(base))
    return others.select("mode", F.round(F.col("hit_rate") - F.col("h"), 9).alias("hit_rate_delta"), F.round(F.col("mrr") - F.col("m"), 9).alias("mrr_delta"))


def misses(ranks: DataFrame) -> DataFrame:
    return ranks.where("rank is null").select("mode", "query_id")


def against(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, found, expected, equal) of two labellings; equal also where both are null."""
    both = found.select(key, F.col("label").alias("found")).join(expected.select(key, F.col("label").alias("expected")), key)
    return both.withColumn("equal", F.col("found").eqNullSafe(F.col("expected")))
