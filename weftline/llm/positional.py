"""Pairs of records that agree at many positions of a signature.

A signature is an array with one value per position; a posting is (position,
value, id). Two records that belong together must agree at ``matches``
positions at least, so they meet in that many postings. Pairs are tallied and
kept if they reach this number.

A posting that very many records share isn't joined, as all pairs of its records would come out
whether they are alike or not. Records of such postings meet by their rarest elements instead
(``rare_pairs``): elements are put in one order for all records, rare ones first, and two sets with
a share of at least s of their union in common must have an element in common among the first
few of each, how few following from s. What a template brings to very many records comes
last in that order, so it makes no pair unless it makes the records alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.tables import durable

#: Buckets of elements whose sizes order the elements: two megabytes, whatever the corpus.
BUCKETS = 1 << 18
#: Records of one element from which they are dealt over several tasks.
SPLIT = 2000


def agreeing_pairs(signatures: DataFrame, matches: int, crowded: int = 256) -> tuple[DataFrame, DataFrame]:
    """(a, b) with a < b: pairs agreeing at ``matches`` or more positions of postings that aren't crowded; and (id): the records of crowded ones.

    ``signatures``: id, sig (array<bigint>, null at positions that do not count), one row per id.
    A pair that agrees at ``matches`` positions comes out, or both its records do. ``crowded`` is the number
    of records from which a posting isn't joined. No signatures give no rows.
    """
    postings = signatures.select("id", F.posexplode("sig").alias("pos", "value")).where("value is not null").select(F.xxhash64("pos", "value").alias("key"), "id")
    hot = durable(postings.groupBy("key").count().where(F.col("count") > crowded).select("key"))
    cold = postings if hot.isEmpty() else postings.join(hot, "key", "left_anti")
    met = cold.select("key", F.col("id").alias("a")).join(cold.select("key", F.col("id").alias("b")), "key").where("a < b")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("tally")).where(F.col("tally") >= matches).select("a", "b")
    return pairs, postings.join(hot, "key", "left_semi").select("id").distinct()


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _bucket_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for s in batch.column(0).to_pylist():
            np.add.at(total, _bucket(np.frombuffer(s, np.uint64)), 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])


def _firsts(sizes: np.ndarray, top: int):
    """The rare elements of each set that a similar set must share one of; ``leads`` where it is among those of the smaller set."""
    schema = pa.schema([("element", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("leads", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, s in zip(ids, sets):
                values = np.frombuffer(s, np.uint64)
                n = len(values)
                values = values[np.lexsort((values, sizes[_bucket(values)]))]
                left = n - np.arange(n)
                values = values[left * 1000 >= n * top]
                k = len(values)
                for part, x in zip(parts, (values.view(np.int64), np.full(k, i), np.full(k, n, np.int32), np.arange(k, dtype=np.int32), left[:k] * (1000 + top) >= 2 * top * n)):
                    part.append(x)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), f.type) for p, f in zip(parts, schema)], schema=schema)

    return run


def rare_pairs(sets: DataFrame, threshold: float, split: int = SPLIT) -> DataFrame:
    """(a, b), a < b: all pairs of sets that can have a share of ``threshold`` of their union in common, and few others.

    ``sets``: id, elements (64-bit numbers, ascending, as binary). The order of elements follows the number of
    occurrences in their bucket, then the element. Let s be the threshold and |x| <= |y|: the pair has at least s / (1 + s) (|x| + |y|) in common, so
    its first common element has as many left from there on, itself included, in x and in y. Elements of more
    than ``split`` records are dealt over tasks. No pair is lost, and there are no other bounds. Empty sets are in no pair.
    """
    top = round(threshold * 1000)
    counted = sets.select("elements").mapInArrow(_bucket_sizes, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    sizes = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted.collect():  # as many rows as there are buckets at most
        sizes[bucket] = n
    firsts = durable(sets.select("id", "elements").mapInArrow(_firsts(sizes, top), "element bigint, id bigint, n int, at int, leads boolean"))
    smaller = firsts.where("leads").select("element", *(F.col(c).alias(f"{c}_a") for c in ("id", "n", "at")))
    larger = firsts.select("element", *(F.col(c).alias(f"{c}_b") for c in ("id", "n", "at")))
    parts = durable(smaller.groupBy("element").count().where(F.col("count") > split).select("element", F.ceil(F.col("count") / split).cast("int").alias("parts")))
    if not parts.isEmpty():
        smaller = smaller.join(parts, "element", "left").withColumn("part", F.pmod(F.xxhash64("id_a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        larger = larger.join(parts, "element", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    met = smaller.join(larger, [c for c in ("element", "part") if c in smaller.columns])
    met = met.where("n_a < n_b or (n_a = n_b and id_a < id_b)").where(F.col("n_a") * 1000 >= F.col("n_b") * top)
    met = met.where(F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (1000 + top) >= top * (F.col("n_a") + F.col("n_b")))
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
