"""Exact vector search with the cosine metric."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.lexical import best
from weftline.sources.tables import durable


#: Queries of one pass: 80 MB of 200 numbers each.
QUERIES = 50_000


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, rounded to nine digits; null for a null or zero vector."""
    return F.round(1 - F.try_divide(dot(a, b), norm(a) * norm(b)), 9) + 0.0


def _measured(rows: DataFrame, id: str, vector: str, as_id: str, as_vector: str) -> DataFrame:
    """Ids, vectors as doubles and their lengths, without null and zero vectors."""
    read = rows.select(F.col(id).alias(as_id), _doubles(F.col(vector)).alias(as_vector))
    return read.withColumn(f"{as_vector}_norm", norm(F.col(as_vector))).where(F.col(f"{as_vector}_norm") > 0)


def _gathered_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an Arrow batch side by side, one row for each length of vectors: ids, and their vectors of unit length as a matrix."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        for size in np.unique(lengths[lengths > 0]).tolist():
            chosen = np.flatnonzero(lengths == size)
            flat = vectors.take(pa.array(chosen)).flatten()
            matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            norm = np.linalg.norm(matrix, axis=1)
            good = np.flatnonzero(norm > 0)
            if len(good):
                held = ids.take(pa.array(chosen[good]))
                lists = pa.ListArray.from_arrays(pa.array([0, len(good)], pa.int32()), held)
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), lists, pa.array([(matrix[good] / norm[good, None]).tobytes()], pa.binary())], ["size", "ids", "matrix"])


def _side_by_side(rows: DataFrame, id: str, vector: str) -> DataFrame:
    read = rows.select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    return read.mapInArrow(_gathered_rows, f"size int, ids array<{read.schema['id'].dataType.simpleString()}>, matrix binary")


def _products(n: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                size = batch.column(0)[k].as_py()
                asked, found = batch.column(1)[k].values, batch.column(3)[k].values
                q, m = (np.frombuffer(batch.column(c)[k].as_py()).reshape(-1, size) for c in (2, 4))
                far = np.round(1 - q @ m.T, 9) + 0.0
                if n is None or n >= far.shape[1]:
                    i, j = (x.ravel() for x in np.indices(far.shape))
                else:  # all that are as near as the n-th, as ties go by id
                    i, j = np.nonzero(far <= np.partition(far, n - 1, axis=1)[:, n - 1 : n])
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(i)), found.take(pa.array(j)), pa.array(far[i, j])], ["query_id", "id", "distance"])

    return run


def distances(corpus: DataFrame, id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, n: int | None = None) -> DataFrame:
    """(query_id, id, distance) for a stated set of queries against all rows. Null and zero vectors don't come out.

    Rows and queries meet as matrices, a batch of each at a time, by one product. With ``n`` only the n nearest of each
    batch of rows, and those as near as the last of them, leave the task. Vectors of different lengths don't meet.
    The queries are counted; every ``QUERIES`` of them are broadcast for one pass over the rows.
    """
    found, parts = _side_by_side(corpus, id, vector), max(1, -(-queries.count() // QUERIES))
    out = []
    for k in range(parts):
        some = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == k)
        asked = _side_by_side(some, query_id, query_vector).select("size", F.col("ids").alias("asked"), F.col("matrix").alias("q"))
        met = found.join(F.broadcast(asked), "size").select("size", "asked", "q", "ids", "matrix")
        kinds = [met.schema[c].dataType.elementType.simpleString() for c in ("asked", "ids")]
        out.append(met.mapInArrow(_products(n), f"query_id {kinds[0]}, id {kinds[1]}, distance double"))
    return reduce(DataFrame.unionByName, out)


def nearest(corpus: DataFrame, id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, n: int = 5) -> DataFrame:
    """(query_id, id, distance, rank): the ``n`` nearest rows of each query; ties by id."""
    return best(distances(corpus, id, vector, queries, query_id, query_vector, n), n, "distance", ascending=True)


def confidence(distance: Column) -> Column:
    """``high`` under 0.3, ``medium`` under 0.5, else ``low``."""
    return F.when(distance < 0.3, "high").when(distance < 0.5, "medium").otherwise("low")


def is_duplicate(distance: Column, threshold: float = 0.1) -> Column:
    """Whether the best match is so near that a fact isn't stored again; nothing stored means no."""
    return F.coalesce(distance < threshold, F.lit(False))


def _gathered(table: pa.Table) -> pa.Table:
    """A block's rows as one: its ids in order, and the vectors as one matrix."""
    table = table.sort_by("id")
    ids, matrix = table.column("id").to_numpy(), np.array(table.column("unit").to_pylist(), np.float64)
    keys = {k: table.column(k)[:1] for k in ("size", "x", "y", "part")}
    return pa.table({**keys, "ids": pa.array([ids.tolist()], pa.list_(pa.int64())), "matrix": pa.array([matrix.tobytes()], pa.binary())})


def _links(threshold: float):
    schema = pa.schema([("early", pa.int64()), ("late", pa.int64()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, ids_a, a, ids_b, b in zip(*(c.to_pylist() for c in batch.columns)):
                u, v = np.frombuffer(a).reshape(-1, size), np.frombuffer(b).reshape(-1, size)
                far = np.round(1 - u @ v.T, 9) + 0.0
                i, j = np.nonzero(far < threshold)
                x, y = np.array(ids_a, np.int64)[i], np.array(ids_b, np.int64)[j]
                near = x < y
                yield pa.RecordBatch.from_arrays([pa.array(x[near]), pa.array(y[near]), pa.array(far[i, j][near])], schema=schema)

    return run


def near_pairs(rows: DataFrame, id: str, vector: str, threshold: float = 0.1, block: int = 200) -> DataFrame:
    """(early, late, distance), early < late: all pairs of rows that are nearer than ``threshold``.

    Vectors lie in cells by their angles to two of them. The angles of two near vectors differ
    by no more than their own angle (triangle inequality), so only cells side by side meet, in
    blocks of some ``block`` vectors. Vectors of different lengths, null and zero vectors are near to none.
    """
    units = _measured(rows, id, vector, "id", "_vector").select(F.col("id").cast("bigint").alias("id"), F.transform("_vector", lambda x: x / F.col("_vector_norm")).alias("unit"))
    units = durable(units.withColumn("size", F.size("unit")))
    pivots = [list(r["unit"]) for r in units.orderBy("id").limit(2).collect()]
    width = acos(1 - threshold) + 1e-6

    def cell(k: int) -> Column:
        pivot = F.array(*map(F.lit, pivots[k % len(pivots)])) if pivots else F.col("unit")
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("unit"), pivot))))
        return F.coalesce(F.floor(angle / width), F.lit(0)).cast("int")

    form = "size int, x int, y int, part int, ids array<bigint>, matrix binary"
    cells = units.withColumn("x", cell(0)).withColumn("y", cell(1))
    counts = cells.groupBy("size", "x", "y").agg(F.ceil(F.count("*") / block).alias("parts"))
    cells = cells.join(counts, ["size", "x", "y"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    held = durable(cells.groupBy("size", "x", "y", "part").applyInArrow(_gathered, form))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    beside = held.withColumn("to", around).select("size", (F.col("x") + F.col("to.dx")).alias("x"), (F.col("y") + F.col("to.dy")).alias("y"), F.col("ids").alias("ids_b"), F.col("matrix").alias("b"))
    met = held.join(beside, ["size", "x", "y"]).select("size", "ids", F.col("matrix").alias("a"), "ids_b", "b")
    return met.mapInArrow(_links(threshold), "early bigint, late bigint, distance double")


def decided(rows: DataFrame, id: str, vector: str, threshold: float = 0.1) -> DataFrame:
    """(id, nearest, distance, rejected), one row per row: whether a fact is stored again if all come in turn by id.

    A fact is rejected if an accepted earlier one is nearer than ``threshold``; the nearest of these is named,
    ties by id. In every round those without an open earlier link are accepted, and those linked to them rejected.
    """
    pairs = durable(near_pairs(rows, id, vector, threshold))
    ids = rows.select(F.col(id).cast("bigint").alias("id"))
    links, refused = pairs.select("early", "late"), ids.where("false")
    while not links.isEmpty():
        first = links.select(F.col("early").alias("id")).distinct().join(links.select(F.col("late").alias("id")), "id", "left_anti")
        out = durable(links.join(first.withColumnRenamed("id", "early"), "early", "left_semi").select(F.col("late").alias("id")).distinct())
        refused = refused.unionByName(out)
        links = links.join(out.withColumnRenamed("id", "late"), "late", "left_anti").join(out.withColumnRenamed("id", "early"), "early", "left_anti")
        links = durable(links.select("early", "late"))
    stored = pairs.join(refused.withColumnRenamed("id", "early"), "early", "left_anti").join(refused.withColumnRenamed("id", "late"), "late", "left_semi")
    nearest = stored.groupBy(F.col("late").alias("id")).agg(F.min(F.struct("distance", "early")).alias("near"))
    return ids.join(nearest, "id", "left").select("id", F.col("near.early").alias("nearest"), F.col("near.distance").alias("distance"), F.col("near").isNotNull().alias("rejected"))
