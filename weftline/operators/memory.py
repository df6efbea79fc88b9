"""Collections of stored rows: upsert, insert, delete, clear, and facts kept in mind."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import is_blank
from weftline.sources.tables import stamp


def latest(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The last row of each key by ``order``: what remains after upserting rows one after the other."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*[o.desc_nulls_last() for o in order]))).where("_nth = 1").drop("_nth")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``new``, which replace those of the same key; a null key never matches."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def replace_by(stored: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """``stored`` without any row of the groups in ``new``, and the rows of ``new``: a file indexed again leaves no stale tail."""
    return stored.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def delete(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``stored`` without the rows of the given keys; unknown and repeated keys change nothing."""
    return stored.join(keys.select(key), key, "left_anti")


def facts_from(arguments: Column) -> Column:
    """Named arguments as one text, ``k: v | k: v``."""
    return F.array_join(F.transform(F.map_entries(arguments), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")


def listed(facts: DataFrame, id: str, content: str, category: str, fallback: str = "general", n: int = 10) -> DataFrame:
    """The first ``n`` stored facts by id, with a category for those that have none."""
    kept = facts.where(~is_blank(F.col(content)))
    return kept.orderBy(id).limit(n).select(F.col(id), F.coalesce(F.col(category), F.lit(fallback)).alias("category"), F.col(content))


def wants_memory(text: Column, save: list[str], skip: list[str]) -> Column:
    """``skip`` if a text holds a word of that list, else ``save`` if one of the other, else ``none``."""

    def holds(words: list[str]) -> Column:
        return F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(F.lower(text), k))

    return F.when(holds(skip), "skip").when(holds(save), "save").otherwise("none")


class Collection:
    """Rows of one name kept as parquet in a folder.

    A change writes a new version beside the old one and then names it the current
    one, so readers never see half a change.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.root = spark, f"{folder}/{name}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT")
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self) -> str | None:
        if not self._fs.exists(self._path):
            return None
        return self.spark.read.text(str(self._path.toString())).first()[0]

    def read(self, schema: str) -> DataFrame:
        """The current rows; none before anything was written."""
        version = self._current()
        return self.spark.createDataFrame([], schema) if version is None else self.spark.read.schema(schema).parquet(f"{self.root}/{version}")

    def version(self) -> str | None:
        """What changes with every change of the rows."""
        return stamp(self.spark, self.root) if self._fs.exists(self._path) else None

    def write(self, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{version}")
        out = self._fs.create(self._path, True)
        out.write(bytearray(version.encode()))
        out.close()

    def upsert(self, rows: DataFrame, key: str, schema: str) -> None:
        self.write(upsert(self.read(schema), rows, key))

    def insert(self, rows: DataFrame) -> None:
        """Add rows without looking for their keys."""
        version = self._current()
        if version is None:
            self.write(rows)
        else:
            rows.write.mode("append").parquet(f"{self.root}/{version}")

    def delete(self, keys: DataFrame, key: str, schema: str) -> None:
        self.write(delete(self.read(schema), keys, key))

    def clear(self, schema: str) -> None:
        self.write(self.spark.createDataFrame([], schema))
