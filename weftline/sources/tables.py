"""Reading the input tables and keeping intermediate ones.

``durable`` cuts lineage with a table written to the folder that the cluster
names in ``spark.checkpoint.dir``: it survives the loss of any executor, is
columnar and compressed, and is read again with column pruning.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = f"weftline-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of an input folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores where their files are so small that Spark would read them in fewer tasks; else as they are.

    For work in Python on each row. What it shuffles is 4 MB of files a core at most.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= cores * (4 << 20) else rows


def stamp(spark: SparkSession, path: str) -> str:
    """What changes when a table's files do: their names, lengths and times."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while listed.hasNext():
        f = listed.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (a local master)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/{_RUN}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before
        pass


_cleaned: set[str] = set()


def durable(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` computed once into the shared folder and read back from there; ``by`` names a column of few values to part it by."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    rows = df.write.option("compression", "zstd")
    (rows.partitionBy(by) if by else rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
