"""Line search, listings and limited reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import lines, rstrip


def matching_lines(files: DataFrame, path: str, content: str, query: str) -> DataFrame:
    """(path, line_no, line): lines that hold the query in any case, without white space at the end. A null or empty query finds nothing."""
    found = files.select(F.col(path).alias("path"), F.posexplode(lines(F.col(content))).alias("at", "line"))
    found = found.where(F.contains(F.lower("line"), F.lower(F.lit(query))) if query else F.lit(False))
    return found.select("path", (F.col("at") + 1).alias("line_no"), rstrip(F.col("line")).alias("line"))


def grep_each(files: DataFrame, path: str, content: str, query: str, most: int = 20) -> DataFrame:
    """(path, line_no, text, capped): in each file the first ``most`` matching lines as ``{n}: {line}``; ``capped`` where that many were reached."""
    found = matching_lines(files, path, content, query)
    order = Window.partitionBy("path").orderBy("line_no")
    found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    count = F.max("nth").over(Window.partitionBy("path"))
    return found.select("path", "line_no", F.concat(F.col("line_no").cast("string"), F.lit(": "), F.col("line")).alias("text"), (count >= most).alias("capped"))


def grep_tree(files: DataFrame, path: str, content: str, query: str, per_file: int = 3, most: int = 30) -> DataFrame:
    """(path, line_no, line): at most ``per_file`` lines a file, files in order of folder and name while the files before gave fewer than ``most``.

    The cap is looked at between files, so up to ``most + per_file - 1`` lines come
    out. Only the first ``most`` files with a hit can take part, so the running sum sees no more than these.
    """
    found = matching_lines(files, path, content, query)
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))).where(F.col("nth") <= per_file)
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    counts = found.groupBy("path").agg(F.count("*").alias("hits")).withColumn("folder", folder).withColumn("name", name)
    first = counts.orderBy("folder", "name", "path").limit(most)
    before = F.coalesce(F.sum("hits").over(Window.orderBy("folder", "name", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = first.withColumn("before", before).where(F.col("before") < most).select("path")
    return found.join(kept, "path").select("path", "line_no", "line")


def listing(files: DataFrame, path: str, most: int = 200) -> DataFrame:
    """(folder, name, kind, nth): the first ``most`` names in each folder in code-point order, ``[DIR]`` or ``[FILE]``.

    A folder is listed in the one above it if it holds a file at any depth.
    """
    steps = files.select(F.col(path).alias("_path")).where("_path is not null").distinct().select(F.split("_path", "/").alias("parts"))
    each = steps.select("parts", F.posexplode("parts").alias("depth", "name"))
    folder = F.array_join(F.slice("parts", 1, F.col("depth")), "/")
    kind = F.when(F.col("depth") == F.size("parts") - 1, "[FILE]").otherwise("[DIR]")
    names = each.select(F.when(F.col("depth") == 0, ".").otherwise(folder).alias("folder"), "name", kind.alias("kind")).distinct()
    nth = F.row_number().over(Window.partitionBy("folder").orderBy("name", "kind"))
    return names.withColumn("nth", nth).where(F.col("nth") <= most)
