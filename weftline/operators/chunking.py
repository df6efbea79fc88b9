"""Line-aware overlapping chunks.

Lines are packed greedily: a line that would exceed the size closes the chunk, and
the next one begins with the last ``overlap`` lines of it, if it had more. Lines are never
split, so a chunk can exceed the size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import is_blank, lines, strip, unix_lines
from weftline.sources.tables import spread

_STATE = "struct<out:array<struct<start:int,n:int>>,start:int,n:int,size:bigint,recent:array<int>>"


def _ranges(parts: Column, size: int, overlap: int) -> Column:
    """The chunks of some lines as (start, n), start from 0. Only line numbers and sizes go through the fold, no text."""
    begin = F.expr(f"cast(named_struct('out', array(), 'start', 0, 'n', 0, 'size', 0L, 'recent', array()) as {_STATE})")

    def step(a: Column, one: Column) -> Column:
        full = (a["size"] + one > size) & (a["n"] > 0)
        keep = full & (a["n"] > overlap) & F.lit(overlap > 0)
        out = F.when(full, F.array_append(a["out"], F.struct(a["start"].alias("start"), a["n"].alias("n")))).otherwise(a["out"])
        start = F.when(keep, a["start"] + a["n"] - overlap).when(full, a["start"] + a["n"]).otherwise(a["start"])
        n = F.when(keep, F.lit(overlap + 1)).when(full, F.lit(1)).otherwise(a["n"] + 1)
        kept = F.aggregate(a["recent"], F.lit(0).cast("bigint"), lambda s, x: s + x)
        new_size = F.when(keep, kept + one).when(full, one).otherwise(a["size"] + one)
        recent = F.slice(F.array_append(a["recent"], one.cast("int")), F.greatest(F.size(a["recent"]) + 2 - overlap, F.lit(1)), max(overlap, 1))
        state = F.struct(out.alias("out"), start.cast("int").alias("start"), n.cast("int").alias("n"), new_size.cast("bigint").alias("size"), recent.alias("recent"))
        return state.cast(_STATE)

    folded = F.aggregate(F.transform(parts, lambda x: F.length(x) + 1), begin, step)
    return F.when(folded["n"] > 0, F.array_append(folded["out"], F.struct(folded["start"].alias("start"), folded["n"].alias("n")))).otherwise(folded["out"])


def chunks(files: DataFrame, path: str, content: str, size: int = 1000, overlap: int = 3) -> DataFrame:
    """(path, chunk_index, start_line, n_lines, clean, numbered): every file's chunks.

    ``start_line`` counts from 1; ``numbered`` carries ``{n}: `` before each line. ``\\r\\n`` and
    ``\\r`` are read as ``\\n``. An empty text is one chunk of one empty line; a null text has none. Files of one path are chunked each for itself.
    """
    read = files.select(F.col(path).alias("path"), lines(unix_lines(F.col(content))).alias("parts")).where("parts is not null")
    cut = read.select("path", "parts", F.posexplode(_ranges(F.col("parts"), size, overlap)).alias("chunk_index", "range"))
    some = F.slice("parts", F.col("range.start") + 1, F.col("range.n"))
    numbered = F.transform(some, lambda x, i: F.concat((F.col("range.start") + 1 + i).cast("string"), F.lit(": "), x))
    return cut.select(
        "path",
        "chunk_index",
        (F.col("range.start") + 1).alias("start_line"),
        F.col("range.n").alias("n_lines"),
        F.array_join(some, "\n").alias("clean"),
        F.array_join(numbered, "\n").alias("numbered"),
    )


def indexed(files: DataFrame, path: str, content: str, size: int = 1000, overlap: int = 3, least: int = 20) -> DataFrame:
    """The chunks that are stored, with their ids: files that aren't blank, chunks of at least ``least`` characters when stripped.

    ``chunk_index`` isn't renumbered where short chunks are left out.
    """
    found = chunks(spread(files.select(path, content)).where(~is_blank(F.col(content))), path, content, size, overlap).where((F.length("clean") >= least) & (F.length(strip(F.col("clean"))) >= least))
    return found.withColumn("id", F.concat("path", F.lit("::chunk"), F.col("chunk_index").cast("string")))
