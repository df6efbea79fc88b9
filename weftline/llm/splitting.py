"""Splitting oversized texts at natural boundaries: content-defined chunking.

A rolling hash over the last ``WINDOW`` characters marks landmarks, places that
depend on the text around them only. From the last cut, the first landmark
between the least and the greatest size of a piece is the aim (the greatest size
where there is none); the cut is the paragraph end nearest to the aim, or the
nearest line end, sentence end or word gap where the better ones don't occur
between those sizes, or the aim itself in text without any. So an edit moves the cuts
next to it, and the cuts come together again at the next landmark.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.codepoints import Block, blocks, span_hash, strip_line_numbers

WINDOW = 24
#: Characters that end a sentence when white space follows.
SENTENCE_ENDS = ".!?…。！？"
_PIECE = pa.schema([("id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("piece", pa.string())])


def _boundaries(block: Block) -> tuple[list[np.ndarray], np.ndarray]:
    """Places of the block after a paragraph, line, sentence and word, and landmarks, each ascending."""
    c = block.codes
    n = len(c)
    newline = c == 10
    space = newline | (c == 32) | (c == 9) | (c == 13) | (c == 0xA0)
    ends = np.isin(c, np.array([ord(x) for x in SENTENCE_ENDS], np.uint32))
    line = np.flatnonzero(newline[:-1]) + 1
    blank = np.flatnonzero(newline[1:-1] & newline[:-2]) + 2
    sentence = np.flatnonzero(space[1:-1] & ends[:-2]) + 2
    word = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if n <= WINDOW:
        return [blank, line, sentence, word], np.zeros(0, np.int64)
    at = np.arange(n - WINDOW + 1)
    h = span_hash(block.prefix(), at, at + WINDOW)
    return [blank, line, sentence, word], np.flatnonzero(h >> np.uint64(56) == 0) + WINDOW


def _nearest(places: np.ndarray, aim: int, lo: int, hi: int) -> int:
    """The place in [lo, hi] nearest to the aim, or -1; of two the earlier."""
    i = bisect_left(places, aim)
    after = places[i] if i < len(places) and places[i] <= hi else -1
    before = places[i - 1] if i and places[i - 1] >= lo else -1
    if after < 0 or (before >= 0 and aim - before <= after - aim):
        return int(before)
    return int(after)


def _cuts(kinds: list[np.ndarray], landmarks: np.ndarray, begin: int, end: int, least: int, most: int) -> list[int]:
    out = []
    cut = begin
    while end - cut > most:
        # what is left must not become a piece under the least size
        lo, hi = cut + least, min(cut + most, max(cut + least, end - least))
        i = bisect_right(landmarks, lo)
        aim = int(landmarks[i]) if i < len(landmarks) and landmarks[i] <= hi else hi
        for places in kinds:
            if (near := _nearest(places, aim, lo, hi)) >= 0:
                break
        else:
            near = aim
        out.append(near)
        cut = near
    return out


def _split(limit: int, overlap: int, numbered: bool):
    most, least = limit - overlap, max(1, (limit - overlap) // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            if numbered:
                texts = [None if t is None else strip_line_numbers(t) for t in texts]
            out: list[list] = [[], [], [], [], [], []]

            def put(i: int, bounds: list[tuple[int, int]]) -> None:
                for k, (a, b) in enumerate(bounds):
                    for column, value in zip(out, (ids[i], k, len(bounds), a, b, texts[i][a:b])):
                        column.append(value)

            long = [t if t is not None and len(t) > limit else None for t in texts]
            for i, t in enumerate(texts):
                if t is not None and long[i] is None:
                    put(i, [(0, len(t))])
            for at, block in blocks(long):
                kinds, landmarks = _boundaries(block)
                for i, begin, length in zip(at.tolist(), block.start.tolist(), block.length.tolist()):
                    # the first piece has nothing to repeat, so its room is the whole limit
                    cuts = [c - begin for c in _cuts(kinds, landmarks, begin, begin + length, least, most)]
                    starts = [0, *(max(0, c - overlap) for c in cuts)]
                    put(i, list(zip(starts, [*cuts, length])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(out, _PIECE)], schema=_PIECE)

    return run


def pieces(records: DataFrame, id: str, text: str, limit: int = 1000, overlap: int = 100, numbered: bool = False) -> DataFrame:
    """(id, piece_no, n_pieces, begin, end, piece): every text as ordered pieces of at most ``limit`` characters.

    A piece after the first repeats the last ``overlap`` characters of the one
    before; without them, the pieces joined are the text. A text within the
    limit, also an empty one, is one piece. Null texts have no piece. Repeated
    rows are split each for itself. Extra columns are ignored. No shuffle.
    """
    picked = records.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return picked.mapInArrow(_split(limit, overlap, numbered), "id bigint, piece_no int, n_pieces int, begin int, end int, piece string")


def renumbered(counts: DataFrame, group: str, order: list[str], pieces_of: str = "n_pieces", span: int = 4096) -> DataFrame:
    """``counts`` with ``shift``: the pieces beyond the first of all rows of the group before this one.

    The sums run in two levels, over stretches of about ``span`` rows and inside each,
    so that a group with a third of all rows is not one task. Rows are dealt to
    stretches by the first column of ``order``; null sorts first.
    """
    extra = F.greatest(F.col(pieces_of) - 1, F.lit(0))
    stretch = F.floor(F.coalesce(F.col(order[0]), F.lit(-1)) / span)
    rows = counts.withColumn("_stretch", stretch)
    sums = rows.groupBy(group, "_stretch").agg(F.sum(extra).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(group).alias("_group"), F.col("_stretch").alias("_s"), before.alias("_before"))
    inside = F.coalesce(F.sum(extra).over(Window.partitionBy(group, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_inside", inside)
    joined = rows.join(sums, rows[group].eqNullSafe(sums["_group"]) & (rows["_stretch"] == sums["_s"]))
    return joined.withColumn("shift", F.col("_before") + F.col("_inside")).drop("_stretch", "_group", "_s", "_before", "_inside")
