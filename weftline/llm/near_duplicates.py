"""Near-duplicate records: a byte-position inverted index with count filtering.

A record is the set of its sequences of three words (five by default for other
corpora). Its signature has ``POSITIONS`` places of four bytes: the smallest
value of that many hash functions over the set. Two sets with a share s of
their union in common agree at each place with probability s, so a pair at the
threshold reaches ``guaranteed(POSITIONS, threshold)`` places except with the
documented probability ``MISS``. The places of four bytes are indexed by position,
the positions shared are tallied for each pair, pairs that reach the guaranteed
minimum are kept, and the exact share of the union decides. Records of positions that very many share
meet by their rarest sequences instead, which loses no pair (``positional``).

A place has four bytes, not one: a single byte would put a 256th of all records
into each posting, which is quadratic in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.codepoints import blocks, distinct_within, mix, strip_line_numbers, word_hashes
from weftline.llm.positional import SPLIT, agreeing_pairs, rare_pairs
from weftline.operators.components import components
from weftline.sources.tables import durable, spread

POSITIONS = 16
MISS = 1e-5

_SKETCH = pa.schema([("id", pa.int64()), ("copy", pa.binary()), ("sig", pa.list_(pa.int64())), ("shingles", pa.binary())])


def guaranteed(positions: int, threshold: float, miss: float = MISS) -> int:
    """The number of positions that a pair at the threshold agrees at, but for a probability of ``miss``."""
    total = 0.0
    for k in range(positions + 1):
        total += comb(positions, k) * threshold**k * (1 - threshold) ** (positions - k)
        if total > miss:
            return max(1, k)
    return positions


def _sketches(words: int, positions: int, numbered: bool):
    seeds = mix(np.arange(1, positions + 1, dtype=np.uint64))
    steps = mix(np.arange(101, 101 + words, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [t if t is None else (strip_line_numbers(t) if numbered else t).lower() for t in batch.column(1).to_pylist()]
            for at, block in blocks(texts):
                hashes, text = word_hashes(block)
                n = len(hashes) - words + 1
                if n < 1:
                    continue
                gram = np.zeros(n, dtype=np.uint64)
                for k, step in enumerate(steps):
                    gram += hashes[k : k + n] * step
                whole = text[:n] == text[words - 1 :]
                gram, owner = distinct_within(mix(gram[whole]), text[:n][whole])
                if not len(gram):
                    continue
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                owners = owner[first]
                sig = np.empty((len(first), positions), dtype=np.int64)
                for k, seed in enumerate(seeds):
                    sig[:, k] = np.minimum.reduceat((gram ^ seed) * (seed | np.uint64(1)) >> np.uint64(32), first)
                bound = np.append(first, len(gram))
                word_at = np.searchsorted(text, np.arange(len(at) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at[owners]], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(hashes[word_at[o] : word_at[o + 1]].tobytes()) for o in owners.tolist()], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * positions, pa.int32()), pa.array(sig.ravel())),
                        pa.array([gram[a:b].tobytes() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())], pa.binary()),
                    ],
                    schema=_SKETCH,
                )

    return run


def _verified(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("share", pa.float64())])
    top = round(threshold * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            keep, share = [], []
            for i, (x, y) in enumerate(zip(left, right)):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(u, v, assume_unique=True))
                union = len(u) + len(v) - common
                if common * 1000 >= union * top:
                    keep.append(i)
                    share.append(common / union)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array(share, pa.float64())], schema=schema)

    return run


class NearDuplicates:
    """Near-duplicate records of a table.

    ``classes``: (id, rep) for every record with at least ``words`` words, where
    rep is the smallest id with the same words in the same order.
    ``links``: (a, b, share), a < b, between representatives whose share of the
    union of their word sequences is at least ``threshold``.

    Null, empty and short texts have no sequences and are in no pair. Copies are
    one class and never expanded unless ``pairs`` is asked for. Ids that occur twice are
    records of their own in no way: give unique ids. Extra columns are ignored.
    Sequences are compared by 64-bit hashes. ``exact``: all pairs meet by their rarest sequences,
    so that none is missed with any probability. ``crowded``: the number of records from which a position's value
    isn't joined; it changes the work, not the pairs.
    """

    def __init__(self, records: DataFrame, id: str, text: str, words: int = 5, threshold: float = 0.8, numbered: bool = False, exact: bool = False, crowded: int = 256):
        picked = records.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where("text is not null")
        sketch = durable(spread(picked).mapInArrow(_sketches(words, POSITIONS, numbered), "id bigint, copy binary, sig array<bigint>, shingles binary"))
        first = sketch.groupBy("copy").agg(F.min("id").alias("rep"))
        self.classes = durable(sketch.select("id", "copy").join(first, "copy").select("id", "rep"))
        chosen = self.classes.where("id = rep").select("id")
        sets = sketch.select("id", F.col("shingles").alias("elements"))
        if exact:
            candidates = rare_pairs(durable(sets.join(chosen, "id")), threshold)
        else:
            signatures = durable(sketch.select("id", "sig").join(chosen, "id"))
            candidates, crowd = agreeing_pairs(signatures, guaranteed(POSITIONS, threshold), crowded)
            crowd = durable(crowd)
            if not crowd.isEmpty():
                candidates = candidates.unionByName(rare_pairs(durable(sets.join(crowd, "id")), threshold)).distinct()
        candidates = durable(candidates)
        touched = candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct()
        few = sketch.select("id", "shingles").join(touched, "id", "left_semi")
        both = candidates.join(few.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
        both = both.join(few.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
        self.candidates = candidates
        self.links = durable(both.select("a", "b", "left", "right").mapInArrow(_verified(threshold), "a bigint, b bigint, share double"))

    def groups(self) -> DataFrame:
        """(id, group, links): every record with its group, the smallest id it is connected with, and the number of representatives linked with its own."""
        ends = self.links.select(F.col("a").alias("rep")).union(self.links.select("b")).groupBy("rep").agg(F.count("*").alias("links"))
        joined = components(self.links).withColumnRenamed("id", "rep")
        out = self.classes.join(joined, "rep", "left").join(ends, "rep", "left")
        return out.select("id", F.coalesce("component", "rep").alias("group"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))

    def pairs(self) -> DataFrame:
        """(a, b), a < b: every pair of records, copies written out. As many rows as there are pairs; large classes are dealt over tasks."""
        member = self.classes
        parts = member.groupBy("rep").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
        split = member.join(parts.where("parts > 1"), "rep", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        left = split.select("rep", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        right = split.select("rep", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        copies = left.join(right, ["rep", "part"]).where("x < y").select("x", "y")
        all_x, all_y = member.select(F.col("rep").alias("a"), F.col("id").alias("x")), member.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        both = copies.unionByName(self.links.join(all_x, "a").join(all_y, "b").select("x", "y"))
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
