"""Deduplicating new batches against all history: a pivot-distance table.

A record is the set of its distinct words. The metric is the number of words in
one of two sets only, d(x, y); the share common / union is at least 0.8 exactly
if d(x, y) <= (|x| + |y|) / 9, and then |x| and |y| differ by a factor of 1.25 at most.

The pivots are the empty set and ``PIVOTS`` halves of all words, dealt by the bits of a hash.
The table keeps each accepted fact's distances to them, |x| and d(x, P) - |P| = |x| - 2 |x and P|;
|P| is the same for all x. By the triangle inequality d(x, y) is at least the difference of the
distances of x and y to any pivot, so a pair with one difference beyond (|x| + |y|) / 9 is
pruned before any word is read.

The join that brings the pairs together runs within ranges of the distance to the empty set, the size. Up to ``SMALL``
words a range is a pair of sizes n and m, so near sets have o = 4 (n + m) / 9 words in common at least. The words of a set are
taken in one order for all facts, common words last; of its first n - o + 2 words and the other's first m - o + 2 a near pair has two
in common, and the keys are those pairs of words. What a template repeats comes last, so that every key has a word of the fact's own.

Larger sets are in ranges by the factor 1.25; a range is joined with itself and the one below. Within a range d(x, y) <= r
for the r of its largest sets. The words are dealt into r + k classes, of which a near pair has the same words in
k at least (distance 0 there). The classes lie in k - 1 groups, so two of these k are in one group: the keys of
a fact are its words in any two classes of one group, and near pairs agree in one key at least.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.codepoints import blocks, distinct_within, mix, word_hashes
from weftline.sources.tables import durable, shared_folder, spread

PIVOTS = 8
#: Facts of a batch up to which their keys (some thirty a fact, a hundred bytes each) are broadcast to the history's scan; beyond it both sides are shuffled.
HELD = 30_000
#: Pairs up to which their ids are broadcast to the scan of the word sets, and decided on in one task; beyond it in joins and rounds of joins.
FEW = 200_000
#: Sets of up to so many words have pairs of words for keys; the last size of a range by the factor 1.25.
SMALL = 22
#: Words that are told apart by how common they are, the most common of all; the others come before them. Any order gives the same result.
COMMON = 65_536
#: Pairs of new facts under one key, in all, up to which they are all looked at; beyond it facts meet the first under their keys before.
CROWD = 20_000_000
_LAST = 2**31 - 1
_FAR = [f"d{k}" for k in range(PIVOTS)]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_DISTANCES = ", ".join(f"{c} int" for c in ("n", *_FAR))
_KEYS = "keys array<struct<block:int,own:boolean,key:bigint>>"
_FORM = f"id bigint, batch int, words binary, {_DISTANCES}, {_KEYS}"
_LINK = pa.schema([("early", pa.int64()), ("late", pa.int64()), ("turn", pa.int32())])


def size_range(n: int) -> int:
    return floor(log(n) / log(1.25) + 1e-9)


def radius(block: int) -> int:
    """The largest distance of two near sets of this range."""
    return 2 * floor(1.25 ** (block + 1) + 1e-6) // 9


@lru_cache(None)
def joint_classes(block: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of classes of a range, and the pairs of classes that make its keys: those of one group, with four classes in a group at most."""
    r = radius(block)
    agreeing = max(4, ceil((r + 4) / 3))
    classes, groups = r + agreeing, agreeing - 1
    pairs = [(i, j) for i in range(classes) for j in range(i + groups, classes, groups)]
    return classes, np.array([i for i, _ in pairs]), np.array([j for _, j in pairs])


def first_words(n: int, m: int) -> tuple[int, int]:
    """How many first words of a set of n meet those of a set of m, and how many of them near sets have in common."""
    common = -(-4 * (n + m) // 9)
    joint = min(2, common)
    return n - common + joint, joint


def _class_keys(values: np.ndarray, fact: np.ndarray, ranges: np.ndarray) -> Iterator[tuple[np.ndarray, int, bool, np.ndarray]]:
    """(facts, range, whether it is their own, keys) of the sets that may be near to one beyond ``SMALL``."""
    scrambled, last = mix(values), size_range(SMALL)
    for above in (0, 1):
        for b in np.unique(ranges[ranges + above > last]):
            chosen = np.flatnonzero(ranges == b)
            place = np.full(len(ranges), -1)
            place[chosen] = np.arange(len(chosen))
            here = place[fact] >= 0
            classes, i, j = joint_classes(int(b) + above)
            held = np.zeros((len(chosen), classes), np.uint64)
            np.add.at(held, (place[fact[here]], ((values[here] >> np.uint64(32)) % np.uint64(classes)).astype(np.int64)), scrambled[here])
            yield chosen, int(b) + above, not above, mix(held[:, i] * _ODD + mix(held[:, j] + np.arange(len(i), dtype=np.uint64)))


def _word_keys(values: np.ndarray, sizes: np.ndarray, order: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, int, bool, np.ndarray]]:
    """The same for sets of up to ``SMALL`` words; a pair of sizes is a range below zero, and each set's own."""
    fact = np.repeat(np.arange(len(sizes)), sizes)
    at = np.minimum(np.searchsorted(order, values), max(len(order) - 1, 0))
    rank = np.where(order[at] == values, place[at], -1) if len(order) else np.full(len(values), -1)
    scrambled = mix(values[np.lexsort((values, rank, fact))])
    begin = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes <= SMALL]).tolist():
        chosen = np.flatnonzero(sizes == n)
        ordered = scrambled[begin[chosen][:, None] + np.arange(n)]
        for m in range(-(-4 * n // 5), min(5 * n // 4, SMALL) + 1):
            first, joint = first_words(n, m)
            i, j = np.triu_indices(first, joint - 1)
            if joint == 1:
                i, j = i[i == j], j[i == j]
            yield chosen, -(min(n, m) * 64 + max(n, m)), True, mix(ordered[:, i] * _ODD + ordered[:, j])


def _keys(order: np.ndarray, place: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds each fact's keys; ``order`` are the common words, ascending, ``place`` how common each is."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64)
            sizes = batch.column("n").to_numpy().astype(np.int64)
            ranges = np.array([size_range(int(x)) for x in sizes])
            made = [*_class_keys(values, np.repeat(np.arange(len(sizes)), sizes), ranges), *_word_keys(values, sizes, order, place)]
            fact = np.concatenate([np.repeat(c, k.shape[1]) for c, _, _, k in made])
            where = np.concatenate([np.full(k.size, b, np.int32) for _, b, _, k in made])
            own = np.concatenate([np.full(k.size, o) for _, _, o, k in made])
            key = np.concatenate([k.ravel() for *_, k in made]).view(np.int64)
            turn = np.argsort(fact, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(fact, minlength=len(sizes)))))
            flat = pa.StructArray.from_arrays([pa.array(c[turn]) for c in (where, own, key)], ["block", "own", "key"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], [*batch.schema.names, "keys"])

    return keyed


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, times = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times, pa.int64())], ["word", "times"])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "batch", "copy", "words", "n", *_FAR]
    for batch in batches:
        ids, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = [None if t is None else t.lower() for t in batch.column(2).to_pylist()]
        for at, block in blocks(texts):
            values, text = distinct_within(*word_hashes(block))
            if not len(values):
                continue
            first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            bound = np.append(first, len(values))
            n = np.diff(bound)
            owners = at[text[first]].tolist()
            far = [np.add.reduceat(1 - 2 * ((values >> np.uint64(k)) & np.uint64(1)).astype(np.int32), first, dtype=np.int32) for k in range(PIVOTS)]
            sets = [values[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[o] for o in owners], pa.int64()),
                    pa.array([numbers[o] for o in owners], pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                    pa.array(sets, pa.binary()),
                    pa.array(n.astype(np.int32)),
                    *map(pa.array, far),
                ],
                names,
            )


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        keep = []
        for i, (x, y) in enumerate(zip(left, right)):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(u, v, assume_unique=True))
            if common * 10 >= (len(u) + len(v) - common) * 8:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in range(3)], ["early", "late", "turn"])


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The later ends that are rejected, each taken in turn; for few links, all in one partition."""
    links = pa.Table.from_batches(list(batches), _LINK).to_pandas().sort_values(["turn", "late"])
    out: dict[int, None] = {}
    for early, late in zip(links["early"].tolist(), links["late"].tolist()):
        if early not in out:
            out[late] = None
    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64())], ["id"])


def described(facts: DataFrame, id: str, text: str, batch: str) -> DataFrame:
    """The facts that have a word: word sets by hash, and distances to the pivots."""
    picked = facts.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(batch).cast("int"), F.lit(_LAST)).alias("batch"), F.col(text).alias("text"))
    return spread(picked).where("text is not null").mapInArrow(_described, f"id bigint, batch int, copy binary, words binary, {_DISTANCES}")


def _with_firsts(sets: DataFrame) -> DataFrame:
    """``is_first``: no fact before it in turn has the same words."""
    first = sets.groupBy("copy").agg(F.min(F.struct("batch", "id")).alias("first"))
    return sets.join(first, "copy").withColumn("is_first", F.col("id") == F.col("first.id")).drop("copy", "first")


def _by_key(sets: DataFrame, side: str) -> DataFrame:
    keyed = sets.select("id", "batch", "n", *_FAR, F.explode("keys").alias("k"))
    return keyed.select("k.block", "k.key", F.col("k.own").alias(f"own_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("id", "batch", "n", *_FAR)))


def _within_reach() -> Column:
    """What the triangle inequality leaves: no two distances to a pivot differ by more than near sets may."""
    most = F.expr("(n_early + n_late) div 9")
    joined = F.expr("(own_early or own_late) and (block >= 0 or n_early + n_late = (-block) div 64 + (-block) % 64)")
    return reduce(Column.__and__, (F.abs(F.col(f"{c}_early") - F.col(f"{c}_late")) <= most for c in ("n", *_FAR)), joined)


def _greedy(links: DataFrame) -> DataFrame:
    """(id): as ``_in_turn``, for any number of links (early, late).

    In every round the ids that are no link's later end are accepted, and the ids linked to them rejected;
    the links of both go. There are as many rounds as the longest chain of alternate decisions has links.
    """
    rejected: list[DataFrame] = []
    while True:
        waiting = links.select(F.col("late").alias("early"), F.lit(True).alias("waits")).distinct()
        marked = durable(links.join(waiting, "early", "left").select("early", "late", F.coalesce("waits", F.lit(False)).alias("waits")))
        out = marked.where("not waits").select(F.col("late").alias("id")).distinct()
        rejected.append(out)
        if marked.isEmpty():
            return reduce(DataFrame.unionByName, rejected)
        left = marked.where("waits").select("early", "late")
        links = left.join(out.withColumnRenamed("id", "late"), "late", "left_anti").join(out.withColumnRenamed("id", "early"), "early", "left_anti").select("early", "late")


class FactHistory:
    """Accepted facts of all batches so far, kept in a folder and extended batch by batch.

    The table has one row per fact: its distances to the pivots, its keys and its word set, sorted by size. What is added
    reads the sizes that its own facts can be near to, of these the accepted facts' distances and keys, and the word sets of the pairs
    left; then it is appended. Texts and rejected facts of earlier batches aren't read, and no two facts of the history are compared.

    A fact is rejected if its distinct words and those of an accepted earlier one, by batch and then id,
    have 0.8 of their union in common. Facts without a word (null, empty, blank) are
    never rejected. Ids must be unique; other repeated rows are duplicates like any. Extra columns are ignored.
    Copies within what is added are resolved without pairs: whatever happens to the first of them, each later one has an accepted fact as near.

    ``met``: the pairs, of the last facts added, that came through the join and the pivots, and whose words were read.
    ``held``, ``few`` and ``crowd`` bound what is broadcast, put into one task or paired at once; they change the work, not the result.
    """

    def __init__(self, spark: SparkSession, folder: str, held: int = HELD, few: int = FEW, crowd: int = CROWD):
        self.spark, self.folder, self.held, self.few, self.crowd = spark, folder, held, few, crowd
        self.met = 0
        self.common: tuple[np.ndarray, np.ndarray] | None = None

    def _read(self, name: str, form: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(form).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _kept(self, rejected: bool) -> DataFrame | None:
        found = self._read("facts", f"{_FORM}, rejected boolean")
        return found if found is None else found.where("rejected" if rejected else "not rejected")

    def _keyed(self, sets: DataFrame) -> DataFrame:
        """``sets`` with their keys; the first facts of a history settle which words are common in it."""
        if self.common is None:
            found = self._read("common", "word bigint, times bigint")
            if found is None:
                counts = sets.select("words").mapInArrow(_counted, "word bigint, times bigint").groupBy("word").agg(F.sum("times").alias("times"))
                counts.where("times > 1").orderBy(F.desc("times"), "word").limit(COMMON).write.parquet(f"{self.folder}/common")
                found = self._read("common", "word bigint, times bigint")
            words = found.toArrow().combine_chunks()
            order = words["word"].to_numpy().view(np.uint64)
            self.common = np.sort(order), words["times"].to_numpy()[np.argsort(order)]
        picked = sets.select("id", "batch", "words", "n", *_FAR, "is_first")
        return picked.mapInArrow(_keys(*self.common), f"id bigint, batch int, words binary, {_DISTANCES}, is_first boolean, {_KEYS}")

    def _near(self, pairs: DataFrame, count: int, early: DataFrame, late: DataFrame) -> DataFrame:
        """The pairs (early, late, turn), ``count`` of them, whose true distance is small enough."""
        self.met += count
        asked = F.broadcast(pairs) if count <= self.few else pairs
        ends = early.select(F.col("id").alias("early"), F.col("words").alias("left")).join(asked, "early")
        ends = ends.join(late.select(F.col("id").alias("late"), F.col("words").alias("right")), "late").select("early", "late", "turn", "left", "right")
        return ends.mapInArrow(_close, "early bigint, late bigint, turn int")

    def _links(self, early: DataFrame, late: DataFrame, facts: int, before: Column) -> tuple[DataFrame, int]:
        """(early, late, turn) of the near pairs, and how many pairs' words are read for them."""
        small = F.broadcast if facts <= self.held else (lambda df: df)
        met = _by_key(early, "early").join(small(_by_key(late, "late")), ["block", "key"]).where(_within_reach() & before).select("id_early", "id_late", "batch_late")
        pairs = durable(met.distinct().withColumnsRenamed({"id_early": "early", "id_late": "late", "batch_late": "turn"}))
        count = pairs.count()
        return self._near(pairs, count, early, late), count

    def _thinned(self, mine: DataFrame, facts: int) -> tuple[DataFrame, DataFrame | None]:
        """What is left of ``mine`` to be compared in pairs, and (id) what is rejected without.

        Where keys are so common that their pairs are more than ``crowd``, as with thousands of copies that differ in a word each, a fact that comes first
        under each of its keys is accepted, as none before it can be near; every fact is compared with the first under its keys only, and what is near
        to an accepted one is rejected. Both leave, and others come first, as long as that settles a tenth of the facts.
        """
        out = None
        while True:
            turn = F.struct("batch", "id")
            keyed = mine.select("id", "batch", turn.alias("turn"), F.explode("keys").alias("k")).select("id", "batch", "turn", "k.block", "k.key")
            shared = keyed.groupBy("block", "key").count().agg(F.sum(F.expr("count * (count - 1) div 2")))
            if facts * (facts - 1) // 2 <= self.crowd or (shared.first()[0] or 0) <= self.crowd:
                return mine, out
            first = durable(keyed.groupBy("block", "key").agg(F.min("turn").alias("first")))
            met = durable(keyed.join(first, ["block", "key"]).select(F.col("first.id").alias("early"), F.col("id").alias("late"), F.col("batch").alias("turn")).distinct())
            sure = durable(met.groupBy("late").agg(F.bool_and(F.col("early") == F.col("late")).alias("is_sure")).where("is_sure").select(F.col("late").alias("id")))
            pairs = durable(met.where("early <> late").join(sure.withColumnRenamed("id", "early"), "early", "left_semi"))
            no = durable(self._near(pairs, pairs.count(), mine, mine).select(F.col("late").alias("id")).distinct())
            out = no if out is None else out.unionByName(no)
            settled = durable(sure.unionByName(no))
            mine = durable(mine.join(settled, "id", "left_anti"))
            count = settled.count()
            if count * 10 < facts:
                return mine, out
            facts -= count

    def _rejected(self, mine: DataFrame, facts: int, low: int, high: int) -> DataFrame | None:
        """(id): the facts of ``mine``, all different, that are near to an accepted one before them.

        The history comes first: what is near to it is rejected and needn't meet the other new facts.
        """
        out = []
        if (old := self._kept(False)) is not None:
            links, count = self._links(old.where(F.col("n").between(low * 4 // 5, high * 5 // 4)), mine, facts, F.lit(True))
            if count:
                out.append(durable(links.select(F.col("late").alias("id")).distinct()))
                mine, facts = mine.join(out[0], "id", "left_anti"), facts - out[0].count()
        mine, thinned = self._thinned(mine, facts)
        out += [] if thinned is None else [thinned]
        links, count = self._links(mine, mine, facts, F.expr("struct(batch_early, id_early) < struct(batch_late, id_late)"))
        if count:
            out.append(links.repartition(1).mapInArrow(_in_turn, "id bigint") if count <= self.few else _greedy(durable(links.select("early", "late"))))
        return reduce(DataFrame.unionByName, out) if out else None

    def _decide(self, sets: DataFrame) -> None:
        """Decides on described facts, and appends them with the decision."""
        self.met = 0
        mine = sets.where("is_first")
        facts, low, high = mine.agg(F.count("*"), F.min("n"), F.max("n")).first()
        if not facts:
            return
        no = F.lit(False)
        out = self._rejected(mine.drop("is_first"), facts, low, high)
        if out is not None:
            sets, no = sets.join(out.withColumn("no", F.lit(True)), "id", "left"), F.coalesce("no", F.lit(False))
        rows = sets.select("id", "batch", "words", "n", *_FAR, "keys", (~F.col("is_first") | no).alias("rejected"))
        parts = 1 + facts // 200_000
        rows.repartitionByRange(parts, "n").sortWithinPartitions("rejected", "n").write.partitionBy("rejected").mode("append").parquet(f"{self.folder}/facts")

    def add(self, facts: DataFrame, id: str, text: str, batch: str) -> DataFrame:
        """Decide on one or more batches, append them, and return (id, accepted) for all rows of ``facts``."""
        sets = durable(described(facts, id, text, batch))
        self._decide(durable(self._keyed(_with_firsts(sets))))
        ids, kept = facts.select(F.col(id).cast("bigint").alias("id")), self._kept(True)
        out = ids.where("false") if kept is None else kept.select("id").join(sets.select("id"), "id", "left_semi")
        return ids.join(out.withColumn("accepted", F.lit(False)), "id", "left").select("id", F.coalesce("accepted", F.lit(True)).alias("accepted"))

    def replay(self, facts: DataFrame, id: str, text: str, batch: str, growth: int = 1) -> DataFrame:
        """(id): the rejected of all batches, added in turn; a null batch comes last.

        The facts are described in one pass. One batch is added first, and then ``growth`` times as many each time as the time before. How many
        are added at once doesn't change the result, as those added are taken in turn, too.
        """
        sets = durable(described(facts, id, text, batch), "batch")
        numbers = sorted(r["batch"] for r in sets.select("batch").distinct().collect())
        begin, many = 0, 1
        while begin < len(numbers):
            self._decide(durable(self._keyed(_with_firsts(sets.where(F.col("batch").isin(numbers[begin : begin + many]))))))
            begin, many = begin + many, many * growth
        kept = self._kept(True)
        return sets.select("id").where("false") if kept is None else kept.select("id")


def rejected(facts: DataFrame, id: str, text: str, batch: str, growth: int = 3) -> DataFrame:
    """(id): the facts to reject if the batches are added in turn to an empty history in the shared folder."""
    spark = facts.sparkSession
    return FactHistory(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}").replay(facts, id, text, batch, growth)
