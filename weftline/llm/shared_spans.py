"""Long exact spans shared between records: repeated-phrase automata.

1. Confirm. Every text yields the phrases of ``phrase`` characters with the
   smallest hash in some window of ``span`` characters (winnowing), so any span of
   ``span`` characters shared by two texts yields the same phrase in both. A
   group-by keeps the phrases that recur under two different owners.
2. Compile. The confirmed phrases are sharded by the texts that yielded them:
   the texts are partitioned by id, and each shard of them has one Aho-Corasick automaton of its confirmed phrases.
3. Stream. Every text runs through the automaton of its shard, which checks the
   phrases letter by letter and locates every occurrence, also those that
   winnowing did not pick. Other shards are ruled out for a text: the smallest phrase of each of its windows is one
   that it yielded itself, so a phrase of another shard only can't be the one that a window of it belongs to. A text that
   yields no confirmed phrase is ruled out for all shards.
4. Extend. Each window of ``span`` characters belongs to the smallest confirmed
   phrase inside it. The windows around an occurrence form one run, which is
   sent to the partition of its phrase; there, phrase by phrase, windows of two owners are matched by
   hash and compared letter by letter, and each run returns the stretches that stand elsewhere too. Phrases that
   very many texts hold are not sent to one task: their windows are matched by a
   group-by of 128-bit hashes with map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.codepoints import Block, blocks, span_hash, strip_line_numbers
from weftline.sources.tables import durable, spread

_FIRST = "owner bigint, id bigint, phrase bigint, at int, more bigint"
#: Windows of crowded phrases up to which Spark broadcasts them for their join.
HELD = 2_000_000
_RUN = pa.schema([("phrase", pa.int64()), ("crowded", pa.bool_()), ("id", pa.int64()), ("owner", pa.int64()), ("begin", pa.int32()), ("run", pa.string())])
_SPAN = pa.schema([("id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])


def same_path(path: Column) -> Column:
    """A path as it counts for being another one: ``/`` for ``\\``, no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def _order(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(24)


def _windows_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    square = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _picked(block: Block, span: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the block of the phrases that winnowing picks, and their hashes."""
    n = len(block.codes)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < span:
        return none
    prefix = block.prefix()
    at = np.arange(n - phrase + 1)
    h = span_hash(prefix, at, at + phrase)
    bits = np.uint64(max(24, int(n).bit_length()))
    least = _windows_min((h >> bits << bits) | at.astype(np.uint64), span - phrase + 1)
    room = np.zeros(n + 1, dtype=np.int64)
    fits = block.length >= span
    np.add.at(room, block.start[fits], 1)
    np.add.at(room, block.start[fits] + block.length[fits] - span + 1, -1)
    least = least[np.cumsum(room)[: len(least)] > 0]
    if not len(least):
        return none
    least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return place, h[place]


def _phrases(span: int, phrase: int, numbered: bool):
    schema = pa.schema([("owner", pa.int64()), ("id", pa.int64()), ("phrase", pa.int64()), ("at", pa.int32()), ("more", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per phrase; and one per text, with its hash in two columns and its length, negative, as the place."""
        for batch in batches:
            ids, owners = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            texts = batch.column(2).to_pylist()
            if numbered:
                texts = [None if t is None else strip_line_numbers(t) for t in texts]
            for at, block in blocks(texts):
                place, h = _picked(block, span, phrase)
                text = np.searchsorted(block.start, place, side="right") - 1
                long = np.flatnonzero(block.length >= span)
                whole = [xxhash.xxh3_128_intdigest(block.codes[b : b + n].tobytes()) for b, n in zip(block.start[long].tolist(), block.length[long].tolist())]
                low = np.array([w & 0xFFFFFFFFFFFFFFFF for w in whole], np.uint64).view(np.int64)
                high = np.array([w >> 64 for w in whole], np.uint64).view(np.int64)
                rows = at[np.concatenate((text, long))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(owners[rows]),
                        pa.array(ids[rows]),
                        pa.array(np.concatenate((h.view(np.int64), low))),
                        pa.array(np.concatenate((place - block.start[text], -block.length[long])).astype(np.int32)),
                        pa.array(np.concatenate((np.zeros(len(h), np.int64), high))),
                    ],
                    schema=schema,
                )

    return run


def _stretches(places: list[int], ranks: list[int], length: int, span: int, phrase: int) -> Iterator[tuple[int, int, int]]:
    """(occurrence, first window, last window) where the occurrence is the smallest phrase inside the window, the first of equals."""
    wide, n = span - phrase, len(places)
    before, after, stack = [-1] * n, [n] * n, []
    for j in range(n):
        while stack and ranks[stack[-1]] > ranks[j]:
            after[stack.pop()] = j
        before[j] = stack[-1] if stack else -1
        stack.append(j)
    for j, p in enumerate(places):
        lo = max(0, p - wide, places[before[j]] + 1 if before[j] >= 0 else 0)
        hi = min(p, length - span, places[after[j]] - wide - 1 if after[j] < n else p)
        if lo <= hi:
            yield j, lo, hi


def _runs(span: int, phrase: int, numbered: bool, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for offset in range(0, whole.num_rows, shard):
                batch = whole.slice(offset, shard)
                ids, owners, texts, hits = (c.to_pylist() for c in batch.columns)
                if numbered:
                    texts = [strip_line_numbers(t) for t in texts]
                automaton = ahocorasick.Automaton()
                for t, own in zip(texts, hits):
                    for hit in own:
                        automaton.add_word(t[hit["at"] : hit["at"] + phrase], (hit["phrase"], hit["crowded"]))
                automaton.make_automaton()
                out: list[list] = [[], [], [], [], [], []]
                for i, o, t in zip(ids, owners, texts):
                    found = [(end - phrase + 1, *what) for end, what in automaton.iter(t)]
                    ranks = [(f[1] & 0xFFFFFFFFFFFFFFFF) >> 24 for f in found]
                    for j, lo, hi in _stretches([f[0] for f in found], ranks, len(t), span, phrase):
                        for column, value in zip(out, (found[j][1], found[j][2], i, o, lo, t[lo : hi + span])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(out, _RUN)], schema=_RUN)

    return run


def _window_hashes(runs: list[str], span: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all windows of all runs, and the number of windows of each run."""
    counts = np.array([len(r) - span + 1 for r in runs], np.int64)
    parts = []
    for _, block in blocks(runs):
        n = block.length - span + 1
        begin = np.repeat(block.start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        parts.append(span_hash(block.prefix(), begin, begin + span))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def _verified_spans(runs: list[str], ids: np.ndarray, owners: np.ndarray, begins: np.ndarray, span: int) -> pa.RecordBatch:
    """The stretches of the runs whose windows stand in a run of another owner, too.

    Windows of one hash have the first window of the least and of the greatest owner as partners. A stretch follows one partner run at one
    distance; the letters of both are compared, and should they differ, the stretch's windows are looked up by their letters.
    """
    h, counts = _window_hashes(runs, span)
    base = np.cumsum(counts) - counts
    run = np.repeat(np.arange(len(counts)), counts)
    own = owners[run]
    order = np.lexsort((np.arange(len(h)), own, h))
    first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(h)))
    # of each group of equal hashes: the first window of the least owner, and the first of the greatest
    sorted_own = own[order]
    last_own = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (sorted_own[1:] != sorted_own[:-1])))) if len(h) else first
    greatest = last_own[np.searchsorted(last_own, first + sizes - 1, side="right") - 1] if len(h) else first
    low, high = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    low[order], high[order] = np.repeat(order[first], sizes), np.repeat(order[greatest], sizes)
    at = np.flatnonzero(own[low] != own[high])
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], k.type) for k in _SPAN], schema=_SPAN)
    partner = np.where(own[low[at]] != own[at], low[at], high[at])
    new = np.concatenate(([True], (np.diff(at) > 1) | (run[at[1:]] != run[at[:-1]]) | (np.diff(partner) != 1) | (run[partner[1:]] != run[partner[:-1]])))
    starts = np.flatnonzero(new)
    flags = np.zeros(len(h), dtype=bool)
    for b, n in zip(starts.tolist(), np.diff(np.append(starts, len(at))).tolist()):
        w, p = int(at[b]), int(partner[b])
        i, j = int(run[w]), int(run[p])
        x, y = w - int(base[i]), p - int(base[j])
        if runs[i][x : x + n + span - 1] == runs[j][y : y + n + span - 1]:
            flags[w : w + n] = True
        else:
            for k in range(n):
                letters = runs[i][x + k : x + k + span]
                flags[w + k] = any(o != owners[i] and letters in r for o, r in zip(owners.tolist(), runs))
    return _spans_of(flags, run, base, ids, begins, span)


def _spans_of(flags: np.ndarray, run: np.ndarray, base: np.ndarray, ids: np.ndarray, begins: np.ndarray, span: int) -> pa.RecordBatch:
    """Stretches of flagged windows as spans of the records."""
    at = np.flatnonzero(flags)
    new = np.concatenate(([True], (np.diff(at) > 1) | (run[at[1:]] != run[at[:-1]]))) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    r = run[at[first]]
    begin, end = begins[r] + at[first] - base[r], begins[r] + at[last] - base[r] + span
    return pa.RecordBatch.from_arrays([pa.array(ids[r], pa.int64()), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], schema=_SPAN)


def _matched(span: int, held: int = 1 << 20):
    """Spans of the runs of one partition, which come sorted by phrase: whole phrases at a time, ``held`` characters of runs or one phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans() -> pa.RecordBatch:
            return _verified_spans(runs, *(np.array(c, np.int64) for c in (ids, owners, begins)), span)

        ids, owners, begins, runs, size, phrase = [], [], [], [], 0, None
        for batch in batches:
            for p, i, o, b, r in zip(*(c.to_pylist() for c in batch.columns)):
                if p != phrase and size >= held:
                    yield spans()
                    ids, owners, begins, runs, size = [], [], [], [], 0
                phrase = p
                size += len(r)
                for store, x in ((ids, i), (owners, o), (begins, b), (runs, r)):
                    store.append(x)
        if runs:
            yield spans()

    return run


def _second_hashes(runs: list[str], span: int) -> np.ndarray:
    """Other hashes of all windows of all runs, of the text turned round."""
    h, counts = _window_hashes([r[::-1] for r in runs], span)
    last = np.cumsum(counts)
    return h[np.repeat(last + last - counts - 1, counts) - np.arange(len(h))]


def _few_windows(span: int):
    """The distinct windows of some runs with the least and the greatest owner: the map side of the group-by."""
    schema = pa.schema([("window", pa.int64()), ("second", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(3).to_pylist()
            h, n = _window_hashes(runs, span)
            if not len(h):
                continue
            second, own = _second_hashes(runs, span), np.repeat(batch.column(1).to_numpy(zero_copy_only=False), n)
            order = np.lexsort((second, h))
            h, second, own = h[order], second[order], own[order]
            first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (second[1:] != second[:-1]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first].view(np.int64)), pa.array(second[first].view(np.int64)), pa.array(np.minimum.reduceat(own, first)), pa.array(np.maximum.reduceat(own, first))], schema=schema
            )

    return run


def _each_window(span: int):
    schema = pa.schema([("id", pa.int64()), ("begin", pa.int32()), ("window", pa.int64()), ("second", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for offset in range(0, whole.num_rows, 1000):
                batch = whole.slice(offset, 1000)
                runs = batch.column(3).to_pylist()
                h, n = _window_hashes(runs, span)
                ids, begins = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in (0, 2))
                begins = begins + np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(begins.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(_second_hashes(runs, span).view(np.int64))], schema=schema)

    return run


def _crowded_spans(runs: DataFrame, span: int, held: int) -> DataFrame:
    """(id, begin, end) for runs of phrases too common for one task each."""
    runs = runs.select("id", "owner", "begin", "run")
    window = ["window", "second"]
    few = runs.mapInArrow(_few_windows(span), "window bigint, second bigint, lo bigint, hi bigint").groupBy(*window).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    twice = durable(few.where("lo <> hi").select(*window))
    if twice.count() <= held:
        twice = F.broadcast(twice)
    each = runs.mapInArrow(_each_window(span), "id bigint, begin int, window bigint, second bigint")
    return each.join(twice, window).select("id", "begin", (F.col("begin") + span).cast("int").alias("end"))


def _matched_spans(runs: DataFrame, parts: int, span: int) -> DataFrame:
    sorted_runs = runs.repartition(parts, "phrase").sortWithinPartitions("phrase").select("phrase", "id", "owner", "begin", "run")
    return sorted_runs.mapInArrow(_matched(span), "id bigint, begin int, end int")


def shared_spans(records: DataFrame, id: str, text: str, owner: Column, span: int = 200, phrase: int = 40, numbered: bool = False, crowded: int = 5000, held: int = HELD) -> DataFrame:
    """(id, spans, shared): the records that share spans of at least ``span`` characters with a record of another owner.

    ``spans`` are the maximal stretches [begin, end) of the text, in code points and
    ascending, of which every window of ``span`` characters stands verbatim in a record of
    another owner; ``shared`` is their total length. Records without such a span
    don't come out. Null texts share nothing; texts shorter than ``span``
    neither; a null owner is an owner like any other; repeated rows of one owner don't make a span
    shared; rows with one id are taken as one record. Extra columns are ignored.
    Letters are compared except for windows of crowded phrases, which count as equal by a 128-bit hash.
    ``crowded``: the number of occurrences from which a phrase is matched by group-by; ``held``: the number of
    its shared windows up to which Spark broadcasts them for their join.

    Equal texts are one: if two owners have it, all of it is shared, and towards others it counts as
    an owner of its own; otherwise its records share what the first of them shares.
    """
    wanted = records.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(F.coalesce(owner, F.lit("\0"))).alias("owner"), F.col(text).alias("text"))
    wanted = wanted.where("text is not null and id is not null")
    picked = durable(spread(wanted).where(F.length("text") >= span).mapInArrow(_phrases(span, phrase, numbered), _FIRST))
    texts = picked.where("at < 0")
    groups = texts.groupBy("phrase", "more").agg(F.min("id").alias("rep"), F.min("owner").alias("lo"), F.max("owner").alias("hi"), (-F.min("at")).alias("length"))
    many = F.col("lo") != F.col("hi")
    groups = groups.select("phrase", "more", "rep", "length", many.alias("many"), F.when(many, F.xxhash64("phrase", "more")).otherwise(F.col("lo")).alias("owner"))
    members = durable(texts.select("id", "phrase", "more").join(groups, ["phrase", "more"]).select("id", "rep", "length", "many", "owner"))
    reps = members.where("id = rep").select("id", "owner")

    phrases = picked.where("at >= 0").drop("owner", "more").join(reps, "id")
    recurring = phrases.groupBy("phrase").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.count("*").alias("n"))
    recurring = durable(recurring.where("lo <> hi").select("phrase", (F.col("n") > crowded).alias("crowded")))
    hits = phrases.join(recurring, "phrase").groupBy("id").agg(F.first("owner").alias("owner"), F.collect_list(F.struct("at", "phrase", "crowded")).alias("hits"))
    streamed = wanted.drop("owner").join(hits, "id").select("id", "owner", "text", "hits")
    runs = streamed.mapInArrow(_runs(span, phrase, numbered, 2000), "phrase bigint, crowded boolean, id bigint, owner bigint, begin int, run string")

    parts = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + recurring.count() // 20000)
    if recurring.where("crowded").isEmpty():
        spans = _matched_spans(runs, parts, span)
    else:
        runs = durable(runs)
        spans = _matched_spans(runs.where("not crowded"), parts, span)
        spans = spans.unionByName(_crowded_spans(runs.where("crowded"), span, held))
    listed = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("parts"))
    # neighbouring stretches are one span where they leave no window out: the next begins at most one place after the last window of the one before
    merged = F.aggregate(
        "parts",
        F.expr("cast(array() as array<struct<begin:int,end:int>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["begin"] <= F.element_at(done, -1)["end"] - span + 1),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["begin"].alias("begin"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    covered = F.aggregate(
        "spans",
        F.expr("struct(0 as upto, 0L as total)"),
        lambda a, x: F.struct(
            F.greatest(a["upto"], x["end"]).alias("upto"),
            (a["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["upto"], x["begin"]))).cast("bigint").alias("total"),
        ),
        lambda a: a["total"],
    )
    found = listed.select(F.col("id").alias("rep"), merged.alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("length").alias("end")))
    each = members.join(found, "rep", "left").select("id", F.when(F.col("many"), whole).otherwise(F.col("spans")).alias("spans"))
    return each.where("spans is not null").withColumn("shared", covered)
