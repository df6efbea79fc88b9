"""Mixing sources to target weights: Pfair scheduling of token blocks.

Every source's records, in an order by hash and once per pass, are cut into blocks of
``block`` tokens. Block k of a source with weight w has the release time
floor((k - 1) / w) and the deadline ceil(k / w); in each slot the released block with
the earliest deadline goes next. The weights sum to 1, so every deadline is met, and at each
slot a source's blocks so far differ from its weight times the slots by less than one. A source
that is used up at its repeat cap drops out of the order; the others go on in proportion.

Weights are whole multiples of 1 / ``PERIOD``, so the order repeats after at most PERIOD
slots. Only this pattern is worked out ahead; it depends on the weights and not on the
records, whose blocks get their slots from it by a join.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.tables import durable, spread

#: Weights are rounded to whole parts of this, so a share is off by 1 / PERIOD at most; a smaller one counts as one part.
PERIOD = 10_000
# White space as the tokenizer's pattern reads it.
_LONG_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")


@lru_cache(2)
def _encoding(path: str):
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encoding: tiktoken.Encoding, text: str) -> int:
    """The number of tokens, also for runs of blanks too long for the tokenizer's pattern.

    The pattern makes such a run a token piece of its own, up to its last blank where something follows.
    """
    total = start = 0
    for m in _LONG_BLANKS.finditer(text):
        end = m.end() - (m.end() < len(text))
        total += len(encoding.encode_ordinary(text[start : m.start()])) + len(encoding._encode_single_piece(text[m.start() : end]))
        start = end
    return total + len(encoding.encode_ordinary(text[start:]))


def _sizes(path: str):
    schema = pa.schema([("id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            sizes = [count_tokens(encoding, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], schema=schema)

    return run


def token_sizes(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(id, source, tokens) of the documents with a text, ``source`` in its regular spelling (lower case, trimmed)."""
    picked = documents.where("text is not null and source is not null").select(F.col("doc_id").cast("bigint").alias("id"), F.lower(F.trim("source")).alias("source"), "text")
    return picked.mapInArrow(_sizes(tokenizer), "id bigint, source string, tokens bigint")


@dataclass
class Source:
    """What one source brings to the mixture and gets in it."""

    name: str
    target: float
    max_repeats: int
    records: int
    tokens: int
    parts: int = 0  # of PERIOD


def shared_out(weights: list[float], period: int = PERIOD) -> list[int]:
    """Weights as whole parts of ``period``, by largest remainder; each at least 1."""
    total = sum(weights)
    exact = [w / total * period for w in weights]
    parts = [max(1, int(x + 1e-9)) for x in exact]
    order = sorted(range(len(exact)), key=lambda i: (parts[i] - exact[i], i))
    left = period - sum(parts)
    for k in range(abs(left)):
        if left > 0:
            parts[order[k % len(order)]] += 1
        else:
            parts[max(range(len(parts)), key=lambda i: parts[i])] -= 1
    return parts


def pattern(parts: list[int]) -> list[int]:
    """Which source has each slot of one period: the released block with the earliest deadline."""
    period = sum(parts)
    done = [0] * len(parts)
    out = []
    for t in range(period):
        ready = [i for i, p in enumerate(parts) if done[i] * period // p <= t and done[i] < p]
        i = min(ready, key=lambda i: (-(-(done[i] + 1) * period // parts[i]), i))
        done[i] += 1
        out.append(i)
    return out


class Mixture:
    """A selection of records in which each source has its target share of the tokens.

    ``documents``: doc_id, text, source; ``targets``: source, target_share,
    max_repeats. Sources without a target, and targets that are null or not above 0, take no
    part; listed sources without tokens can't be served, and the shares of the others are
    raised in proportion. A null ``max_repeats`` is 1. No record is used more often than its source allows.
    ``total`` is the size in tokens, in whole blocks; ``whole``: it is all tokens of the listed
    sources. A source that is used up before drops out, and ``shares`` tells what it lacks. Without either, the
    mixture is as large as it can be with every source at its share. Null and empty texts have no tokens and aren't used. Rows with one
    doc_id are records of their own. Extra columns are ignored.

    ``selection``: (doc_id, source, pass, tokens, block, slot), one row per use of a record; sorted by
    slot it is the mixture. ``shares``: per target, what was aimed at and reached.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str, block: int = 4096, total: int | None = None, whole: bool = False):
        spark = documents.sparkSession
        wanted = targets.where("target_share > 0 and source is not null").groupBy(F.lower(F.trim("source")).alias("source"))
        wanted = wanted.agg(F.sum("target_share").alias("target"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
        taking_part = spread(documents.select("doc_id", "text", "source")).withColumn("_source", F.lower(F.trim("source"))).join(F.broadcast(wanted.select(F.col("source").alias("_source"))), "_source", "left_semi")
        sizes = durable(token_sizes(taking_part.select("doc_id", "text", "source"), tokenizer).where("tokens > 0"))
        stock = sizes.groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))
        rows = wanted.join(stock, "source", "left").orderBy("source").collect()  # as many as there are targets
        self.sources = [Source(r["source"], r["target"], max(1, r["max_repeats"]), r["records"] or 0, r["tokens"] or 0) for r in rows]
        present = [s for s in self.sources if s.tokens]
        self.block = block
        form = "doc_id bigint, source string, pass int, tokens bigint, block bigint, slot bigint"
        if not present:
            self.slots, self.selection = 0, spark.createDataFrame([], form)
            return
        for s, parts in zip(present, shared_out([s.target for s in present])):
            s.parts = parts
        divisor = gcd(*(s.parts for s in present))
        per = [s.parts // divisor for s in present]
        period = sum(per)
        order = pattern(per)
        before = [[0] * len(per)]  # blocks of each source before each place of the period
        for x in order:
            before.append([n + (i == x) for i, n in enumerate(before[-1])])
        caps = [-(-s.tokens * s.max_repeats // block) for s in present]

        def blocks_in(turns: int) -> list[int]:
            return [min(cap, turns // period * n + ahead) for cap, n, ahead in zip(caps, per, before[turns % period])]

        if whole:
            total = sum(s.tokens for s in present)
        if total is None:
            turns_taken = max(0, int(min(s.tokens * s.max_repeats / s.parts for s in present) * PERIOD) // block - 1)
        else:  # turns of sources that are used up are passed over; slots count the others
            last = (max(-(-cap // n) for cap, n in zip(caps, per)) + 1) * period
            turns_taken = bisect_right(range(last + 1), total // block, key=lambda t: sum(blocks_in(t))) - 1
        taken = blocks_in(turns_taken)
        self.slots = sum(taken)
        places = [(s.name, j, at, per[i], period, before[at], taken[i]) for i, s in enumerate(present) for j, at in enumerate(k for k, x in enumerate(order) if x == i)]
        turns = spark.createDataFrame(places, "source string, turn int, at bigint, per int, period int, before array<bigint>, taken bigint")
        passes = [(s.name, p) for s, n in zip(present, taken) for p in range(min(s.max_repeats, n * block // s.tokens + 1))]
        # what is broadcast has as many rows as there are targets and passes, or slots in a period, or stretches of 20,000 records
        uses = sizes.join(F.broadcast(spark.createDataFrame(passes, "source string, pass int")), "source")

        # sums over stretches of the order by hash first, so that no source is one task
        stretches = max(16, sum(s.records for s in present) // 20_000)
        uses = uses.withColumn("place", F.xxhash64("id", "pass", F.lit(17))).withColumn("stretch", F.pmod(F.shiftright("place", 33), F.lit(stretches)))
        sums = uses.groupBy("source", "pass", "stretch").agg(F.sum("tokens").alias("sum"))
        ahead = Window.partitionBy("source").orderBy("pass", "stretch").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("source", "pass", "stretch", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
        inside = Window.partitionBy("source", "pass", "stretch").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
        placed = uses.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, ["source", "pass", "stretch"])
        placed = placed.withColumn("block", F.floor((F.col("ahead") + F.col("inside")) / block))
        per_source = spark.createDataFrame([(s.name, n) for s, n in zip(present, per)], "source string, own int")
        placed = placed.join(F.broadcast(per_source), "source").withColumn("turn", F.pmod(F.col("block"), F.col("own").cast("bigint")).cast("int"))
        slotted = placed.join(F.broadcast(turns), ["source", "turn"]).where("block < taken")
        cycle = F.floor(F.col("block") / F.col("per"))
        slotted = slotted.withColumn("slot", sum((F.least(cycle * n + F.col("before")[i], F.lit(caps[i])) for i, n in enumerate(per)), F.lit(0)))
        self.selection = slotted.select(F.col("id").alias("doc_id"), "source", "pass", "tokens", F.col("block").cast("bigint").alias("block"), F.col("slot").cast("bigint").alias("slot"))

    def checks(self) -> DataFrame:
        """(source, target_share, max_repeats, repeats_kept, in_step) per target.

        ``repeats_kept``: no record is used more often than allowed. ``in_step``: as long as no source is used up, the
        source's k-th block of weight w stands between its release time floor((k - 1) / w) and its deadline ceil(k / w).
        """
        spark = self.selection.sparkSession
        weights = [(s.name, s.parts, s.tokens * s.max_repeats) for s in self.sources if s.tokens]
        period = sum(p for _, p, _ in weights)
        known = F.broadcast(spark.createDataFrame(weights, "source string, parts bigint, most bigint"))
        ends = self.selection.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("slot").alias("last")).join(known, "source").where("tokens = most")
        until = F.broadcast(ends.agg(F.coalesce(F.min("last"), F.lit(2**62)).alias("until")))
        kept = F.col("slot").between(F.expr(f"block * {period} div parts"), F.expr(f"((block + 1) * {period} + parts - 1) div parts - 1"))
        steps = self.selection.join(known, "source").crossJoin(until).groupBy("source").agg(F.min(kept | (F.col("slot") > F.col("until"))).alias("in_step"))
        uses = self.selection.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("most_uses"))
        aim = spark.createDataFrame([(s.name, s.target, s.max_repeats) for s in self.sources], "source string, target_share double, max_repeats int")
        out, yes = aim.join(uses, "source", "left").join(steps, "source", "left"), F.lit(True)
        return out.select("source", "target_share", "max_repeats", F.coalesce(F.col("most_uses") <= F.col("max_repeats"), yes).alias("repeats_kept"), F.coalesce("in_step", yes).alias("in_step"))

    def shares(self) -> DataFrame:
        """(source, target_share, served_share, actual_share, tokens, uses, records, most_uses, max_repeats, used_up, shortfall) per target.

        ``used_up``: every record is used as often as it may be. ``shortfall``: tokens that
        the source lacks to its target share of the mixture.
        """
        spark = self.selection.sparkSession
        all_targets = sum(s.target for s in self.sources)
        rows = [(s.name, s.target, s.parts / PERIOD, s.max_repeats, s.target / all_targets, s.records * s.max_repeats) for s in self.sources]
        aim = spark.createDataFrame(rows, "source string, target_share double, served_share double, max_repeats int, due double, most bigint")
        each = self.selection.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
        got = each.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("uses"), F.count("*").alias("records"), F.max("n").alias("most_uses"))
        whole = got.agg(F.sum("tokens").alias("whole"))
        out = aim.join(got, "source", "left").join(whole)
        zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tokens", "uses", "records", "most_uses")]
        lacking = F.greatest(F.lit(0), F.round(F.col("due") * F.coalesce("whole", F.lit(0)) - F.coalesce("tokens", F.lit(0)))).cast("bigint")
        return out.select(
            "source",
            "target_share",
            "served_share",
            F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
            *zero,
            "max_repeats",
            (F.coalesce("uses", F.lit(0)) == F.col("most")).alias("used_up"),
            lacking.alias("shortfall"),
        )
