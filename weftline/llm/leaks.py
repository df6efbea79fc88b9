"""Evaluation texts leaking into training text: latent semantic retrieval.

Test passages and documents are read as windows of ``2 * run`` words that start
every ``run`` words, so any stretch of ``run`` words lies whole in one window of either.

1. A pass over all documents counts in how many each word of the passages occurs.
2. The passages' windows are TF-IDF rows. A randomised SVD, whose products with the
   rows are Spark jobs summing over partitions, gives the ``rank`` strongest directions.
3. A pass over all documents projects their windows into this space; windows whose
   cosine with a window of a passage reaches ``cosine`` are candidates. Beside other words a run can weigh
   too little for that; so stretches of ``run`` words that are one of a passage's, which have the
   cosine 1 by themselves, make candidates of the windows around them.
4. Candidates are checked word by word: a common run of ``run`` words is a leak; in
   paraphrases the longest common subsequence decides, and whether the answer stands in the document.

What tasks and driver hold is bounded by the test set, which is taken in blocks of
``items`` items, never by the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.codepoints import Block, blocks, mix, word_hashes
from weftline.sources.tables import spread

_PAIR = "doc_id bigint, item_id bigint, kind string, first int, last int, cosine double, common int, answer boolean"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("cosine", pa.float64()), ("common", pa.int32()), ("answer", pa.bool_())]
)
#: Part of the window's words that a paraphrase has in common with the passage, in order.
PARAPHRASE = 0.75


def _halves(text: np.ndarray, run: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each half window and the text it is of; ``text`` gives each word's text."""
    starts = np.searchsorted(text, np.arange(n + 1))
    count = -(-np.diff(starts) // run)
    owner = np.repeat(np.arange(n), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return starts[owner] + inside * run, owner


def _windows(owner: np.ndarray) -> np.ndarray:
    """Halves that begin a window: all but the last of a text, unless it is the only one."""
    if not len(owner):
        return np.zeros(0, np.int64)
    last = np.append(owner[1:] != owner[:-1], True)
    only = last & np.append(True, owner[1:] != owner[:-1])
    return np.flatnonzero(~last | only)


def _sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    n = len(hashes) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, step in enumerate(mix(np.arange(7, 7 + length, dtype=np.uint64)) | np.uint64(1)):
        out += hashes[k : k + n] * step
    return mix(out)


class Items:
    """A block of test items: their words, windows and word sequences."""

    def __init__(self, rows: list, run: int):
        self.ids = np.array([r["item_id"] for r in rows], np.int64)
        self.answers = [[a for a in (r["expected"] or []) if a] for r in rows]
        self.questions = [set(re.findall(r"\w+", (r["query"] or "").lower())) for r in rows]
        block = Block([(r["passage"] or "").lower() for r in rows])
        hashes, text = word_hashes(block)
        self.vocabulary, words = np.unique(hashes, return_inverse=True)
        self.words = [words[text == i] for i in range(len(rows))]
        self.first, owner = _halves(text, run, len(rows))
        half = _windows(owner)
        bounds = np.append(self.first, len(words))
        span = [(bounds[h], bounds[h + 2] if h + 1 < len(owner) and owner[h + 1] == owner[h] else bounds[h + 1]) for h in half]
        self.window_item = owner[half]
        self.windows = [np.unique(words[a:b], return_counts=True) for a, b in span]
        seq = _sequences(hashes, run)
        whole = np.flatnonzero(text[: len(seq)] == text[run - 1 :]) if len(seq) else np.zeros(0, np.int64)
        starts = np.searchsorted(text, np.arange(len(rows)))
        keys = self.key(text[whole], seq[whole])
        order = np.argsort(keys, kind="stable")
        places = whole - starts[text[whole]]
        self.keys, self.places = keys[order], places[order]
        # every stretch of run words with a window that holds it; a last half is held by the window before
        last = np.searchsorted(self.window_item, text[whole], side="right") - 1
        order = np.argsort(seq[whole], kind="stable")
        self.stretches = seq[whole][order]
        self.stretch_window = np.minimum(np.searchsorted(self.window_item, text[whole]) + places // run, last)[order]

    def meetings(self, sequences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sequences are stretches of passages, and the windows that hold these."""
        lo, hi = np.searchsorted(self.stretches, sequences), np.searchsorted(self.stretches, sequences, side="right")
        n = hi - lo
        which = np.repeat(np.arange(len(sequences)), n)
        return which, self.stretch_window[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    @staticmethod
    def key(item: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        return mix(mix(item.astype(np.uint64) + np.uint64(1)) ^ sequence)


def _counts(vocabulary: np.ndarray):
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            for at, block in blocks([None if t is None else t.lower() for t in batch.column(0).to_pylist()]):
                hashes, text = word_hashes(block)
                word = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                seen = vocabulary[word] == hashes
                pairs = np.unique(text[seen].astype(np.int64) * len(vocabulary) + word[seen])
                total[:-1] += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                total[-1] += len(at)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    return run


def _times_its_transpose(q: np.ndarray, parts: int):
    """For sparse rows A, the partition's share of A' A Q in ``parts`` stretches of rows."""
    schema = pa.schema([("part", pa.int32()), ("share", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros_like(q)
        for batch in batches:
            for words, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.array(weights, np.float32)
                out[words] += np.outer(w, w @ q[words])
        for k, stretch in enumerate(np.array_split(out, parts)):
            if stretch.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([stretch.tobytes()], pa.binary())], schema=schema)

    return run


def _summed(table: pa.Table) -> pa.Table:
    shares = [np.frombuffer(b, np.float32) for b in table.column("share").to_pylist()]
    return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "share": pa.array([np.sum(shares, axis=0, dtype=np.float32).tobytes()], pa.binary())})


def directions(rows: DataFrame, n_words: int, rank: int, extra: int = 16, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """The ``rank`` strongest right singular vectors (n_words x rank) of sparse rows (words array<int>, weights array<float>).

    Randomised subspace iteration. Each round is one Spark job: every partition multiplies its
    rows with the current basis and its transpose, and the products are summed by a group-by over stretches of words.
    """
    width = min(rank + extra, n_words)
    parts = 16
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_words, width)).astype(np.float32))
    for last in [False] * rounds + [True]:
        shares = rows.mapInArrow(_times_its_transpose(q, parts), "part int, share binary")
        summed = {r["part"]: r["share"] for r in shares.groupBy("part").applyInArrow(_summed, "part int, share binary").collect()}
        z = np.concatenate([np.frombuffer(summed[k], np.float32).reshape(s.shape) if k in summed else np.zeros_like(s) for k, s in enumerate(np.array_split(q, parts))])
        if last:
            values, vectors = np.linalg.eigh((q.T @ z).astype(np.float64))
            return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)
        q, _ = np.linalg.qr(z)
    raise AssertionError


def _common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; the rows of the table are bits of one integer."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        u = v & masks.get(y, 0)
        v = (v + u) | (v - u)
        v &= full
    return len(a) - v.bit_count()


def _search(items: Items, shared, run_words: int, cosine: float, paraphrases: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, passages = shared.value
        vocabulary, n_words = items.vocabulary, len(items.vocabulary)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in _SCHEMA]
            for at, block in blocks([None if t is None else t.lower() for t in texts], 1 << 19):
                hashes, text = word_hashes(block)
                if not len(hashes):
                    continue
                word = np.minimum(np.searchsorted(vocabulary, hashes), n_words - 1)
                word[vocabulary[word] != hashes] = n_words  # the row of zeros
                known = np.concatenate(([0], np.cumsum(word < n_words)))
                first, owner = _halves(text, run_words, len(at))
                half = _windows(owner)
                ends = np.append(first[1:], len(word))
                two = (half + 1 < len(owner)) & (owner[np.minimum(half + 1, len(owner) - 1)] == owner[half])
                stop = np.where(two, ends[np.minimum(half + 1, len(owner) - 1)], ends[half])
                # a common run is a run of words of the passages
                begins = np.flatnonzero(known[run_words:] - known[:-run_words] == run_words)
                begins = begins[text[begins] == text[begins + run_words - 1]] if len(begins) else begins
                if paraphrases:
                    keep = known[stop] - known[first[half]] >= run_words
                else:
                    runs = np.zeros(len(word) + 1, np.int64)
                    runs[begins + 1] = 1
                    runs = np.cumsum(runs)
                    keep = runs[np.maximum(stop - run_words + 1, first[half])] > runs[first[half]]
                if not keep.any():
                    continue
                half, two, stop = half[keep], two[keep], stop[keep]
                sequence = _sequences(hashes, run_words)
                met, met_q = items.meetings(sequence[begins])
                met_w = np.searchsorted(first, begins[met], side="right") - 1
                only = np.append(True, owner[1:] != owner[:-1])[met_w]
                final = np.append(owner[1:] != owner[:-1], True)[met_w]
                met_w = np.searchsorted(half, met_w - (final & ~only))  # a last half is held by the window before
                for lo in range(0, len(half), 1024):
                    h, t, s = half[lo : lo + 1024], two[lo : lo + 1024], stop[lo : lo + 1024]
                    needed, place = np.unique(np.concatenate((h, h[t] + 1)), return_inverse=True)
                    sums = np.zeros((len(needed), vectors.shape[1]), np.float32)
                    lengths = ends[needed] - first[needed]
                    which = np.repeat(first[needed] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                    np.add.reduceat(vectors[word[which]], np.cumsum(lengths) - lengths, axis=0, out=sums)
                    x = sums[place[: len(h)]]
                    x[t] += sums[place[len(h) :]]
                    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
                    close = x @ passages
                    candidate = close >= cosine
                    here = (met_w >= lo) & (met_w < lo + len(h))
                    candidate[met_w[here] - lo, met_q[here]] = True
                    w, q = np.nonzero(candidate)
                    if not len(w):
                        continue
                    degree = close[w, q]
                    item = items.window_item[q]
                    # exact check: sequences of the window that are sequences of the item
                    begin = first[h[w]]
                    count = np.maximum(s[w] - begin - run_words + 1, 0)
                    cand = np.repeat(np.arange(len(w)), count)
                    start = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    keys = Items.key(item[cand], sequence[start]) if len(cand) else np.zeros(0, np.uint64)
                    spot = np.minimum(np.searchsorted(items.keys, keys), max(len(items.keys) - 1, 0))
                    same = items.keys[spot] == keys if len(items.keys) else np.zeros(len(keys), bool)
                    doc = ids[at[owner[h[w]]]]
                    for c, p in zip(cand[same].tolist(), items.places[spot[same]].tolist()):
                        for column, value in zip(out, (int(doc[c]), int(items.ids[item[c]]), "run", p, p + run_words, float(degree[c]), run_words, None)):
                            column.append(value)
                    if paraphrases:
                        exact = np.zeros(len(w), bool)
                        exact[cand[same]] = True
                        for c in np.flatnonzero(~exact & (degree >= 0.7)).tolist():
                            mine = word[begin[c] : s[w[c]]]
                            common = _common_subsequence(mine[mine < n_words], items.words[item[c]])
                            if common >= PARAPHRASE * 2 * run_words:
                                i, whole = int(item[c]), texts[at[owner[h[w[c]]]]]
                                asked = items.questions[i]
                                answer = any(a in whole for a in items.answers[i]) or (bool(asked) and asked <= set(re.findall(r"\w+", whole.lower())))
                                for column, value in zip(out, (int(doc[c]), int(items.ids[i]), "paraphrase", None, None, float(degree[c]), common, answer)):
                                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(out, _SCHEMA)], schema=_SCHEMA)

    return run


def leaks(documents: DataFrame, tests: DataFrame, run: int = 12, rank: int = 256, cosine: float = 0.45, items: int = 2000, paraphrases: bool = False) -> DataFrame:
    """(doc_id, item_id, kind, first, last, cosine, common, answer): places where documents give test items away.

    ``documents``: doc_id, text; ``tests``: item_id, passage, query, expected. kind
    "run": the ``run`` words of the passage from word ``first`` up to ``last`` stand in the
    document one after the other, whatever lies between them; one row for every such place found in a candidate window.
    kind "paraphrase" (if asked for): the window and the passage have ``common`` words in
    common in the same order, at least three quarters of a window, without such a run; ``answer`` says
    whether an expected answer, or all words of the query, stand in the document.

    Null and empty texts and passages, and those shorter than ``run`` words, give no run. Repeated rows
    give repeated results. Passages that coincide in part are all reported. Extra columns are ignored.
    ``items``: test items taken at a time, each block in its own passes over the documents.
    """
    spark = documents.sparkSession
    picked = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).where("text is not null")
    wanted = tests.select("item_id", "passage", "query", "expected").where("passage is not null").orderBy("item_id", "passage")
    rows = wanted.toLocalIterator(prefetchPartitions=False)
    out = None
    while block := [r for _, r in zip(range(items), rows)]:
        held = Items(block, run)
        if not len(held.vocabulary):
            continue
        counted = picked.select("text").mapInArrow(_counts(held.vocabulary), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        df = np.zeros(len(held.vocabulary) + 1)
        for r in counted.collect():
            df[r["word"]] = r["n"]
        idf = np.log((df[-1] + 1) / (df[:-1] + 1)).astype(np.float32) + np.float32(1e-3)
        weighed = []
        for words, times in held.windows:
            w = idf[words] * times
            weighed.append((words.tolist(), (w / (np.linalg.norm(w) + 1e-9)).tolist()))
        sparse = spark.createDataFrame(weighed, "words array<int>, weights array<float>").repartition(8)
        basis = directions(sparse, len(held.vocabulary), rank)
        passages = np.zeros((len(weighed), basis.shape[1]), np.float32)
        for k, (words, weights) in enumerate(weighed):
            passages[k] = np.array(weights, np.float32) @ basis[words]
        passages /= np.linalg.norm(passages, axis=1, keepdims=True) + 1e-9
        vectors = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]), np.float32)])
        shared = spark.sparkContext.broadcast((vectors, np.ascontiguousarray(passages.T)))
        found = picked.mapInArrow(_search(held, shared, run, cosine, paraphrases), _PAIR)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], _PAIR) if out is None else out
