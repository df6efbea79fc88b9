"""Abusive, hateful or sexual content: maximum-scoring segments.

Words get log-odds of standing in a toxic passage against clean text, with Dirichlet
priors from the whole corpus. They are fitted on documents that raters judged: first
words of toxic against words of clean documents, then, in ``ROUNDS`` rounds, words of the best segment of
each toxic document against words of clean documents. Then the scores of words are moved, as
little as needed, so that the best segments of toxic documents score above the misleading ones of
clean documents. Words of neither list share one score, which is negative.

Every document is scanned in linear time for its maximum-scoring segment, and
where this is significant, for all maximal segments (Ruzzo and Tompa). A score S in a text
of n words has by chance the probability 1 - exp(-K n exp(-lambda S)), with lambda the root
of sum p exp(lambda s) = 1 over the corpus's words and K fitted on clean judged documents.
The document's score is minus the decimal logarithm of this; the cut is where precision and recall
on judged documents, each scored by words fitted on the other half, are best in balance.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.codepoints import Block, blocks, mix, span_hash, word_hashes, word_table
from weftline.sources.tables import durable, spread

ROUNDS, SHARPENINGS = 3, 2
#: Weight of the prior, in words, and of the even part of it.
PRIOR, EVEN = 200.0, 2.0
#: Words of a judged document's best passage that the fit looks at; with ``most`` it bounds what the fit holds. Scores have no such bound.
PASSAGE = 200
#: Score from which a passage is taken as a sign, and how often one in a clean text is counted more than other text.
CLEAR, MISLEADING = 4.0, 20
_WORD = re.compile(r"\w+")

# Letters of Latin and Cyrillic that look alike, and digits and signs used as letters.

_TO_CYRILLIC = str.maketrans("aeopcyxkmhtbiu", "аеорсухкмнтвии")
_TO_LATIN = str.maketrans("аеорсухкмнтвіѕиг", "aeopcyxkmhtbisur")
_LEET = str.maketrans("01345679@$", "oleasgtgas")
_LEET_I = str.maketrans("01345679@$", "oieasgtgas")
_MIXED = re.compile(r"[a-z][а-яёіѕ]|[а-яёіѕ][a-z]")
_SPACED = re.compile(r"(?<!\w)\w([ .\-_*])\w(?:\1\w){2,}(?!\w)")
_MASKED = re.compile(r"[*#]+(?=\w)|(?<=\w)[*#]")
_LEETED = re.compile(r"[0-9@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0-9@$]")
_LONG = re.compile(r"([^\W\d_])\1\1+")



@dataclass
class Weights:
    """Scores of words, and what is needed to look through disguises of the toxic ones."""

    words: dict[str, float]
    other: float
    rate: float = 1.0
    volume: float = 0.1
    cut: float = 3.0
    toxic: dict[tuple[int, str], list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for w, s in self.words.items():
            if s > 0 and len(w) > 3:
                self.toxic.setdefault((len(w), w[0]), []).append(w)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and scores of words; letter hashes and scores of toxic words for letters that changed places."""
        block = Block(list(self.words))
        h, text = word_hashes(block)
        scores = np.array(list(self.words.values()))
        order = np.argsort(h)
        strong = [w for w, s in self.words.items() if s > 1.5 and len(w) > 3 and len(set(w)) > 2]
        letters = _letters(Block(strong)) if strong else np.zeros(0, np.uint64)
        strong_scores = np.array([self.words[w] for w in strong])
        place = np.argsort(letters)
        return h[order], scores[text][order], letters[place], strong_scores[place] if len(strong) else strong_scores


def _letters(block: Block) -> np.ndarray:
    """A hash of each word's first letter and of its letters in any order."""
    begin, end, _ = block.words()
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(block.codes + np.uint64(1)))))
    return mix((sums[end] - sums[begin]) ^ mix(block.codes[begin] + np.uint64(77)))


def _around(text: str, at: int, also: str) -> tuple[int, int]:
    lo, hi = at, at
    while lo > 0 and (text[lo - 1].isalnum() or text[lo - 1] in also):
        lo -= 1
    while hi < len(text) and (text[hi].isalnum() or text[hi] in also):
        hi += 1
    return lo, hi


def _replaced(text: str, trigger: re.Pattern, by: Callable[[str], str], also: str = "@$_") -> str:
    """The text with each word around a match replaced; signs of ``also`` belong to words."""
    out, done = [], 0
    for m in trigger.finditer(text):
        if m.start() < done:
            continue
        lo, hi = _around(text, m.start(), also)
        if lo < done or hi <= lo:
            continue
        out += [text[done:lo], by(text[lo:hi])]
        done = hi
    return "".join([*out, text[done:]]) if out else text


_OTHER, _LATIN, _CYRILLIC, _LETTER, _DIGIT, _STAR, _GAP = range(7)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of each code point, as the tricks tell them apart."""
    t = np.zeros(0x110000, dtype=np.uint8)
    t[word_table()] = _LETTER
    t[ord("a") : ord("z") + 1] = _LATIN
    t[ord("а") : ord("я") + 1] = _CYRILLIC
    for signs, kind in (("ёіѕ", _CYRILLIC), ("0123456789@$", _DIGIT), ("*#", _STAR), (" .-_", _GAP)):
        t[[ord(c) for c in signs]] = kind
    return t


def _suspects(texts: list[str]) -> list[set[str]]:
    """Which tricks each text (in lower case) may use, found by passes over arrays, so that the others are spared the expressions."""
    out: list[set[str]] = [set() for _ in texts]
    for at, block in blocks(texts):
        c, k = block.codes, _kinds()[block.codes]
        a, b = k[:-1], k[1:]
        letter = (k >= _LATIN) & (k <= _LETTER)
        wordish = letter | (k == _DIGIT)
        gap = (k == _GAP) | (k == _STAR)
        found = {
            "script": np.flatnonzero(((a == _LATIN) & (b == _CYRILLIC)) | ((a == _CYRILLIC) & (b == _LATIN))),
            "leet": np.flatnonzero((letter[:-1] & (b == _DIGIT)) | ((a == _DIGIT) & letter[1:])),
            "masked": np.flatnonzero((wordish[:-1] & (b == _STAR)) | ((a == _STAR) & wordish[1:])),
            "long": np.flatnonzero(letter[2:] & (c[2:] == c[1:-1]) & (c[1:-1] == c[:-2])) if len(c) > 2 else [],
            "spaced": np.flatnonzero(wordish[:-4] & gap[1:-3] & wordish[2:-2] & gap[3:-1] & wordish[4:]) if len(c) > 4 else [],
        }
        for trick, places in found.items():
            for i in np.unique(np.searchsorted(block.start, places, side="right") - 1).tolist():
                out[at[i]].add(trick)
    return out


def undisguised(texts: list[str], weights: Weights) -> list[str]:
    """Texts in lower case with spelling tricks undone: letters spaced out, of another script, as digits, repeated or hidden by asterisks."""
    words = weights.words

    def script(w: str) -> str:
        a, b = w.translate(_TO_LATIN), w.translate(_TO_CYRILLIC)
        return a if a in words else b if b in words else a if sum("a" <= c <= "z" for c in w) * 2 > len(w) else b

    def leet(w: str) -> str:
        if not any(c.isalpha() for c in w):
            return w
        return next((v for v in (w.translate(_LEET), w.translate(_LEET_I), w.translate(_LEET).translate(_TO_CYRILLIC)) if words.get(v, 0) > 0), w)

    def masked(w: str) -> str:
        shown = sum(c not in "*#" for c in w)
        if shown < 2 or shown == len(w):
            return w
        shape = re.compile("".join("." if c in "*#" else re.escape(c) for c in w))
        keys = [(len(w), w[0])] if w[0] not in "*#" else [k for k in weights.toxic if k[0] == len(w)]
        fits = [v for k in keys for v in weights.toxic.get(k, ()) if shape.fullmatch(v)]
        return max(fits, key=words.__getitem__) if fits else w

    low = [(t if t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)).lower() for t in texts]
    for i, tricks in enumerate(_suspects(low)):
        t = low[i]
        if "spaced" in tricks:
            t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), t)
        if "script" in tricks or "spaced" in tricks:
            t = _replaced(t, _MIXED, script)
        if "leet" in tricks:
            t = _replaced(t, _LEETED, leet)
        if "long" in tricks:
            t = _LONG.sub(r"\1", t)
        if "masked" in tricks:
            t = _replaced(t, _MASKED, masked, "*#")
        low[i] = t
    return low


def _best(scores: np.ndarray) -> tuple[float, int, int]:
    """Score, begin and end of the maximum-scoring segment; (0, 0, 0) where no score is positive."""
    p = np.flatnonzero(scores > 0)
    if not len(p):
        return 0.0, 0, 0
    c = np.concatenate(([0.0], np.cumsum(scores)))
    low = np.minimum.accumulate(c[p])
    gain = c[p + 1] - low
    j = int(gain.argmax())
    i = int(np.flatnonzero(c[p[: j + 1]] == low[j])[-1])
    return float(gain[j]), int(p[i]), int(p[j]) + 1


def all_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, in linear time (Ruzzo and Tompa)."""
    kept: list[tuple[float, float, int, int]] = []  # sum before, sum at the end, begin, end
    total = 0.0
    for k, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        left, right, begin, end = total, total + s, k, k + 1
        total = right
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= left:
                j -= 1
            if j < 0 or kept[j][1] >= right:
                kept.append((left, right, begin, end))
                break
            left, begin = kept[j][0], kept[j][2]
            del kept[j:]
    return [(r - l, b, e) for l, r, b, e in kept]


def _by_halves(texts: list[str | None], halves: list[int], weights: list[Weights]) -> list[str | None]:
    """Each text undisguised with the weights of its half; null where there are none for it."""
    out: list[str | None] = [None] * len(texts)
    for k, w in enumerate(weights):
        mine = [i for i, t in enumerate(texts) if t is not None and halves[i] == k]
        for i, t in zip(mine, undisguised([texts[i] for i in mine], w)):
            out[i] = t
    return out


def _word_counts(weights: Weights | None):
    """Of judged texts: how often each word stands in toxic passages and in clean texts."""
    schema = pa.schema([("half", pa.int32()), ("word", pa.string()), ("toxic", pa.float64()), ("clean", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, str], list[float]] = {}
        for batch in batches:
            toxics, halves, texts = (c.to_pylist() for c in batch.columns)
            plain = _by_halves(texts, halves, weights) if weights else [t.lower() for t in texts]
            for toxic, half, t in zip(toxics, halves, plain):
                w = weights[half] if weights else None
                words = _WORD.findall(t)
                if w:
                    best, b, e = _best(np.array([w.words.get(x, w.other) for x in words]))
                    passage = words[b:e] if best >= CLEAR else []
                    # what misleads in clean texts counts more than their other words
                    words = passage if toxic else words + passage * MISLEADING
                else:
                    words = list(set(words))
                for x in words:
                    counts.setdefault((half, x), [0.0, 0.0])[0 if toxic else 1] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys]), pa.array([counts[k][0] for k in keys]), pa.array([counts[k][1] for k in keys])], schema=schema
        )

    return run


def _corpus_counts(hashes: np.ndarray):
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashes) + 1, np.int64)
        for batch in batches:
            for _, block in blocks([None if t is None else t.lower() for t in batch.column(0).to_pylist()]):
                h, _ = word_hashes(block)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                total[:-1] += np.bincount(at[hashes[at] == h], minlength=len(hashes))
                total[-1] += len(h)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], schema=schema)

    return run


def _log_odds(counts: dict[str, tuple[float, float]], share: dict[str, float], first: bool) -> Weights:
    """Log-odds of words with priors by their share of the corpus; words whose score isn't clear of its error fall to the rest."""
    n = np.array([sum(c[k] for c in counts.values()) for k in (0, 1)]) + 1.0
    part = n / n.sum()
    words, rest = {}, np.zeros(2)
    for w, c in counts.items():
        prior = (PRIOR * share.get(w, 0.0) + EVEN) * part
        a, b = c[0] + prior[0], c[1] + prior[1]
        score = float(np.log(a / n[0]) - np.log(b / n[1]))
        if score > 0 and c[0] >= 2 and score / np.sqrt(1 / a + 1 / b) > 1.64:
            words[w] = score
            continue
        rest += c
        if score < 0 and c[1] >= MISLEADING:
            words[w] = score
    rest += EVEN * part
    other = min(-0.3, float(np.log(rest[0] / n[0]) - np.log(rest[1] / n[1]))) if not first else -0.7
    # words known from clean texts cost more than unknown ones, or go with them
    words = {w: s for w, s in words.items() if s > 0 or s < other}
    if first:
        words = {w: s - 0.7 for w, s in words.items()}
    return Weights({w: max(-4.0, min(8.0, s)) for w, s in words.items()}, max(-4.0, other))


def _sharpened(weights: Weights, passages: list[tuple[float, list[str]]], pull: float = 0.02, steps: int = 400) -> Weights:
    """Log-odds moved as little as needed so that their sums tell toxic passages from misleading ones.

    Logistic loss over (toxic, words) with a quadratic pull of each word's score towards the one it has.
    """
    if not passages or len({t for t, _ in passages}) < 2:
        return weights
    seen: dict[str, int] = {}
    for _, words in passages:
        for w in words:
            seen[w] = seen.get(w, 0) + 1
    names = [w for w, n in seen.items() if n >= 2 or w in weights.words]
    at = {w: i for i, w in enumerate(names)}
    rest = len(names)
    start = np.array([*(weights.words.get(w, weights.other) for w in names), weights.other])
    row = np.concatenate([np.full(len(words), i) for i, (_, words) in enumerate(passages)]).astype(np.int64)
    column = np.array([at.get(w, rest) for _, words in passages for w in words], np.int64)
    y = np.array([t for t, _ in passages], float)
    value, bias = start.copy(), float(np.median(np.bincount(row, start[column], len(y))))
    # only words that speak for a toxic passage may come to speak for it more
    most = np.where(start > 0, start + 2, start)
    most[rest], start[rest] = weights.other, weights.other
    # a word moves the more easily the more often it is seen
    step = 0.5 / (0.25 * np.bincount(column, minlength=len(value)) * 4 + pull)
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(np.bincount(row, value[column], len(y)) - bias, -30, 30))) - y
        value -= step * (np.bincount(column, miss[row], len(value)) + pull * (value - start))
        value = np.minimum(value, most)
        bias += 0.5 / len(y) * miss.sum()
    value = np.clip(value, -8, 10)
    words = {**weights.words, **{w: float(v) for w, v in zip(names, value) if w in weights.words or v < weights.other - 0.3}}
    return Weights(words, weights.other)


def _best_passages(weights: list[Weights]):
    """Of judged texts: the half, the judgement and the words of the best segment."""
    schema = pa.schema([("half", pa.int32()), ("toxic", pa.float64()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            toxics, halves, texts = (c.to_pylist() for c in batch.columns)
            for toxic, half, t in zip(toxics, halves, _by_halves(texts, halves, weights)):
                w = weights[half]
                words = _WORD.findall(t)
                best, b, e = _best(np.array([w.words.get(x, w.other) for x in words]))
                if best >= CLEAR:
                    for column, value in zip(out, (half, float(toxic), words[b:e][:PASSAGE])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def _rate(weights: Weights, share: dict[str, float]) -> float:
    """The root lambda of sum p exp(lambda s) = 1."""
    p = np.array([share.get(w, 0.0) for w in weights.words])
    s = np.array(list(weights.words.values()))
    rest = max(1e-9, 1 - p.sum())
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if (p * np.exp(mid * s)).sum() + rest * np.exp(mid * weights.other) < 1:
            lo = mid
        else:
            hi = mid
    return max(lo, 0.05)


def _scan(weights: list[Weights], by_half: bool):
    """(id, score, n, passages) of every text; with ``by_half``, by the weights fitted on the other half."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("n", pa.int64()), ("passages", pa.list_(pa.string()))])

    def scores_of(block: Block, w: Weights, arrays: tuple) -> tuple[np.ndarray, np.ndarray]:
        h, value, letters, strong = arrays
        begin, end, text = block.words()
        hashes = span_hash(block.prefix(), begin, end)
        at = np.minimum(np.searchsorted(h, hashes), max(len(h) - 1, 0))
        known = h[at] == hashes if len(h) else np.zeros(len(hashes), bool)
        out = np.where(known, value[at] if len(h) else w.other, w.other)
        if len(letters) and len(hashes):
            mine = _letters(block)
            spot = np.minimum(np.searchsorted(letters, mine), len(letters) - 1)
            turned = ~known & (letters[spot] == mine)
            out[turned] = strong[spot[turned]]
        return out, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [w.arrays() for w in weights]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            halves = [1 - x for x in batch.column(2).to_pylist()] if by_half else [0] * len(ids)
            out: list[list] = [[], [], [], []]
            every = _by_halves(texts, halves, weights)
            for k, w in enumerate(weights):
                plain = [t if halves[i] == k else None for i, t in enumerate(every)]
                for at, block in blocks(plain):
                    values, text = scores_of(block, w, arrays[k])
                    bound = np.searchsorted(text, np.arange(len(at) + 1))
                    any_good = np.concatenate(([0], np.cumsum(values > 0)))
                    for j, i in enumerate(at.tolist()):
                        lo, hi = int(bound[j]), int(bound[j + 1])
                        best, passages = 0.0, []
                        if any_good[hi] > any_good[lo]:
                            best = _best(values[lo:hi])[0]
                            floor_ = _least_score(w, hi - lo)
                            if best >= floor_:
                                words = _WORD.findall(plain[i])
                                passages = [" ".join(words[b:e]) for s, b, e in all_segments(values[lo:hi].tolist()) if s >= floor_]
                        for column, value in zip(out, (ids[i], best, hi - lo, passages)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def _least_score(w: Weights, n: int) -> float:
    """The score a segment of n words needs for the cut."""
    return (np.log(w.volume * max(n, 1)) + w.cut * np.log(10)) / w.rate


def _significance(score: Column, n: Column, w: Weights) -> Column:
    expected = F.log(F.lit(w.volume) * F.greatest(n, F.lit(1))) - score * w.rate
    # -log10(1 - exp(-x)) is -log10(x) for small x
    return F.when(expected < -6, -expected / float(np.log(10))).otherwise(-F.log10(1 - F.exp(-F.exp(F.least(expected, F.lit(6.0)))) + 1e-300))


def judged(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(id, toxic, half, text): documents on which the raters' majority is clear; at most about ``most`` of them, by hash."""
    votes = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("share"))
    votes = votes.where("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("toxic"))
    keep = min(1.0, most / max(1, votes.count()))
    votes = votes.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(keep * 1_000_000))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    return documents.where("text is not null").join(votes, "doc_id").select(F.col("doc_id").cast("bigint").alias("id"), "toxic", half.alias("half"), "text")


def fit(documents: DataFrame, labels: DataFrame, most: int = 20000) -> Weights:
    """Weights of words fitted on at most about ``most`` judged documents, with priors and calibration from the whole corpus."""
    texts = spread(documents.select("doc_id", "text"))
    sample = durable(judged(texts, labels, most))
    form = "half int, word string, toxic double, clean double"

    def counts(weights: list[Weights] | None) -> list[dict[str, tuple[float, float]]]:
        some = sample.select("toxic", "half", "text").mapInArrow(_word_counts(weights), form).groupBy("half", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        halves: list[dict] = [{}, {}, {}]
        for r in some.where("toxic > 0 or clean > 2").toLocalIterator():
            halves[r["half"]][r["word"]] = (r["toxic"], r["clean"])
        for h in halves[:2]:
            for w, c in h.items():
                have = halves[2].get(w, (0.0, 0.0))
                halves[2][w] = (have[0] + c[0], have[1] + c[1])
        return halves

    found = counts(None)
    vocabulary = sorted(found[2])
    share: dict[str, float] = {}
    if vocabulary:
        h, text = word_hashes(Block(vocabulary))
        order = np.argsort(h)
        numbers = texts.select("text").where("text is not null").mapInArrow(_corpus_counts(h[order]), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
        times = {r["word"]: r["n"] for r in numbers}
        total = max(1, times.get(len(h), 1))
        share = {vocabulary[text[order[k]]]: n / total for k, n in times.items() if k < len(h)}
    weights = [_log_odds(c, share, True) for c in found]
    for _ in range(ROUNDS):
        # each half's own weights pick its segments, those of both halves the segments of all
        halves = counts(weights[:2])
        weights = [_log_odds(c, share, False) for c in halves]
    for _ in range(SHARPENINGS):
        best = sample.select("toxic", "half", "text").mapInArrow(_best_passages(weights[:2]), "half int, toxic double, words array<string>").collect()
        parts = [[(r["toxic"], r["words"]) for r in best if r["half"] == k] for k in (0, 1)]
        weights = [_sharpened(w, p) for w, p in zip(weights, (*parts, parts[0] + parts[1]))]
    for w in weights:
        w.rate = _rate(w, share)
    # K and the cut from documents scored by the other half's weights
    held = sample.select("id", "text", "half").mapInArrow(_scan(weights[:2], True), "id bigint, score double, n bigint, passages array<string>")
    rows = held.join(sample.select("id", "toxic"), "id").select("score", "n", "toxic").collect()
    score, n, toxic = (np.array([r[k] for r in rows], float) for k in ("score", "n", "toxic"))
    last = weights[2]
    clean = toxic == 0
    if clean.any():
        last.volume = float(1 / np.mean(np.maximum(n[clean], 1) * np.exp(-last.rate * score[clean])))
    if toxic.any():
        power = -(np.log(last.volume * np.maximum(n, 1)) - last.rate * score) / np.log(10)
        order = np.argsort(-power)
        # clean documents are under-represented among the judged ones; false alarms weigh accordingly
        hits, alarms = np.cumsum(toxic[order]), np.cumsum(1 - toxic[order])
        f1 = 2 * hits / (hits + ALARM * alarms + toxic.sum())
        k = int(f1.argmax())
        nxt = power[order[k + 1]] if k + 1 < len(order) else power[order[k]] - 1
        last.cut = float((power[order[k]] + nxt) / 2)
    return last


#: How many clean documents of the corpus a clean judged one stands for, against toxic ones.
ALARM = 4.0


def toxic_scores(documents: DataFrame, weights: Weights) -> DataFrame:
    """(id, score, significance, toxic, passages) for every document.

    ``significance``: minus the decimal logarithm of the probability of such a segment by
    chance; ``toxic``: whether it reaches the cut; ``passages``: the significant ones, in lower case and with spelling
    tricks undone. Null, empty and blank texts score 0. Rows are scored each for itself.
    """
    picked = spread(documents.select(F.col("doc_id").cast("bigint").alias("id"), "text")).withColumn("text", F.coalesce("text", F.lit("")))
    out = picked.mapInArrow(_scan([weights], False), "id bigint, score double, n bigint, passages array<string>")
    power = -(F.log(F.lit(weights.volume) * F.greatest("n", F.lit(1))) - F.col("score") * weights.rate) / float(np.log(10))
    sure = (F.col("score") > 0) & (power >= weights.cut)
    return out.select("id", F.round("score", 6).alias("score"), F.round(_significance(F.col("score"), F.col("n"), weights), 6).alias("significance"), sure.alias("toxic"), "passages")
