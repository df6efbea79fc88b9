"""Whole batches of texts as numpy arrays of code points.

Arrow batches are joined into blocks of about a million code points, so that
hashing, word splitting and window minima run as array passes and no Python
code runs per character. Spark partitions and shuffles the work; these helpers
only see one batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from weftline.functions.text import BLANK_SIGNS

LINE_NUMBER = re.compile(r"(?m)^[0-9]+: ")
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def strip_line_numbers(text: str) -> str:
    """The text without the leading ``{n}: `` of each line."""
    return LINE_NUMBER.sub("", text)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(1)
def word_table() -> np.ndarray:
    """True at each code point that may stand in a word: letters, digits, underscore."""
    signs = np.concatenate((np.arange(0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)))
    t = np.zeros(0x110000, dtype=bool)
    for m in re.finditer(r"\w+", signs.tobytes().decode("utf-32-le")):
        t[signs[m.start() : m.end()]] = True
    return t


@lru_cache(1)
def sign_table() -> np.ndarray:
    """True at each code point that is neither in a word nor white space."""
    t = ~word_table()
    t[[ord(c) for c in BLANK_SIGNS]] = False
    return t


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


class Block:
    """Some texts side by side, each followed by one newline that belongs to none.

    ``codes`` holds the code points, ``start`` and ``length`` each text's place.
    """

    def __init__(self, texts: list[str]):
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.concatenate(([0], np.cumsum(self.length + 1)))[:-1].astype(np.int64)
        joined = "\n".join(texts) + "\n"
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)

    def prefix(self) -> np.ndarray:
        """Sums from which ``span_hash`` takes the hash of any span."""
        n = len(self.codes)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(self.codes + np.uint64(1)) * _power(_ODD, n), out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each word, and the index of the text it stands in."""
        edge = np.diff(np.concatenate(([0], word_table()[self.codes].view(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return begin, end, np.searchsorted(self.start, begin, side="right") - 1


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal spans have equal hashes wherever they stand."""
    inverse = _power(_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[begin]) * inverse[begin])


def blocks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, Block]]:
    """The texts that are not null in blocks of about ``limit`` code points, with their indices."""
    at: list[int] = []
    some: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        at.append(i)
        some.append(t)
        size += len(t) + 1
        if size >= limit:
            yield np.array(at), Block(some)
            at, some, size = [], [], 0
    if at:
        yield np.array(at), Block(some)


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a block and the index of its text."""
    begin, end, text = block.words()
    return span_hash(block.prefix(), begin, end), text


def distinct_within(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, ascending, texts in order."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    first = np.ones(len(v), dtype=bool)
    first[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return v[first], t[first]
