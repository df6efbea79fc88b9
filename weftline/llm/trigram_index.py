"""A trigram index over texts, and the trigrams that a regular expression requires.

``required`` walks a pattern's syntax tree and says which trigrams every match
must contain, as a tree of "all of" and "one of". The index keeps, for each
trigram that some pattern requires, the texts holding it. Intersecting and uniting
these postings gives the texts a pattern can match in; only there it is run.

The index is kept in segments, one for each batch of texts, as a text's postings
never need another segment: so it is built where the texts are read and no posting is
shuffled.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as op
from re import _parser as parser

import numpy as np

from weftline.functions.codepoints import Block

ALWAYS = ("all", ())


def _grams(literal: str) -> tuple:
    return ("all", tuple(dict.fromkeys(literal[i : i + 3] for i in range(len(literal) - 2))))


def _both(a: tuple, b: tuple) -> tuple:
    return a if b == ALWAYS else b if a == ALWAYS else ("all", (*(a[1] if a[0] == "all" else (a,)), *(b[1] if b[0] == "all" else (b,))))


def _one_of(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ALWAYS if ALWAYS in parts else parts[0] if len(parts) == 1 else ("one", tuple(parts))


def _strings(item: tuple, most: int = 8) -> list[str] | None:
    """The few strings an item can match, or None."""
    kind, arg = item
    if kind is op.LITERAL:
        return [chr(arg).lower()]
    if kind is op.IN and arg and len(arg) <= most and all(k is op.LITERAL for k, _ in arg):
        return list(dict.fromkeys(chr(c).lower() for _, c in arg))
    if kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
        return [""]
    if kind is op.SUBPATTERN:
        return _few(list(arg[3]), most)
    if kind is op.BRANCH:
        out = []
        for branch in arg[1]:
            if (s := _few(list(branch), most)) is None:
                return None
            out += s
        return list(dict.fromkeys(out)) if len(set(out)) <= most else None
    if kind is op.MAX_REPEAT and arg[1] == 1 and arg[0] == 0:
        s = _few(list(arg[2]), most)
        return None if s is None else list(dict.fromkeys(["", *s]))
    return None


def _few(items: list, most: int) -> list[str] | None:
    out = [""]
    for item in items:
        if (s := _strings(item, most)) is None or len(out) * len(s) > most * 4:
            return None
        out = [a + b for a, b in product(out, s)]
    return out


def _need(items: list) -> tuple:
    need, run = ALWAYS, [""]

    def close(found: tuple, run: list[str]) -> tuple:
        return _both(found, _one_of([_grams(s) if len(s) > 2 else ALWAYS for s in run]))

    for item in items:
        s = _strings(item)
        if s is not None and len(run) * len(s) <= 32:
            run = [a + b for a, b in product(run, s)]
            continue
        need, run = close(need, run), [""]
        kind, arg = item
        if s is not None:
            run = s
        elif kind is op.SUBPATTERN:
            need = _both(need, _need(list(arg[3])))
        elif kind is op.BRANCH:
            need = _both(need, _one_of([_need(list(b)) for b in arg[1]]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
            need = _both(need, _need(list(arg[2])))
    return close(need, run)


def required(pattern: str) -> tuple:
    """What each match of ``pattern``, read without regard to case, contains: ("all", parts) or ("one", parts) of trigrams or such trees."""
    return _need(list(parser.parse(pattern, re.IGNORECASE)))


def trigrams_of(tree: tuple | str) -> set[str]:
    return {tree} if isinstance(tree, str) else set().union(*map(trigrams_of, tree[1])) if tree[1] else set()


def _code(gram: str) -> int:
    a, b, c = map(ord, gram)
    return (a << 42) | (b << 21) | c


class Segment:
    """The postings of one block of texts (in lower case) for the trigrams wanted."""

    SLOTS = 20

    def __init__(self, block: Block, wanted: Wanted):
        self.n = len(block.length)
        c = block.codes.astype(np.uint64)
        code = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:] if len(c) > 2 else np.zeros(0, np.uint64)
        at = np.flatnonzero(wanted.slots[(code * wanted.step >> np.uint64(64 - self.SLOTS)).astype(np.int64)])
        code = code[at]
        which = np.searchsorted(wanted.codes, code)
        which[which == len(wanted.codes)] = 0
        real = wanted.codes[which] == code
        text = np.searchsorted(block.start, at[real], side="right") - 1
        pairs = np.unique(which[real].astype(np.int64) * self.n + text)
        self.gram, self.text = pairs // max(self.n, 1), pairs % max(self.n, 1)
        self.wanted = wanted
        self.block = block

    def texts_with_run(self, letters: np.ndarray, least: int) -> np.ndarray:
        """The texts with ``least`` or more signs of a class in a row, ascending: the postings of a class, which trigrams can't tell."""
        codes = self.block.codes
        inside = letters[np.minimum(codes, len(letters) - 1)] & (codes < len(letters))
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return np.unique(np.searchsorted(self.block.start, begin[end - begin >= least], side="right") - 1)

    def postings(self, gram: str) -> np.ndarray:
        k = self.wanted.number[gram]
        lo, hi = np.searchsorted(self.gram, (k, k + 1))
        return self.text[lo:hi]

    def texts(self, tree: tuple | str) -> np.ndarray:
        """The texts that hold what the tree requires, ascending."""
        if isinstance(tree, str):
            return self.postings(tree)
        kind, parts = tree
        if not parts:
            return np.arange(self.n)
        out = self.texts(parts[0])
        for p in parts[1:]:
            out = np.intersect1d(out, self.texts(p), assume_unique=True) if kind == "all" else np.union1d(out, self.texts(p))
        return out


class Wanted:
    """The trigrams to index, for quick lookup."""

    step = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, trees: list[tuple]):
        grams = sorted(set().union(*map(trigrams_of, trees)), key=_code)
        self.codes = np.array([_code(g) for g in grams], np.uint64)
        self.number = {g: i for i, g in enumerate(grams)}
        self.slots = np.zeros(1 << Segment.SLOTS, dtype=bool)
        self.slots[(self.codes * self.step >> np.uint64(64 - Segment.SLOTS)).astype(np.int64)] = True
