"""Small hostile inputs for the training-data operators."""

from __future__ import annotations

import random

CHUNKS = "row_id bigint, documents string, path string, id string, copy string, sig string, block int, batch int, source string"


def numbered(text: str, start: int = 1) -> str:
    return "\n".join(f"{start + i}: {line}" for i, line in enumerate(text.split("\n")))


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdeжзик") for _ in range(r.randint(2, 7))) for _ in range(n)]


def chunk_rows(texts: list[tuple[str | None, str | None]]) -> list[tuple]:
    """(text, path) as chunk rows with extra columns whose names the operators use inside."""
    return [(i, t, p, f"{p}::chunk{i}", "x", "y", 7, 3, "z") for i, (t, p) in enumerate(texts, 1)]
