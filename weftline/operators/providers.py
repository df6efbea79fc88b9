"""Embedding models behind one interface; the default needs no model and no network."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.codepoints import blocks, mix, word_hashes


class EmbeddingProvider(Protocol):
    """Vectors for a batch of texts, null for null."""

    def embed(self, texts: list[str | None]) -> list[list[float] | None]: ...


class ChatProvider(Protocol):
    """Answers for a batch of prompts, null for null. There is no default: a model is an outside service."""

    def answer(self, prompts: list[str | None]) -> list[str | None]: ...


class HashingProvider:
    """Signed hashing of words into ``size`` places, to unit length. Deterministic; no semantics beyond shared words."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str | None]) -> list[list[float] | None]:
        out: list[list[float] | None] = [None if t is None else [0.0] * self.size for t in texts]
        for at, block in blocks([None if t is None else t.lower() for t in texts]):
            hashes, text = word_hashes(block)
            place = (hashes % np.uint64(self.size)).astype(np.int64)
            sign = np.where(mix(hashes) >> np.uint64(63), 1.0, -1.0)
            sums = np.bincount(text * self.size + place, sign, len(at) * self.size).astype(float).reshape(len(at), self.size)
            sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
            for i, v in zip(at.tolist(), sums.tolist()):
                out[i] = v
        return out


def embedded(rows: DataFrame, text: Column, provider: EmbeddingProvider | None = None, prefix: str | None = None) -> DataFrame:
    """``rows`` with ``embedding`` and ``embedding_kind``, the task prefix it was made with.

    Vectors of different kinds must not be compared. With a ``prefix`` (``search_document``, ``search_query``) the model reads ``prefix: text``.
    """
    model = provider or HashingProvider()

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array(model.embed(texts.to_pylist()), pa.list_(pa.float32()))

    read = text if prefix is None else F.concat(F.lit(prefix + ": "), text)
    return rows.withColumn("embedding", vectors(read)).withColumn("embedding_kind", F.lit(prefix or "plain"))


def answered(rows: DataFrame, prompt: Column, provider: ChatProvider) -> DataFrame:
    """``rows`` with ``answer``, asked in batches where the rows are."""

    @F.arrow_udf("string")
    def ask(prompts: pa.Array) -> pa.Array:
        return pa.array(provider.answer(prompts.to_pylist()), pa.string())

    return rows.withColumn("answer", ask(prompt))
