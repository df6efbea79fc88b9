"""A project's index from folder to answer: read, chunk, embed, store; then search, fuse and render."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import is_blank
from weftline.operators import chunking, hybrid, lexical, memory, render, vector
from weftline.operators.providers import EmbeddingProvider, embedded
from weftline.sources import files

FORM = "id string, path string, chunk_index int, documents string, embedding array<float>, embedding_kind string"


class Project:
    """One collection of chunks in a folder.

    The lexical index reads chunks as stored, with line numbers; vectors are made of the text without them.
    """

    def __init__(self, spark: SparkSession, folder: str, provider: EmbeddingProvider | None = None):
        self.spark, self.provider = spark, provider
        self.store = memory.Collection(spark, folder, "project_files_hybrid")
        self._index: tuple[str | None, lexical.LexicalIndex] | None = None
        files.register(spark)

    def _chunks(self, read: DataFrame) -> DataFrame:
        found = embedded(chunking.indexed(read.where("error is null"), "path", "content"), F.col("clean"), self.provider, "search_document")
        return found.select("id", "path", "chunk_index", F.col("numbered").alias("documents"), "embedding", "embedding_kind")

    def index(self, root: str) -> DataFrame:
        """Index a folder from scratch and return (files, chunks, errors)."""
        read = self.spark.read.format("text_folder").load(root)
        self.store.write(self._chunks(read))
        counts = self.stats()
        return counts.crossJoin(read.agg(F.count("error").alias("errors")))

    def reindex(self, root: str, paths: DataFrame) -> None:
        """Index some files again; all their earlier chunks go."""
        read = self.spark.read.format("text_folder").load(root).join(paths.select("path"), "path", "left_semi")
        old = self.store.read(FORM)
        self.store.write(old.join(read.select("path").distinct(), "path", "left_anti").unionByName(self._chunks(read)))

    def stats(self) -> DataFrame:
        """(files, chunks) stored."""
        return self.store.read(FORM).agg(F.countDistinct("path").alias("files"), F.count("*").alias("chunks"))

    def _lexical(self) -> lexical.LexicalIndex:
        """The lexical index, built at the first search and again after the chunks have changed."""
        version = self.store.version()
        if self._index is None or self._index[0] != version:
            self._index = version, lexical.LexicalIndex(self.store.read(FORM), "id", "documents")
        return self._index[1]

    def search(self, questions: DataFrame, n: int = 5, mode: str = "hybrid") -> DataFrame:
        """The ``n`` best chunks for each question (query_id, query); blank questions find nothing."""
        rows = self.store.read(FORM)
        asked = questions.where(~is_blank(F.col("query")))
        vectors = embedded(asked, F.col("query"), self.provider, "search_query")
        near = vector.nearest(rows, "id", "embedding", vectors, "query_id", "embedding", hybrid.pool_size(n))
        words = self._lexical().search(asked, "query_id", "query", hybrid.pool_size(n))
        return hybrid.ranked(hybrid.fuse(near, words, mode), rows.select("id", "path", F.col("documents").alias("text")), n)

    def ask(self, questions: DataFrame, n: int = 5, mode: str = "hybrid") -> DataFrame:
        """(query_id, shown, total, answer) within the budgets."""
        return render.rendered(self.search(questions, n, mode))
