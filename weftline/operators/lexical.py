"""Lexical index and ranked search over tokenised texts.

The score of a document for a query is the sum over the query's tokens, repeated
ones counted again, of idf * tf / (1 + 0.75 (dl / avgdl - 1)) * (1 + 0.75 tf / (tf + 1)) with
idf = ln((N - df + 0.5) / (df + 0.5) + 1).

Texts are tokenised in one pass over whole Arrow batches, which gives each text's terms
with their counts, and its length. An index keeps what that pass gives and is searched any number of times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.codepoints import Block, blocks, sign_table, span_hash
from weftline.functions.text import TOKEN, tokens
from weftline.sources.tables import durable, spread, stamp, table

B = 0.75
#: Distinct terms of a query set up to which they are named to the scan of an index, which then skips pages without them; beyond it a join alone picks them.
TERMS = 1000


def length(text: Column) -> Column:
    """The number of tokens, without building them."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(TOKEN)), F.lit(0))


def tokenised(texts: DataFrame, id: str, text: str) -> DataFrame:
    """(id, tokens, dl), the tokens in order. Null texts have no tokens, as empty ones."""
    found = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    return texts.select(F.col(id).alias("id"), found.alias("tokens")).withColumn("dl", F.size("tokens"))


def _counted(only: list[str] | None):
    if only is not None:
        asked = Block(only)
        wanted = np.sort(span_hash(asked.prefix(), asked.start, asked.start + asked.length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at, block in blocks(texts):
                begin, end, _ = block.words()
                sign = np.flatnonzero(sign_table()[block.codes])
                begin, end = np.concatenate((begin, sign)), np.concatenate((end, sign + 1))
                text = np.searchsorted(block.start, begin, side="right") - 1
                h = span_hash(block.prefix(), begin, end)
                dl = np.bincount(text, minlength=len(at))
                if only is not None:
                    found = np.searchsorted(wanted, h)
                    found[found == len(wanted)] = 0
                    kept = np.flatnonzero(wanted[found] == h) if len(wanted) else np.zeros(0, np.int64)
                    begin, end, text, h = begin[kept], end[kept], text[kept], h[kept]
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.append(first, len(h)))
                _, one, term = np.unique(h[first], return_index=True, return_inverse=True)
                one = first[one]
                base = block.start[text[one]]
                names = [texts[at[t]][b:e] for t, b, e in zip(text[one].tolist(), (begin[order[one]] - base).tolist(), (end[order[one]] - base).tolist())]
                owner = text[first]
                rows = np.concatenate((at[owner], at))
                terms = pa.concat_arrays([pa.array(names, pa.string()).take(pa.array(term.astype(np.int64))), pa.nulls(len(at), pa.string())])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        terms,
                        pa.array(np.concatenate((tf, np.bincount(owner, minlength=len(at)))), pa.int64()),
                        pa.array(np.concatenate((dl[owner], dl)), pa.int64()),
                    ],
                    ["id", "term", "tf", "dl"],
                )

    return run


def counted(texts: DataFrame, id: str, text: str, only: list[str] | None = None) -> DataFrame:
    """(id, term, tf, dl): a row for each text and each of its terms, of which ``only`` some may be wanted; and one for each text with a null term and, as ``tf``, the number of these terms.

    Null texts have no tokens, as empty ones. Rows of one id are texts of their own.
    """
    read = spread(texts.select(F.col(id).alias("id"), F.col(text).alias("text"))).select("id", F.lower("text").alias("text"))
    return read.mapInArrow(_counted(only), f"id {read.schema['id'].dataType.simpleString()}, term string, tf bigint, dl bigint")


def term_frequency(texts: DataFrame, id: str, text: str) -> DataFrame:
    """(id, term, tf)."""
    return counted(texts, id, text).where("term is not null").select("id", "term", "tf")


def corpus_stats(texts: DataFrame, id: str, text: str) -> DataFrame:
    """(n_docs, total_len, avg_len) in one row; avg_len is 0 for no documents."""
    found = counted(texts, id, text, []).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"))
    return found.withColumn("avg_len", F.col("total_len") / F.greatest(F.col("n_docs"), F.lit(1)))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def document_frequency(texts: DataFrame, id: str, text: str) -> DataFrame:
    """(term, df, idf)."""
    counts = counted(texts, id, text).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(texts.agg(F.count("*").alias("n")))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def _asked(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query))).alias("term"))
    return asked.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _sizes(found: DataFrame) -> tuple[int, float]:
    """The number of texts and their mean length."""
    n, mean = found.where("term is null").agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    return n, mean


def _scored(found: DataFrame, asked: DataFrame, n: int, mean: float) -> DataFrame:
    """Scores from a table of counted terms, rounded to nine digits.

    Document frequencies are counted for the queries' terms only, so they are as few as those; Spark broadcasts them and the queries
    where they are small by its own measure.
    """
    hits = found.where("term is not null").join(asked.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighted = asked.join(df, "term").select("query_id", "term", (F.col("qtf") * idf(F.lit(n), F.col("df"))).alias("weight"))
    part = F.col("weight") * (F.col("tf") / (1 + B * (F.col("dl") / F.lit(mean) - 1))) * (1 + B * F.col("tf") / (F.col("tf") + 1))
    return hits.join(weighted, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))


def scores(texts: DataFrame, id: str, text: str, queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """(query_id, id, score) of every text with a token of the query, from one pass over the texts.

    The pass gives the queries' terms only; the query set is a stated one, whose terms every task holds.
    """
    asked = durable(_asked(queries, query_id, query))
    terms = [r["term"] for r in asked.select("term").distinct().collect()]
    found = durable(counted(texts, id, text, terms))
    return _scored(found, asked, *_sizes(found))


class LexicalIndex:
    """The counted terms of all texts, kept in the shared folder, with the number of texts and their mean length.

    Each file of it holds the terms of its own texts in order. So building it moves no rows between tasks, no term is
    too common for one of them, and a search reads of each file the pages with its terms.
    """

    def __init__(self, texts: DataFrame, id: str, text: str):
        self.terms = durable(counted(texts, id, text).sortWithinPartitions("term"))
        self.sizes = _sizes(self.terms)

    def search(self, queries: DataFrame, query_id: str, query: str, n: int = 10, terms: int = TERMS) -> DataFrame:
        """(query_id, id, score, rank), as ``search``. ``terms`` changes what is read, not the result."""
        asked = durable(_asked(queries, query_id, query))
        named = [r["term"] for r in asked.select("term").distinct().limit(terms + 1).collect()]
        found = self.terms.where(F.col("term").isin(named)) if len(named) <= terms else self.terms
        return best(_scored(found, asked, *self.sizes).where("score > 0"), n)


_kept: dict[tuple[str, str, str, str], tuple[str, LexicalIndex]] = {}


def index_of(spark: SparkSession, folder: str, name: str, id: str, text: str) -> LexicalIndex:
    """The index of a stored table. It is built once and used until the table's files change; then it is dropped and built anew."""
    key, now = (spark.sparkContext.applicationId, f"{folder}/{name}", id, text), stamp(spark, f"{folder}/{name}.parquet")
    if key not in _kept or _kept[key][0] != now:
        _kept[key] = now, LexicalIndex(table(spark, folder, name), id, text)
    return _kept[key][1]


def best(found: DataFrame, n: int, score: str = "score", ascending: bool = False) -> DataFrame:
    """The ``n`` best rows of each query with ``rank`` from 1; ties by id. Each partition keeps its n best before the shuffle."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).where(F.col("rank") <= n)


def search(texts: DataFrame, id: str, text: str, queries: DataFrame, query_id: str, query: str, n: int = 10) -> DataFrame:
    """(query_id, id, score, rank): the ``n`` best texts with a score above 0 for each query. Null and blank queries find nothing."""
    return best(scores(texts, id, text, queries, query_id, query).where("score > 0"), n)
