"""Queries of the lexical index, vector search, fusion, rendering and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import TOKEN
from weftline.operators import evaluate, hybrid, lexical, render, vector
from weftline.operators.providers import embedded
from weftline.plans.base import Plans
from weftline.sources.tables import durable, spread, table

PLANS = Plans()
N = 5
POOL = hybrid.pool_size(N)
MODES = ["vector", "bm25", "hybrid"]


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "project_files_hybrid")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set: every item whose id is divisible by 20."""
    return table(spark, folder, "eval_cases").where("item_id % 20 = 0")


def _details(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select(F.col("row_id").alias("id"), "path", F.col("documents").alias("text"))


def _asked_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return _questions(spark, folder).select("item_id").join(vectors, "item_id")


def _vector_pool(spark: SparkSession, folder: str) -> DataFrame:
    return vector.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", _asked_vectors(spark, folder), "item_id", "embedding", POOL)


def _index(spark: SparkSession, folder: str) -> lexical.LexicalIndex:
    return lexical.index_of(spark, folder, "project_files_hybrid", "row_id", "documents")


def _lexical_pool(spark: SparkSession, folder: str, n: int = POOL) -> DataFrame:
    return _index(spark, folder).search(_questions(spark, folder), "item_id", "query", n)


def _hits(spark: SparkSession, folder: str, *modes: str) -> DataFrame:
    """The hits of each mode; the two pools of candidates are made once for all."""
    pools = durable(_vector_pool(spark, folder)), durable(_lexical_pool(spark, folder))
    fused = reduce(DataFrame.unionByName, (hybrid.fuse(*pools, m).withColumn("mode", F.lit(m)) for m in modes))
    return hybrid.ranked(fused, _details(spark, folder), N, ("mode", "query_id"))


_TOKENS = f"coalesce(regexp_extract_all(lower(documents), '{TOKEN}'), [])"
_BM25 = f"""
tok AS (SELECT row_id AS id, {_TOKENS} AS toks FROM project_files_hybrid),
dl AS (SELECT id, len(toks) AS dl FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(QUERY), '{TOKEN}')) AS term FROM eval_cases WHERE item_id % 20 = 0),
qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf / (1 + 0.75 * (dl / avgdl - 1))) * (1 + 0.75 * tf / (tf + 1))), 9) AS score
       FROM tf JOIN df USING (term) JOIN qt USING (term) JOIN dl USING (id) CROSS JOIN st GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0) WHERE rank <= LIMITED)
"""
_DISTANCE = "round(1 - list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) + 0.0::DOUBLE"
_VECTOR = f"""
vec AS (SELECT v.vec_id AS query_id, e.vec_id AS id, {_DISTANCE} AS distance
        FROM embeddings e CROSS JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT item_id FROM eval_cases WHERE item_id % 20 = 0)) v),
vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM vec) WHERE rank <= {POOL})
"""
_FUSED = """
fu AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.id, b.id) AS id, v.rank AS vector_rank, b.rank AS bm25_rank,
              coalesce(1 - v.distance, 0.0::DOUBLE) AS vector_score, coalesce(b.score, 0.0::DOUBLE) AS bm25_score,
              coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS rrf, 'MODE' AS mode
       FROM (SELECT * FROM vr WHERE 'MODE' <> 'bm25') v FULL JOIN (SELECT * FROM bm WHERE 'MODE' <> 'vector') b ON v.query_id = b.query_id AND v.id = b.id)
"""
_EXT = r"lower(regexp_extract(path, '[^/\\]+(\.[^./\\]*)$', 1))"
_EXAMPLE = "(contains(lower(TEXT), 'observation from') AND (contains(lower(TEXT), 'assistant:') OR contains(lower(TEXT), 'user:')))"
_DEMOTION = f"(CASE WHEN {_EXT} IN ('.md', '.rst', '.txt') THEN 0.3 ELSE 1.0 END)::DOUBLE * (CASE WHEN {_EXAMPLE.replace('TEXT', 'documents')} THEN 0.3 ELSE 1.0 END)::DOUBLE"
_RANKED = f"""
sd AS (SELECT fu.*, path, documents, round(rrf * {_DEMOTION}, 9) AS score FROM fu LEFT JOIN project_files_hybrid p ON p.row_id = fu.id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, id) AS position FROM sd) WHERE position <= {N})
"""


def _bm25_sql(query: str = "query", n: int = POOL) -> str:
    return _BM25.replace("QUERY", query).replace("LIMITED", str(n))


def _hits_sql(mode: str, suffix: str = "") -> str:
    out = ", ".join(x.strip() for x in (_FUSED.replace("MODE", mode), _RANKED))
    return out if not suffix else out.replace("fu AS", f"fu{suffix} AS").replace("sd AS", f"sd{suffix} AS").replace("hits AS", f"hits{suffix} AS").replace("FROM fu ", f"FROM fu{suffix} fu ").replace("FROM sd)", f"FROM sd{suffix})")


def _mode_sql(mode: str) -> str:
    return f"""WITH {_bm25_sql()}, {_VECTOR}, {_hits_sql(mode)}
SELECT query_id, id, path, vector_rank::BIGINT AS vector_rank, bm25_rank::BIGINT AS bm25_rank, score, position::BIGINT AS position FROM hits"""


_ALL_MODES = ", ".join([_bm25_sql(), _VECTOR, *(_hits_sql(m, f"_{m}") for m in MODES)])
_RANKS = f"""WITH {_ALL_MODES},
allhits AS ({" UNION ALL ".join(f"SELECT mode, query_id, path, position FROM hits_{m}" for m in MODES)}),
cases AS (SELECT item_id AS query_id, expected, mode FROM eval_cases CROSS JOIN (VALUES {", ".join(f"('{m}')" for m in MODES)}) t(mode) WHERE item_id % 20 = 0),
ranks AS (SELECT c.mode, c.query_id, min(CASE WHEN list_contains(c.expected, h.path) THEN h.position END) AS rank
          FROM cases c LEFT JOIN allhits h ON h.mode = c.mode AND h.query_id = c.query_id GROUP BY ALL)
"""


def _whole(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@PLANS.query(f"SELECT row_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT row_id, {_TOKENS} AS t FROM project_files_hybrid)")
def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.counted(_chunks(spark, folder), "row_id", "documents").where("term is null")
    return found.select(F.col("id").alias("row_id"), F.col("dl").alias("n_tokens"), F.col("tf").alias("n_distinct"))


@PLANS.query(f"SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest({_TOKENS}) AS term FROM project_files_hybrid) GROUP BY ALL")
def term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.term_frequency(_chunks(spark, folder), "row_id", "documents").withColumnRenamed("id", "row_id")


@PLANS.query(
    f"""SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 9) AS idf
FROM (SELECT term, count(*) AS df FROM (SELECT row_id, unnest(list_distinct({_TOKENS})) AS term FROM project_files_hybrid) GROUP BY ALL) CROSS JOIN (SELECT count(*) AS n FROM project_files_hybrid)"""
)
def document_frequency_idf(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.document_frequency(_chunks(spark, folder), "row_id", "documents").withColumn("idf", F.round("idf", 9))


@PLANS.query(f"SELECT count(*) AS n_docs, sum(len({_TOKENS}))::BIGINT AS total_len, round(sum(len({_TOKENS})) / greatest(1, count(*)), 9) AS avg_len FROM project_files_hybrid")
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.corpus_stats(_chunks(spark, folder), "row_id", "documents").withColumn("avg_len", F.round("avg_len", 9))


@PLANS.query(f"WITH {_bm25_sql(n=10)} SELECT query_id, id, score, rank::BIGINT AS rank FROM bm")
def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    return _whole(_lexical_pool(spark, folder, 10), "rank")


@PLANS.query(f"WITH {_bm25_sql('query || chr(32) || query || chr(32) || passage', 10)} SELECT query_id, id, score, rank::BIGINT AS rank FROM bm")
def bm25_repeated_terms(spark: SparkSession, folder: str) -> DataFrame:
    asked = _questions(spark, folder).withColumn("query", F.concat_ws(" ", "query", "query", "passage"))
    return _whole(_index(spark, folder).search(asked, "item_id", "query", 10), "rank")


_EVERY_20TH = f"SELECT v.vec_id AS query_id, e.vec_id AS id, {_DISTANCE} AS distance FROM embeddings e CROSS JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) v"


def _nearest(spark: SparkSession, folder: str, n: int) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vector.nearest(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", n)


@PLANS.query(f"SELECT * REPLACE (rank::BIGINT AS rank) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ({_EVERY_20TH})) WHERE rank <= 5")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _whole(_nearest(spark, folder, 5), "rank")


@PLANS.query(f"SELECT query_id, id, 1 - distance AS vector_score FROM ({_EVERY_20TH})")
def vector_similarity_score(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    found = vector.distances(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0"), "vec_id", "embedding")
    return found.select("query_id", "id", (1 - F.col("distance")).alias("vector_score"))


@PLANS.query(
    f"""SELECT query_id, id, distance, CASE WHEN distance < 0.3 THEN 'high' WHEN distance < 0.5 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ({_EVERY_20TH})) WHERE rank <= 3"""
)
def confidence_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return _nearest(spark, folder, 3).select("query_id", "id", "distance", vector.confidence(F.col("distance")).alias("confidence"))


@PLANS.query(
    f"""SELECT query_id, id AS nearest, distance, distance < 0.1 AS rejected
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ({_EVERY_20TH}) WHERE id <> query_id) WHERE rank = 1"""
)
def memory_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    found = vector.distances(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0"), "vec_id", "embedding").where("id <> query_id")
    near = lexical.best(found, 1, "distance", ascending=True)
    return near.select("query_id", F.col("id").alias("nearest"), "distance", vector.is_duplicate(F.col("distance")).alias("rejected"))


@PLANS.query()
def memory_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with the decision if all are stored in turn, each compared with those accepted before."""
    return vector.decided(table(spark, folder, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


@PLANS.query(
    f"""SELECT query_id, d.id, distance, replace(substring(coalesce(documents, ''), 1, 150), chr(10), ' | ') AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ({_EVERY_20TH})) d LEFT JOIN project_files_hybrid ON row_id = d.id WHERE rank <= 3"""
)
def distance_diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    found = _nearest(spark, folder, 3).join(_details(spark, folder).select("id", "text"), "id", "left")
    return found.select("query_id", "id", "distance", F.replace(F.substring(F.coalesce("text", F.lit("")), 1, 150), F.lit("\n"), F.lit(" | ")).alias("preview"))


def _mode(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    return _whole(_hits(spark, folder, mode).select("query_id", "id", "path", "vector_rank", "bm25_rank", "score", "position"), "vector_rank", "bm25_rank", "position")


@PLANS.query(_mode_sql("hybrid"))
def rrf_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return _mode(spark, folder, "hybrid")


@PLANS.query(_mode_sql("vector"))
def hybrid_vector_mode(spark: SparkSession, folder: str) -> DataFrame:
    return _mode(spark, folder, "vector")


@PLANS.query(_mode_sql("bm25"))
def hybrid_bm25_mode(spark: SparkSession, folder: str) -> DataFrame:
    return _mode(spark, folder, "bm25")


@PLANS.query(f"WITH {_bm25_sql()}, {_VECTOR}, {_FUSED.replace('MODE', 'hybrid')} SELECT query_id, id, round(rrf, 9) AS rrf, round(vector_score, 9) AS vector_score, bm25_score FROM fu")
def rrf_contribution(spark: SparkSession, folder: str) -> DataFrame:
    fused = hybrid.fuse(_vector_pool(spark, folder), _lexical_pool(spark, folder))
    return fused.select("query_id", "id", F.round("rrf", 9).alias("rrf"), F.round("vector_score", 9).alias("vector_score"), "bm25_score")


@PLANS.query(f"SELECT row_id, {_EXT} IN ('.md', '.rst', '.txt') AS documentation, round({_DEMOTION}, 9) AS factor FROM project_files_hybrid")
def doc_demotion(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chunks(spark, folder)
    return rows.select("row_id", hybrid.is_documentation(F.col("path")).alias("documentation"), F.round(hybrid.demotion(F.col("path"), F.col("documents")), 9).alias("factor"))


@PLANS.query(f"SELECT doc_id, coalesce({_EXAMPLE.replace('TEXT', 'text')}, false) AS example FROM documents")
def prompt_example_flag(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", hybrid.is_prompt_example(F.col("text")).alias("example"))


_LINES = "string_split(coalesce(documents, ''), chr(10))"
_TRIMMED = r"""CASE WHEN length(coalesce(documents, '')) <= LIMITED THEN coalesce(documents, '')
 WHEN kept = 0 THEN substring(documents, 1, LIMITED)
 ELSE array_to_string(list_slice(string_split(documents, chr(10)), 1, kept), chr(10)) || chr(10) || '... [cut]' END"""
_KEPT = f"""(SELECT *, len(list_filter(range(1, len({_LINES}) + 1), lambda i: list_sum(list_transform(list_slice({_LINES}, 1, i), lambda x: length(x) + 1)) <= LIMITED)) AS kept FROM TABLED)"""


@PLANS.query(f"SELECT row_id, {_TRIMMED.replace('LIMITED', '600')} AS trimmed FROM {_KEPT.replace('LIMITED', '600').replace('TABLED', 'project_files_hybrid')}")
def trim_whole_lines(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.functions.text import whole_lines

    return _chunks(spark, folder).select("row_id", whole_lines(F.coalesce("documents", F.lit("")), 600).alias("trimmed"))


@PLANS.query(
    f"""WITH {_bm25_sql()}, {_VECTOR}, {_hits_sql("hybrid")},
tr AS (SELECT query_id, position, position || '. [' || coalesce(path, '') || ']' || chr(10) || {_TRIMMED.replace('LIMITED', '600')} AS block FROM {_KEPT.replace('LIMITED', '600').replace('TABLED', 'hits')}),
bu AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY position) <= 3000 AS keep FROM tr),
ag AS (SELECT query_id, count(*) FILTER (keep) AS shown, count(*) AS total, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY position) FILTER (keep), '') AS answer FROM bu GROUP BY ALL)
SELECT query_id, shown, total, CASE WHEN shown = total THEN answer WHEN shown = 0 THEN '[shown 0 of ' || total || ']' ELSE answer || chr(10) || chr(10) || '[shown ' || shown || ' of ' || total || ']' END AS answer FROM ag"""
)
def budget_render(spark: SparkSession, folder: str) -> DataFrame:
    return render.rendered(_hits(spark, folder, "hybrid").select("query_id", "position", "path", "text"), 600, 3000)


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    hits = _hits(spark, folder, *MODES).select("mode", "query_id", "path", "position")
    return evaluate.first_relevant(hits, _questions(spark, folder).select(F.col("item_id").alias("query_id"), "expected"), MODES)


@PLANS.query(_RANKS + "SELECT mode, query_id, rank::BIGINT AS rank FROM ranks")
def first_relevant_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _whole(_ranks(spark, folder), "rank")


@PLANS.query(
    _RANKS
    + """SELECT mode, sum((rank IS NOT NULL)::INT)::BIGINT AS hits, count(*) AS total, round(avg((rank IS NOT NULL)::INT::DOUBLE), 9) AS hit_rate, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM ranks GROUP BY mode"""
)
def hit_at_k_mrr(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.quality(_ranks(spark, folder))


@PLANS.query(
    _RANKS
    + """, qu AS (SELECT mode, avg((rank IS NOT NULL)::INT::DOUBLE) AS h, avg(coalesce(1.0 / rank, 0)) AS m FROM ranks GROUP BY mode)
SELECT q.mode, round(round(q.h, 9) - round(v.h, 9), 9) AS hit_rate_delta, round(round(q.m, 9) - round(v.m, 9), 9) AS mrr_delta FROM qu q CROSS JOIN qu v WHERE v.mode = 'vector' AND q.mode <> 'vector'"""
)
def mode_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.deltas(evaluate.quality(_ranks(spark, folder)))


@PLANS.query(_RANKS + "SELECT mode, query_id FROM ranks WHERE rank IS NULL")
def eval_misses(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.misses(_ranks(spark, folder))


def _embedded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the chunks' texts without line numbers."""
    clean = F.regexp_replace("documents", "(^|\n)[0-9]+: ", "$1")
    return embedded(spread(_chunks(spark, folder).select("row_id", "documents")), clean, prefix="search_document")


@PLANS.query()
def embed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _embedded_chunks(spark, folder).select("row_id", "embedding", "embedding_kind")


@PLANS.query()
def hybrid_own_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search in which both rankings are of the same chunks, by their own vectors and the questions'."""
    asked = embedded(_questions(spark, folder).where("query is not null"), F.col("query"), prefix="search_query")
    near = vector.nearest(_embedded_chunks(spark, folder), "row_id", "embedding", asked, "item_id", "embedding", POOL)
    found = hybrid.ranked(hybrid.fuse(durable(near), durable(_lexical_pool(spark, folder))), _details(spark, folder), N)
    return _whole(found.select("query_id", "id", "path", "vector_rank", "bm25_rank", "score", "position"), "vector_rank", "bm25_rank", "position")
