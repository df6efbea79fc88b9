"""Queries of chunking, line search, listings, limited reads and stored collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import BLANKS, cut_to, is_blank, short_id
from weftline.operators import chunking, grep, memory
from weftline.plans.base import Plans
from weftline.sources.tables import table

PLANS = Plans()
SAVE = ["remember", "save", "note", "запомни", "сохрани", "запиши"]
SKIP = ["show", "recall", "покажи", "вспомни"]

_PATH = "coalesce(source, 'none') || '/' || doc_id || '.txt'"
_STRIP = rf"regexp_replace(regexp_replace(X, '^[\s{BLANKS}]+', ''), '[\s{BLANKS}]+$', '')"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as files."""
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, folder, "documents").select("doc_id", path.alias("path"), "text")


_CHUNKS = rf"""
src AS (SELECT {_PATH} AS path, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS parts, text FROM documents WHERE text IS NOT NULL),
sz AS (SELECT path, list_transform(parts, lambda x: length(x) + 1) AS s, len(parts) AS m FROM src),
step(path, i, start, n, size, fs, fn) AS (
  SELECT path, 0, 0, 0, 0::BIGINT, NULL::INT, NULL::INT FROM sz
  UNION ALL
  SELECT p.path, i + 1,
    CASE WHEN size + s[i + 1] > 1000 AND n > 3 THEN start + n - 3 WHEN size + s[i + 1] > 1000 AND n > 0 THEN start + n ELSE start END,
    CASE WHEN size + s[i + 1] > 1000 AND n > 3 THEN 4 WHEN size + s[i + 1] > 1000 AND n > 0 THEN 1 ELSE n + 1 END,
    CASE WHEN size + s[i + 1] > 1000 AND n > 3 THEN s[i] + s[i - 1] + s[i - 2] + s[i + 1] WHEN size + s[i + 1] > 1000 AND n > 0 THEN s[i + 1] ELSE size + s[i + 1] END,
    CASE WHEN size + s[i + 1] > 1000 AND n > 0 THEN start END, CASE WHEN size + s[i + 1] > 1000 AND n > 0 THEN n END
  FROM step p JOIN sz ON sz.path = p.path WHERE i < m),
ranges AS (SELECT path, fs AS start, fn AS n FROM step WHERE fs IS NOT NULL
  UNION ALL SELECT step.path, start, n FROM step JOIN sz ON sz.path = step.path WHERE i = m AND n > 0),
ch AS (SELECT r.path, row_number() OVER (PARTITION BY r.path ORDER BY start) - 1 AS chunk_index, start + 1 AS start_line, n AS n_lines,
  array_to_string(list_slice(parts, start + 1, start + n), chr(10)) AS clean,
  array_to_string(list_transform(range(start + 1, start + n + 1), lambda k: k || ': ' || parts[k]), chr(10)) AS numbered, text
  FROM ranges r JOIN src ON src.path = r.path)
"""


def _chunked(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunks(_files(spark, folder), "path", "text")


def _wide(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@PLANS.query(f"WITH RECURSIVE {_CHUNKS} SELECT path, chunk_index::BIGINT AS chunk_index, start_line::BIGINT AS start_line, n_lines::BIGINT AS n_lines, clean FROM ch")
def chunk_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _wide(_chunked(spark, folder).select("path", "chunk_index", "start_line", "n_lines", "clean"), "chunk_index", "start_line", "n_lines")


@PLANS.query(f"WITH RECURSIVE {_CHUNKS} SELECT path, chunk_index::BIGINT AS chunk_index, numbered FROM ch")
def chunk_numbered(spark: SparkSession, folder: str) -> DataFrame:
    return _wide(_chunked(spark, folder).select("path", "chunk_index", "numbered"), "chunk_index")


@PLANS.query(
    f"""WITH RECURSIVE {_CHUNKS} SELECT path || '::chunk' || chunk_index AS id, path, chunk_index::BIGINT AS chunk_index, length(clean)::BIGINT AS n_chars FROM ch
WHERE length({_STRIP.replace('X', 'text')}) > 0 AND length({_STRIP.replace('X', 'clean')}) >= 20"""
)
def chunk_minlen(spark: SparkSession, folder: str) -> DataFrame:
    found = chunking.indexed(_files(spark, folder), "path", "text")
    return _wide(found.select("id", "path", "chunk_index", F.length("clean").alias("n_chars")), "chunk_index", "n_chars")


@PLANS.query("SELECT count(*) AS chunks, count(DISTINCT path) AS files FROM project_files_hybrid")
def project_stats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "project_files_hybrid").agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files"))


_MATCHING = rf"""
ln AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM (SELECT {_PATH} AS path, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
ma AS (SELECT path, line_no, regexp_replace(line, '[\s{BLANKS}]+$', '') AS line, row_number() OVER (PARTITION BY path ORDER BY line_no) AS nth FROM ln WHERE contains(lower(line), 'index'))
"""


@PLANS.query(f"WITH {_MATCHING} SELECT path, line_no, line_no || ': ' || line AS text, max(nth) OVER (PARTITION BY path) >= 20 AS capped FROM ma WHERE nth <= 20")
def grep_document(spark: SparkSession, folder: str) -> DataFrame:
    return _wide(grep.grep_each(_files(spark, folder), "path", "text", "INDEX", 20), "line_no")


@PLANS.query(
    rf"""WITH {_MATCHING}, co AS (SELECT path, count(*) AS hits FROM ma WHERE nth <= 3 GROUP BY path),
ru AS (SELECT path, coalesce(sum(hits) OVER (ORDER BY regexp_extract(path, '^(.*)/[^/]*$', 1), regexp_extract(path, '([^/]*)$', 1), path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM co)
SELECT path, line_no, line FROM ma JOIN ru USING (path) WHERE nth <= 3 AND before < 30"""
)
def grep_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return _wide(grep.grep_tree(_files(spark, folder), "path", "text", "Index", 3, 30), "line_no")


@PLANS.query(
    """WITH pa AS (SELECT DISTINCT string_split(path, '/') AS parts FROM project_files_hybrid WHERE path IS NOT NULL),
ea AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS k FROM pa),
na AS (SELECT DISTINCT CASE WHEN k = 1 THEN '.' ELSE array_to_string(list_slice(parts, 1, k - 1), '/') END AS folder, parts[k] AS name, CASE WHEN k = len(parts) THEN '[FILE]' ELSE '[DIR]' END AS kind FROM ea)
SELECT folder, name, kind, nth::BIGINT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name, kind) AS nth FROM na) WHERE nth <= 200"""
)
def list_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return _wide(grep.listing(table(spark, folder, "project_files_hybrid"), "path", 200), "nth")


@PLANS.query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) || chr(10) || '... [cut]' ELSE text END AS content FROM documents")
def read_truncate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", cut_to(F.col("text"), 1000).alias("content"))


@PLANS.query(
    """SELECT doc_id, url, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'unsupported address' WHEN length(text) > 400 THEN substring(text, 1, 400) || chr(10) || '... [cut]' ELSE text END AS page
FROM (SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'https://' WHEN lang = 'ru' THEN 'http://' ELSE 'ftp://' END || 'host.invalid/' || doc_id AS url FROM documents)"""
)
def page_fetch_truncate(spark: SparkSession, folder: str) -> DataFrame:
    scheme = F.when(F.col("lang") == "en", "https://").when(F.col("lang") == "ru", "http://").otherwise("ftp://")
    pages = table(spark, folder, "documents").select("doc_id", "text", F.concat(scheme, F.lit("host.invalid/"), F.col("doc_id").cast("string")).alias("url"))
    return pages.select("doc_id", "url", F.when(~F.col("url").rlike("^https?://"), "unsupported address").otherwise(cut_to(F.col("text"), 400)).alias("page"))


@PLANS.query("SELECT mem_id, coalesce(category, 'general') AS category, content FROM agent_memory WHERE length(" + _STRIP.replace("X", "coalesce(content, '')") + ") > 0 ORDER BY mem_id LIMIT 10")
def list_memory(spark: SparkSession, folder: str) -> DataFrame:
    return memory.listed(table(spark, folder, "agent_memory"), "mem_id", "content", "category")


@PLANS.query("SELECT mem_id, substr(md5(content), 1, 12) AS short_id FROM agent_memory")
def short_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "agent_memory").select("mem_id", short_id(F.col("content")).alias("short_id"))


@PLANS.query("SELECT blank, count(*) AS n FROM (SELECT length(" + _STRIP.replace("X", "coalesce(content, '')") + ") = 0 AS blank FROM agent_memory) GROUP BY blank")
def blank_guard(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "agent_memory").groupBy(is_blank(F.col("content")).alias("blank")).agg(F.count("*").alias("n"))


@PLANS.query("SELECT id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id DESC) AS nth FROM project_files_hybrid) WHERE nth = 1")
def upsert_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return memory.latest(table(spark, folder, "project_files_hybrid"), F.col("id"), F.col("row_id")).select("id", "row_id")


@PLANS.query(
    """WITH new AS (SELECT * FROM project_files_hybrid WHERE loaded_at >= TIMESTAMP '2025-07-01')
SELECT row_id, path FROM project_files_hybrid WHERE loaded_at < TIMESTAMP '2025-07-01' AND path NOT IN (SELECT path FROM new WHERE path IS NOT NULL) UNION ALL SELECT row_id, path FROM new"""
)
def replace_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "project_files_hybrid").select("row_id", "path", "loaded_at")
    cut = F.expr("timestamp_ntz '2025-07-01 00:00:00'")
    return memory.replace_by(rows.where(F.col("loaded_at") < cut), rows.where(F.col("loaded_at") >= cut), "path").select("row_id", "path")


@PLANS.query("SELECT row_id, id FROM project_files_hybrid WHERE id NOT IN (SELECT id FROM project_files_hybrid WHERE documents IS NULL)")
def delete_by_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "project_files_hybrid")
    return memory.delete(rows.select("row_id", "id"), rows.where("documents is null").select("id"), "id")


def _holds(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + ")"


@PLANS.query(f"SELECT msg_id, CASE WHEN {_holds(SKIP)} THEN 'skip' WHEN {_holds(SAVE)} THEN 'save' ELSE 'none' END AS intent FROM chat_messages")
def intent_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chat_messages").select("msg_id", memory.wants_memory(F.col("content"), SAVE, SKIP).alias("intent"))
