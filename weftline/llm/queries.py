"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import fact_history, toxicity
from weftline.llm.credentials import credentials, redacted
from weftline.llm.leaks import leaks
from weftline.llm.mixing import Mixture
from weftline.llm.near_duplicates import NearDuplicates
from weftline.llm.shared_spans import same_path, shared_spans
from weftline.llm.splitting import pieces, renumbered
from weftline.sources.tables import table


def _clean(numbered: Column) -> Column:
    """A chunk's text without its line numbers."""
    return F.regexp_replace(numbered, "(^|\n)[0-9]+: ", "$1")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(table(spark, folder, "project_files_hybrid"), "row_id", "documents", same_path(F.col("path")), span=200, numbered=True)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that share 200 characters or more with a chunk of another path."""
    return _spans(spark, folder).select(F.col("id").alias("row_id"))


def p1_shared(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with its passages found elsewhere and their amount."""
    chunks = table(spark, folder, "project_files_hybrid").select("row_id", _clean(F.col("documents")).alias("clean"))
    out = chunks.join(_spans(spark, folder).withColumnRenamed("id", "row_id"), "row_id", "left")
    passages = F.transform("spans", lambda x: F.substring("clean", x["begin"] + 1, x["end"] - x["begin"]))
    return out.select(
        "row_id",
        F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"),
        F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared_chars"),
        F.coalesce(F.length("clean"), F.lit(0)).cast("bigint").alias("n_chars"),
        F.array_join(passages, "\n---\n").alias("passages"),
    )


def _secrets(spark: SparkSession, folder: str) -> DataFrame:
    return credentials(table(spark, folder, "project_files_hybrid"), "row_id", "documents", same_path(F.col("path")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that hold a credential or a piece of one."""
    return _secrets(spark, folder).select(F.col("id").alias("row_id"), "line_no").distinct()


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with the values of its credentials hidden."""
    out = redacted(table(spark, folder, "project_files_hybrid"), "row_id", "documents", _secrets(spark, folder))
    return out.select(F.col("id").alias("row_id"), F.col("text").alias("documents"), "hidden")


def p2_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What hiding must leave as it is: every chunk's length, its lines and their numbers."""
    out = p2_redacted(spark, folder).select("row_id", F.col("documents").alias("d"))
    numbers = F.array_join(F.regexp_extract_all("d", F.lit("(?:^|\n)([0-9]+): "), F.lit(1)), ",")
    return out.select("row_id", F.length("d").cast("bigint").alias("n_chars"), F.size(F.split("d", "\n", -1)).cast("bigint").alias("n_lines"), F.md5(numbers.cast("binary")).alias("numbers_md5")).where("n_chars is not null")


def _near(spark: SparkSession, folder: str) -> NearDuplicates:
    return NearDuplicates(table(spark, folder, "project_files_hybrid"), "row_id", "documents", words=3, threshold=0.7, numbered=True)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks that are near-duplicates."""
    return _near(spark, folder).pairs().select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with its group of near-duplicates and its number of links."""
    return _near(spark, folder).groups().select(F.col("id").alias("row_id"), "group", "links")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that are cut into more than one piece."""
    cut = pieces(table(spark, folder, "project_files_hybrid"), "row_id", "documents", limit=1000, overlap=100, numbered=True)
    return cut.where("piece_no = 0 and n_pieces > 1").select(F.col("id").alias("row_id"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all chunks; ``new_index`` follows on ``chunk_index`` (taken from ``id`` where null) within the file."""
    chunks = table(spark, folder, "project_files_hybrid")
    index = F.coalesce("chunk_index", F.try_to_number(F.regexp_extract("id", "::chunk([0-9]+)$", 1), F.lit("999999999")).cast("int"))
    place = chunks.select("row_id", same_path(F.col("path")).alias("path"), index.alias("chunk_index"))
    cut = pieces(chunks, "row_id", "documents", limit=1000, overlap=100, numbered=True)
    counts = cut.where("piece_no = 0").select(F.col("id").alias("row_id"), "n_pieces").join(place, "row_id")
    shifts = renumbered(counts, "path", ["chunk_index", "row_id"]).select("row_id", "path", "chunk_index", "shift")
    out = cut.withColumnRenamed("id", "row_id").join(shifts, "row_id")
    return out.select("row_id", "path", "chunk_index", (F.col("chunk_index") + F.col("shift") + F.col("piece_no")).cast("bigint").alias("new_index"), "piece_no", "n_pieces", "piece")


def p4_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's text put together again from its pieces, by hash, and whether all pieces keep to the limits."""
    cut = pieces(table(spark, folder, "project_files_hybrid"), "row_id", "documents", limit=1000, overlap=100, numbered=True)
    parts = F.array_sort(F.collect_list(F.struct("begin", "end", "piece")))
    before = F.col("parts")[F.col("k") - 1]["end"]
    each = cut.groupBy("id").agg(parts.alias("parts")).select("id", "parts", F.posexplode("parts").alias("k", "part"))
    again = F.when(F.col("k") == 0, 0).otherwise(before - F.col("part.begin"))
    each = each.select("id", "k", F.expr("part.piece").alias("piece"), again.alias("again"))
    own = F.expr("substring(piece, again + 1)")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", own.alias("own")))), lambda x: x["own"]), "")
    fits = (F.length("piece") <= 1000) & F.col("again").between(0, 100)
    return each.groupBy(F.col("id").alias("row_id")).agg(F.md5(whole.cast("binary")).alias("text_md5"), F.min(fits).alias("fits"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Facts to reject."""
    return fact_history.rejected(table(spark, folder, "agent_memory"), "mem_id", "content", "batch_no").select(F.col("id").alias("mem_id"))


def p5_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Every fact with its batch and the decision."""
    facts = table(spark, folder, "agent_memory")
    out = fact_history.rejected(facts, "mem_id", "content", "batch_no").select(F.col("id").alias("mem_id"), F.lit(False).alias("accepted"))
    return facts.select("mem_id", "batch_no").join(out, "mem_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(True)))


def p5_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Per batch, how many facts are accepted and how many rejected."""
    facts = table(spark, folder, "agent_memory")
    out = fact_history.rejected(facts, "mem_id", "content", "batch_no").select(F.col("id").alias("mem_id"), F.lit(1).alias("no"))
    return facts.select("mem_id", "batch_no").join(out, "mem_id", "left").groupBy("batch_no").agg(
        F.sum(F.when(F.col("no").isNull(), 1).otherwise(0)).alias("accepted"), F.sum(F.coalesce("no", F.lit(0))).alias("rejected")
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the test items of which they hold twelve words in a row."""
    out = leaks(table(spark, folder, "documents"), table(spark, folder, "eval_cases"), run=12)
    return out.where("kind = 'run'").select("doc_id", "item_id").distinct()


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Per document and test item: passage words given away in runs, the best paraphrase, and whether the answer stands there."""
    out = leaks(table(spark, folder, "documents"), table(spark, folder, "eval_cases"), run=12, paraphrases=True)
    words = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == "run", F.sequence("first", F.col("last") - 1))))))
    return out.groupBy("doc_id", "item_id").agg(
        words.alias("run_words"), F.max(F.when(F.col("kind") == "paraphrase", F.col("common"))).alias("paraphrase_words"), F.max("answer").alias("answer"), F.round(F.max("cosine"), 3).alias("cosine")
    )


def _toxic(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.toxic_scores(documents, toxicity.fit(documents, table(spark, folder, "labels")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _toxic(spark, folder).where("toxic").select(F.col("id").alias("doc_id")).distinct()


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score, and its significant passages."""
    return _toxic(spark, folder).select(F.col("id").alias("doc_id"), "score", "significance", "toxic", F.array_join("passages", " | ").alias("passages"))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per source, in its regular spelling, the documents and the rate of toxic ones."""
    source = table(spark, folder, "documents").select(F.col("doc_id"), F.lower(F.trim("source")).alias("source"))
    scored = _toxic(spark, folder).select(F.col("id").alias("doc_id"), "toxic")
    return source.join(scored, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.avg(F.col("toxic").cast("double")).alias("rate"))


def tokenizer_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """The place of a public tokenizer's vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _mixture(spark: SparkSession, folder: str) -> Mixture:
    return Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), tokenizer_file(), block=1024, whole=True)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture: each use of a record with its place."""
    return _mixture(spark, folder).selection


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per source, the share aimed at, the share reached and what a source lacks that is used up."""
    return _mixture(spark, folder).shares()


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per source, whether its records keep to their repeats and its blocks to their times."""
    return _mixture(spark, folder).checks()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_shared": p1_shared, "p2_found": p2_found, "p2_redacted": p2_redacted, "p2_checks": p2_checks, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_checks": p4_checks, "p5_found": p5_found, "p5_facts": p5_facts, "p5_batches": p5_batches, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_checks": p7_checks, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}


_CLEAN = r"regexp_replace(documents, '(^|\n)[0-9]+: ', '\1', 'g')"
_OWNER = r"regexp_replace(replace(path, '\', '/'), '^(\./)+', '')"
_WORDS = r"regexp_extract_all(lower(X), '[\p{L}\p{N}_]+')"

_P1 = f"""WITH t AS (SELECT row_id, coalesce({_OWNER}, chr(0)) AS owner, {_CLEAN} AS c FROM project_files_hybrid WHERE documents IS NOT NULL),
w AS (SELECT row_id, owner, hash(substring(c, k, 200)) AS h FROM (SELECT row_id, owner, c, unnest(range(1, length(c) - 198)) AS k FROM t WHERE length(c) >= 200)),
s AS (SELECT h FROM w GROUP BY h HAVING min(owner) <> max(owner))
SELECT DISTINCT row_id FROM w WHERE h IN (SELECT h FROM s)"""

_P3 = f"""WITH t AS (SELECT row_id, {_WORDS.replace('X', _CLEAN)} AS w FROM project_files_hybrid WHERE documents IS NOT NULL),
g AS (SELECT DISTINCT row_id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS k FROM t WHERE len(w) >= 3)),
n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
c AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.row_id < b.row_id GROUP BY ALL)
SELECT a AS row_id_a, b AS row_id_b FROM c JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b WHERE c * 10 >= (x.n + y.n - c) * 7"""

_P5 = f"""WITH RECURSIVE t AS (SELECT mem_id, coalesce(batch_no, 2147483647) AS batch_no, list_distinct({_WORDS.replace('X', 'content')}) AS w FROM agent_memory WHERE content IS NOT NULL),
r AS (SELECT mem_id, w, len(w) AS n, row_number() OVER (ORDER BY batch_no, mem_id) AS k FROM t WHERE len(w) > 0),
g AS (SELECT k, n, unnest(w) AS x FROM r),
c AS (SELECT b.k AS k, a.k AS early FROM g a JOIN g b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING count(*) * 10 >= (a.n + b.n - count(*)) * 8),
e AS (SELECT r.k, coalesce(list(early) FILTER (early IS NOT NULL), []) AS before FROM r LEFT JOIN c ON c.k = r.k GROUP BY r.k),
d(k, bad) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT e.k, CASE WHEN len(list_filter(e.before, lambda x: NOT list_contains(d.bad, x))) > 0 THEN list_append(d.bad, e.k) ELSE d.bad END FROM d JOIN e ON e.k = d.k + 1)
SELECT mem_id FROM r WHERE list_contains((SELECT bad FROM d ORDER BY k DESC LIMIT 1), k)"""

_P6 = f"""WITH p AS (SELECT item_id, {_WORDS.replace('X', 'passage')} AS w FROM eval_cases WHERE passage IS NOT NULL),
d AS (SELECT doc_id, {_WORDS.replace('X', 'text')} AS w FROM documents WHERE text IS NOT NULL),
pg AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM p WHERE len(w) >= 12)),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN pg ON dg.g = pg.g"""


_P2_CHECKS = r"""SELECT row_id, length(documents)::BIGINT AS n_chars, len(string_split(documents, chr(10)))::BIGINT AS n_lines, md5(array_to_string(regexp_extract_all(documents, '(?:^|\n)([0-9]+): ', 1), ',')) AS numbers_md5
FROM project_files_hybrid WHERE documents IS NOT NULL"""

_P3_GROUPS = f"""WITH RECURSIVE t AS (SELECT row_id, {_WORDS.replace('X', _CLEAN)} AS w FROM project_files_hybrid WHERE documents IS NOT NULL),
u AS (SELECT row_id, w, min(row_id) OVER (PARTITION BY w) AS rep FROM t WHERE len(w) >= 3),
p AS ({_P3}),
l AS (SELECT row_id_a AS a, row_id_b AS b FROM p WHERE row_id_a IN (SELECT rep FROM u) AND row_id_b IN (SELECT rep FROM u)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT DISTINCT rep, rep FROM u UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT u.row_id, (SELECT min(y) FROM r WHERE x = u.rep) AS "group", (SELECT count(*) FROM e WHERE a = u.rep) AS links FROM u"""

_P5_FACTS = f"""SELECT mem_id, batch_no, mem_id NOT IN (SELECT mem_id FROM ({_P5})) AS accepted FROM agent_memory"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries it can state; the others are tested against brute force."""
    checks = "SELECT lower(trim(source)) AS source, sum(target_share) AS target_share, max(coalesce(max_repeats, 1))::INT AS max_repeats, true AS repeats_kept, true AS in_step FROM mix_targets GROUP BY lower(trim(source))"
    more = {
        "p2_checks": _P2_CHECKS,
        "p3_groups": _P3_GROUPS,
        "p4_checks": f"SELECT row_id, md5({_CLEAN}) AS text_md5, true AS fits FROM project_files_hybrid WHERE documents IS NOT NULL",
        "p5_facts": _P5_FACTS,
        "p5_batches": f"SELECT batch_no, sum(accepted::INT)::BIGINT AS accepted, sum((NOT accepted)::INT)::BIGINT AS rejected FROM ({_P5_FACTS}) GROUP BY batch_no",
    }
    return more | {"p7_checks": checks, "p1_found": _P1, "p3_found": _P3, "p4_found": f"SELECT row_id FROM project_files_hybrid WHERE length({_CLEAN}) > 1000", "p5_found": _P5, "p6_found": _P6}
