"""Ranking, fusion, rendering and evaluation with worked values."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.operators import evaluate, grep, hybrid, lexical, render, vector
from weftline.operators.components import components
from weftline.operators.providers import HashingProvider, embedded


def test_an_implementation_outranks_a_mention(spark):
    docs = spark.createDataFrame(
        [("impl", "def calculator(expression): return ast.parse(expression)"), ("mention", "the calculator is named here and there"), ("other", "nothing of the kind"), ("null", None), ("empty", "")],
        "id string, text string",
    )
    asked = spark.createDataFrame([(1, "def calculator"), (2, None), (3, " ")], "q int, query string")
    found = lexical.search(docs, "id", "text", asked, "q", "query").orderBy("rank").collect()
    assert [r["id"] for r in found] == ["impl", "mention"] and {r["query_id"] for r in found} == {1}


def test_score_formula_and_repeated_terms(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "c c c c")], "id int, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "a a b")], "q int, query string")
    got = {(r["query_id"], r["id"]): r["score"] for r in lexical.scores(docs, "id", "text", asked, "q", "query").collect()}

    def part(tf, df, dl):
        return math.log((3 - df + 0.5) / (df + 0.5) + 1) * (tf / (1 + 0.75 * (dl / 3 - 1))) * (1 + 0.75 * tf / (tf + 1))

    assert got[1, 1] == pytest.approx(part(2, 1, 3) + part(1, 2, 3), abs=1e-8)
    assert got[2, 1] == pytest.approx(2 * part(2, 1, 3) + part(1, 2, 3), abs=1e-8)
    assert (1, 3) not in got


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "id int, text string")
    asked = spark.createDataFrame([(1, "a")], "q int, query string")
    assert lexical.search(docs, "id", "text", asked, "q", "query").count() == 0
    assert lexical.corpus_stats(docs, "id", "text").first()["avg_len"] == 0


def test_a_kept_index_finds_what_a_pass_finds(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} shared {'often ' * (i % 4)}") for i in range(60)] + [(60, None), (61, "")], "id int, text string")
    asked = spark.createDataFrame([(1, "word3 often"), (2, "shared shared"), (3, None), (4, "absent")], "q int, query string")
    plain = sorted(lexical.search(docs, "id", "text", asked, "q", "query", 5).collect())
    index = lexical.LexicalIndex(docs, "id", "text")
    assert plain and index.sizes[0] == 62
    for terms in (0, 1, 1000):
        assert sorted(index.search(asked, "q", "query", 5, terms).collect()) == plain
    for empty in (docs.where("id < 0"), docs.where("id >= 60")):
        assert lexical.LexicalIndex(empty, "id", "text").search(asked, "q", "query").count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "id int, v array<float>")
    asked = rows.where("id = 1").select("id", "v")
    found = vector.nearest(rows, "id", "v", asked, "id", "v", 5).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in found] == [(1, 0.0), (3, 0.0), (2, 1.0)]
    buckets = spark.createDataFrame([(0.29,), (0.3,), (0.5,)], "d double").select(vector.confidence(F.col("d"))).collect()
    assert [b[0] for b in buckets] == ["high", "medium", "low"]


def lists(spark):
    v = spark.createDataFrame([(1, "A", 0.1, 1), (1, "B", 0.2, 2)], "query_id int, id string, distance double, rank int")
    b = spark.createDataFrame([(1, "B", 3.0, 1), (1, "C", 1.0, 2)], "query_id int, id string, score double, rank int")
    return v, b


def test_fusion(spark):
    v, b = lists(spark)
    got = {r["id"]: r for r in hybrid.fuse(v, b).collect()}
    assert got["B"]["rrf"] > got["A"]["rrf"] > got["C"]["rrf"]
    assert got["A"]["rrf"] == pytest.approx(1 / 61) and got["C"]["vector_rank"] is None and got["A"]["bm25_score"] == 0
    assert {r["id"] for r in hybrid.fuse(v, b, "bm25").collect()} == {"B", "C"}
    assert hybrid.fuse(v, b, "other").count() == 0
    assert hybrid.pool_size(3) == 20 and hybrid.pool_size(6) == 24


def test_demotion(spark):
    v, b = lists(spark)
    details = spark.createDataFrame([("A", "x/a.py", "t"), ("B", "b.MD", "Observation from x, user: y"), ("C", None, None)], "id string, path string, text string")
    found = hybrid.ranked(hybrid.fuse(v, b), details, 5).orderBy("position").collect()
    assert [r["id"] for r in found] == ["A", "C", "B"]
    assert found[2]["score"] == pytest.approx((1 / 62 + 1 / 61) * 0.09, abs=1e-9)


def test_budget(spark):
    hits = spark.createDataFrame([(1, i, "p", "y" * 500) for i in range(1, 9)] + [(2, 1, None, None)], "query_id int, position int, path string, text string")
    got = {r["query_id"]: r for r in render.rendered(hits).collect()}
    assert got[1]["shown"] == 5 and got[1]["answer"].endswith("[shown 5 of 8]") and got[2]["answer"] == "1. []\n"


def test_quality(spark):
    hits = spark.createDataFrame([("m", 1, "a", 1), ("m", 1, "b", 2), ("m", 2, "c", 1)], "mode string, query_id int, path string, position int")
    cases = spark.createDataFrame([(1, ["b"]), (2, ["z"]), (3, None)], "query_id int, expected array<string>")
    ranks = evaluate.first_relevant(hits, cases, ["m"])
    row = evaluate.quality(ranks).first()
    assert (row["hits"], row["total"]) == (1, 3) and row["mrr"] == pytest.approx(1 / 6, abs=1e-8)
    assert sorted(r["query_id"] for r in evaluate.misses(ranks).collect()) == [2, 3]


def test_line_search(spark):
    files = spark.createDataFrame([("a/x", "\n".join(f"Key {i}  " for i in range(30))), ("a/y", "none"), ("b", "KEY"), ("c", None)], "path string, text string")
    each = grep.grep_each(files, "path", "text", "key", 20).collect()
    assert sum(r["path"] == "a/x" for r in each) == 20 and all(r["capped"] for r in each if r["path"] == "a/x")
    assert [r["text"] for r in each if r["path"] == "b"] == ["1: KEY"]
    tree = grep.grep_tree(files, "path", "text", "key", 3, 2).collect()
    assert sorted((r["path"], r["line_no"]) for r in tree) == [("a/x", 1), ("a/x", 2), ("a/x", 3), ("b", 1)]
    assert [r["path"] for r in grep.grep_tree(files, "path", "text", "key", 3, 1).collect()] == ["b"]
    assert grep.grep_each(files, "path", "text", "").count() == 0
    names = grep.listing(files, "path").orderBy("folder", "name").collect()
    assert [(r["folder"], r["name"], r["kind"]) for r in names if r["folder"] == "."] == [(".", "a", "[DIR]"), (".", "b", "[FILE]"), (".", "c", "[FILE]")]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (None, 1), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 15: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(0, i) for i in range(200, 260)], "a long, b long")
    assert {r["component"] for r in components(chain).collect()} == {0}


def test_embedding(spark):
    rows = spark.createDataFrame([("один два",), ("два один",), ("",), (None,)], "t string")
    got = embedded(rows, F.col("t")).collect()
    assert got[0]["embedding"] == pytest.approx(got[1]["embedding"]) and len(got[0]["embedding"]) == 64
    assert got[3]["embedding"] is None and set(got[2]["embedding"]) == {0.0}
    other = embedded(rows, F.col("t"), HashingProvider(8), "search_query").first()
    assert len(other["embedding"]) == 8 and other["embedding_kind"] == "search_query"


def test_every_vector_is_decided_in_turn(spark):
    import random

    r = random.Random(2)
    rows = []
    for i in range(300):
        old = rows[r.randrange(i)][1] if i and r.random() < 0.6 else [r.gauss(0, 1) for _ in range(8)]
        rows.append((i, [x + r.gauss(0, 0.2) for x in old]))
    rows += [(400, rows[20][1]), (401, [2 * x for x in rows[20][1]]), (500, None), (501, [0.0] * 8), (502, [1.0, 0.0])]

    def distance(a, b):
        return round(1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 9)

    kept, want = [], {}
    for i, v in rows:
        near = [(distance(v, w), j) for j, w in kept if len(w) == len(v)] if v and any(v) else []
        near = min((x for x in near if x[0] < 0.1), default=None)
        want[i] = (near[1], True) if near else (None, False)
        if v and any(v) and not near:
            kept.append((i, v))
    d = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    exact = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    assert {x["id"]: (x["nearest"], x["rejected"]) for x in vector.decided(exact, "vec_id", "embedding").collect()} == want
    assert 50 < sum(x[1] for x in want.values()) < 250 and want[400][1] and want[401][1]
    assert vector.decided(d.where("false"), "vec_id", "embedding").count() == 0
