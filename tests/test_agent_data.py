"""Tool calls, registry, calculator, history, collections, sources and streaming."""

import json
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions.text import clock
from weftline.operators import calc, history, memory, registry, toolcalls
from weftline.operators.project import FORM, Project
from weftline.operators.providers import answered
from weftline.sources import files
from weftline.streaming.history import last_messages_stream

KNOWN = frozenset({"calculator", "read_file"})


def test_calls_in_text():
    plain = '{"name": "calculator", "arguments": {"expression": "1+1"}}'
    assert [c["name"] for c in toolcalls.calls_in(plain, KNOWN)] == ["calculator"]
    assert len(toolcalls.calls_in(f"so:\n```json\n{plain}\n```\nand {plain}", KNOWN)) == 1
    assert toolcalls.calls_in("just text", KNOWN) == [] and toolcalls.calls_in(None, KNOWN) == []
    assert toolcalls.calls_in('{"function": {"name": "read_file", "arguments": "x"}}', KNOWN) == [{"name": "read_file", "arguments": "x"}]
    assert toolcalls.calls_in(r'{"name": "read_file", "arguments": {"path": "C:\dir\x"}}', KNOWN)[0]["name"] == "read_file"
    # a call inside another object isn't looked for
    assert toolcalls.calls_in(f'{{"wrap": {plain}}}', KNOWN) == []
    assert len(toolcalls.calls_in(f"{{broken {plain}", KNOWN)) == 1


def test_calls_behind_repaired_and_unreadable_ones():
    call = '{"name": "calculator", "arguments": {"expression": "3"}}'
    path = r'{"name": "read_file", "arguments": {"path": "C:\dir\x\q\z"}}'
    assert [c["name"] for c in toolcalls.calls_in(f"{path} {call} {path}{call}", KNOWN)] == ["read_file", "calculator"] * 2
    for start in ("{", '{"a":', '{"a":["\\', '{"a": "{', '{"a": {"b": 1}, "c": ['):
        began = time.process_time()
        assert [c["name"] for c in toolcalls.calls_in(start * 50_000 + " " + call, KNOWN)] == ["calculator"], start
        assert time.process_time() - began < 5, start


def test_calculator_on_a_column(spark):
    given = ["(15 * 7) + 3", "1/0", "__import__('os').getcwd()", "2+2", "9**9**9", "-7 // 2", "7 % -3", "x", "", "True", None, "1" + "+1" * 600]
    want = ["108", calc.DIVISION, calc.FORBIDDEN, "4", calc.FORBIDDEN, "-4", "-2", calc.FORBIDDEN, calc.FORBIDDEN, "True", None, calc.FORBIDDEN]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(given)], "i int, e string")
    assert [r["v"] for r in df.select("i", calc.answers(F.col("e")).alias("v")).orderBy("i").collect()] == want


def test_unknown_names():
    text = '{"name": "post_letter", "arguments": {}} {"name": "post_letter", "parameters": 1} {"name": "calculator", "arguments": {}} {"name": "Ann"}'
    assert toolcalls.unknown_names_in(text, KNOWN) == ["post_letter"]
    assert toolcalls.unknown_names_in('{"name": "x"}', KNOWN) == []


def test_probe():
    assert toolcalls.mentions_tool('ok {"name": "probe_add", "arguments": {}}', "probe_add")
    assert not toolcalls.mentions_tool("probe_add it is", "probe_add") and not toolcalls.mentions_tool("", "probe_add")


def test_messages(spark):
    schema = "id int, content string, tool_calls array<struct<function:struct<name:string,arguments:map<string,string>>>>"
    rows = [(1, "", [((("calculator"), {"expression": "2"}),)]), (2, '{"name": "read_file", "arguments": {}}', None), (3, None, [None, ((None, None),), None]), (4, "text", [])]
    df = toolcalls.with_text_calls(spark.createDataFrame(rows, schema), "content", sorted(KNOWN))
    native = toolcalls.native_calls(F.col("tool_calls"))
    got = {r["id"]: r for r in df.select("id", native.alias("n"), toolcalls.call_format(native, F.col("text_calls")).alias("f")).collect()}
    assert [got[i]["f"] for i in (1, 2, 3, 4)] == ["native", "text", "unknown", "unknown"]
    assert json.loads(got[1]["n"][0]["arguments"]) == {"expression": "2"} and got[3]["n"] == []


def test_arguments(spark):
    df = spark.createDataFrame([(None,), ('{"a": 1}',), ("2+2",), ("[1]",)], "a string").select(toolcalls.normalised_arguments(F.col("a")).alias("m"))
    got = [r["m"] for r in df.collect()]
    assert got == [{}, {"a": "1"}, {"expression": "2+2", "path": "2+2", "query": "2+2"}, {"expression": "[1]", "path": "[1]", "query": "[1]"}]


def value(spark, expression):
    return spark.range(1).select(calc.compiled(expression).alias("v")).first()["v"]


def test_calculator(spark):
    assert value(spark, "(15 * 7) + 3") == 108 and value(spark, "1/0") is None
    assert value(spark, "-7 // 2") == -4 and value(spark, "-7 % 3") == 2 and value(spark, "7 % -3") == -2 and value(spark, "2 ** 10") == 1024
    for bad in ("__import__('os').getcwd()", "x + 1", "'a' * 3", "1 if 2 else 3", "1 <", "1+" * 600 + "1", "[1]"):
        with pytest.raises(ValueError):
            calc.compiled(bad)


def test_registry(spark):
    r = registry.Registry()

    @r.tool("calculator", "adds up")
    def calculator(expression: str):
        return eval_free(expression)

    def eval_free(e):
        return len(e)

    @r.tool("read_file", "reads")
    def read_file(path: str, max_chars: int = 8000):
        raise OSError("gone")

    @r.tool("note", "keeps")
    def note(text: str, **rest):
        return f"{text}|{sorted(rest)}"

    assert r.parameters("read_file") == [("path", "string", True, None), ("max_chars", "integer", False, "8000")]
    assert r.run("calculator", {"expression": "abc", "extra": 1}) == "3" and r.run("note", {"text": "a", "b": 1, "c": 2}) == "a|['b', 'c']"
    assert r.run("nope", {}) == "unknown tool: nope" and "gone" in r.run("read_file", {"path": "x"})
    found = {x["tool"]: json.loads(x["schema"])["function"]["parameters"] for x in registry.schemas(r.table(spark)).collect()}
    assert found["calculator"]["required"] == ["expression"] and "rest" not in found["note"]["properties"]
    assert found["read_file"]["properties"]["max_chars"] == {"type": "integer", "description": "default: 8000"}
    names = spark.createDataFrame([("qwen2.5-coder:3b",), ("nomic-embed-text:latest",)], "n string")

    def holds(wanted):
        return names.where(registry.model_matches(F.col("n"), wanted)).count() > 0

    assert [holds(w) for w in ("qwen2.5-coder:3b", "nomic-embed-text", "qwen2.5-coder:7b", "qwen")] == [True, True, False, False]
    tidy = spark.createDataFrame([(' "\'Ответ:  да\'" ',), ("answer: yes",), (None,)], "t string").select(registry.tidied(F.col("t"), ["answer:", "ответ:"])).collect()
    assert [t[0] for t in tidy] == ["да", "yes", None]


def test_history(spark):
    rows = [(1, 1, t, str(t)) for t in range(15)] + [(100, 1, 3, "again"), (50, 2, None, "x"), (51, 2, 0, "reset"), (52, 2, 1, "y")]
    df = spark.createDataFrame(rows, "id int, conv int, turn int, content string")
    once = history.once(df, "conv", "turn", order="id")
    assert once.count() == 18
    assert sorted(r["turn"] for r in history.last_messages(once, "conv", "turn", "id", 10).where("conv = 1").collect()) == list(range(5, 15))
    kept = history.after_reset(once, "conv", "turn", "id", F.col("content") == "reset")
    assert [r["content"] for r in kept.where("conv = 2").collect()] == ["y"] and kept.where("conv = 1").count() == 15


def test_collection(spark, tmp_path):
    c = memory.Collection(spark, f"file://{tmp_path}", "facts")
    form = "id string, text string"
    assert c.read(form).count() == 0
    c.upsert(spark.createDataFrame([("a", "1"), ("b", "2")], form), "id", form)
    c.upsert(spark.createDataFrame([("b", "3"), ("c", "4")], form), "id", form)
    assert {r["id"]: r["text"] for r in c.read(form).collect()} == {"a": "1", "b": "3", "c": "4"}
    c.insert(spark.createDataFrame([("c", "5")], form))
    assert c.read(form).count() == 4
    c.delete(spark.createDataFrame([("c",), ("zz",), ("c",)], "id string"), "id", form)
    assert {r["id"] for r in c.read(form).collect()} == {"a", "b"}
    c.clear(form)
    assert c.read(form).count() == 0
    stale = spark.createDataFrame([("f", 1), ("f", 2), ("g", 1)], "path string, n int")
    assert memory.replace_by(stale, stale.where("path = 'f' and n = 1"), "path").count() == 2
    text = spark.createDataFrame([({"b": "1", "c": "2"},)], "m map<string,string>").select(memory.facts_from(F.col("m"))).first()[0]
    assert text == "b: 1 | c: 2"
    wants = spark.createDataFrame([("Запомни это",), ("покажи, что запомни",), ("x",), (None,)], "t string").select(memory.wants_memory(F.col("t"), ["запомни"], ["покажи"])).collect()
    assert [w[0] for w in wants] == ["save", "skip", "none", "none"]


def test_text_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "__init__.py").write_bytes(b"a\r\nb\xff")
    (tmp_path / "sub" / "_x.MD").write_text("")
    (tmp_path / ".git" / "no.py").write_text("no")
    (tmp_path / "no.bin").write_text("no")
    files.register(spark)
    got = {r["path"]: r["content"] for r in spark.read.format("text_folder").load(str(tmp_path)).collect()}
    assert got == {"__init__.py": "a\nb", "sub/_x.MD": ""}
    cut = spark.read.format("text_folder").option("errors", "replace").option("maxChars", "2").load(str(tmp_path)).where("path = '__init__.py'").first()
    assert cut["content"] == "a\nb"
    assert spark.read.format("text_folder").load(str(tmp_path / ".git" / "none")).count() == 0


def test_stream_keeps_the_last_messages(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "conv_id bigint, turn int, content string"
    spark.createDataFrame([(1, t, f"m{t}") for t in range(5)] + [(None, 1, "x"), (2, None, "y")], schema).write.mode("append").parquet(source)
    query = last_messages_stream(spark.readStream.schema(schema).parquet(source), 3).writeStream.outputMode("update").format("memory").queryName("last").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        spark.createDataFrame([(1, 7, "m7"), (1, 4, "again")], schema).write.mode("append").parquet(source)
        time.sleep(0.5)
        query.processAllAvailable()
        got = [(r["turns"], r["contents"]) for r in spark.table("last").collect()]
    finally:
        query.stop()
    assert got[0] == ([2, 3, 4], ["m2", "m3", "m4"]) and got[-1] == ([3, 4, 7], ["m3", "again", "m7"])


class Shouting:
    def answer(self, prompts):
        return [None if p is None else p.upper() for p in prompts]


def test_a_project_from_folder_to_answer(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    texts = spark.createDataFrame([("impl.py", "def calculator(expression):\n    return ast.parse(expression)\n"), ("notes.md", "the calculator is named here, and nothing else at all\n"), ("../out.py", "x"), ("none/x.py", "x")], "path string, content string")
    written = {r["path"]: r for r in files.write_texts(texts, str(root)).collect()}
    assert written["impl.py"]["chars"] == 61 and written["../out.py"]["error"] and written["none/x.py"]["error"]
    (root / "blank.txt").write_text(" \n")
    project = Project(spark, f"file://{tmp_path}/index")
    assert project.index(str(root)).first().asDict() == {"files": 2, "chunks": 2, "errors": 0}
    asked = spark.createDataFrame([(1, "def calculator"), (2, " "), (3, None)], "query_id int, query string")
    hits = project.search(asked).orderBy("position").collect()
    assert [h["path"] for h in hits] == ["impl.py", "notes.md"] and {h["query_id"] for h in hits} == {1}
    answer = project.ask(asked).first()
    assert answer["answer"].startswith("1. [impl.py]\n1: def calculator") and answer["shown"] == 2
    (root / "impl.py").write_text("def something_else_entirely(): pass")
    project.reindex(str(root), spark.createDataFrame([("impl.py",)], "path string"))
    assert "something" in project.store.read(FORM).where("path = 'impl.py'").first()["documents"] and project.stats().first()["chunks"] == 2
    said = answered(asked, F.col("query"), Shouting()).orderBy("query_id").collect()
    assert [x["answer"] for x in said] == ["DEF CALCULATOR", " ", None]
    assert len(spark.range(1).select(clock()).first()[0]) == 19
