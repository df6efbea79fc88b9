"""Queries of tool calls, the tool registry, chat history and arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import calc, evaluate, history, memory, registry, toolcalls
from weftline.plans.base import Plans
from weftline.sources.tables import table

PLANS = Plans()
PREFIXES = ["answer:", "reply:", "ответ:"]


def _chat(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chat_messages")


def _tools(spark: SparkSession, folder: str) -> list[str]:
    """The registry's names: one row per tool and parameter, a table of fixed size."""
    return [r[0] for r in table(spark, folder, "tool_registry").select("tool").distinct().collect()]


_NATIVE = """list_filter(coalesce(tool_calls, []), lambda c: length(coalesce(c."function"."name", '')) > 0)"""
_SINGLE = """CASE WHEN json_valid(X) THEN coalesce(json_extract_string(X, '$.name'), json_extract_string(X, '$.function.name')) END"""


@PLANS.query()
def tool_call_extract(spark: SparkSession, folder: str) -> DataFrame:
    found = toolcalls.with_text_calls(_chat(spark, folder), "content", _tools(spark, folder))
    return found.select("msg_id", F.posexplode("text_calls").alias("nth", "call")).select("msg_id", "nth", "call.name", "call.arguments")


@PLANS.query()
def unknown_tools(spark: SparkSession, folder: str) -> DataFrame:
    found = toolcalls.with_text_calls(_chat(spark, folder), "content", _tools(spark, folder))
    return found.select("msg_id", F.explode("unknown_tools").alias("tool"))


@PLANS.query(f"""SELECT msg_id, unnest(range(len(n)))::BIGINT AS nth, unnest(list_transform(n, lambda c: c."function"."name")) AS name FROM (SELECT msg_id, {_NATIVE} AS n FROM chat_messages)""")
def native_calls(spark: SparkSession, folder: str) -> DataFrame:
    found = _chat(spark, folder).select("msg_id", F.posexplode(toolcalls.native_calls(F.col("tool_calls"))).alias("nth", "call"))
    return found.select("msg_id", F.col("nth").cast("bigint").alias("nth"), "call.name")


@PLANS.query(
    f"""SELECT name, count(*) AS n FROM (SELECT unnest(list_transform({_NATIVE}, lambda c: c."function"."name")) AS name FROM chat_messages)
WHERE name NOT IN (SELECT tool FROM tool_registry) GROUP BY name"""
)
def unknown_native_tools(spark: SparkSession, folder: str) -> DataFrame:
    called = _chat(spark, folder).select(F.explode(toolcalls.native_calls(F.col("tool_calls"))).alias("call")).select("call.name")
    return called.join(table(spark, folder, "tool_registry").select(F.col("tool").alias("name")), "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"))


@PLANS.query(
    f"""SELECT 'chat' AS origin, msg_id AS id, {_SINGLE.replace('X', 'content')} AS tool FROM chat_messages
UNION ALL SELECT 'event', event_id, {_SINGLE.replace('X', "concat('{\"name\": \"', event_type, '\", \"arguments\": ', props, '}')")} FROM events"""
)
def tool_call_parse(spark: SparkSession, folder: str) -> DataFrame:
    chat = _chat(spark, folder).select(F.lit("chat").alias("origin"), F.col("msg_id").alias("id"), F.col("content").alias("text"))
    wrapped = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "arguments": '), F.col("props"), F.lit("}"))
    events = table(spark, folder, "events").select(F.lit("event").alias("origin"), F.col("event_id").alias("id"), wrapped.alias("text"))
    return chat.unionByName(events).select("origin", "id", toolcalls.single_call(F.col("text")).alias("tool"))


@PLANS.query(
    """WITH a AS (SELECT 'chat' AS origin, msg_id AS id, content AS t FROM chat_messages UNION ALL SELECT 'event', event_id, props FROM events)
SELECT origin, id, CASE WHEN t IS NULL THEN 'none' WHEN json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT' THEN 'object' ELSE 'text' END AS kind,
  CASE WHEN json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT' THEN json_extract_string(CASE WHEN json_valid(t) THEN t END, '$.k') END AS k, CASE WHEN json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT' THEN json_extract_string(CASE WHEN json_valid(t) THEN t END, '$.query') ELSE t END AS query FROM a"""
)
def normalize_args(spark: SparkSession, folder: str) -> DataFrame:
    chat = _chat(spark, folder).select(F.lit("chat").alias("origin"), F.col("msg_id").alias("id"), F.col("content").alias("t"))
    both = chat.unionByName(table(spark, folder, "events").select(F.lit("event").alias("origin"), F.col("event_id").alias("id"), F.col("props").alias("t")))
    made = both.withColumn("args", toolcalls.normalised_arguments(F.col("t")))
    kind = F.when(F.col("t").isNull(), "none").when(F.map_contains_key("args", F.lit("expression")), "text").otherwise("object")
    return made.select("origin", "id", kind.alias("kind"), F.try_element_at("args", F.lit("k")).alias("k"), F.try_element_at("args", F.lit("query")).alias("query"))


@PLANS.query()
def format_detect(spark: SparkSession, folder: str) -> DataFrame:
    found = toolcalls.with_text_calls(_chat(spark, folder), "content", _tools(spark, folder))
    return found.select("msg_id", toolcalls.call_format(toolcalls.native_calls(F.col("tool_calls")), F.col("text_calls")).alias("format"))


_TURNS = "turns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY msg_id) AS nth FROM chat_messages) WHERE nth = 1)"


@PLANS.query(
    f"""WITH {_TURNS} SELECT t.msg_id, CASE WHEN len(coalesce(a.tool_calls, [])) > 0 THEN 'tool' ELSE 'user' END AS role,
  CASE WHEN len(coalesce(a.tool_calls, [])) > 0 THEN t.tool_name END AS tool_name, CASE WHEN len(coalesce(a.tool_calls, [])) > 0 THEN t.content ELSE 'Observation from ' || t.tool_name || ': ' || t.content END AS content
FROM turns t JOIN turns a ON a.conv_id = t.conv_id AND a.turn = t.turn - 1 WHERE lower(t.role) = 'tool'"""
)
def observation_message(spark: SparkSession, folder: str) -> DataFrame:
    turns = history.once(_chat(spark, folder), "conv_id", "turn", order="msg_id")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("tool_calls").alias("asked"))
    both = turns.where("lower(role) = 'tool'").join(asked, ["conv_id", "turn"])
    form = F.when(F.coalesce(F.size("asked"), F.lit(0)) > 0, "native").otherwise("text")
    return both.select("msg_id", toolcalls.observation(F.col("tool_name"), F.col("content"), form).alias("m")).select("msg_id", "m.role", "m.tool_name", "m.content")


@PLANS.query(
    f"""WITH {_TURNS}, f AS (SELECT conv_id, turn, {_NATIVE}[1]."function"."name" AS called, {_SINGLE.replace('X', 'content')} AS written FROM turns)
SELECT t.msg_id, coalesce(called, written) AS found, t.tool_name AS expected, coalesce(called, written) IS NOT DISTINCT FROM t.tool_name AS equal
FROM turns t JOIN f ON f.conv_id = t.conv_id AND f.turn = t.turn - 1 WHERE lower(t.role) = 'tool'"""
)
def call_vs_result(spark: SparkSession, folder: str) -> DataFrame:
    turns = history.once(_chat(spark, folder), "conv_id", "turn", order="msg_id")
    named = F.coalesce(F.get(toolcalls.native_calls(F.col("tool_calls")), F.lit(0))["name"], toolcalls.single_call(F.col("content")))
    called = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), named.alias("label"))
    results = turns.where("lower(role) = 'tool'").select("msg_id", "conv_id", "turn", F.col("tool_name").alias("label"))
    found = results.drop("label").join(called, ["conv_id", "turn"]).select("msg_id", "label")
    return evaluate.against(found, results.select("msg_id", "label"), "msg_id")


@PLANS.query(
    """SELECT msg_id, nth::BIGINT AS nth, array_to_string(list_transform(map_entries(a), lambda e: e."key" || ': ' || e."value"), ' | ') AS text
FROM (SELECT msg_id, unnest(range(len(tool_calls))) AS nth, unnest(list_transform(tool_calls, lambda c: c."function"."arguments")) AS a FROM chat_messages WHERE tool_calls IS NOT NULL)"""
)
def kwargs_to_text(spark: SparkSession, folder: str) -> DataFrame:
    calls = _chat(spark, folder).select("msg_id", F.posexplode("tool_calls").alias("nth", "call"))
    return calls.select("msg_id", F.col("nth").cast("bigint").alias("nth"), memory.facts_from(F.col("call.function.arguments")).alias("text"))


@PLANS.query()
def tool_schema(spark: SparkSession, folder: str) -> DataFrame:
    return registry.schemas(table(spark, folder, "tool_registry"))


@PLANS.query(
    """SELECT tool, tool || ': ' || string_agg(param || ' (' || param_type || CASE WHEN is_required THEN ', required)' ELSE ', default: ' || coalesce(default_value, 'none') || ')' END, ', ' ORDER BY param) AS line
FROM tool_registry GROUP BY tool"""
)
def render_tools(spark: SparkSession, folder: str) -> DataFrame:
    return registry.prompt_lines(table(spark, folder, "tool_registry"))


@PLANS.query(
    """WITH c AS (SELECT msg_id, unnest(range(len(tool_calls))) AS nth, unnest(tool_calls) AS call FROM chat_messages WHERE tool_calls IS NOT NULL),
d AS (SELECT msg_id || '-' || nth AS call_id, call."function"."name" AS tool, map_keys(call."function"."arguments") AS params FROM c),
r AS (SELECT tool, list(param) AS takes, list(param) FILTER (is_required) AS needs FROM tool_registry GROUP BY tool)
SELECT call_id, d.tool, takes IS NOT NULL AS known,
  array_to_string(list_sort(CASE WHEN takes IS NULL THEN [] ELSE list_filter(coalesce(needs, []), lambda x: NOT list_contains(coalesce(params, []), x)) END), ',') AS missing,
  array_to_string(list_sort(CASE WHEN takes IS NULL THEN [] ELSE list_filter(coalesce(params, []), lambda x: NOT list_contains(takes, x)) END), ',') AS extra FROM d LEFT JOIN r ON r.tool = d.tool"""
)
def checked_calls(spark: SparkSession, folder: str) -> DataFrame:
    calls = _chat(spark, folder).select("msg_id", F.posexplode("tool_calls").alias("nth", "call"))
    named = calls.select(F.concat_ws("-", "msg_id", "nth").alias("call_id"), F.col("call.function.name").alias("tool"), F.map_keys("call.function.arguments").alias("params"))
    return registry.checked_calls(named, table(spark, folder, "tool_registry"))


@PLANS.query(f"WITH {_TURNS} SELECT conv_id, turn::BIGINT AS turn, msg_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, msg_id DESC) AS k FROM turns) WHERE k <= 10")
def history_last_n(spark: SparkSession, folder: str) -> DataFrame:
    turns = history.once(_chat(spark, folder), "conv_id", "turn", order="msg_id")
    return history.last_messages(turns, "conv_id", "turn", "msg_id", 10).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "msg_id")


@PLANS.query(
    f"""WITH {_TURNS}, m AS (SELECT *, coalesce(tool_name = 'clock' OR length(trim(content)) = 0 AND lower(role) = 'user', false)::INT AS r FROM turns),
s AS (SELECT *, sum(r) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, msg_id ROWS UNBOUNDED PRECEDING) AS seg, sum(r) OVER (PARTITION BY conv_id) AS last FROM m)
SELECT conv_id, turn::BIGINT AS turn, msg_id FROM s WHERE seg = last AND r = 0"""
)
def history_reset(spark: SparkSession, folder: str) -> DataFrame:
    turns = history.once(_chat(spark, folder), "conv_id", "turn", order="msg_id")
    reset = (F.col("tool_name") == "clock") | ((F.length(F.trim("content")) == 0) & (F.lower("role") == "user"))
    return history.after_reset(turns, "conv_id", "turn", "msg_id", reset).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "msg_id")


@PLANS.query(
    """SELECT msg_id, trim(regexp_replace(trim(trim(trim(trim(content), '"'), '''')), '(?i)^(answer:|reply:|ответ:)\\s*', '')) AS tidy FROM chat_messages"""
)
def cleanup_output(spark: SparkSession, folder: str) -> DataFrame:
    return _chat(spark, folder).select("msg_id", registry.tidied(F.col("content"), PREFIXES).alias("tidy"))


@PLANS.query(
    """SELECT doc_id, name, coalesce(name = 'lesson_code' OR starts_with(name, 'lesson_code:'), false) AS any_tag, coalesce(name = 'lesson_code:ru', false) AS one_tag
FROM (SELECT doc_id, source || ':' || lang AS name FROM documents)"""
)
def model_name_match(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "documents").select("doc_id", F.concat("source", F.lit(":"), "lang").alias("name"))
    no = F.lit(False)
    return names.select(
        "doc_id", "name", F.coalesce(registry.model_matches(F.col("name"), "lesson_code"), no).alias("any_tag"), F.coalesce(registry.model_matches(F.col("name"), "lesson_code:ru"), no).alias("one_tag")
    )


@PLANS.query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_quantity / 2, 6) AS value FROM lineitem")
def calc_expression(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    names = {"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax"), "quantity": F.col("l_quantity")}
    return lines.select("l_orderkey", "l_linenumber", F.round(calc.compiled("price * (1 - discount) * (1 + tax) - quantity / 2", names), 6).alias("value"))


@PLANS.query(
    """SELECT o_orderkey, floor(-o_custkey / 7)::BIGINT AS floored, (o_custkey - -3 * floor(o_custkey / -3))::BIGINT AS modulo,
  floor(o_custkey / nullif(o_orderkey % 5, 0))::BIGINT AS by_zero, round(power(o_orderkey % 11, 2), 6) AS squared FROM orders"""
)
def calc_floor_mod(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    names = {"cust": F.col("o_custkey"), "order": F.col("o_orderkey"), "rest": F.col("o_orderkey") % 5, "eleventh": F.col("o_orderkey") % 11}
    return orders.select(
        "o_orderkey",
        calc.compiled("-cust // 7", names).cast("bigint").alias("floored"),
        calc.compiled("cust % -3", names).cast("bigint").alias("modulo"),
        calc.compiled("cust // rest", names).cast("bigint").alias("by_zero"),
        F.round(calc.compiled("eleventh ** 2", names), 6).alias("squared"),
    )


@PLANS.query()
def calc_calls(spark: SparkSession, folder: str) -> DataFrame:
    """The answer to every call that carries an expression."""
    calls = _chat(spark, folder).select("msg_id", F.posexplode("tool_calls").alias("nth", "call"))
    asked = calls.select("msg_id", F.col("nth").cast("bigint").alias("nth"), F.try_element_at("call.function.arguments", F.lit("expression")).alias("expression"))
    return asked.where("expression is not null").withColumn("answer", calc.answers(F.col("expression")))
