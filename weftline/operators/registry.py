"""A registry of tools, and what is derived from it: parameter tables, prompts, JSON schemas, dispatch."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names of parameters.
TYPE_NAMES = {str: "string", int: "integer", float: "number", bool: "boolean"}
ANY = "any"


class Registry:
    """Functions under names, with a description; ``tool`` decorates them."""

    def __init__(self) -> None:
        self._tools: dict[str, tuple[Callable[..., Any], str]] = {}

    def tool(self, name: str, description: str) -> Callable:
        def register(f: Callable) -> Callable:
            self._tools[name] = (f, description)
            return f

        return register

    def names(self) -> list[str]:
        return sorted(self._tools)

    def parameters(self, name: str) -> list[tuple[str, str, bool, str | None]]:
        """(param, type, required, default) of a tool; ``*args`` and ``**kwargs`` aren't parameters."""
        out = []
        annotations = inspect.get_annotations(self._tools[name][0], eval_str=True)
        for p in inspect.signature(self._tools[name][0]).parameters.values():
            if p.kind in (p.VAR_KEYWORD, p.VAR_POSITIONAL):
                continue
            needed = p.default is p.empty
            out.append((p.name, TYPE_NAMES.get(annotations.get(p.name), ANY), needed, None if needed else str(p.default)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(tool, description, param, param_type, is_required, default_value), one row per parameter."""
        rows = [(n, self._tools[n][1], *p) for n in self.names() for p in self.parameters(n)]
        return spark.createDataFrame(rows, "tool string, description string, param string, param_type string, is_required boolean, default_value string")

    def run(self, name: str, arguments: dict[str, Any]) -> str:
        """A tool's result as text; arguments it doesn't take are dropped, and failures are texts too."""
        if name not in self._tools:
            return f"unknown tool: {name}"
        f = self._tools[name][0]
        taken = inspect.signature(f).parameters
        if not any(p.kind is p.VAR_KEYWORD for p in taken.values()):
            arguments = {k: v for k, v in arguments.items() if k in taken}
        try:
            return str(f(**arguments))
        except Exception as e:
            return f"tool {name} failed: {e}"


def _parameter_text() -> Column:
    needed = F.concat("param", F.lit(" ("), "param_type", F.lit(", required)"))
    free = F.concat("param", F.lit(" ("), "param_type", F.lit(", default: "), F.coalesce("default_value", F.lit("none")), F.lit(")"))
    return F.when(F.col("is_required"), needed).otherwise(free)


def prompt_lines(registry: DataFrame) -> DataFrame:
    """(tool, line): each tool with its parameters in order of name, as a prompt lists them."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("param", _parameter_text().alias("text")))), lambda x: x["text"]), ", ")
    return registry.groupBy("tool").agg(F.concat("tool", F.lit(": "), parts).alias("line"))


def schemas(registry: DataFrame) -> DataFrame:
    """(tool, schema): a JSON schema for function calling. ``any`` leaves a parameter's type open; defaults go into its description."""
    typed = F.when(F.col("param_type").isin(*TYPE_NAMES.values()), F.col("param_type"))
    described = F.when(~F.col("is_required"), F.concat(F.lit("default: "), F.coalesce("default_value", F.lit("none"))))
    field = F.struct(F.col("param").alias("key"), F.struct(typed.alias("type"), described.alias("description")).alias("value"))
    grouped = registry.groupBy("tool").agg(F.array_sort(F.collect_list(field)).alias("fields"), F.array_sort(F.collect_list(F.when(F.col("is_required"), F.col("param")))).alias("required"))
    inner = F.struct(F.lit("object").alias("type"), F.map_from_entries("fields").alias("properties"), F.col("required"))
    whole = F.struct(F.lit("function").alias("type"), F.struct(F.col("tool").alias("name"), inner.alias("parameters")).alias("function"))
    return grouped.select("tool", F.to_json(whole).alias("schema"))


def checked_calls(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """(call_id, tool, known, missing, extra): each call held against the registry.

    ``calls``: call_id, tool, params (array<string>). ``missing`` are required parameters that aren't given, ``extra`` given ones the tool doesn't take.
    """
    tools = registry.groupBy("tool").agg(F.collect_list("param").alias("takes"), F.collect_list(F.when(F.col("is_required"), F.col("param"))).alias("needs"))
    empty = F.array().cast("array<string>")
    joined = calls.join(tools, "tool", "left")
    known = F.col("takes").isNotNull()
    return joined.select(
        "call_id",
        "tool",
        known.alias("known"),
        F.array_join(F.array_sort(F.when(known, F.array_except("needs", F.coalesce("params", empty))).otherwise(empty)), ",").alias("missing"),
        F.array_join(F.array_sort(F.when(known, F.array_except(F.coalesce("params", empty), "takes")).otherwise(empty)), ",").alias("extra"),
    )


def model_matches(installed: Column, wanted: str) -> Column:
    """Whether a model's name is the wanted one; a wanted name without a tag matches any tag."""
    exact = installed == F.lit(wanted)
    return exact if ":" in wanted else exact | installed.startswith(wanted + ":")


def tidied(text: Column, prefixes: list[str]) -> Column:
    """A model's answer without white space and quotes around it and without one leading phrase."""
    t = F.trim(text)
    t = F.btrim(F.btrim(t, F.lit('"')), F.lit("'"))
    return F.trim(F.regexp_replace(F.trim(t), "(?iu)^(" + "|".join(prefixes) + r")\s*", ""))
