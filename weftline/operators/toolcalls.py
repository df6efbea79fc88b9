"""Tool calls in chat messages: extraction from text and from structured fields.

JSON standing anywhere in free text is no regular language, so one Arrow UDF per
batch finds the objects; whatever follows (which tools are known, which format a
message used, its rendering) is joins and expressions.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.tables import spread

_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL)
_PART = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}]', re.DOTALL)
_DECODER = json.JSONDecoder()
_CALLS = "array<struct<name:string,arguments:string>>"
_CALL_TYPE = pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.string())]))


def _decoded(text: str) -> dict | list | str | float | None:
    try:
        return json.loads(text)
    except ValueError:
        return None


class _Unlined(str):
    """A text whose errors carry no line number, as counting lines anew for every error would take time by the square."""

    def count(self, *_: object) -> int:
        return 0

    def rfind(self, *_: object) -> int:
        return -1


class _Reader:
    """Reads objects at braces of one text. No stretch is read again and again, as braces that must fail are remembered.

    If reading fails at some place, it fails there from each brace too that was still open, so those aren't tried.
    """

    def __init__(self, text: str):
        self.text = _Unlined(text)
        self.hopeless: set[int] = set()

    def read(self, at: int) -> tuple[object, int] | None:
        """The object at a brace and the place after it, or None."""
        if at in self.hopeless:
            return None
        try:
            return _DECODER.raw_decode(self.text, at)
        except json.JSONDecodeError as e:
            failed = e.pos
        except RecursionError:
            failed = len(self.text)
        open_braces = []
        for part in _PART.finditer(self.text, at, failed):
            if part.group() == "{":
                open_braces.append(part.start())
            elif part.group() == "}" and open_braces:
                open_braces.pop()
        self.hopeless.update(open_braces)
        return None


def objects_in(text: str, repair: bool) -> Iterator[object]:
    """The JSON objects that begin at a brace of the text; an object's inside isn't looked at again.

    With ``repair``, one that can't be read is tried once more with its backslashes doubled, as Windows paths need.
    Takes time in proportion to the text.
    """
    slashes = [m.start() for m in re.finditer(r"\\", text)] if repair else []
    plain, doubled = _Reader(text), _Reader(text.replace("\\", "\\\\")) if slashes else None
    # where the second of each pair stands in the doubled text
    seconds = [place + i + 1 for i, place in enumerate(slashes)]
    at = text.find("{")
    while at >= 0:
        found, stop = plain.read(at), at + 1
        if found:
            yield found[0]
            stop = found[1]
        elif doubled and slashes[-1] > at:
            found = doubled.read(at + bisect_left(slashes, at))
            if found:
                yield found[0]
                stop = found[1] - bisect_left(seconds, found[1])
        at = text.find("{", stop)


def _candidates(found: object) -> list[dict]:
    """An object itself and the one under ``function``."""
    if not isinstance(found, dict):
        return []
    inner = found.get("function")
    return [found, *([inner] if isinstance(inner, dict) else [])]


def _known_call(found: object, known: frozenset[str]) -> dict | None:
    for c in _candidates(found):
        if isinstance(c.get("name"), str) and c["name"] in known:
            given = c.get("arguments", {})
            return {"name": c["name"], "arguments": given if isinstance(given, str) else json.dumps(given, ensure_ascii=False)}
    return None


def calls_in(text: str | None, known: frozenset[str]) -> list[dict]:
    """Calls of known tools: those in fenced blocks if there are any, else all in the text."""
    if not text:
        return []
    fenced = [c for block in _FENCE.findall(text) if (c := _known_call(_decoded(block), known))]
    return fenced or [c for o in objects_in(text, repair=True) if (c := _known_call(o, known))]


def unknown_names_in(text: str | None, known: frozenset[str]) -> list[str]:
    """Names of tools called that aren't known, each once, in order; only objects with arguments or parameters are calls."""
    if not text:
        return []
    found = [_decoded(block) for block in _FENCE.findall(text)]
    names = {}
    for o in [*found, *objects_in(text, repair=False)]:
        for c in _candidates(o):
            name = c.get("name")
            if isinstance(name, str) and name and name not in known and ("arguments" in c or "parameters" in c):
                names[name] = None
    return list(names)


def mentions_tool(text: str | None, tool: str) -> bool:
    """Whether an object beginning at any brace, also inside another, calls the tool."""
    if not text or tool not in text:
        return False
    waiting = list(objects_in(text, repair=False))
    while waiting:
        found = waiting.pop()
        if isinstance(found, dict):
            if any(c.get("name") == tool for c in _candidates(found)):
                return True
            waiting += found.values()
        elif isinstance(found, list):
            waiting += found
    return False


def with_text_calls(messages: DataFrame, content: str, known: list[str]) -> DataFrame:
    """``messages`` with ``text_calls`` and ``unknown_tools``. ``known``: the registry's names."""
    names = frozenset(known)

    @F.arrow_udf(f"struct<calls:{_CALLS},unknown:array<string>>")
    def scan(texts: pa.Array) -> pa.Array:
        some = texts.to_pylist()
        return pa.StructArray.from_arrays(
            [pa.array([calls_in(t, names) for t in some], _CALL_TYPE), pa.array([unknown_names_in(t, names) for t in some], pa.list_(pa.string()))], ["calls", "unknown"]
        )

    return spread(messages).withColumn("_found", scan(F.col(content))).select(*messages.columns, F.col("_found.calls").alias("text_calls"), F.col("_found.unknown").alias("unknown_tools"))


def native_calls(tool_calls: Column) -> Column:
    """Calls of a structured field, whatever the registry holds; entries without a function or a name are left out."""
    named = F.filter(tool_calls, lambda c: F.coalesce(F.length(c["function"]["name"]) > 0, F.lit(False)))
    return F.coalesce(
        F.transform(named, lambda c: F.struct(c["function"]["name"].alias("name"), F.coalesce(F.to_json(c["function"]["arguments"]), F.lit("{}")).alias("arguments"))), F.array().cast(_CALLS)
    )


def single_call(content: Column) -> Column:
    """The name called by a text that is one JSON object and nothing else, in either of two shapes; null otherwise. No Python."""
    whole = F.try_parse_json(content)
    return F.coalesce(F.try_variant_get(whole, "$.name", "string"), F.try_variant_get(whole, "$.function.name", "string"))


def call_format(native: Column, text: Column) -> Column:
    """``native`` where the structured field holds a call, else ``text`` where the content does, else ``unknown``."""
    return F.when(F.size(native) > 0, "native").when(F.size(text) > 0, "text").otherwise("unknown")


def observation(tool: Column, result: Column, form: Column) -> Column:
    """(role, tool_name, content) of the message that brings a result back, by the format of the call."""
    native = form == "native"
    return F.struct(
        F.when(native, "tool").otherwise("user").alias("role"),
        F.when(native, tool).alias("tool_name"),
        F.when(native, result).otherwise(F.concat(F.lit("Observation from "), tool, F.lit(": "), result)).alias("content"),
    )


def normalised_arguments(arguments: Column) -> Column:
    """Arguments as a map: none for null, an object's fields, else the text under ``expression``, ``path`` and ``query``."""
    parsed = F.from_json(arguments, "map<string,string>")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT"), F.lit(False))
    fallback = F.create_map(*(x for k in ("expression", "path", "query") for x in (F.lit(k), arguments)))
    return F.when(arguments.isNull(), F.create_map().cast("map<string,string>")).when(is_object, parsed).otherwise(fallback)
