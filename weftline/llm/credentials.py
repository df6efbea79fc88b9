"""Credentials in source code, configuration and notes: found and hidden.

Each rule is a regular expression whose group ``v`` is the value, or the name of
a check. Rules run on the texts that hold the trigrams they require
(``trigram_index``); a value counts if it looks like a secret and isn't a
placeholder, a reference or a mere word or number.

Private-key blocks are followed over chunks: a chunk that holds key lines but no marker belongs to
a private key if the marker nearest before it in the file opens one, or the marker nearest
after it closes one, within ``REACH`` lines.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.codepoints import blocks
from weftline.llm.trigram_index import Segment, Wanted, required
from weftline.sources.tables import durable, spread

#: Lines of a key block at most between a marker and a chunk without one; four times the largest key in use.
REACH = 256

# Words that name a credential, at the end of an identifier.
NAMES = r"(?:passw(?:or)?d|passphrase|pass|pwd|secret|token|apikey|key|creds?|credentials?|passwort|kennwort|contraseña|clave|парол[ьяи]|ключ)"
# Words that introduce a login in a note.
NOTES = r"(?:парол[ьяи]|логин|вход|доступ|учётк\w*|пока так|login|password|passwd|credentials?|anmeldung|kennwort|passwort|zugang|contraseña|clave|acceso)"
_IDENT = rf"[\w.$-]*?{NAMES}\d{{0,2}}"
_VALUE = r"""(?P<v>[^\s"'`<>{}\\]{6,})"""

RULES: dict[str, str] = {
    # NAME = "v", NAME: v, NAME := v, "NAME": "v", \"NAME\": \"v\", env["NAME"] = 'v', --name=v, get("x-name") == "v";
    # getenv('NAME', 'v'), '--name', default='v'; NAME v, as in notes and chat
    "named": rf"""{NAMES}\d{{0,2}}(?:(?P<set>(?:\\?["'`])?[\])]?\s{{0,20}}(?:==?|:=|=>|:)\s{{0,20}}(?:str|bytes)?\(?[rbuf]{{0,2}}(?:\\?["'`]){{0,3}})|(?P<given>\\?["'`]\s{{0,20}},\s{{0,20}}(?:default\s{{0,4}}=\s{{0,4}})?[rbuf]{{0,2}}\\?["'`]{{1,3}})|(?P<said>[ \t]{{1,4}}(?:is[ \t]|[-—–][ \t])?["'`]?)){_VALUE}""",
    "netrc": r"""\blogin[ \t]{1,4}\S{1,100}[ \t]{1,4}password[ \t]{1,4}(?P<v>\S{4,100})""",
    "url": r"""[a-z][\w+.-]{1,20}://[^\s/:@"'<>`]{0,200}:(?P<v>[^\s/@"'<>`]{3,200})@""",
    "user_option": r"""curl\b[^\n]{0,300}?[ \t](?:-u|--user)[ =]{1,4}["']?[^\s:"']{1,100}:(?P<v>[^\s"']{4,})""",
    "basic": r"""basic\s{1,4}(?P<v>[A-Za-z0-9+/_-]{8,}={0,2})""",
    "bearer": r"""bearer\s{1,4}(?P<v>[\w.~+/=-]{16,})""",
    "login_call": r"""(?:login|auth\w{0,20}|connect|credentials)\s{0,4}(?:=\s{0,4})?\(\s{0,4}["'][^"'\n]{1,100}["']\s{0,4},\s{0,4}["'](?P<v>[^"'\n]{4,200})["']""",
    "slashed": r"""(?:^|[:—–-])[ \t]{0,4}[\w.@-]{1,100} / (?P<v>\S{6,100})[ \t\r]{0,4}$""",
    "quoted_note": rf"""{NOTES}[^\n`]{{0,60}}`(?P<v>[^`\s]{{5,100}})`""",
    "jwt": r"""(?P<v>eyJ[\w-]{8,}\.[\w-]{6,}(?:\.[\w-]+)?)""",
    "prefixed": r"""(?<![\w-])(?P<v>(?:gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|hf_|npm_|pypi-|sk-|rk_|pk_live_|sk_live_|shpat_|dop_v1_|ya29\.|[a-z]{2,10}_live_)[\w-]{8,})""",
    "cloud_id": r"""(?<![\w])(?P<v>(?:AKIA|ASIA|AIza)[\w-]{12,40})""",
}
# checks over several lines, and the words one of which they need
CHECKS: dict[str, str] = {"private_key": r"-----|PuTTY|Private-", "over_lines": rf"{NAMES}", "table": rf"\|[^\n]{{0,80}}(?:{NAMES}|---)", "named_value": r"name"}

# which of these a value is: nothing to hide
_HARMLESS = re.compile(
    r"""(?ix)
    [<{(\[].* | \$\{.* | \$\(.* | \$[A-Za-z_]+ | %\w*% | %\(.* | %[sd] | .*[>}] | .*\$\{.* | (?:os|sys|process|env|self|config|settings|cfg)\b[.\[].*
    | x{3,} | .*\*{3,}.* | \.{3,} | -+ | _+
    | (?:your|insert|enter|put|fill)[-_ ]?[a-z_ -]* | .*[-_]here | your[-_].*
    | (?!.*\d)(?:.*[^a-z])?(?:placeholder|redacted|change[-_]?me|todo|tbd|dummy|masked|hidden|removed|example|not[-_]set)(?:[^a-z].*)?
    | (?:none|null|nil|true|false|undefined|str|int|bool|bytes|optional|secretstr)(?:[\s|,)=\[\]].*)?
    | [\d.,:;+-]+ | 0x[0-9a-f]{1,8}
    | (?:sha\d+|md5)[-:=].* | data:.* | \w*(?:getpass|getenv|environ|input|prompt)\w*\(.* | (?:https?|file)://[^@]*
    """
)
_CALL = re.compile(r"[A-Za-z_][\w.]*[(\[].*")
_BODY = re.compile(r"[ \t]*[\"']?(?:[A-Za-z0-9+/]{16,}={0,2})(?:\\n)?[\"']{0,3}[,;]?[ \t]*\r?")
_SHORT = re.compile(r"[ \t]*[\"']?[A-Za-z0-9+/]{2,}={0,2}(?:\\n)?[\"']{0,3}[,;]?[ \t]*\r?")
_BLOCK_LETTERS = re.compile(r"[A-Za-z0-9+/]{2,}={0,2}")
_LINE_END = re.compile(r"(?:\\[nr])*[\s\"'`,;+\\]*\Z")
_HEADER = re.compile(r"[ \t]*(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID|Private-Lines|Public-Lines|Private-MAC|Encryption|Key-Derivation|Argon2-\w+)\s*:.*|[ \t]*\r?")
_OPEN = re.compile(r"-----BEGIN ([A-Z0-9 ]*)-----|PuTTY-User-Key-File-\d")
_CLOSE = re.compile(r"-----END ([A-Z0-9 ]*)-----|Private-MAC:")
# These run on lines of any length, so they take time in proportion: blanks are matched once, and a search begins at the name.
_PIECE = re.compile(r"""[ \t]*+(?:\+[ \t]*+)?[rbuf]{0,2}["'](?P<v>[^\s"']{5,})["'][ \t]*+(?:\+|\\|,)?[ \t]*+\)?[ \t]*+""")
_NAME_OPENS = re.compile(rf"""(?i){NAMES}\d{{0,2}}["']?\]?[ \t]*+(?::=|[:=])[ \t]*+(?:\(|\\|>-?|\|-?|["']{{3}}|)[ \t]*+(?:[rbuf]{{0,2}}["'](?P<v>[^\s"']{{5,}})["'][ \t]*+[\\+]?)?[ \t]*+\Z""")
_SECTION = re.compile(rf"(?i)[ \t]*\[+[\"']?{_IDENT}[\"']?\]+[ \t]*")
_ANY_SECTION = re.compile(r"[ \t]*\[+[\w.\"'-]+\]+[ \t]*")
_SECTION_VALUE = re.compile(r"""[ \t]*(?:value|default|data|text|content)[ \t]*[:=][ \t]*["']{0,3}(?P<v>[^\s"']{5,})["']{0,3}[ \t]*""")
_ROW = re.compile(r"[ \t]*\|(.+)\|[ \t]*\r?")
_RULER = re.compile(r"(?=[^-]*-)[ \t]*+\|[ \t:|-]*\|[ \t]*+\r?")
_NAME_CELL = re.compile(rf"(?i)[\w .-]*?{NAMES}\d?")
_NAMED = re.compile(rf"""(?i)(?:-[ \t]*)?(?:\{{[ \t]*)?["']?(?:name|key|variable|env)["']?\s*[:=]\s*["']?{_IDENT}["']?\s*,?""")
_ANY_NAMED = re.compile(r"""(?i)(?:name|key|variable|env)["']?\s*[:=]""")
_NAMED_VALUE = re.compile(r"""["']?(?:value|default)["']?\s*[:=]\s*["']?(?P<v>[^\s"',}]{5,})""")

_HIT = pa.schema([("id", pa.int64()), ("path", pa.string()), ("line_no", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])


def looks_secret(value: str, strict: bool = False) -> bool:
    """Whether a value is a literal secret: letters with digits or signs among them, and no placeholder, reference, word or number."""
    if len(value) < 6 or _HARMLESS.fullmatch(value) or _CALL.fullmatch(value):
        return False
    letter, digit = bool(re.search(r"[^\W\d_]", value)), bool(re.search(r"\d", value))
    if letter and digit:
        # a word with a number behind it, as in step12 or node_3, is a name
        return not (strict and (len(value) < 7 or re.fullmatch(r"[A-Za-zа-я_]+[-_]?\d{1,2}|v?\d[\d.]*\w{0,4}|[A-Za-z]+\d*\.[a-z]{1,5}|\d+\w{1,3}", value)))
    return not strict and letter and (len(set(re.findall(r"[^\w\s.,:;/()\[\]-]", value))) >= 2 or (len(value) >= 20 and not re.search(r"[_./:-]", value) and value != value.lower() and value != value.upper()))


def _unwrapped(value: str) -> str:
    return value.rstrip(",;.)]:!" if re.search(r"[\w=)]", value) else "").rstrip(")") if "(" not in value else value


def _decoded_login(value: str) -> bool:
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode()
    except (binascii.Error, ValueError):
        return False
    return bool(re.fullmatch(r"[^\s:]*:\S+", text))


class _Chunk:
    """A chunk's lines, with their numbers and places in the stored text."""

    def __init__(self, stored: str, numbered: bool):
        self.numbers: list[int] = []
        self.lines: list[str] = []
        self.at: list[int] = []
        place = 0
        for k, line in enumerate(stored.split("\n")):
            m = re.match(r"([0-9]{1,9}): ", line) if numbered else None
            self.numbers.append(int(m[1]) if m else k + 1)
            self.lines.append(line[m.end() :] if m else line)
            self.at.append(place + (m.end() if m else 0))
            place += len(line) + 1
        self.text = "\n".join(self.lines)
        low = self.text.lower()
        # some capitals become two characters; such texts keep them, so that places agree
        self.low = low if len(low) == len(self.text) else "".join(x if len(x.lower()) > 1 else x.lower() for x in self.text)
        self.starts = [0]
        for line in self.lines[:-1]:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def parts(self, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(line number, begin, end in the stored text) of a span of the text, line by line."""
        k = bisect_right(self.starts, begin) - 1
        while k < len(self.lines) and self.starts[k] < end:
            lo, hi = max(0, begin - self.starts[k]), min(len(self.lines[k]), end - self.starts[k])
            if lo < hi:
                yield self.numbers[k], self.at[k] + lo, self.at[k] + hi
            k += 1

    def key_part(self, k: int, kind: str = "value") -> tuple[int, int, int, str]:
        """What line ``k`` holds of a key, without the quotes, names and commas around it."""
        begin, end = _key_part(self.lines[k])
        return self.numbers[k], self.at[k] + begin, self.at[k] + end, kind


def _key_part(line: str) -> tuple[int, int]:
    """Begin and end of the marker and key letters of a line that belongs to a key block."""
    opened, closed = _OPEN.search(line), None
    for closed in _CLOSE.finditer(line):
        pass
    if opened or closed:
        if opened:
            begin = opened.start()
        else:
            begin = next((m.start() for m in _BLOCK_LETTERS.finditer(line, 0, closed.start())), closed.start())
        if closed and (not opened or closed.start() > begin):
            return begin, len(line.rstrip()) if closed.group() == "Private-MAC:" else closed.end()
        quote = line[begin - 1 : begin]
        end = line.find(quote, begin) if quote in ("'", '"', "`") else -1
        end = len(line) if end < 0 else end
        return begin, begin + len(_LINE_END.sub("", line[begin:end]))
    if _HEADER.fullmatch(line):
        begin = len(line) - len(line.lstrip())
        return begin, max(begin, len(line.rstrip()))
    body = _BLOCK_LETTERS.search(line)
    return body.span() if body else (0, len(line))


def _private_keys(c: _Chunk) -> Iterator[tuple[int, int, int, str]]:
    """Lines of key blocks; also markers and key lines of no known block, for the chunks around."""
    inside: str | None = None
    loose: list[int] = []
    for k, line in enumerate(c.lines):
        opened, closed = _OPEN.search(line), _CLOSE.search(line)
        if opened or closed:
            for m in (opened, closed):
                if m:
                    private = "PRIVATE" in m.group() or "PuTTY" in m.group()
                    yield c.numbers[k], c.at[k], c.at[k], ("open " if m is opened else "close ") + ("private" if private else "other")
            if closed and not opened and inside is None:
                private = "PRIVATE" in closed.group()
                if private:
                    yield from (c.key_part(j) for j in loose)
                loose = []
            if opened and ("PRIVATE" in opened.group() or "PuTTY" in opened.group()) or closed and (inside == "private" or (inside is None and "PRIVATE" in closed.group())):
                yield c.key_part(k)
            inside = None if closed and (not opened or closed.start() > opened.start()) else ("private" if "PRIVATE" in opened.group() or "PuTTY" in opened.group() else "other")
            loose = []
        elif inside is not None:
            if _SHORT.fullmatch(line) or _HEADER.fullmatch(line):
                if inside == "private" and line.strip():
                    yield c.key_part(k)
            else:
                inside = None
        elif _BODY.fullmatch(line) or (_SHORT.fullmatch(line) and (loose or k == 0) and any(map(_CLOSE.search, c.lines[k + 1 : k + 2]))):
            loose.append(k)
        elif line.strip():
            yield from (c.key_part(j, "loose") for j in loose)
            loose = []
    yield from (c.key_part(j, "loose") for j in loose)


def _over_lines(c: _Chunk) -> Iterator[tuple[int, int, int, str]]:
    """A name on one line and its value, or the value's pieces, on the next ones; TOML sections."""

    def hit(k: int, m: re.Match) -> tuple[int, int, int, str]:
        return c.numbers[k], c.at[k] + m.start("v"), c.at[k] + m.end("v"), "value"

    n = len(c.lines)
    for k, line in enumerate(c.lines):
        last = line.rstrip()[-1:]
        if not last or last not in "](\\>|-:=+\"'":
            continue
        if _SECTION.fullmatch(line):
            for j in range(k + 1, n):
                if _ANY_SECTION.fullmatch(c.lines[j]):
                    break
                if (m := _SECTION_VALUE.fullmatch(c.lines[j])) and looks_secret(m["v"]):
                    yield hit(j, m)
            continue
        m = _NAME_OPENS.search(line)
        if not m:
            continue
        pieces = [(k, m)] if m["v"] else []
        j = k + 1
        if line.rstrip().endswith("("):  # another statement may stand in between
            j = next((i for i in range(k + 1, min(n, k + 4)) if _PIECE.fullmatch(c.lines[i])), j)
        while j < n and (p := _PIECE.fullmatch(c.lines[j])):
            pieces.append((j, p))
            j += 1
        if pieces and (len(pieces) > 1 or not m["v"]) and looks_secret("".join(p["v"] for _, p in pieces)):
            yield from (hit(*p) for p in pieces)
        elif not pieces and k + 1 < n and re.search(r"(?:[:=]|>-?|\|-?)[ \t]*$", line):
            indent = len(line) - len(line.lstrip())
            j = k + 1
            while j < n and (p := re.fullmatch(r"([ \t]*)(?P<v>[^\s\"'#:]{5,})[ \t]*", c.lines[j])) and len(p[1]) > indent and looks_secret(p["v"]):
                yield hit(j, p)
                j += 1
    # pieces at the top of a chunk, the name in the chunk before
    j = 0
    tops = []
    while j < n and (p := _PIECE.fullmatch(c.lines[j])):
        tops.append((j, p))
        j += 1
    if tops and j < n and re.fullmatch(r"[ \t]*\)[ \t]*", c.lines[j]) and looks_secret("".join(p["v"] for _, p in tops)):
        yield from (hit(*p) for p in tops)


def _tables(c: _Chunk) -> Iterator[tuple[int, int, int, str]]:
    """Columns of Markdown tables whose head names a credential; a stray line may stand between.

    At the top of a chunk, where the head can be in the chunk before, the last of two cells counts if it looks like a password.
    """
    wanted: set[int] | None = None
    guessing, stray = True, 0
    for k, line in enumerate(c.lines):
        row = _ROW.fullmatch(line)
        if not row:
            stray += 1
            if stray > 2:
                wanted = None
            guessing = guessing and k < 3
            continue
        if _RULER.fullmatch(line):
            continue
        stray = 0
        cells = row[1].split("|")
        named = {i for i, cell in enumerate(cells) if _NAME_CELL.fullmatch(cell.strip())}
        if any(_RULER.fullmatch(x) for x in c.lines[k + 1 : k + (4 if named else 2)]):
            wanted, guessing = named or None, False
            continue
        if wanted is None and not (len(cells) == 2 and (guessing or 0 in named)):
            continue
        at = c.at[k] + row.start(1)
        for i, cell in enumerate(cells):
            value = cell.strip().strip("`")
            if i in (wanted or {1}) and " " not in value and looks_secret(value, strict=wanted is None):
                b = at + cell.index(value)
                yield c.numbers[k], b, b + len(value), "value"
            at += len(cell) + 1


def _objects(line: str, places: list[int]) -> tuple[list[int], dict[int, int]]:
    """For ascending places of a line, where the innermost braces around each open; and for all braces, the next ones around.

    What no braces of the line enclose has the number of braces that were closed before it, as a negative place.
    Braces in double quotes don't count, unless a quote is left open.
    """
    tokens = list(re.finditer(r"""\\.|["{}]""", line))
    quoting = sum(t.group() == '"' for t in tokens) % 2 == 0
    stack, around, out, quoted, i = [-1], {-1: -1}, [], False, 0
    for t in tokens:
        while i < len(places) and places[i] < t.start():
            out.append(stack[-1])
            i += 1
        if t.group() == '"':
            quoted = quoting and not quoted
        elif t.group() == "{" and not quoted:
            around[t.start()] = stack[-1]
            stack.append(t.start())
        elif t.group() == "}" and not quoted:
            last = stack.pop()
            if not stack:
                stack.append(last - 1)
                around[last - 1] = last - 1
    return out + [stack[-1]] * (len(places) - i), around


def _values_of_names(line: str, names: list[re.Match], values: list[re.Match]) -> Iterator[re.Match]:
    """The values of credentials' names: those in the same braces, or the first one after a name without braces."""
    named = [(m.end() - 1, 0, None) for m in _ANY_NAMED.finditer(line)]
    # a name's place is its last character, which is behind a brace that the match begins with
    marks = sorted([*named, *((m.end() - 1, 1, None) for m in names), *((m.start(), 2, m) for m in values)], key=lambda x: x[:2])
    inner, around = _objects(line, [m[0] for m in marks])
    some = {o for (_, kind, _), o in zip(marks, inner) if kind < 2}
    wanted = {o for (_, kind, _), o in zip(marks, inner) if kind == 1}
    owner: dict[int, int] = {}

    def named_around(o: int) -> int:
        seen = []
        while o >= 0 and o not in some and o not in owner:
            seen.append(o)
            o = around[o]
        o = owner.get(o, o)
        owner.update(dict.fromkeys(seen, o))
        return o

    waiting = None
    for (_, kind, m), o in zip(marks, inner):
        if kind == 1 and o < 0:
            waiting = o
        elif kind == 2:
            o = named_around(o)
            if o >= 0 and o in wanted or o < 0 and o == waiting:
                yield m
            if o < 0:
                waiting = None


def _named_values(c: _Chunk) -> Iterator[tuple[int, int, int, str]]:
    """{"name": "API_KEY", "value": "..."}, any number on one line, or on lines near each other."""
    for k, line in enumerate(c.lines):
        if names := list(_NAMED.finditer(line)):
            if values := list(_NAMED_VALUE.finditer(line)):
                for v in _values_of_names(line, names, values):
                    if looks_secret(v["v"]):
                        yield c.numbers[k], c.at[k] + v.start("v"), c.at[k] + v.end("v"), "value"
            elif _NAMED.fullmatch(line.strip()):
                for j in (k + 1, k + 2, k - 1):
                    if 0 <= j < len(c.lines) and (v := _NAMED_VALUE.match(c.lines[j].strip().removeprefix("- "))) and looks_secret(v["v"]):
                        b = c.at[j] + c.lines[j].index(v["v"])
                        yield c.numbers[j], b, b + len(v["v"]), "value"
                        break


_OVER = {"private_key": _private_keys, "over_lines": _over_lines, "table": _tables, "named_value": _named_values}
_STRICT = {"said", "slashed", "quoted_note"}
_CASED = {"jwt", "cloud_id"}


def _by_rule(rule: str, pattern: re.Pattern, c: _Chunk) -> Iterator[tuple[int, int, int, str]]:
    for m in pattern.finditer(c.text if rule in _CASED else c.low):
        begin, end = m.span("v")
        value = c.text[begin:end]
        way = rule if rule != "named" else next(g for g in ("set", "given", "said") if m[g] is not None)
        if way in ("set", "given", "said", "user_option", "slashed"):
            value = _unwrapped(value)
        if way == "set" and ("\n" in c.text[m.start() : begin] or "://" in value):
            continue
        if way == "said" and re.search(r"[\w]\(", value):
            continue
        if rule == "basic":
            good = _decoded_login(value)
        elif rule == "url":
            good = not re.search(r"\$\{|\$\(|^\$[A-Za-z_]+$|^\{|\}$|^%\(|^%s$|\*{3}|^<", value) and not re.fullmatch(r"\d{1,5}|(?i:pass(word)?|secret|pwd)", value)
        elif rule in ("jwt", "prefixed", "cloud_id"):
            good = (rule == "cloud_id" or bool(re.search(r"\d", value))) and not re.search(r"(?i)x{6}|example|\.\.\.", value)
        elif rule in ("bearer", "user_option"):
            good = looks_secret(value)
        elif rule == "login_call":
            good = " " not in value and looks_secret(value)
        else:
            good = looks_secret(value, way in _STRICT)
        if good:
            for part in c.parts(begin, begin + len(value)):
                yield (*part, "value")


def _scan(numbered: bool):
    # on texts in lower case, as matching without regard to case can't use the first letters
    compiled = {k: re.compile(p, re.MULTILINE) for k, p in RULES.items()}
    loose = re.compile(r"(?m)^(?:[0-9]+: )?[ \t]*[A-Za-z0-9+/]{40,}={0,2}[\"']{0,3}\r?$")
    marked = re.compile(r"-----(?:BEGIN|END) |PuTTY|Private-")
    letters = np.zeros(128, dtype=bool)
    letters[[ord(x) for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]] = True
    trees = {k: required(p) for k, p in {**RULES, **CHECKS}.items()}
    wanted = Wanted(list(trees.values()))

    def found(stored: str, rules: set[str]) -> set[tuple[int, int, int, str]]:
        c = _Chunk(stored, numbered)
        out: set[tuple[int, int, int, str]] = set()
        if "private_key" in rules:
            out.update(_private_keys(c))
        for rule in sorted(rules - {"private_key"}):
            out.update(_OVER[rule](c) if rule in _OVER else _by_rule(rule, compiled[rule], c))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths, texts = (c.to_pylist() for c in batch.columns)
            out: list[list] = [[], [], [], [], [], []]
            for at, block in blocks([None if t is None else t.lower() for t in texts]):
                segment = Segment(block, wanted)
                rules: list[set[str]] = [set() for _ in at]
                for rule, tree in trees.items():
                    for t in segment.texts(tree).tolist():
                        rules[t].add(rule)
                for i, some in zip(at.tolist(), rules):
                    if "private_key" in some and not marked.search(texts[i]):
                        some.remove("private_key")
                for t in segment.texts_with_run(letters, 40).tolist():
                    if loose.search(texts[at[t]]):
                        rules[t].add("private_key")
                for i, some in zip(at.tolist(), rules):
                    if some:
                        for line, b, e, kind in sorted(found(texts[i], some)):
                            for column, value in zip(out, (ids[i], paths[i], line, b, e, kind)):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(out, _HIT)], schema=_HIT)

    return run


def credentials(chunks: DataFrame, id: str, text: str, path: Column, numbered: bool = True) -> DataFrame:
    """(id, line_no, begin, end): every part of a line that is a credential or a piece of one, in code points of the stored text.

    ``numbered``: lines carry their number in the file; otherwise they are counted
    from 1. Null and empty texts hold nothing; a null path is a file of its own; repeated rows
    are searched each for itself. Extra columns are ignored. No text is shuffled: of
    all chunks only hits, markers and key lines without a marker leave the scan.
    """
    picked = chunks.select(F.col(id).cast("bigint").alias("id"), F.coalesce(path, F.lit("")).alias("path"), F.col(text).alias("text")).where("text is not null")
    seen = durable(spread(picked).mapInArrow(_scan(numbered), "id bigint, path string, line_no int, begin int, end int, kind string"))
    sure = seen.where("kind = 'value'").select("id", "line_no", "begin", "end")
    loose = seen.where("kind = 'loose'").withColumn("cell", F.explode(F.array(*(F.floor(F.col("line_no") / REACH) + d for d in (-1, 0, 1)))))
    marks = seen.where("kind like 'open%' or kind like 'close%'").select("path", F.col("line_no").alias("mark"), F.col("kind").alias("what")).distinct()
    marks = marks.withColumn("cell", F.floor(F.col("mark") / REACH))
    near = loose.join(marks, ["path", "cell"]).where(F.abs(F.col("mark") - F.col("line_no")) <= REACH)
    line = ["id", "line_no", "begin", "end"]
    before = F.max(F.when(F.col("mark") < F.col("line_no"), F.struct("mark", "what")))
    after = F.min(F.when(F.col("mark") > F.col("line_no"), F.struct("mark", "what")))
    judged = near.groupBy(*line).agg(before.alias("before"), after.alias("after"))
    private = judged.where("before.what = 'open private' or (after.what = 'close private' and coalesce(before.what, '') not like 'open%')").select(*line)
    return sure.unionByName(private).distinct()


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out = []
        for t, some in zip(texts, spans):
            for s in sorted(some or (), key=lambda s: s["begin"]):
                b, e = s["begin"], s["end"]
                t = t[:b] + re.sub(r"[^\s\r]", "*", t[b:e]) + t[e:]
            out.append(t)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array([len(s or ()) for s in spans], pa.int32())], ["id", "text", "hidden"])


def redacted(chunks: DataFrame, id: str, text: str, found: DataFrame) -> DataFrame:
    """(id, text, hidden): every text with each character of the values replaced by ``*``; all else, and the length, stays."""
    spans = found.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    rows = chunks.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).join(spans, "id", "left")
    return rows.select("id", "text", "spans").mapInArrow(_mask, "id bigint, text string, hidden int")
