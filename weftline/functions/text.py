"""Text expressions, all built-in and inside whole-stage code generation where Spark has it.

Fixed values: the white space of Unicode beyond what regular expressions call ``\\s``, and a token,
which is a word of letters, digits and underscores or a single other sign.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s{BLANKS}]"
BLANK_SIGNS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CUT = "... [cut]"


def tokens(text: Column) -> Column:
    """The tokens of a text in lower case, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def unix_lines(text: Column) -> Column:
    """``\\r\\n`` and ``\\r`` as ``\\n``, as a file opened in text mode reads them."""
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    """The lines of a text, split at ``\\n`` only; one empty line for an empty text."""
    return F.split(text, "\n", -1)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(BLANK_SIGNS))


def rstrip(text: Column) -> Column:
    """Without white space of any kind at the end."""
    return F.rtrim(text, F.lit(BLANK_SIGNS))


def is_blank(text: Column) -> Column:
    """Null, empty, or only white space."""
    return F.coalesce(~F.rlike(text, F.lit(rf"[^\s{BLANKS}]")), F.lit(True))


def cut_to(text: Column, limit: int, marker: str = CUT) -> Column:
    """The first ``limit`` characters, with a marker on a line of its own where more was there."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n" + marker))).otherwise(text)


def whole_lines(text: Column, limit: int, marker: str = CUT) -> Column:
    """The first lines that fit into ``limit`` characters, line ends counted, and a marker where lines are left out.

    A text within the limit stays; where not even the first line fits, the first ``limit`` characters come without a marker.
    """
    parts = lines(text)
    kept = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda a, x: F.struct(
            (a["size"] + F.length(x) + 1).alias("size"),
            (a["n"] + F.when(a["open"] & (a["size"] + F.length(x) + 1 <= limit), 1).otherwise(0)).alias("n"),
            (a["open"] & (a["size"] + F.length(x) + 1 <= limit)).alias("open"),
        ),
        lambda a: a["n"],
    )
    fits = F.concat(F.array_join(F.slice(parts, 1, F.greatest(kept, F.lit(1))), "\n"), F.lit("\n" + marker))
    return F.when(F.length(text) <= limit, text).when(kept == 0, F.substring(text, 1, limit)).otherwise(fits)


def extension(path: Column) -> Column:
    """The ending of a file name from its last point, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\]+(\.[^./\\]*)$", 1))


def short_id(text: Column) -> Column:
    """The first twelve digits of the MD5 hash."""
    return F.substring(F.md5(text.cast("binary")), 1, 12)


def clock() -> Column:
    """The time of the query, to the second."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
