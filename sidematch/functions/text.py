"""Text helpers, Column -> Column."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# The characters that count as white space.  Written so that Java
# and RE2 read them alike.
SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{SPACE_CHARS}]"
NON_SPACE = f"[^{SPACE_CHARS}]"
# The same characters, one by one.
SPACES = "".join(map(chr, [
    *range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f,
    0x205f, 0x3000,
]))

WORD = r"[\p{L}\p{N}_]"

# Words that carry no meaning in a title.
TITLE_STOP_WORDS = [
    "the", "and", "for", "with", "from", "into", "over", "under",
    "between", "that", "this", "these", "those", "have", "has",
    "had", "are", "was", "were", "a", "an", "of", "in", "on",
    "to", "by", "at", "as", "or", "if", "is",
]


def strip(c: Column) -> Column:
    """Drop white space at both ends (``trim`` would only drop spaces)."""
    return F.btrim(c, F.lit(SPACES))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used: inside
    lambda functions Spark does not share equal expressions."""
    return F.transform(F.array(value), use)[0]


def is_blank(c: Column) -> Column:
    return ~c.rlike(NON_SPACE)


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def normalize_title(c: Column) -> Column:
    """Lower case, ends stripped, inner white space collapsed to one space."""
    return F.lower(F.regexp_replace(strip(c), f"{SPACE}+", " "))


def title_tokens(c: Column) -> Column:
    """Distinct words of two or more characters, stop words removed.

    A title of stop words only keeps them; a title without any such word stands
    for itself.  ``c`` is a normalised title.
    """
    words = F.regexp_extract_all(c, F.lit(f"({WORD}{{2,}})"), F.lit(1))
    useful = F.array_except(words, F.array(*[F.lit(w) for w in TITLE_STOP_WORDS]))
    return (
        F.when(F.size(words) == 0, F.array(c))
        .when(F.size(useful) == 0, F.array_distinct(words))
        .otherwise(useful)
    )


def edit_ratio(a: Column, b: Column, limit: int | None = None) -> Column:
    """1 - edit distance / longer length, of whole texts or of their first ``limit``
    characters."""
    if limit is not None:
        a, b = F.substring(a, 1, limit), F.substring(b, 1, limit)
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)
    )


def distance(a: str, b: str, most: int | None = None) -> int | None:
    """Edit distance, a column of the table at a time: the steps up and down a column are
    the bits of two numbers (Myers, Hyyro).  None as soon as it is sure to exceed ``most``."""
    if most is None:
        most = len(a) + len(b)
    if not a or not b:
        return len(a) + len(b) if len(a) + len(b) <= most else None
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last, far = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    # every letter left can take one step off at most
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        same = places.get(c, 0)
        level = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(level | up)), up & level
        if more & last:
            far += 1
        elif less & last:
            far -= 1
        if far - left > most:
            return None
        more, less = (more << 1) | 1, less << 1
        up, down = (less | (full & ~(same | down | more))) & full, more & (same | down) & full
    return far


@F.arrow_udf(IntegerType())
def long_distance(a: pa.Array, b: pa.Array, most: pa.Array) -> pa.Array:
    """Edit distance of long texts; NULL with a NULL, or beyond ``most``."""
    rows = zip(a.to_pylist(), b.to_pylist(), most.to_pylist())
    return pa.array([None if x is None or y is None else distance(x, y, n) for x, y, n in rows], pa.int32())


def java_regex(pattern: str) -> str:
    """A Python pattern in Java's dialect: named groups, end anchor, ``\\n`` as
    the only line end, classes and case of all of Unicode."""
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    out = out.replace(r"\Z", r"\z")
    return f"(?dUu){out}"


def search(c: Column, pattern: str) -> Column:
    return c.rlike(java_regex(pattern))


def match_start(c: Column, pattern: str) -> Column:
    """True when the pattern matches at the start of the text."""
    return c.rlike(f"^(?:{java_regex(pattern)})")


def matched_value(c: Column, pattern: str) -> Column:
    """What the pattern captured: group 1 when any group took part (NULL if that was
    only a later one), else the whole match; NULL without a match."""
    java = java_regex(pattern)
    whole = F.regexp_substr(c, F.lit(java))
    n_groups = re.compile(pattern).groups
    if not n_groups:
        return whole
    # the patterns that tell the groups are dear, and most lines match nothing
    return (
        F.when(~c.rlike(java), F.lit(None).cast("string"))
        .when(c.rlike(took_part(java, [1])), F.regexp_extract(c, java, 1))
        .when(c.rlike(took_part(java, range(1, n_groups + 1))), F.lit(None).cast("string"))
        .otherwise(whole)
    )


# An escape, a class, or the opening of a capturing group.
PIECES = re.compile(r"\\(\d+)|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?!\?)|\(\?<(?![=!])\w+>", re.S)


def took_part(java: str, groups: Iterable[int]) -> str:
    """A pattern that is found where one of ``groups`` takes part in the first match of
    ``java``.

    Every group gets an empty group inside.  A reference to an empty group holds
    anywhere once it took part, and nowhere if it did not.
    """
    def marked(m: re.Match) -> str:
        if m[1] and m[1][0] != "0":
            return rf"(?:\{2 * int(m[1]) - 1})"
        return m[0] + "()" if m[0].startswith("(") else m[0]

    refs = "|".join(rf"\{2 * i}" for i in groups)
    return rf"\A(?>[\s\S]*?(?:{PIECES.sub(marked, java)}))(?:{refs})"
