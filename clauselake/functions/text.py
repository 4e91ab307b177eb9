"""Text scalars as Columns. Patterns carry (?i) or (?is) first, if any, and run with Unicode classes and LF line ends."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four separators that also count.
SPACE = r"[\s\x1c-\x1f]"


def java(pattern: str) -> str:
    m = re.match(r"\(\?([is]+)\)", pattern)
    return f"(?{m[1] if m else ''}dU)" + pattern[m.end() if m else 0 :]


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(java(pattern))


def count(c: Column, pattern: str) -> Column:
    """Non-overlapping matches."""
    return F.regexp_count(c, F.lit(java(pattern)))


def total(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cs) if cs else F.lit(0)


def every(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs) if cs else F.lit(True)


def some(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs) if cs else F.lit(False)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def first_filled(*cs: Column) -> Column:
    """The first column that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def groups(pattern: str) -> int:
    return re.compile(re.sub(r"^\(\?[is]+\)", "", pattern)).groups


def captured(c: Column, pattern: str) -> Column:
    """The first group that took part in the first match; '' if the pattern has no group; null without a match."""
    n = groups(pattern)
    got = F.coalesce(*[F.nullif(F.regexp_extract(c, java(pattern), i), F.lit("")) for i in range(1, n + 1)]) if n else F.lit("")
    return F.when(matches(c, pattern), got)


def content_hash(c: Column) -> Column:
    """SHA-256 of the collapsed text; case counts."""
    return F.sha2(collapse(c), 256)


def phrase_count(c: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal phrase, ignoring case."""
    low = F.lower(c)
    return ((F.length(low) - F.length(F.replace(low, F.lit(phrase.lower()), F.lit("")))) / len(phrase)).cast("int")


def template(text: str, values: dict[str, Column]) -> Column:
    """A text with {slots}: known ones take their column or '', unknown ones ''."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[F.lit(x) if i % 2 == 0 else F.coalesce(values.get(x, F.lit("")), F.lit("")) for i, x in enumerate(parts)])
