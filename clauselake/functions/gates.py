"""Literal gates: what a text must contain, in lower case, for a pattern to match at all.

A pattern's gate is a conjunction of alternatives, each a set of literals of which one must occur; it is read off the pattern's parse tree, once. A
row's text is folded and searched for each literal once, the results are bits of a few numbers, and a pattern runs only where its gate's bits
allow it. A gate is never false where its pattern matches: `fold` maps all letters that ignore-case matching takes for ASCII ones.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A literal has this many characters at least; a gate has so many alternatives at most.
LEAST, MOST = 3, 3
#: Not ASCII, but equal to s, i, i and k where case is ignored.
_ODD, _PLAIN = "ſıİK", "siik"
BITS = 63
Gate = tuple[frozenset[str], ...]


def fold(text: Column) -> Column:
    """Lower case, with letters that match ASCII ones as those."""
    odd = F.contains(text, F.lit(_ODD[0]))
    for c in _ODD[1:]:
        odd = odd | F.contains(text, F.lit(c))
    return F.lower(F.when(odd, F.translate(text, _ODD, _PLAIN)).otherwise(text))


def _best(clauses: list[frozenset[str]]) -> frozenset[str]:
    """The alternative that is the least likely by chance: the longest shortest literal, then the fewest."""
    return max(clauses, key=lambda c: (min(map(len, c)), -len(c)))


def _clauses(items) -> list[frozenset[str]]:
    out: list[frozenset[str]] = []
    run = ""

    def ended() -> None:
        nonlocal run
        if len(run) >= LEAST:
            out.append(frozenset([run]))
        run = ""

    for op, arg in items:
        if op is K.LITERAL and (chr(arg).isascii() or chr(arg).lower() == chr(arg).upper()):
            run += chr(arg).lower()
            continue
        if op is K.AT:
            continue  # a boundary has no width
        if op is K.SUBPATTERN and all(x[0] is K.LITERAL for x in arg[3]):
            run += "".join(chr(x[1]).lower() for x in arg[3])
            continue
        ended()
        if op is K.SUBPATTERN:
            out += _clauses(arg[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] >= 1:
            out += _clauses(arg[2])
        elif op is K.BRANCH:
            each = [_clauses(x) for x in arg[1]]
            if all(each):
                out.append(frozenset().union(*map(_best, each)))
    ended()
    return out


@lru_cache(maxsize=None)
def gate(pattern: str) -> Gate:
    """The strongest alternatives of a pattern; none if it has no literal that every match holds."""
    flags = re.match(r"\(\?([is]+)\)", pattern)
    found = _clauses(_parser.parse(pattern[flags.end() :] if flags else pattern))
    unique = sorted(set(found), key=lambda c: (-min(map(len, c)), len(c), sorted(c)))
    return tuple(unique[:MOST])


def allows(text: str, pattern: str) -> bool:
    """The gate's test of one text, as Columns make it."""
    low = text.translate(str.maketrans(_ODD, _PLAIN)).lower()
    return all(any(x in low for x in c) for c in gate(pattern))


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Gates:
    """The literals of a set of patterns, numbered."""

    def __init__(self, patterns):
        self.at = {x: i for i, x in enumerate(sorted({x for p in patterns for c in gate(p) for x in c}))}

    def columns(self, name: str = "__hits") -> list[str]:
        return [f"{name}{k}" for k in range(-(-len(self.at) // BITS))]

    def hits(self, folded: str, k: int) -> Column:
        """A bigint of which of the k-th BITS literals occur in a column. (As one SQL text: hundreds of Columns take longer to make than to run.)"""
        each = [f"if(contains({folded}, {_quoted(x)}), {1 << i}L, 0L)" for i, x in enumerate(list(self.at)[k * BITS : (k + 1) * BITS])]
        return F.expr(" | ".join(each))

    def may(self, pattern: str, name: str = "__hits") -> Column:
        """Whether a pattern can match the text of a row that add() has seen."""
        clauses = []
        for c in gate(pattern):
            masks: dict[int, int] = {}
            for x in c:
                k, i = divmod(self.at[x], BITS)
                masks[k] = masks.get(k, 0) | 1 << i
            clauses.append("(" + " or ".join(f"({name}{k} & {m}L) <> 0" for k, m in masks.items()) + ")")
        return F.expr(" and ".join(clauses) or "true")

    def add(self, rows: DataFrame, text: Column, name: str = "__hits") -> DataFrame:
        """rows plus the hits of a text, which is folded once. They come out of a generator of one row, past which the optimizer copies no
        expression: a filter on what is made of hits would else take the making of hits along, once for each use."""
        found = rows.withColumn("__low", fold(text))
        return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.inline(F.array(F.struct(*[self.hits("__low", k).alias(c) for k, c in enumerate(self.columns(name))]))))
