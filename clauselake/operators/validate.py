"""Validators of made-up training rows: constraints are data, evaluated in one pass, with one row for each violation.

A constraint is a name and a SQL predicate that holds for a bad row. Duplicate sources are found from counts per source, summed in two phases. A
vocabulary comes from a real corpus: rows of types that it does not have are told of and dropped, the others are kept.

Nulls: a predicate that is null is no violation; a null source is one of its own kind ('missing source') and never a duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DEONTIC_LABELS

Constraints = tuple[tuple[str, str], ...]
NO_SOURCE = ("missing source", "source IS NULL")
NO_TEXT = ("missing raw_text", "known AND (raw_text IS NULL OR raw_text = '')")
OUTSIDE = ("type outside vocabulary", "NOT known")
DUPLICATE = "duplicate source"
REDFLAG: Constraints = (NO_SOURCE, OUTSIDE, NO_TEXT)
SPAN: Constraints = (*REDFLAG, ("missing part", "known AND part IS NULL"))
#: Over label_size, ones, odd (values that are not 0 or 1), active (the type at the first 1) and types (deontic_types, comma-joined).
MULTILABEL: Constraints = (
    NO_SOURCE,
    ("bad label dim", f"label_size IS NULL OR label_size <> {len(DEONTIC_LABELS)}"),
    ("non-binary label", f"label_size = {len(DEONTIC_LABELS)} AND (odd > 0 OR ones = 0)"),
    ("expected exactly one label", f"label_size = {len(DEONTIC_LABELS)} AND ones > 1"),
    ("bad party", "party IS NULL OR party NOT IN ('tenant', 'landlord')"),
    ("'none' label with types", f"label_size = {len(DEONTIC_LABELS)} AND ones = 1 AND active = 'none' AND types NOT IN ('', 'none')"),
    ("types disagree", f"label_size = {len(DEONTIC_LABELS)} AND ones = 1 AND active <> 'none' AND types <> active"),
)


def violations(rows: DataFrame, constraints: Constraints, key: list[str]) -> DataFrame:
    """(key, error): one row per violated constraint, from one pass."""
    errors = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(name)) for name, p in constraints]))
    return rows.select(*key, F.explode_outer(errors).alias("error")).filter("error is not null")


def duplicate_sources(rows: DataFrame, source: str = "source") -> DataFrame:
    """(source, n) of sources that occur more than once."""
    return rows.filter(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def marked(rows: DataFrame, corpus: DataFrame, kind: str = "type") -> DataFrame:
    """rows plus `known`: whether the corpus has the row's type."""
    vocabulary = corpus.filter(F.col(kind).isNotNull()).select(F.col(kind).alias("__kind")).distinct().withColumn("__known", F.lit(True))
    out = rows.join(vocabulary, F.col(kind) == F.col("__kind"), "left")
    return out.withColumn("known", F.coalesce("__known", F.lit(False))).drop("__kind", "__known")


def described(rows: DataFrame) -> DataFrame:
    """Multi-label rows (label, party, deontic_types) plus what MULTILABEL is about."""
    names = F.array(*[F.lit(x) for x in DEONTIC_LABELS])
    count = lambda f: F.size(F.filter(F.coalesce("label", F.array().cast("array<int>")), f))
    at = F.array_position("label", 1).cast("int")
    return rows.withColumns({
        "label_size": F.when(F.col("label").isNotNull(), F.size("label")), "ones": count(lambda x: x == 1), "odd": count(lambda x: x.isNull() | ~x.isin(0, 1)),
        "active": F.when(at > 0, F.try_element_at(names, at)), "types": F.array_join(F.coalesce("deontic_types", F.array().cast("array<string>")), ","),
    })


def _with_duplicates(found: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    twice = duplicate_sources(rows)
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in key if c != "source"]
    return found.unionByName(twice.select("source", *none, F.lit(DUPLICATE).alias("error")))


def redflags(rows: DataFrame, corpus: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, violations) of rows (source, type, raw_text)."""
    known = marked(rows, corpus)
    return known.filter("known").drop("known"), _with_duplicates(violations(known, REDFLAG, key), rows, key)


def spans(rows: DataFrame, corpus: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, violations) of rows (source, part, type, raw_text)."""
    known = marked(rows, corpus)
    return known.filter("known").drop("known"), _with_duplicates(violations(known, SPAN, key), rows, key)


def multilabel(rows: DataFrame, key: list[str]) -> DataFrame:
    """Violations of rows (source, label, party, deontic_types)."""
    return _with_duplicates(violations(described(rows), MULTILABEL, key), rows, key)
