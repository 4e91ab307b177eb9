"""Corpus reports, nested, from one scan of each corpus.

A scan is one grouping over sets: the whole corpus, each source, each text length, each column and each pair of columns that the report asks for. Its
result, a few rows per distinct value, is written once; all parts of the report are made of it. Distinct sources, lengths and headings meet
one task only as counts of counts, as one of each length, or as the first few by rank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.scratch import scratch
from .dataset import is_cut
from .eda import order_statistics, overlap, percent

NONE = "None"


@dataclass
class Scan:
    """Grouped rows (part, a, b, n, cut, blank, size, first, last_size): `part` names the set, a and b its values."""

    rows: DataFrame

    def part(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("part") == name)


def scan(rows: DataFrame, columns: tuple[str, ...] = (), pairs: tuple[tuple[str, str], ...] = (), order: tuple[str, ...] = (), flags: dict[str, Column] | None = None, source: str = "source", text: str = "text") -> Scan:
    """One pass over rows. Columns may be missing, which counts as null. `order` says which row is first and last; `flags` are counted
    per set as well, each in a column of its name."""
    t = F.coalesce(F.col(text), F.lit("")) if text in rows.columns else F.lit("")
    value = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    asked = list(dict.fromkeys([*columns, *[c for p in pairs for c in p]]))
    keys = {f"k{i}": value(c) for i, c in enumerate(asked)}
    at = {c: f"k{i}" for i, c in enumerate(asked)}
    base = rows.select(
        value(source).alias("source"), F.length(t).alias("length"), is_cut(t).cast("int").alias("cut"), (strip(t) == "").cast("int").alias("blank"), F.struct(*[F.col(c) for c in order], F.lit(0)).alias("at"),
        *[c.alias(k) for k, c in keys.items()], *[F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in (flags or {}).items()],
    )
    sets = {"all": [], "source": ["source"], "length": ["length"], **{f"column {c}": [at[c]] for c in columns}, **{f"pair {a} {b}": [at[a], at[b]] for a, b in pairs}}
    names = ["source", "length", *keys]
    flags_sum = [F.sum(k).alias(k) for k in flags or {}]
    sums = base.groupingSets([[F.col(c) for c in s] for s in sets.values()], *[F.col(c) for c in names]).agg(
        F.grouping_id(*names).alias("set"), F.count(F.lit(1)).alias("n"), F.sum("cut").alias("cut"), F.sum("blank").alias("blank"), F.sum("length").alias("size"), F.min("at").alias("first"),
        F.max_by(F.col("length") + 0, "at").alias("last_size"), *flags_sum,
    )
    number = lambda s: sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in s)
    part = F.coalesce(*[F.when(F.col("set") == number(s), F.lit(k)) for k, s in sets.items()])
    value_of = lambda i: F.coalesce(*[F.when(F.col("set") == number(s), F.col(s[i]).cast("string")) for s in sets.values() if len(s) > i])
    found = sums.select(part.alias("part"), value_of(0).alias("a"), value_of(1).alias("b") if pairs else F.lit(None).cast("string").alias("b"), "n", "cut", "blank", "size", "first", "last_size", *(flags or {}))
    path = scratch(rows.sparkSession, "report")
    found.write.parquet(path)
    return Scan(rows.sparkSession.read.schema(found.schema).parquet(path))


def _one(df: DataFrame, name: str) -> DataFrame:
    """A one-row table as one struct."""
    return df.select(F.struct(*df.columns).alias(name))


def joined(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with a struct of each of some one-row tables."""
    out = None
    for name, df in parts.items():
        one = _one(df, name)
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def lengths(s: Scan) -> DataFrame:
    per = s.part("length").select(F.col("a").cast("long").alias("len"), "n")
    at = {f"p{q}": f"cast(floor({q / 100} * (total - 1)) as bigint)" for q in (50, 90, 95)}
    plain = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 1).alias("mean"), F.min("len").alias("min"), F.max("len").alias("max"))
    return plain.crossJoin(order_statistics(per, "len", "n", at)).select("rows", "mean", "min", "p50", "p90", "p95", "max")  # one row each


def _middle(counts: DataFrame) -> DataFrame:
    """min, p50 (at n // 2) and max of a multiset (k, n)."""
    ends = counts.agg(F.coalesce(F.min("k"), F.lit(0)).alias("min"), F.coalesce(F.max("k"), F.lit(0)).alias("max"))
    return ends.crossJoin(order_statistics(counts, "k", "n", {"p50": "cast(floor(total / 2) as bigint)"})).select("min", F.coalesce("p50", F.lit(0)).alias("p50"), "max")


def summary(s: Scan) -> DataFrame:
    """One row: rows, unique_sources, rows_per_source, text, truncated_at_limit, truncated_pct, empty_text."""
    whole = s.part("all").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("cut"), F.lit(0)).alias("truncated_at_limit"), F.coalesce(F.sum("blank"), F.lit(0)).alias("empty_text"))
    sources = s.part("source").agg(F.count(F.lit(1)).alias("unique_sources"))
    per = _one(_middle(s.part("source").groupBy(F.col("n").alias("k")).agg(F.count(F.lit(1)).alias("n"))), "rows_per_source")
    rows = whole.crossJoin(sources).crossJoin(per).crossJoin(_one(lengths(s), "text"))  # one row each
    return rows.select("rows", "unique_sources", "rows_per_source", "text", "truncated_at_limit", percent(F.col("truncated_at_limit"), F.col("rows")).alias("truncated_pct"), "empty_text")


def _listed(df: DataFrame, order: list[Column], *fields: Column) -> DataFrame:
    """One row with an ordered array of structs, of as many as the report shows."""
    listed = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*fields).alias("x"))))
    return df.agg(F.transform(listed, lambda r: r["x"]).alias("x"))


def _name(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(NONE))


def distribution(s: Scan, column: str, limit: int | None = None) -> DataFrame:
    """One row: values with counts, most frequent first, ties by first appearance."""
    rows = s.part(f"column {column}")
    if limit:
        rows = rows.orderBy(F.desc("n"), "first").limit(limit)
    return _listed(rows, [-F.col("n"), F.col("first")], _name("a").alias("value"), F.col("n").alias("n"))


def truncation(s: Scan, column: str) -> DataFrame:
    """One row: values with rows and cut ones, most cut ones first, ties by first appearance."""
    return _listed(s.part(f"column {column}"), [-F.col("cut"), F.col("first")], _name("a").alias("value"), F.col("n").alias("n"), F.col("cut").alias("truncated"), percent(F.col("cut"), F.col("n")).alias("truncated_pct"))


def cross(s: Scan, a: str, b: str) -> DataFrame:
    """One row: values of one column, each with those of the other and counts, in order of first appearance."""
    rows = s.part(f"pair {a} {b}").select(_name("a").alias("a"), _name("b").alias("b"), "n", "first")
    inner = F.array_sort(F.collect_list(F.struct("first", F.struct(F.col("b").alias("value"), "n").alias("x"))))
    per = rows.groupBy("a").agg(F.min("first").alias("first"), F.transform(inner, lambda r: r["x"]).alias("values"))
    return _listed(per, [F.col("first")], F.col("a").alias("value"), F.col("values").alias("values"))


def _with(base: DataFrame, **parts: DataFrame) -> DataFrame:
    """A one-row table plus the only column of others."""
    for name, df in parts.items():
        base = base.crossJoin(df.select(F.col(df.columns[0]).alias(name)))  # one row each
    return base


def report(leases: DataFrame, redflags: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One row of structs leases, redflags and cross_corpus, of rows with source and text, leases with type_fast_lane and heading, red flags
    with type and redflag_type."""
    left = scan(leases, ("type_fast_lane", "heading"), order=order)
    right = scan(redflags, ("type", "redflag_type"), (("type", "redflag_type"),), order=order)
    shared = overlap(left.part("source"), right.part("source"), "a")
    sides = shared.select(F.struct(F.col("left_only").alias("leases_only"), F.col("right_only").alias("redflags_only"), "shared").alias("source_overlap"))
    return joined({
        "leases": _with(summary(left), type_fast_lane=distribution(left, "type_fast_lane"), truncation_by_type_fast_lane=truncation(left, "type_fast_lane"), top_headings=distribution(left, "heading", 25)),
        "redflags": _with(summary(right), type=distribution(right, "type"), redflag_type=distribution(right, "redflag_type"), truncation_by_type=truncation(right, "type"), type_x_redflag_type=cross(right, "type", "redflag_type")),
        "cross_corpus": sides,
    })


def full_report(docs: DataFrame, redflags: DataFrame, easy_redflags: DataFrame, entities: DataFrame, clauses: DataFrame, order: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row of a struct per corpus. `order` has the columns that say which row of a corpus comes first; of a source's documents the last
    one counts for lengths."""
    d = scan(docs, ("document_class",), order=order["docs"])
    sizes = d.part("source").groupBy(F.col("last_size").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    positive = F.coalesce(F.col("type"), F.lit(NONE)) != "none"
    r = scan(redflags, ("type",), order=order["redflags"], flags={"positive": positive})
    e = scan(easy_redflags, ("type",), order=order["easy_redflags"])
    n = scan(entities, ("class_id",), order=order["entities"], text="")
    c = scan(clauses, ("clause_type",), order=order["clauses"], flags={"begins": F.col("clause_begin")})
    whole = lambda s, *more: s.part("all").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *more)
    count = lambda s, part, when=F.lit(True), name="docs": s.part(part).agg(F.count_if(when).alias(name))
    flags = lambda name, out: F.coalesce(F.sum(name), F.lit(0)).alias(out)
    red = _with(whole(r), docs=count(r, "source"), positive=whole(r, flags("positive", "x")).select("x"), positive_types=count(r, "column type", F.col("positive") > 0), docs_with_positive=count(r, "source", F.col("positive") > 0), type=distribution(r, "type"))
    return joined({
        "docs": _with(summary(d), document_class=distribution(d, "document_class"), len_chars=_one(_middle(sizes), "x")),
        "redflags": red.select("rows", "docs", "positive", (F.col("rows") - F.col("positive")).alias("negative_none"), "positive_types", "docs_with_positive", "type"),
        "easy_redflags": _with(whole(e), docs=count(e, "source"), types=count(e, "column type"), type=distribution(e, "type")),
        "entities": _with(whole(n), docs=count(n, "source"), class_id=distribution(n, "class_id")),
        "clauses": _with(whole(c), docs=count(c, "source"), clause_begin_true=whole(c, flags("begins", "x")).select("x"), clause_type=distribution(c, "clause_type")),
    })
