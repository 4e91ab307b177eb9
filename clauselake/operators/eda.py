"""Corpus profiles. Quantiles are order statistics at fixed positions, found from length counts rather than sorted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .dataset import is_cut


def order_statistics(counts: DataFrame, value: str, n: str, at: dict[str, str]) -> DataFrame:
    """One row: the values at 0-based positions (SQL over `total`) of a multiset given as (value, n). The distinct values pass
    one window; for text lengths and group sizes they are few."""
    total = F.sum(n).over(Window.partitionBy(F.lit(1)))
    upto = F.sum(n).over(Window.partitionBy(F.lit(1)).orderBy(value))
    rows = counts.withColumn("total", total).withColumn("upto", upto)
    return rows.agg(*[F.min(F.when(F.col("upto") > F.expr(p), F.col(value))).alias(name) for name, p in at.items()])


def text_stats(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows, mean (one decimal), min, p50, p90, p95 (at int(q * (n - 1))) and max of the lengths in characters."""
    lengths = rows.select(F.length(F.coalesce(F.col(text), F.lit(""))).alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    plain = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 1).alias("mean"), F.min("len").alias("min"), F.max("len").alias("max"))
    at = {f"p{q}": f"cast(floor({q / 100} * (total - 1)) as bigint)" for q in (50, 90, 95)}
    return plain.crossJoin(order_statistics(lengths, "len", "n", at)).select("rows", "mean", "min", "p50", "p90", "p95", "max")


def percent(part, whole):
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, 1))


def summarize(rows: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """One row: row and source counts (a null source counts), rows per source (min, the middle one, max), text statistics,
    cut and blank texts."""
    per = rows.groupBy(source).agg(F.count(F.lit(1)).alias("k"))
    sources = per.agg(F.count(F.lit(1)).alias("unique_sources"), F.min("k").alias("per_source_min"), F.max("k").alias("per_source_max"))
    middle = order_statistics(per.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "n", {"per_source_p50": "cast(floor(total / 2) as bigint)"})
    t = F.coalesce(F.col(text), F.lit(""))
    cut = rows.agg(F.count_if(is_cut(t)).alias("truncated"), F.count_if(strip(t) == "").alias("empty_text"))
    out = text_stats(rows, text).crossJoin(sources).crossJoin(middle).crossJoin(cut)
    return out.withColumn("truncated_pct", percent(F.col("truncated"), F.col("rows")))


def distribution(rows: DataFrame, column: str, order: list[str], limit: int | None = None) -> DataFrame:
    """(value, n, rank): most frequent first, ties by first appearance; null is a value."""
    out = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    top = out.orderBy(F.desc("n"), "first")
    return (top.limit(limit) if limit else top).select("value", "n")


def cut_by(rows: DataFrame, column: str, text: str = "text") -> DataFrame:
    cut = is_cut(F.coalesce(F.col(text), F.lit("")))
    out = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if(cut).alias("truncated"))
    return out.withColumn("truncated_pct", percent(F.col("truncated"), F.col("n")))


def overlap(left: DataFrame, right: DataFrame, column: str = "source") -> DataFrame:
    """One row: distinct values on the left only, on the right only, on both (null is a value)."""
    both = left.select(F.col(column).alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(column).alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = both.groupBy("v").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(F.count_if(F.col("l") > F.col("r")).alias("left_only"), F.count_if(F.col("r") > F.col("l")).alias("right_only"), F.count_if(F.col("r") == F.col("l")).alias("shared"))


def cross_tab(rows: DataFrame, a: str, b: str) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return rows.groupBy(name(a).alias("a"), name(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def deontic_report(rows: DataFrame) -> DataFrame:
    """One row: rows with several labels and the number of spans."""
    from .dataset import span_count

    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("deontic_types") > 1).alias("multi_label_rows"), F.sum(F.coalesce(span_count(F.col("spans")), F.lit(0))).alias("spans"))


def label_counts(rows: DataFrame, labels: str = "deontic_types") -> DataFrame:
    return rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def redflag_report(rows: DataFrame, source: str = "source", kind: str = "type") -> DataFrame:
    """One row of the red-flag part of the full report."""
    pos = F.col(kind) != "none"
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(source).alias("docs"),
        F.count_if(pos).alias("positive"),
        F.count_if(~pos).alias("negative_none"),
        F.count_distinct(F.when(pos, F.col(kind))).alias("positive_types"),
        F.count_distinct(F.when(pos, F.col(source))).alias("docs_with_positive"),
    )


def page_methods(pages: DataFrame) -> DataFrame:
    """(source, n_pages, methods, error_pages): page counts, distinct methods in order, and pages that failed."""
    return pages.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("method") == "error", F.col("page_idx")))).cast("array<string>"), ",").alias("error_pages"),
    )


def full_text(pages: DataFrame) -> DataFrame:
    """(source, n_pages, full_text): pages in order, joined by blank lines."""
    parts = F.array_sort(F.collect_list(F.struct("page_idx", "text")))
    return pages.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("full_text"))


def trigger_recall(sentences: DataFrame, kind: str = "type", top: int = 4) -> DataFrame:
    """(type, n, caught, top_rules) of sentences with an array of rule ids: those with a finding, and the rules that fire most. Sentences are read once:
    each counts as itself and once per rule, and only counts meet."""
    itself = F.array(F.struct(F.lit(None).cast("string").alias("rule_id"), (F.size("rule_ids") > 0).cast("long").alias("hit")))
    each = F.transform("rule_ids", lambda r: F.struct(r.alias("rule_id"), F.lit(1).cast("bigint").alias("hit")))
    counts = sentences.select(F.col(kind).alias("type"), F.inline_outer(F.concat(itself, each))).groupBy("type", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("c"))
    own = F.when(F.col("rule_id").isNull(), F.struct("n", "c"))
    rules = F.array_sort(F.collect_list(F.when(F.col("rule_id").isNotNull(), F.struct((-F.col("c")).alias("o"), "rule_id"))))  # as many as there are rules
    names = F.transform(F.slice("r", 1, top), lambda x: x["rule_id"])
    return counts.groupBy("type").agg(F.first(own, ignorenulls=True).alias("x"), rules.alias("r")).select("type", "x.n", F.col("x.c").alias("caught"), F.array_join(names, ",").alias("top_rules"))
