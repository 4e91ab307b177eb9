"""Content-hash index: document hashes, deduplicated units, statistics, exact lookup, first-row deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, content_hash, first_filled


def document_hashes(sections: DataFrame) -> DataFrame:
    """(source, sha256): hash of a document's section texts joined by blank lines, in order, blanks included."""
    text = first_filled(F.col("raw_text"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("section_idx", text.alias("t"))))
    return sections.groupBy("source").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n"), 256).alias("sha256"))


def unique_units(units: DataFrame, order: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """(id, text, n_occurrences, sources): non-blank units grouped by content hash; text and sources in first-seen order.

    Sources are reduced to one row each before they are gathered, so a list holds a unit's distinct sources only.
    """
    at = F.struct(*order)
    rows = units.withColumn("id", content_hash(F.col(text))).filter(collapse(F.col(text)) != "")
    per = rows.groupBy("id", source).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(at.alias("at"), F.col(text).alias("t"))).alias("first"))
    seen = F.array_sort(F.collect_list(F.struct(F.col("first.at").alias("at"), F.col(source).alias("s"))))
    return per.groupBy("id").agg(F.min("first")["t"].alias("text"), F.sum("n").alias("n_occurrences"), F.transform(seen, lambda x: x["s"]).alias("sources"))


def statistics(manifests: DataFrame, sections: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row: totals come from the manifests, unique counts from the units, duplicates are their difference."""
    total = manifests.agg(F.count(F.lit(1)).alias("n_documents"), F.sum("chars").alias("total_chars"), F.sum("n_sections").alias("total_sections"), F.sum("n_sentences").alias("total_sentences"))
    parts = total.crossJoin(sections.agg(F.count(F.lit(1)).alias("unique_sections"))).crossJoin(sentences.agg(F.count(F.lit(1)).alias("unique_sentences")))
    return parts.withColumn("duplicate_sections", F.col("total_sections") - F.col("unique_sections")).withColumn("duplicate_sentences", F.col("total_sentences") - F.col("unique_sentences"))


def lookup(sections: DataFrame, sentences: DataFrame, text: str) -> DataFrame:
    """Units, of either kind, whose text equals the given one up to white space."""
    both = sections.withColumn("kind", F.lit("section")).unionByName(sentences.withColumn("kind", F.lit("sentence")))
    return both.filter(F.col("id") == content_hash(F.lit(text)))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; nulls equal each other."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def repeated_sources(rows: DataFrame, source: str = "source") -> DataFrame:
    """Sources that are null or occur more than once, with their counts."""
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(source).isNull())
