"""Corpus ingest, cleaning and validation as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CUT_AT, DEONTIC_LABELS, PARTY_ALIASES
from ..functions.text import collapse, first_filled, strip
from .index import keep_first

# Corrections of two misspelt labels.
LABEL_FIXES = {"compalsory_reconstraction": "compulsory_reconstruction", "warrantees_of_the_owner": "warranties_of_the_owner"}


def fixed_type(c: Column, fixes: dict[str, str] = LABEL_FIXES) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixes.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def is_cut(text: Column) -> Column:
    return F.length(text) >= CUT_AT


def clean(rows: DataFrame, text: str = "text", kinds: tuple[str, ...] = ("type",), fix: bool = False) -> DataFrame:
    """Collapsed texts, a `truncated` flag that is true or null, and corrected labels."""
    out = rows.withColumn(text, collapse(F.col(text))).withColumn("truncated", F.when(is_cut(collapse(F.col(text))), True))
    return out.withColumns({k: fixed_type(F.col(k)) for k in kinds}) if fix else out


def violations(rows: DataFrame, required: dict[str, Column | None]) -> DataFrame:
    """rows plus array `errors`: columns that are null, and those whose check fails."""
    checks = []
    for name, ok in required.items():
        checks.append(F.when(F.col(name).isNull(), F.lit(f"missing {name}")))
        if ok is not None:
            checks.append(F.when(F.col(name).isNotNull() & ~ok, F.lit(f"bad {name}")))
    return rows.withColumn("errors", F.array_compact(F.array(*checks)))


def dedupe(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(rows, keys, order)


def document_id(c: Column) -> Column:
    """What stands before the first -lease_."""
    return F.substring_index(c, "-lease_", 1)


def whole_number(c: Column, signed: bool = True) -> Column:
    return F.when(c.rlike("^-*[0-9]+$" if signed else "^[0-9]+$"), F.regexp_replace(c, "^-*(?=-)", "")).try_cast("int")


def redflags(csv: DataFrame, easy: bool = False) -> DataFrame:
    """Red-flag rows of a CSV (uuid, text, raw_text, type, start, end; easy ones have part and drop `none`)."""
    extra = [F.col("part")] if easy else []
    rows = csv.filter("type is distinct from 'none'") if easy else csv
    return rows.select(document_id(F.col("uuid")).alias("source"), *extra, "text", "raw_text", "type", whole_number(F.col("start")).alias("start"), whole_number(F.col("end")).alias("end"))


def documents(csv: DataFrame) -> DataFrame:
    return csv.select(document_id(F.col("uuid")).alias("source"), "document_class", F.col("document_full_text").alias("text"))


def entities(csv: DataFrame) -> DataFrame:
    at = lambda c: whole_number(F.col(c), signed=False).alias(c)
    return csv.select(document_id(F.col("uuid")).alias("source"), F.col("part_id").alias("part"), "class_id", "entity_text", at("entity_start"), at("entity_end"))


def clauses(csv: DataFrame) -> DataFrame:
    return csv.select(document_id(F.col("uuid")).alias("source"), "part", "text", (F.col("clause_begin") == "True").alias("clause_begin"), "clause_type")


def party(text: Column) -> Column:
    """Struct (party, text): a leading [name], mapped through the aliases; unknown without one."""
    name = F.lower(strip(F.regexp_extract(text, r"^\s*\[([^\]]*)\]", 1)))
    table = F.create_map(*[F.lit(x) for kv in PARTY_ALIASES.items() for x in kv])
    has = text.rlike(r"^\s*\[[^\]]*\]")
    body = F.regexp_replace(text, r"^\s*\[[^\]]*\]", "")
    return F.struct(F.when(has, F.coalesce(F.try_element_at(table, name), name)).otherwise("unknown").alias("party"), strip(body).alias("text"))


def contract(cid: Column) -> Column:
    """Struct (source, idx): the last path part, cut at its last dash; -1 without a number."""
    last = F.element_at(F.split(cid, "/"), -1)
    tail = F.regexp_extract(last, "^(.*)-([^-]*)$", 2)
    return F.struct(F.when(last.contains("-"), F.regexp_extract(last, "^(.*)-([^-]*)$", 1)).otherwise(last).alias("source"), F.coalesce(F.when(tail.rlike("^[0-9]+$"), tail.cast("int")), F.lit(-1)).alias("idx"))


def labels(c: Column) -> Column:
    return F.from_json(c, "array<int>")


def active_types(label: Column) -> Column:
    """Names of the positions that are not zero."""
    names = F.array(*[F.lit(x) for x in DEONTIC_LABELS])
    return F.filter(F.transform(label, lambda x, i: F.when(x != 0, F.try_element_at(names, i + 1))), lambda x: x.isNotNull())


def spans(c: Column) -> Column:
    """A literal such as {'obl': [[0, 5]]} as map of arrays."""
    return F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "map<string,array<array<int>>>")


def annotated(csv: DataFrame) -> DataFrame:
    """Deontic rows of a CSV (id, cid, text, label, span, split)."""
    rows = csv.select(contract(F.col("cid")).alias("c"), party(F.col("text")).alias("p"), labels(F.col("label")).alias("label"), spans(F.col("span")).alias("spans"), "split")
    return rows.select(F.col("c.source").alias("source"), F.col("c.idx").alias("sentence_idx"), "p.party", "p.text", "label", active_types(F.col("label")).alias("deontic_types"), "spans", "split")


def in_vocabulary(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows whose type occurs in vocabulary(type)."""
    return rows.join(vocabulary.select("type").distinct(), "type", "left_semi")


def multilabel_errors(rows: DataFrame) -> DataFrame:
    """rows plus array `errors` of a multi-label row: one-hot label of the right length, party, and types that agree."""
    label, n = F.col("label"), len(DEONTIC_LABELS)
    ones = F.size(F.filter(label, lambda x: x == 1))
    types = active_types(label)
    agree = F.when(types == F.array(F.lit("none")), (F.size("deontic_types") == 0) | (F.col("deontic_types") == types)).otherwise(F.col("deontic_types") == types)
    good = (F.size(label) == n) & (ones == 1)
    checks = [
        F.when(F.coalesce(F.size(label) != n, F.lit(True)), "bad label dim"),
        F.when(F.exists(label, lambda x: ~x.isin(0, 1)), "non-binary label"),
        F.when((F.size(label) == n) & (ones != 1), "expected exactly one label"),
        F.when(~F.coalesce(F.col("party").isin("tenant", "landlord"), F.lit(False)), "bad party"),
        F.when(good & ~agree, "types disagree"),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*checks)))


def training_text(raw_text: Column, text: Column) -> Column:
    return first_filled(raw_text, text)


def span_count(spans_: Column) -> Column:
    return F.aggregate(F.map_values(spans_), F.lit(0), lambda s, x: s + F.size(x))


