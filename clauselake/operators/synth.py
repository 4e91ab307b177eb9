"""Synthetic rows: templates with slots, filled from pools by the digits of a variant number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import DEONTIC_LABELS, REDFLAG_TYPES

# Rows per deontic label, and per red-flag type where it is not the usual number.
PER_LABEL = 250
USUAL, MANY = 10, {"riders": 30, "no_obligation_to_operate": 30, "assignment_indeplaatsstelling_permitted": 30, "additional_remarks": 25, "expansion": 25, "extension_period": 25, "special_stipulations": 25, "compalsory_reconstraction": 25, "warrantees_of_the_owner": 25, "none": 40}
RARE_SPANS, USUAL_SPANS = 8, 4

#: Our own pools and templates; callers may pass theirs.
POOLS: dict[str, tuple[str, ...]] = {
    "landlord": ("Landlord", "Lessor", "Owner", "Birchfield Estates", "Quayside Holdings"),
    "tenant": ("Tenant", "Lessee", "Occupant", "Marlow Textiles", "Ostrava Foods"),
    "clause": ("Clause 2", "Clause 5.1", "Section 9", "Article 14", "Paragraph 20(b)"),
    "amount": ("$1,500", "$2,750", "EUR 4,000", "ten percent (10%) of the rent"),
    "days": ("7", "14", "30", "60"),
}
TEMPLATES: dict[str, tuple[str, ...]] = {
    "obl": ("{tenant} shall pay {amount} to {landlord} under {clause}.", "{landlord} shall maintain the roof and give {days} days of notice."),
    "ent": ("{tenant} shall be entitled to renew under {clause}.", "{landlord} has the right to inspect after {days} days."),
    "pro": ("{tenant} shall not assign without consent under {clause}.", "{landlord} may not enter within {days} days of a dispute."),
    "per": ("{tenant} may install shelves under {clause}.", "{landlord} may show the rooms in the last {days} days."),
    "oth": ("{clause} is governed by local law.", "Notices to {tenant} count after {days} days."),
    "nen": ("{tenant} waives any right to a set-off of {amount}.", "{landlord} shall have no right to relocate {tenant}."),
    "none": ("The building has {days} floors.", "{clause} is intentionally blank."),
}


def render(template: Column, variant: Column, pools: dict[str, tuple[str, ...]] = POOLS) -> Column:
    """Mixed-radix digits of the variant pick each slot's value; landlord and tenant share the first digit."""
    out, radix = template, 1
    for i, (slot, values) in enumerate(pools.items()):
        digit = F.pmod(F.floor(variant / radix), F.lit(len(values))).cast("int")
        out = F.replace(out, F.lit("{" + slot + "}"), F.element_at(F.array(*[F.lit(v) for v in values]), digit + 1))
        radix *= 1 if i == 0 else len(values)
    return out


def _rows(spark: SparkSession, counts: dict[str, int], templates: dict[str, tuple[str, ...]]) -> DataFrame:
    table = spark.createDataFrame([(i, k, n, list(templates[k])) for i, (k, n) in enumerate(counts.items())], "i int, kind string, n int, templates array<string>")
    rows = table.select("i", "kind", "templates", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    return rows.withColumn("template", F.element_at("templates", (F.col("j") % F.size("templates") + 1).cast("int"))).withColumn("variant", F.floor(F.col("j") / F.size("templates")) + F.col("i") * 131)


def deontic_rows(spark: SparkSession, seed: int = 42, per_label: int = PER_LABEL, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    rows = _rows(spark, dict.fromkeys(DEONTIC_LABELS, per_label), templates)
    coin = F.substring(F.md5(F.concat_ws("|", "kind", "j", F.lit(seed))), 1, 1) < "8"
    hot = F.transform(F.array(*[F.lit(x) for x in DEONTIC_LABELS]), lambda x: (x == F.col("kind")).cast("int"))
    return rows.select(
        F.concat(F.lit("d-"), "kind", F.lit("-"), F.lpad((F.col("j") + 1).cast("string"), 3, "0")).alias("source"), F.lit(1).alias("sentence_idx"), F.when(coin, "tenant").otherwise("landlord").alias("party"),
        render(F.col("template"), F.col("variant")).alias("text"), hot.alias("label"), F.array("kind").alias("deontic_types"),
    )


def _flag_templates() -> dict[str, tuple[str, ...]]:
    words = {k: k.replace("_", " ") for k in (*REDFLAG_TYPES, "none")}
    return {k: (f"Under {{clause}}, {w} is agreed between {{landlord}} and {{tenant}}.", f"As to {w}, {{tenant}} owes {{amount}} within {{days}} days.") for k, w in words.items()}


def redflag_rows(spark: SparkSession, counts: dict[str, int] | None = None) -> DataFrame:
    counts = counts or {k: MANY.get(k, USUAL) for k in (*REDFLAG_TYPES, "none")}
    rows = _rows(spark, counts, _flag_templates())
    source = F.concat(F.lit("rf-"), "kind", F.lit("-"), F.lpad((F.col("j") + 1).cast("string"), 3, "0"))
    return rows.select(source.alias("source"), F.lit("").alias("text"), render(F.col("template"), F.col("variant")).alias("raw_text"), F.col("kind").alias("type"), F.lit(0).alias("start"), F.lit(0).alias("end"))


def span_rows(spark: SparkSession) -> DataFrame:
    counts = {k: RARE_SPANS if k in MANY else USUAL_SPANS for k in REDFLAG_TYPES}
    rows = _rows(spark, counts, _flag_templates()).withColumn("text", render(F.col("template"), F.col("variant")))
    number = F.element_at(F.array(*[F.lit(v) for v in POOLS["clause"]]), F.pmod("j", F.lit(len(POOLS["clause"]))) + 1)
    two = F.lpad((F.col("j") + 1).cast("string"), 2, "0")
    return rows.select(
        F.concat(F.lit("sp-"), "kind", F.lit("-"), two).alias("source"), F.concat(F.lit("s1p"), two).alias("part"), "text", F.when(F.col("j") % 2 == 0, F.concat(number, F.lit(" "), "text")).otherwise(F.col("text")).alias("raw_text"),
        F.col("kind").alias("type"), F.lit(0).alias("start"), F.lit(0).alias("end"),
    )
