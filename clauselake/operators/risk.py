"""Risk rules over classified sections. The rules are few and fixed, so each becomes a Column and a section makes its findings in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gates import Gates
from ..functions.lexicon import RISK_LEVELS, UNKNOWN
from ..functions.rulebook import RULES, Rule
from ..functions.text import captured, every, matches, some, template

CLAUSE_LENGTH, GROUNDING_LENGTH = 600, 900


def triggered(rule: Rule, text: Column, gates: Gates | None = None) -> Column:
    """All triggers match and no exclusion does. On rows that gates.add() has seen, a pattern runs only where it may match."""
    may = lambda p: matches(text, p) if gates is None else gates.may(p) & matches(text, p)
    return every([may(p) for p in rule.triggers]) & ~some([may(p) for p in rule.exclusions])


def extracted(rule: Rule, text: Column) -> Column:
    """Map of the rule's values found in the text."""
    if not rule.extractors:
        return F.create_map().cast("map<string,string>")
    found = F.create_map(*[x for name, p in rule.extractors.items() for x in (F.lit(name), captured(text, p))])
    return F.map_filter(found, lambda k, v: v.isNotNull())


def rationale(rule: Rule, text: Column) -> Column:
    values = {name: captured(text, p) for name, p in rule.extractors.items()}
    return template(rule.rationale, values | {"clause": F.substring(text, 1, 200)})


def severity(level: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in RISK_LEVELS]), level)
    return F.when(at > 0, at - 1).otherwise(9).cast("int")


def with_findings(sections: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Sections (text, type, ...) plus `findings`, an array of structs in the rules' order. A rule looks at sections of its types, with confidence 1,
    and at unknown ones, with 0.75; the tests of the type and of literals come first, so that patterns only run where they may count."""
    text, kind = F.coalesce(F.col("text"), F.lit("")), F.col("type")
    unknown = kind == UNKNOWN
    gates = Gates([p for r in rules for p in (*r.triggers, *r.exclusions)])
    fired = [
        F.when(
            kind.isin(*rule.clause_types, UNKNOWN),
            F.when(
                triggered(rule, text, gates),
                F.struct(
                    F.lit(i).alias("rule_ord"),
                    F.lit(rule.rule_id).alias("rule_id"),
                    F.lit(rule.level).alias("risk_level"),
                    F.when(unknown, 0.75).otherwise(1.0).alias("confidence"),
                    rationale(rule, text).alias("rationale"),
                    extracted(rule, text).alias("extracted_values"),
                    F.lit(rule.fallback).alias("statute"),
                ),
            ),
        )
        for i, rule in enumerate(rules)
    ]
    return gates.add(sections, text).withColumn("findings", F.array_compact(F.array(*fired))).drop(*gates.columns())


def findings(sections: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sections (id, text, type) to one row per finding."""
    rows = with_findings(sections, rules).select("id", *keep, "text", "type", F.explode_outer("findings").alias("f")).filter("f is not null")  # a plain explode has the optimizer look for findings twice
    return rows.select("id", *keep, F.col("type").alias("clause_type"), F.substring(F.coalesce("text", F.lit("")), 1, CLAUSE_LENGTH).alias("clause_text"), "f.*", F.lit("").alias("grounding"))


def ordered(found: DataFrame) -> DataFrame:
    """Most severe first, then by section and rule."""
    return found.orderBy(severity(F.col("risk_level")), "id", "rule_ord")


def summary(documents: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, of sections with their findings: sections, classified ones, findings and their levels; documents without sections stay."""
    level = lambda x: F.size(F.filter("findings", lambda f: f["risk_level"] == x))
    sums = {"n_findings": F.size("findings")} | {f"n_{x}": level(x) for x in RISK_LEVELS}
    per = sections.groupBy(key).agg(F.count(F.lit(1)).alias("total_sections"), F.count_if(F.col("type") != UNKNOWN).alias("classified_sections"), *[F.sum(c).alias(n) for n, c in sums.items()])
    rows = documents.select(key).join(per, key, "left")
    return rows.select(key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total_sections", "classified_sections", *sums)])
