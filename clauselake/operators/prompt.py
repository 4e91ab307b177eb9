"""Prompts, constrained output and its validation, chat pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import RISK_LEVELS, TAXONOMY
from .features import ranked

OUTPUT = "clause_type string, risk_level string, statute string, plain_explanation string, tenant_impact string"
# The instruction and the parts of a prompt.
SYSTEM = (
    "You review a clause from a lease contract and rewrite it in plain language for a non-lawyer tenant. You produce a JSON object with: clause_type (the type of clause), risk_level (high/medium/low/info), "
    "statute (the applicable statute reference), plain_explanation (plain language explanation), and tenant_impact (how this affects the tenant in terms of costs, restrictions, or rights)."
)


def finding_prompt(clause: Column, rationale: Column, level: Column, statute: Column, grounding: Column) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Lease clause:\n"), F.substring(clause, 1, 600)),
        F.when(filled(statute), F.concat(F.lit("\nStatute reference:\n"), statute)),
        F.when(filled(grounding), F.concat(F.lit("\n"), F.substring(grounding, 1, 900))),
        F.concat(F.lit("\nRisk: "), level, F.lit(". "), rationale),
        F.lit("\nRewrite in plain language for the tenant."),
    )


def parse(raw: Column) -> Column:
    """Struct (parse_ok, plain_explanation, tenant_impact): the model's JSON, or its first 500 characters if it is none."""
    ok = F.try_parse_json(raw).isNotNull() & raw.rlike(r"(?s)^\s*\{")
    j = F.from_json(raw, OUTPUT)
    return F.struct(
        ok.alias("parse_ok"), F.when(ok, F.coalesce(j["plain_explanation"], F.lit(""))).otherwise(F.substring(raw, 1, 500)).alias("plain_explanation"), F.when(ok, F.coalesce(j["tenant_impact"], F.lit(""))).otherwise("").alias("tenant_impact")
    )


def obeys_grammar(raw: Column) -> Column:
    """Whether an output has the five keys with known types and levels and non-empty strings."""
    j = F.from_json(raw, OUTPUT)
    filled = lambda n: F.coalesce(j[n], F.lit("")) != ""
    return F.coalesce(F.try_parse_json(raw).isNotNull() & j["clause_type"].isin(*TAXONOMY) & j["risk_level"].isin(*RISK_LEVELS) & filled("statute") & filled("plain_explanation") & filled("tenant_impact"), F.lit(False))


def simplify(found: DataFrame, generate: Callable[[Iterable[str]], list[str]]) -> DataFrame:
    """Findings through a text generator (a picklable function of a batch of prompts, loaded once per worker), parsed, with the
    engine's own fields stamped on."""
    prompt = finding_prompt(F.col("clause_text"), F.col("rationale"), F.col("risk_level"), F.col("statute"), F.col("grounding"))

    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(generate(list(prompts)), dtype=object)

    rows = found.withColumn("raw", F.pandas_udf(run, "string")(prompt)).withColumn("p", parse(F.col("raw")))
    return rows.select("id", "rule_id", "clause_type", "risk_level", "statute", "p.plain_explanation", "p.tenant_impact", "p.parse_ok", "raw")


def chat_pair(user: Column, answer: Column) -> Column:
    """Array of (role, content): system, user, assistant."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(SYSTEM)), turn("user", user), turn("assistant", answer))


def augmented(pairs: DataFrame, ids: list[str], seed: int = 42) -> DataFrame:
    """All pairs once with the paragraphs of their prompt in hashed order, and the first half (in hashed order) once more."""
    both = ranked(pairs, [], ids, seed).withColumn("copy", F.explode(F.when(F.col("__r") <= F.floor(F.col("__n") / 2), F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))))
    order = lambda p: F.md5(F.concat(p, F.lit("|"), F.col("copy").cast("string")))
    parts = F.array_sort(F.transform(F.split("prompt", "\n\n"), lambda p: F.struct(order(p).alias("h"), p.alias("p"))))
    return both.withColumn("prompt", F.when(F.col("copy") == 0, F.col("prompt")).otherwise(F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n"))).drop("__r", "__n")


def output_rates(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """One row: share of outputs that parse, and of those with a known clause type."""
    j = F.from_json(F.col(raw), OUTPUT)
    n = F.count(F.lit(1))
    return outputs.agg(n.alias("n"), F.round(F.count_if(parse(F.col(raw))["parse_ok"]) / n, 4).alias("parse_rate"), F.round(F.count_if(F.coalesce(j["clause_type"].isin(*TAXONOMY), F.lit(False))) / n, 4).alias("valid_type_rate"))
