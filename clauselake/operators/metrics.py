"""Quality metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CONCEPTS
from ..functions.text import java


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def scores(tp: Column, fp: Column, fn: Column, digits: int = 4) -> list[Column]:
    """precision, recall, f1; f1 is that of the unrounded two."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(ratio(2 * p * r, p + r), digits).alias("f1")]


def class_counts(pairs: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, gold) of pairs (y_true, y_pred); one pass, two rows per pair."""
    side = lambda c, g: F.struct(F.col(c).alias("label"), F.lit(g).alias("gold"), (F.col("y_true") == F.col("y_pred")).alias("same"))
    rows = pairs.select(F.explode(F.array(side("y_true", True), side("y_pred", False))).alias("x")).select("x.*")
    return rows.groupBy("label").agg(
        F.count_if(F.col("gold") & F.col("same")).alias("tp"), F.count_if(~F.col("gold") & ~F.col("same")).alias("fp"), F.count_if(F.col("gold") & ~F.col("same")).alias("fn"), F.count_if("gold").alias("gold")
    )


def per_class(pairs: DataFrame, gold_only: bool = False, digits: int = 4) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of pairs (y_true, y_pred)."""
    out = class_counts(pairs)
    out = out.filter("gold > 0") if gold_only else out
    return out.select("label", "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn"), digits))


def multiclass(pairs: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro means of the rounded class values (micro ones equal the accuracy)."""
    of = dict(zip(("precision", "recall", "f1"), scores(F.col("tp"), F.col("fp"), F.col("fn")), strict=True))
    rows = class_counts(pairs).select("tp", "gold", *[c.alias(f"x_{n}") for n, c in of.items()])
    macro = [F.round(F.coalesce(F.avg(f"x_{n}"), F.lit(0.0)), 4).alias(f"macro_{n}") for n in of]
    sums = rows.agg(F.coalesce(F.sum("gold"), F.lit(0)).alias("n"), F.coalesce(F.sum("tp"), F.lit(0)).alias("k"), *macro)
    return sums.select("n", F.round(ratio(F.col("k"), F.col("n")), 4).alias("accuracy"), *[f"macro_{n}" for n in of])


def pooled(pairs: DataFrame) -> DataFrame:
    """One row for classes of the gold side only: pooled micro values and unrounded-mean macro ones."""
    rows = per_class(pairs, gold_only=True, digits=15)
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    micro = [c.alias(f"micro_{n}") for c, n in zip(scores(tp, fp, fn, 3), ("precision", "recall", "f1"), strict=True)]
    return rows.agg(*micro, *[F.round(F.avg(c), 3).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def multilabel(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of rows (y_true, y_pred) of 0/1 arrays; label `micro` pools all."""
    at = [(F.try_element_at("y_true", F.lit(i + 1)), F.try_element_at("y_pred", F.lit(i + 1)), n) for i, n in enumerate(labels)]
    cells = F.array(*[F.struct(F.lit(n).alias("label"), t.alias("t"), p.alias("p")) for t, p, n in at])
    rows = pairs.select(F.explode(cells).alias("x")).select("x.*")
    sums = rows.groupBy("label").agg(F.count_if((F.col("t") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if((F.col("t") == 0) & (F.col("p") == 1)).alias("fp"), F.count_if((F.col("t") == 1) & (F.col("p") == 0)).alias("fn"))
    every = sums.agg(F.lit("micro").alias("label"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.unionByName(every).select("label", "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def exact_match(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.round(ratio(F.count_if(F.col("y_true") == F.col("y_pred")), F.count(F.lit(1))), 4).alias("exact_match_ratio"))


def calibrate(scored: DataFrame, steps: int = 19) -> DataFrame:
    """(label, threshold, f1) of rows (label, y, p): the best of thresholds 0.05, 0.10, ...; the first one wins ties.

    A row counts at every threshold up to its score, so one pass with a bounded array per row replaces a join with the grid.
    """
    grid = F.sequence(F.lit(1), F.lit(steps))
    rows = scored.select("label", "y", F.explode(F.transform(grid, lambda i: F.struct(i.alias("i"), (F.col("p") >= F.round(i * 0.05, 2)).alias("hit")))).alias("g"))
    hit = F.col("g.hit")
    sums = rows.groupBy("label", F.col("g.i").alias("i")).agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"))
    f1 = F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)
    best = sums.withColumn("f1", f1).groupBy("label").agg(F.max(F.struct("f1", (-F.col("i")).alias("o"))).alias("b"))
    return best.select("label", F.round(-F.col("b.o") * 0.05, 2).alias("threshold"), F.col("b.f1").alias("f1"))


def concepts_of(text: Column) -> Column:
    """Array of the concepts whose pattern occurs in the lower-cased text, in order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(java(p)), F.lit(name)) for name, p in CONCEPTS.items()]))


def flag_concepts(flags: DataFrame, key: str, flag: str) -> DataFrame:
    """(key, concept), distinct."""
    return flags.select(key, F.explode(concepts_of(F.col(flag))).alias("concept")).distinct()


def finding_concepts(found: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, concept), distinct, of findings through the rule table."""
    return found.select(key, "rule_id").join(rules.select("rule_id", "concept"), "rule_id").filter("concept is not null").select(key, "concept").distinct()


def set_agreement(gold: DataFrame, pred: DataFrame, key: str, value: str, digits: int = 3) -> DataFrame:
    """(key, jaccard, precision, recall) of two tables of distinct (key, value)."""
    both = gold.select(key, value, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(key, value, F.lit(0).alias("g"), F.lit(1).alias("p")))
    cells = both.groupBy(key, value).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    sums = cells.groupBy(key).agg(F.sum(F.col("g") * F.col("p")).alias("b"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    return sums.select(key, F.round(ratio(F.col("b"), F.col("g") + F.col("p") - F.col("b")), digits).alias("jaccard"), F.round(ratio(F.col("b"), F.col("p")), digits).alias("precision"), F.round(ratio(F.col("b"), F.col("g")), digits).alias("recall"))


def cohort_recall(gold: DataFrame, pred: DataFrame, cohorts: DataFrame, key: str, value: str) -> DataFrame:
    """(cohort, n_docs, recall, precision), pooled over a cohort's documents; null where there is nothing to divide by."""
    both = gold.select(key, value, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(key, value, F.lit(0).alias("g"), F.lit(1).alias("p")))
    cells = both.groupBy(key, value).agg(F.max("g").alias("g"), F.max("p").alias("p")).groupBy(key).agg(F.sum(F.col("g") * F.col("p")).alias("b"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    rows = cohorts.join(cells, key, "left").groupBy("cohort").agg(F.count(F.lit(1)).alias("n_docs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "bgp"])
    part = lambda d: F.when(F.col(d) > 0, F.round(F.col("b") / F.col(d), 4))
    return rows.select("cohort", "n_docs", part("g").alias("recall"), part("p").alias("precision"))


def document_key(c: Column) -> Column:
    return F.replace(c, F.lit("_SCANNED"), F.lit(""))


def aligned(gold: DataFrame, pred: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Pairs (y_true, y_pred) joined by key; a missing prediction is unknown."""
    p = pred.select(*keys, F.col(label).alias("y_pred"))
    return gold.select(*keys, F.col(label).alias("y_true")).join(p, keys, "left").withColumn("y_pred", F.coalesce("y_pred", F.lit("unknown")))


def ood_report(pairs: DataFrame) -> DataFrame:
    """One row: accuracy, accuracy over known gold types, and how unknown is confused."""
    known = F.col("y_true") != "unknown"
    same = F.col("y_true") == F.col("y_pred")
    n = F.count(F.lit(1))
    return pairs.agg(
        n.alias("n"), F.round(ratio(F.count_if(same), n), 4).alias("accuracy"), F.round(ratio(F.count_if(known & same), F.count_if(known)), 4).alias("clause_accuracy"),
        F.count_if(known & (F.col("y_pred") == "unknown")).alias("missed"), F.count_if(~known & (F.col("y_pred") != "unknown")).alias("invented"),
    )
