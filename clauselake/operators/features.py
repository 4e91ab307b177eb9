"""Deontic features and deterministic splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import DEONTIC_PHRASES
from ..functions.text import phrase_count, some, strip, total


def trigger_vector(text: Column) -> Column:
    """0/1 per phrase group: whether any of its phrases occurs as a substring."""
    low = F.array(F.lower(F.coalesce(text, F.lit(""))))  # bound to a variable: named for each phrase, the text would be made anew for each
    return F.transform(low, lambda t: F.array(*[some([F.contains(t, F.lit(p)) for p in ps]).cast("int") for ps in DEONTIC_PHRASES.values()]))[0]


def trigger_counts(text: Column) -> Column:
    """Occurrences per phrase group, summed over its phrases."""
    t = F.coalesce(text, F.lit(""))
    return F.array(*[total([phrase_count(t, p) for p in ps]) for ps in DEONTIC_PHRASES.values()])


def is_tenant(party: Column) -> Column:
    return F.coalesce(F.lower(strip(party)) == "tenant", F.lit(False)).cast("int")


def group_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """(group, n): rows that hit each phrase group."""
    v = rows.select(trigger_vector(F.col(text)).alias("v"))
    names = F.array(*[F.lit(g) for g in DEONTIC_PHRASES])
    return v.select(F.explode(F.arrays_zip(names.alias("g"), F.col("v").alias("v"))).alias("x")).groupBy(F.col("x.g").alias("group")).agg(F.sum("x.v").alias("n"))


def shuffled(seed: int, *ids: str) -> Column:
    """Order of a seeded, reproducible shuffle: a hash of the row's id."""
    return F.md5(F.concat_ws("|", *[F.col(i).cast("string") for i in ids], F.lit(str(seed))))


def ranked(rows: DataFrame, strata: list[str], ids: list[str], seed: int = 42) -> DataFrame:
    """rows plus __r, the rank in a hashed order within the strata (all rows if there are none), and __n, the stratum's size.

    Rows are ranked in buckets of their hash's first digits, and a bucket starts after the counts of those before it: no task sees
    more than one bucket of a stratum, and only counts meet in order.
    """
    rows = rows.withColumn("__h", shuffled(seed, *ids)).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*strata)
    before = F.sum("__c").over(w.orderBy("__b")) - F.col("__c")
    counts = counts.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(strata)], F.col("__b").alias("__at"), before.alias("__before"), F.sum("__c").over(w).alias("__n"))
    same = F.col("__b") == F.col("__at")
    for i, c in enumerate(strata):
        same &= F.col(c).eqNullSafe(F.col(f"__s{i}"))
    rank = F.row_number().over(Window.partitionBy(*strata, "__b").orderBy("__h", *ids))
    out = rows.withColumn("__k", rank).join(counts, same).withColumn("__r", F.col("__before") + F.col("__k"))
    return out.drop("__h", "__b", "__at", "__before", "__k", *[f"__s{i}" for i in range(len(strata))])


def split(rows: DataFrame, stratum: str, ids: list[str], seed: int = 42, ratios: tuple[float, float] = (0.8, 0.1), least: int = 0) -> DataFrame:
    """rows plus `split`: within each stratum the first int(n * ratio) rows of a hashed order train, the next validate, the rest
    test. With `least`, train and val get so many rows at least, while there are any."""
    n = F.col("__n")
    train = F.greatest(F.floor(n * F.lit(ratios[0]) + 1e-9), F.lit(least))
    val = F.greatest(F.floor(n * F.lit(ratios[1]) + 1e-9), F.lit(least))
    out = ranked(rows, [stratum], ids, seed).withColumn("__t", train).withColumn("__v", val)
    return out.withColumn("split", F.when(F.col("__r") <= F.col("__t"), "train").when(F.col("__r") <= F.col("__t") + F.col("__v"), "val").otherwise("test")).drop("__r", "__n", "__t", "__v")


def downsample(rows: DataFrame, label: str, ids: list[str], negative: str = "none", factor: int = 3, seed: int = 42) -> DataFrame:
    """All positives, and at most `factor` times as many negatives, chosen by hash."""
    positives = rows.agg(F.count_if(F.col(label) != negative).alias("__pos"))
    out = ranked(rows, [label], ids, seed).crossJoin(F.broadcast(positives))  # one row
    return out.filter((F.col(label) != negative) | (F.col("__r") <= factor * F.col("__pos"))).drop("__r", "__n", "__pos")


def sample(rows: DataFrame, n: int, ids: list[str], seed: int = 42) -> DataFrame:
    return rows.orderBy(shuffled(seed, *ids), *ids).limit(n)


def frequent_labels(rows: DataFrame, label: str = "type", text: str = "text", least: int = 2) -> DataFrame:
    """Labelled, non-blank rows of classes with `least` rows or more."""
    kept = rows.filter((F.col(label) != "unknown") & (strip(F.coalesce(F.col(text), F.lit(""))) != ""))
    large = kept.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    return kept.join(large, F.col(label) == F.col("__label"), "left_semi")
