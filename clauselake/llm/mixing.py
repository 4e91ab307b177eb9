"""Mixing sources to target weights by entropy balancing.

Find document rates r that stay closest to 1 in relative entropy (each document weighted by its words) while every
source's words meet its target: minimise sum(size * (r log r - r)) subject to sum over a source of size * r = target.
The convex dual has one variable per source, and its optimum tilts every document's rate exponentially,
r = exp(dual of its source). The dual's Hessian is diagonal here (a document has one source), so a Newton step is a
projection over the table of sources, which stays distributed; rates are then rounded into whole copies.

Rounding is exact to the smallest documents of a source: its sizes are visited from the largest to the smallest,
each class of equal sizes gets the number of extra copies that best meets what is due so far, and the rest is carried
on. Where a few long documents make whole copies miss a target by more than `tolerance`, one document's last copy is
cut short. Within a class, a hash of the id decides; classes of over BUCKET rows are split by that hash.

Edge cases: null or empty texts have size 0 and are never taken; null sources form one source, ordered last; repeated
rows count as rows; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BUCKET = 1000
#: Classes of equal sizes, at about 60 bytes each, that may be sent to all executors.
BROADCAST = 200_000
STEPS = 6


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space (space and \\x09-\\x0D)."""
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(key, source, source_size) plus target: `share` of all words by repeating weights in code point order, nulls
    last; a target stops at `cap` times its source's size and the excess is shared again by weight."""
    rows = C.numbered(sources, [F.col("source").asc_nulls_last()], "__at")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__at") % len(weights) + 1).cast("int"))
    rows = C.cut(rows.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(cap)))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while level != before:  # the level rises and a source that is full stays full: each pass fills one at least
        before = level
        full = F.col("__cap") <= F.lit(level) * F.col("__w")
        a = rows.agg(F.sum(F.when(full, F.col("source_size"))).alias("s"), F.sum(F.when(~full, F.col("__w"))).alias("w")).first()
        if a["w"]:
            level = (share * total - cap * (a["s"] or 0)) / a["w"]
    return rows.withColumn("target", F.least("__cap", F.lit(level) * F.col("__w"))).drop("__at", "__w", "__cap")


def duals(sources: DataFrame, precision: float = 1e-13, most: int = 200) -> DataFrame:
    """(source_size, target) plus dual and rate: Newton's iterations on the dual until every source meets its target."""
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    at = sources.withColumn("dual", F.when(live, F.lit(0.0)))
    for _ in range(0, most, STEPS):
        for _ in range(STEPS):
            held = F.col("source_size") * F.exp("dual")  # the gradient is held - target, the Hessian's diagonal held
            at = at.withColumn("dual", F.col("dual") - (held - F.col("target")) / held)
        at = C.cut(at)
        worst = at.agg(F.max(F.abs(F.col("source_size") * F.exp("dual") / F.col("target") - 1))).first()[0]
        if worst is None or worst < precision:
            break
    return at.withColumn("rate", F.coalesce(F.exp("dual"), F.lit(0.0)))


def _rounded(tolerance: float):
    def of_source(part: pd.DataFrame) -> pd.DataFrame:
        """One source's classes of equal sizes; there are no more than sqrt(2 * words) of them."""
        part = part.sort_values("size", ascending=False)
        rate, target = float(part["rate"].iloc[0]), float(part["target"].iloc[0])
        whole = int(np.floor(rate + 1e-9))
        size, n = part["size"].to_numpy(), part["n"].to_numpy()
        extra, cut = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
        due = 0.0
        for i in range(len(part)):
            due += max(rate - whole, 0.0) * size[i] * n[i]
            if size[i] > 0:
                extra[i] = min(max(int(np.floor(due / size[i] + 0.5)), 0), n[i])
                due -= float(extra[i] * size[i])
        miss = int(round(target - float(((whole * n + extra) * size).sum())))
        if abs(miss) > tolerance * target:
            small = n <= BUCKET
            fits = np.flatnonzero(small & (extra < n) & (size > miss)) if miss > 0 else np.flatnonzero(small & (extra > 0) & (size > -miss))
            if len(fits):
                i = fits[-1]
                if miss < 0:
                    extra[i] -= 1
                cut[i] = miss if miss > 0 else size[i] + miss
        return pd.DataFrame({"key": part["key"], "size": size, "n": n, "whole": whole, "extra": extra, "cut": cut})

    return of_source


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", tolerance: float = 0.002, **how) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, rate, copies (whole ones) and taken (words, with a cut last copy)."""
    light = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("source").cast("string")))
    light = C.cut(light.withColumn("key", key))
    classes = light.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source"))
    sums = classes.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rates = C.cut(duals(targets(sums, **how)).select("key", "source_size", "target", "rate"))
    due = classes.join(rates, "key").groupBy("key").applyInPandas(_rounded(tolerance), "key string, size long, n long, whole long, extra long, cut long")
    due = C.cut(due.withColumn("buckets", F.ceil(F.col("n") / BUCKET)))
    if due.count() <= BROADCAST:  # else rows move to meet their class, in a join that Spark splits where it is skewed
        due = F.broadcast(due)
    rows = light.join(due, ["key", "size"]).withColumn("bucket", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("buckets")))
    rows = rows.repartition("key", "size", "bucket")  # so that no later step gathers a class
    per = rows.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("in"), *[F.first(c).alias(c) for c in ("n", "extra")])
    upto = F.sum("in").over(Window.partitionBy("key", "size").orderBy("bucket"))
    portion = lambda x: F.floor(F.col("extra") * x / F.col("n"))
    per = per.withColumn("upto", upto).select("key", "size", "bucket", (portion(F.col("upto")) - portion(F.col("upto") - F.col("in"))).alias("more"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id"))
    out = rows.join(per, ["key", "size", "bucket"]).withColumn("rank", rank).join(rates, "key")
    copies = F.col("whole") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)
    cut = F.when(F.col("rank") == F.col("more") + 1, F.col("cut")).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size") + cut).cast("long").alias("taken"))


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents"))
