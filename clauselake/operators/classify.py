"""Clause classification: weighted pattern evidence first, a linear head with refusal for what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gates import Gates
from ..functions.lexicon import TAXONOMY, TRIGGERS, TYPE_WEIGHTS, UNKNOWN
from ..functions.text import count, first_filled, total

THRESHOLD = MARGIN = 0.3


GATES = Gates([p for t in TAXONOMY for p in TRIGGERS[t]])


def evidence(text: Column, gated: bool = False) -> Column:
    """Struct of match counts by clause type, in the taxonomy's order. On rows that GATES.add() has seen, a pattern runs only where it may match."""
    gated = lambda p, on=gated: F.when(GATES.may(p), count(text, p)).otherwise(0) if on else count(text, p)
    return F.struct(*[total([gated(p) for p in TRIGGERS[t]]).cast("int").alias(t) for t in TAXONOMY])


def best_type(counts: Column) -> Column:
    """Struct (clause_type, count): the highest weighted count, ties to the earlier type; (unknown, 0) without evidence."""
    ranked = F.array_max(
        F.array(*[F.struct((counts[t] * F.lit(TYPE_WEIGHTS.get(t, 1.0))).alias("score"), F.lit(-i).alias("rank"), F.lit(t).alias("clause_type"), counts[t].alias("count")) for i, t in enumerate(TAXONOMY)])
    )
    none = F.struct(F.lit(UNKNOWN).alias("clause_type"), F.lit(0).alias("count"))
    return F.when(ranked["score"] > 0, F.struct(ranked["clause_type"].alias("clause_type"), ranked["count"].alias("count"))).otherwise(none)


def confidence(n: Column) -> Column:
    return 1 - F.pow(F.lit(0.5), F.greatest(n, F.lit(0)).cast("double"))


def taxonomy_index(t: Column) -> Column:
    """Position in the taxonomy; what is not in it comes last."""
    at = F.array_position(F.array(*[F.lit(x) for x in TAXONOMY]), t)
    return F.when(at > 0, at - 1).otherwise(len(TAXONOMY)).cast("int")


def with_evidence(sections: DataFrame, text: str = "text", once: bool = False) -> DataFrame:
    """sections plus struct `evidence`. With `once`, equal texts are matched only once (a shuffle of hashes instead)."""
    gated = lambda rows, t: GATES.add(rows, t).withColumn("evidence", evidence(t, gated=True)).drop(*GATES.columns())
    if not once:
        return gated(sections, F.coalesce(F.col(text), F.lit("")))
    keyed = sections.withColumn("__h", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    found = keyed.groupBy("__h").agg(F.first(text).alias("__t"))
    return keyed.join(gated(found, F.coalesce("__t", F.lit(""))).select("__h", "evidence"), "__h").drop("__h")


def fast_lane(sections: DataFrame, text: str = "text") -> DataFrame:
    """sections plus clause_type, count and confidence from the patterns alone."""
    rows = with_evidence(sections, text).withColumn("__best", best_type(F.col("evidence")))
    return rows.select(*sections.columns, F.col("__best.clause_type").alias("clause_type"), F.col("__best.count").alias("count"), confidence(F.col("__best.count")).alias("confidence"))


def probabilities(vectors: DataFrame, head: DataFrame, key: str = "id", vector: str = "v") -> DataFrame:
    """(key, class_idx, class, p): softmax of a linear head (class_idx, class, w, b), within each row. The head, one row per class, is
    broadcast as a single row."""
    one = head.agg(F.array_sort(F.collect_list(F.struct("class_idx", "class", F.col("w").cast("array<double>").alias("w"), "b"))).alias("__head"))
    dot = lambda w: F.aggregate(F.zip_with(F.col(vector), w, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    rows = vectors.select(key, vector).crossJoin(F.broadcast(one)).withColumn("__z", F.transform("__head", lambda h: dot(h["w"]) + h["b"]))
    rows = rows.withColumn("__e", F.transform("__z", lambda z: F.exp(z - F.array_max("__z")))).withColumn("__all", F.aggregate("__e", F.lit(0.0), lambda s, e: s + e))
    each = F.zip_with("__head", "__e", lambda h, e: F.struct(h["class_idx"].alias("class_idx"), h["class"].alias("class"), (e / F.col("__all")).alias("p")))
    return rows.select(key, F.inline(each))


def refuse(probs: DataFrame, key: str = "id", threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(key, clause_type, confidence): the top class if it is likely enough and far enough ahead, else unknown; the probability
    of the top class either way. Ties go to the earlier class."""
    ranked = F.sort_array(F.collect_list(F.struct("p", (-F.col("class_idx")).alias("o"), "class")), asc=False)
    rows = probs.groupBy(key).agg(ranked.alias("r")).select(key, F.col("r")[0]["class"].alias("top"), F.col("r")[0]["p"].alias("p"), F.coalesce(F.try_element_at("r", F.lit(2))["p"], F.lit(0.0)).alias("next"))
    ok = (F.col("p") >= threshold) & (F.col("p") - F.col("next") >= margin)
    return rows.select(key, F.when(ok, F.col("top")).otherwise(UNKNOWN).alias("clause_type"), F.col("p").alias("confidence"))


def analyze(sections: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(id, text, clause_type, method, confidence). Sections have id, text and perhaps raw_text; fallback rows (id, clause_type,
    confidence) decide what the patterns leave unknown: a refused one stays unknown but keeps its confidence."""
    raw = [F.col("raw_text")] if "raw_text" in sections.columns else []
    rows = fast_lane(sections.select("id", first_filled(F.col("text"), *raw).alias("text")))
    fast = F.col("clause_type") != UNKNOWN
    if fallback is None:
        return rows.select("id", "text", "clause_type", F.when(fast, "fast_lane").otherwise("unknown").alias("method"), "confidence")
    head = fallback.select(F.col("id").alias("__id"), F.col("clause_type").alias("__type"), F.col("confidence").alias("__conf"))
    both = rows.join(head, F.col("id") == F.col("__id"), "left")
    kind = F.when(fast, F.col("clause_type")).otherwise(F.coalesce("__type", F.lit(UNKNOWN)))
    method = F.when(fast, "fast_lane").when(kind == UNKNOWN, "unknown").otherwise("classifier")
    sure = F.when(fast, F.col("confidence")).otherwise(F.coalesce("__conf", F.lit(0.0)))
    return both.select("id", "text", kind.alias("clause_type"), method.alias("method"), sure.alias("confidence"))
