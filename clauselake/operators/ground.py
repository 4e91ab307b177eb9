"""Vector normalisation, exact top-k, and grounding of findings: lexical, then dense, then the rule's own reference."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rulebook import RULES, Rule
from ..functions.text import collapse, every
from .risk import GROUNDING_LENGTH


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    v = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-9)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean_pool(tokens: DataFrame, key: str, vector: str, mask: str | None = None) -> DataFrame:
    """(key, v): mean of a group's vectors where mask is 1."""
    m = F.col(mask).cast("double") if mask else F.lit(1.0)
    rows = tokens.select(key, m.alias("m"), F.posexplode(vector).alias("i", "x"))
    means = rows.groupBy(key, "i").agg((F.sum(F.col("x") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))


#: Queries and rows of a tile of top_k, and scores that a task holds at once.
ASKED, BLOCK, HELD = 16_384, 20_000, 1_000_000
#: Digits of a score, and how near to the edge of rounding it is summed again, term by term.
DIGITS, EDGE = 4, 1e-9


def matrix(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros, and their lengths; -1 for null ones."""
    rows = list(vectors)
    lengths = np.array([-1 if v is None else len(v) for v in rows], dtype=int)
    wide = max(int(lengths.max(initial=0)), 0)
    if len(rows) and (lengths == wide).all():
        return np.array(rows, dtype=float).reshape(len(rows), wide), lengths
    out = np.zeros((len(rows), wide))
    for i, v in enumerate(rows):
        if lengths[i] > 0:
            out[i, : lengths[i]] = v
    return out, lengths


def rounded(raw: np.ndarray, q: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Scores of pairs (rows of q and u) as Spark sums and rounds them: half up, term by term where the sum's order could tell."""
    out = np.round(raw, DIGITS) + 0.0
    with np.errstate(invalid="ignore"):
        edge = np.flatnonzero(np.abs(np.abs(raw - out) - 0.5 * 10.0**-DIGITS) < EDGE)
    if len(edge):
        total = np.zeros(len(edge))
        for x, y in zip(q[edge].T, u[edge].T, strict=True):
            total += x * y
        out[edge] = [float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP)) + 0.0 for x in total]
    return out


def best(q: np.ndarray, nq: np.ndarray, u: np.ndarray, nu: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, ids, scores): the best k rows of each query by score, then id, HELD scores at a time. nq and nu are lengths; NaN comes as
    inf, no score as -inf."""
    wide = max(q.shape[1], u.shape[1])
    q, u = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (q, u))
    step = max(1, HELD // max(1, len(u)))
    alike = len(nq) and len(nu) and (nq == nu[0]).all() and (nu == nu[0]).all() and nu[0] >= 0
    for a in range(0, len(q), step):
        part = q[a : a + step]
        with np.errstate(invalid="ignore"):
            raw = part @ u.T
        raw[np.isnan(raw)] = np.inf
        if not alike:
            raw[(nq[a : a + step, None] != nu[None, :]) | (nu < 0)[None, :]] = -np.inf
        if len(u) > k:
            kth = np.partition(raw, len(u) - k, axis=1)[:, len(u) - k]
            row, at = np.nonzero(raw >= (np.round(kth, DIGITS) - 0.5 * 10.0**-DIGITS - EDGE)[:, None])
        else:
            row, at = np.indices(raw.shape).reshape(2, -1)
        score = raw[row, at]
        finite = np.isfinite(score)
        score[finite] = rounded(score[finite], part[row[finite]], u[at[finite]])
        order = np.lexsort((ids[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        yield row[place < k] + a, ids[at[place < k]], score[place < k]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "id", vector: str = "v") -> DataFrame:
    """(query_id, rank, id, score): exact inner products of unit vectors. Queries and rows meet in tiles (blocks of both), each a
    product of matrices of which a task holds a strip, so neither side has to be small; a tile keeps k rows a query. Ties go to the smaller id."""
    chunks, blocks = max(1, -(-queries.count() // ASKED)), max(1, -(-vectors.count() // BLOCK))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    whole = lambda v: F.when(~F.exists(v, lambda x: x.isNull()), unit(v))  # noqa: E731  a null component makes every score null
    q = queries.select(F.col(key).alias("query_id"), whole(F.col(vector)).alias("q")).withColumn("chunk", part("query_id", chunks)).withColumn("block", every_one(blocks))
    rows = vectors.select(F.col(key).alias("id"), whole(F.col(vector)).alias("u")).withColumn("block", part("id", blocks)).withColumn("chunk", every_one(chunks))
    keys = ["block", "chunk"]
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": left["query_id"].iloc[:0], "id": right["id"].iloc[:0], "score": np.zeros(0)})]
        if len(left) and len(right):
            asked, ids = left["query_id"].to_numpy(), right["id"].to_numpy()
            for row, found, score in best(*matrix(left["q"]), *matrix(right["u"]), ids, k):
                out.append(pd.DataFrame({"query_id": asked[row], "id": found, "score": score}))
        return pd.concat(out[1:] or out)

    met = q.repartition(chunks * blocks, *keys).groupBy(*keys).cogroup(rows.repartition(chunks * blocks, *keys).groupBy(*keys)).applyInPandas(tile, kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")
    score = F.when(F.col("score") == float("inf"), nan).when(F.col("score") == float("-inf"), none).otherwise(F.col("score"))
    return met.withColumn("score", score).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    rows = [(i, r.rule_id, list(r.clause_types), r.level, r.query, list(r.anchors), r.fallback, r.concept) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, clause_types array<string>, risk_level string, query string, anchors array<string>, fallback string, concept string")


def lexical(rules: tuple[Rule, ...], chunks: DataFrame) -> DataFrame:
    """(rule_id, id, text): per rule the first chunk, in corpus order, that contains all its anchors as substrings.

    The rules are Columns over one scan of the chunks, and each partition keeps one candidate per rule.
    """
    low = collapse(F.lower("text"))
    hits = [F.when(F.lit(bool(r.anchors)) & every([F.contains(low, F.lit(a.lower())) for a in r.anchors]), F.lit(r.rule_id)) for r in rules]
    rows = chunks.select("chunk_idx", "id", "text", F.explode(F.array_compact(F.array(*hits))).alias("rule_id"))
    return rows.groupBy("rule_id").agg(F.min(F.struct("chunk_idx", "id", "text")).alias("c")).select("rule_id", "c.id", "c.text")


def ground(found: DataFrame, rules: DataFrame, by_words: DataFrame, by_vectors: DataFrame | None = None) -> DataFrame:
    """Findings with statute, statute_citation and grounding. Chunks were chosen per rule, so only small tables join; findings of
    unknown rules stay as they are."""
    chosen = rules.select("rule_id", "fallback").join(by_words.select("rule_id", F.col("id").alias("w"), F.col("text").alias("wt")), "rule_id", "left")
    if by_vectors is None:
        chosen = chosen.withColumns({"v": F.lit(None).cast("string"), "vt": F.lit(None).cast("string")})
    else:
        chosen = chosen.join(by_vectors.select("rule_id", F.col("id").alias("v"), F.col("text").alias("vt")), "rule_id", "left")
    chosen = chosen.withColumn("known", F.lit(True))
    rows = found.join(chosen, "rule_id", "left")
    statute = F.when(F.col("known"), F.coalesce("w", "v", "fallback")).otherwise(F.col("statute"))
    grounding = F.when(F.col("known"), F.substring(F.coalesce("wt", "vt", F.lit("")), 1, GROUNDING_LENGTH)).otherwise(F.col("grounding"))
    citation = F.when(F.col("known"), F.col("fallback")).otherwise(F.col("statute"))
    return rows.select(*[c for c in found.columns if c not in ("statute", "grounding")], statute.alias("statute"), citation.alias("statute_citation"), grounding.alias("grounding"))
