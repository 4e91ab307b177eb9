"""Exact top-k search over binary codes by incremental multi-index hashing (Norouzi, Punjani and Fleet, 2012).

A vector's code has a bit per component, set where it is positive; vectors of more than 64 components are refused with an error. The codes of a block are
indexed by each of m segments. A query probes the segments in turn with growing radii; once every segment up to s has been
searched to radius r and the others to r - 1, every code within distance m r + s is found. The search of a block ends when the
k-th verified distance is within that bound, which also covers all ties, or as soon as the next probes outnumber the
codes, when what is left is scanned. Queries and codes meet in tiles (blocks of both), each tile gives k rows a query,
and these are merged; a code keeps only its k smallest ids, so equal codes cannot fill a tile.

Edge cases: vectors that are null, empty, or hold null components have no code and are neither found nor ask; ties go to the
smaller id; repeated rows are found each; a query finds itself too; fewer than k codes give fewer rows; an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BITS, BLOCK, CHUNK = 64, 200_000, 4096


def code(v: Column) -> Column:
    """The sign bits of a vector as a long; null if it has no code, an error if it has more than 64 components."""
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    wide = F.raise_error(F.concat(F.lit(f"vectors of more than {BITS} components have no code: "), F.size(v).cast("string"))).cast("long")
    return F.when(F.size(v) > BITS, wide).when((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()), F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


class Index:
    def __init__(self, codes: np.ndarray):
        self.codes = codes
        m = max(2, min(8, round(BITS / max(log2(max(len(codes), 2)), 8))))
        cuts = [BITS * i // m for i in range(m + 1)]
        self.segments = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            value = ((codes >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.segments.append((a, b - a, order, value[order]))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def flips(self, width: int, r: int) -> np.ndarray:
        if (width, r) not in self.masks:
            self.masks[width, r] = np.array([sum(1 << i for i in c) for c in combinations(range(width), r)], dtype=np.int64)
        return self.masks[width, r]

    def search(self, q: np.uint64, k: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (their places) that hold the k nearest ids with all ties, and their distances."""
        m, n = len(self.segments), len(self.codes)
        seen = np.zeros(n, dtype=bool)
        found, counts = [], np.zeros(BITS + 1, dtype=np.int64)  # ids by distance
        probes = 0
        for r in range(BITS):
            for s, (at, width, order, values) in enumerate(self.segments):
                if r > width:
                    continue
                size = 1
                for i in range(r):
                    size = size * (width - i) // (i + 1)
                probes += size
                if probes > n:
                    rest = np.flatnonzero(~seen)
                    return self.answer(q, k, weight, found, rest)
                own = int((q >> np.uint64(at)) & np.uint64((1 << width) - 1))
                want = self.flips(width, r) ^ own
                lo, hi = np.searchsorted(values, want, "left"), np.searchsorted(values, want, "right")
                full = hi > lo
                lo, size = lo[full], (hi - lo)[full]
                if len(lo):
                    upto = np.cumsum(size)
                    hits = order[np.repeat(lo - upto + size, size) + np.arange(upto[-1])]
                    hits = hits[~seen[hits]]
                    seen[hits] = True
                    found.append(hits)
                    counts += np.bincount(np.bitwise_count(self.codes[hits] ^ q), weights=weight[hits], minlength=BITS + 1).astype(np.int64)
                if counts[: m * r + s + 1].sum() >= k:
                    return self.answer(q, k, weight, found, np.zeros(0, dtype=np.int64))
        return self.answer(q, k, weight, found, np.flatnonzero(~seen))

    def answer(self, q, k, weight, found, rest) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([*found, rest]).astype(np.int64)
        far = np.bitwise_count(self.codes[at] ^ q)
        upto = np.cumsum(np.bincount(far, weights=weight[at], minlength=BITS + 1))
        kth = int(np.searchsorted(upto, k))
        return at[far <= kth], far[far <= kth]


def _tile(k: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(index) and len(queries):
            ids = [np.asarray(x) for x in index["ids"]]
            ix, weight = Index(index["code"].to_numpy().astype(np.uint64)), np.array([len(x) for x in ids])
            for q in queries["code"]:
                at, far = ix.search(np.uint64(q & (1 << 64) - 1), k, weight)
                best = sorted((int(d), int(i)) for a, d in zip(at, far, strict=True) for i in ids[a])[:k]
                rows += [(q, d, i) for d, i in best]
        return pd.DataFrame(rows, columns=["code", "distance", "vec_id"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, distance): for every row of queries the k nearest rows of vectors."""
    coded = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), code(F.col(vector)).alias("code")).filter("code is not null and vec_id is not null")
    rank = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    index = C.cut(coded(vectors).withColumn("r", rank).filter(F.col("r") <= k).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = C.cut(coded(queries))
    codes = C.cut(asked.select("code").distinct())
    n, q = index.count(), codes.count()
    blocks = max(1, -(-n // BLOCK))
    chunks = max(1, min(-(-q // 64), max(-(-q // CHUNK), C.partitions(vectors.sparkSession) // blocks)))
    seq = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = index.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks))).withColumn("chunk", seq(chunks))
    right = codes.withColumn("chunk", F.pmod(F.xxhash64("code", F.lit(1)), F.lit(chunks)).cast("int")).withColumn("block", seq(blocks)).withColumn("block", F.col("block").cast("long"))
    tiles = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(_tile(k), "code long, distance int, vec_id long")
    rank = F.row_number().over(Window.partitionBy("code").orderBy("distance", "vec_id"))
    best = tiles.withColumn("rank", rank).filter(F.col("rank") <= k)
    asked = asked.select(F.col("vec_id").alias("query_id"), "code")
    return asked.join(best, "code").select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))


def op4_hamming_topk(spark, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 20 = 0"))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
d AS (
  SELECT q.vec_id AS query_id, e.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.b, e.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM e q, e WHERE q.vec_id % 20 = 0
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
