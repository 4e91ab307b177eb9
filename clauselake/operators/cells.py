"""Exact top-k by a saved index of cells: each has a centre, a radius (the largest angle to a member) and a size.

No member of a cell can score above cos(angle to the centre - radius). A query first visits the cells of the best bounds until these hold k vectors; what it
has found then is a floor, and only cells whose bound reaches the floor are visited besides. So the result is exact, and on clustered vectors most
pairs are never scored. Cells and queries meet in tiles, so a cell that holds a third of all vectors, or that all queries visit, is many tasks.

Edge cases: null vectors are left out of the index and ask nothing; a zero vector scores 0 with all; with fewer than k vectors all are returned; an
empty index returns nothing. Scores are rounded to four decimals, ties go to the smaller id, and bounds allow for both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ground import best, unit

#: Vectors that centres are found on, most cells, rounds; members of a tile; values of a matrix and rows that a task holds at once.
SAMPLE, MOST, ROUNDS, BLOCK, HELD, ROWS = 16_384, 4096, 5, 20_000, 1_000_000, 20_000
DIGITS, SLACK = 4, 1e-7


def _matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), dtype=float)


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best centre of each row and its cosine, a strip of rows at a time."""
    cell, cosine, step = np.zeros(len(rows), dtype=int), np.zeros(len(rows)), max(1, HELD // len(centres))
    for a in range(0, len(rows), step):
        at = rows[a : a + step] @ centres.T
        cell[a : a + step] = at.argmax(axis=1)
        cosine[a : a + step] = at.max(axis=1)
    return cell, cosine


def centres_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres by some rounds of means, beginning with the first rows; a cell that loses all its rows keeps its centre."""
    centres = sample[:cells].copy()
    for _ in range(ROUNDS):
        at, _ = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def build(vectors: DataFrame, path: str, key: str = "id", vector: str = "v", cells: int | None = None) -> None:
    """Writes members (cell, id, u), sorted by cell, and cells (cell, centre, radius, n) below path."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), unit(F.col(vector)).alias("u"))
    wanted = cells or max(1, int(rows.count() ** 0.5))
    sample = rows.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(SAMPLE).select("u").collect()  # bounded
    if not sample:
        rows.select(F.lit(0).alias("cell"), "id", "u").write.parquet(f"{path}/members")
        spark.createDataFrame([], "cell int, centre array<double>, radius double, n long").write.parquet(f"{path}/cells")
        return
    sent = spark.sparkContext.broadcast(centres_of(_matrix(r["u"] for r in sample), min(wanted, MOST, len(sample))))  # MOST centres at most

    def assigned(batches):
        for b in batches:
            if len(b):
                cell, cosine = nearest(_matrix(b["u"]), sent.value)
                yield b.assign(cell=cell, angle=np.arccos(np.clip(cosine, -1, 1)))

    placed = rows.mapInPandas(assigned, f"id {rows.schema['id'].dataType.simpleString()}, u array<double>, cell int, angle double")
    placed.repartitionByRange(F.col("cell"), F.xxhash64("id")).sortWithinPartitions("cell", "id").write.parquet(f"{path}/members")
    sizes = spark.read.parquet(f"{path}/members").groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row a cell
    table = [(int(r["cell"]), [float(x) for x in sent.value[r["cell"]]], float(r["radius"]), int(r["n"])) for r in sizes]
    spark.createDataFrame(table, "cell int, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/cells")


@dataclass
class Cells:
    """A loaded index."""

    members: DataFrame
    cell: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    n: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The best score that each query can have in each cell."""
        angle = np.arccos(np.clip(queries @ self.centre.T, -1, 1))
        away = np.where(np.linalg.norm(queries, axis=1, keepdims=True) > 1e-6, np.maximum(angle - self.radius - SLACK, 0), np.pi / 2)
        return np.cos(away)


def load(spark: SparkSession, path: str) -> Cells:
    rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # MOST at most
    return Cells(spark.read.parquet(f"{path}/members"), np.array([r["cell"] for r in rows], int), _matrix(r["centre"] for r in rows), np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows], int))


def visits(index: Cells, queries: DataFrame, k: int, floor: bool) -> DataFrame:
    """(query_id, q, cell): the cells to visit first; or, with column `floor`, those besides that may hold a score of the floor or above."""
    spark = queries.sparkSession
    cell, centre, radius, n = index.cell, index.centre, index.radius, index.n
    sent = spark.sparkContext.broadcast(Cells(None, cell, centre, radius, n))

    def run(batches):
        i = sent.value
        step = max(1, HELD // len(i.cell))
        for b in (whole.iloc[a : a + step] for whole in batches for a in range(0, len(whole), step)):
            bounds = i.bounds(_matrix(b["q"]))
            order = np.argsort(-bounds, axis=1, kind="stable")
            before = np.cumsum(i.n[order], axis=1) - i.n[order]
            take = before < k  # cells by bound until they hold k vectors
            if floor:
                best = np.take_along_axis(bounds, order, axis=1)
                take = ~take & (best >= b["floor"].to_numpy()[:, None] - 0.5 * 10.0**-DIGITS - 1e-9)
            row, at = np.nonzero(take)
            cells = i.cell[order[row, at]]
            for a in range(0, len(row), ROWS):  # each row brings its vector
                some = row[a : a + ROWS]
                yield pd.DataFrame({"query_id": b["query_id"].to_numpy()[some], "q": b["q"].to_numpy()[some], "cell": cells[a : a + ROWS]})

    return queries.mapInPandas(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, q array<double>, cell int")


def scores(index: Cells, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the best k of each query in each tile of the cells that it visits."""
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(8)).cast("int"))
    spark = asked.sparkSession
    blocks = spark.createDataFrame([(int(c), max(1, -(-int(n) // BLOCK))) for c, n in zip(index.cell, index.n, strict=True)], "cell int, blocks int")  # MOST rows at most
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.join(F.broadcast(blocks), "cell").withColumn("block", each(F.col("blocks"))).drop("blocks")
    right = index.members.select("cell", "id", "u").join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    right = right.withColumn("chunk", each(F.lit(8)))
    keys = ["cell", "block", "chunk"]
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {index.members.schema['id'].dataType.simpleString()}, score double"

    def tile(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(rows):
            asked, x, u = q["query_id"].to_numpy(), _matrix(q["q"]), _matrix(rows["u"])
            for row, ids, score in best(x, np.full(len(x), x.shape[1]), u, np.full(len(u), u.shape[1]), rows["id"].to_numpy(), k):
                out.append(pd.DataFrame({"query_id": asked[row], "id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, kinds)


def top_k(index: Cells, queries: DataFrame, path: str, k: int = 5, key: str = "id", vector: str = "v") -> DataFrame:
    """(query_id, rank, id, score), exact. The first visits' results are written below path, as the floor and the rest are made of them."""
    spark = queries.sparkSession
    if not len(index.cell):
        return queries.select(F.col(key).alias("query_id"), F.lit(1).alias("rank"), F.col(key).alias("id"), F.lit(0.0).alias("score")).limit(0)
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), unit(F.col(vector)).alias("q"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    best(scores(index, visits(index, q, k, False), k)).write.parquet(path)
    first = spark.read.parquet(path)
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) < k, F.lit(-2.0)).otherwise(F.min("score")).alias("floor"))
    more = scores(index, visits(index, q.join(floors, "query_id"), k, True), k)
    return best(first.drop("rank").unionByName(more)).select("query_id", "rank", "id", "score")


def share_scored(index: Cells, queries: DataFrame, first: DataFrame, k: int = 5, key: str = "id", vector: str = "v") -> float:
    """Scored pairs as a share of all; first: what top_k wrote."""
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), unit(F.col(vector)).alias("q"))
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) < k, F.lit(-2.0)).otherwise(F.min("score")).alias("floor"))
    sizes = queries.sparkSession.createDataFrame([(int(c), int(n)) for c, n in zip(index.cell, index.n, strict=True)], "cell int, n long")
    every = visits(index, q, k, False).select("cell").unionByName(visits(index, q.join(floors, "query_id"), k, True).select("cell"))
    scored = every.join(F.broadcast(sizes), "cell").agg(F.sum("n")).first()[0] or 0
    return scored / max(1, q.count() * int(index.n.sum()))
