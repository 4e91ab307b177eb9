"""The saved index of cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clauselake.operators import cells, ground


def brute(vectors, asked, k):
    ids = [i for i, v in vectors if v is not None]
    m = np.array([v for _, v in vectors if v is not None], float)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    out = []
    for a in asked:
        s = np.round(m @ m[ids.index(a)], 4)
        for r, j in enumerate(sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:k]):
            out.append((a, r + 1, ids[j], s[j]))
    return sorted(out)


@pytest.mark.parametrize(("spread", "most"), [(0.05, 0.35), (2.0, 1.0)])
def test_cells_are_exact(spark, tmp_path, monkeypatch, spread, most):
    """Clustered and shapeless vectors, copies, zero and null ones; small tiles."""
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in heads[i % 12] + spread * rng.normal(size=8)]) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, [0.0] * 8), (2001, None), (2002, [1e-3] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    monkeypatch.setattr(cells, "BLOCK", 30)
    path = str(tmp_path / "index")
    cells.build(df, path)
    index = cells.load(spark, path)
    assert int(index.n.sum()) == len(rows) - 1 and len(index.cell) > 10
    asked = [i for i, v in rows if i % 20 == 0 and v is not None]
    queries = df.filter("id % 20 = 0")
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in cells.top_k(index, queries, str(tmp_path / "first"), 5).collect())
    want = brute(rows, asked, 5)
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[3] - b[3]) < 1e-4 + 1e-9 for a, b in zip(got, want, strict=True))
    assert sum(a[2] != b[2] for a, b in zip(got, want, strict=True)) <= 1  # a score on the edge of rounding
    assert cells.share_scored(index, queries, spark.read.parquet(str(tmp_path / "first"))) <= most


def test_cells_small_and_empty(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    cells.build(few, str(tmp_path / "a"))
    got = cells.top_k(cells.load(spark, str(tmp_path / "a")), few, str(tmp_path / "b"), 5).collect()
    assert sorted((r["query_id"], r["id"], r["score"]) for r in got) == [(1, 1, 1.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 1.0)]
    cells.build(few.limit(0), str(tmp_path / "c"))
    assert cells.top_k(cells.load(spark, str(tmp_path / "c")), few, str(tmp_path / "d"), 5).count() == 0


def test_tasks_hold_strips(spark, tmp_path, monkeypatch):
    """No row set of a visit is longer than ROWS, whatever queries and cells are; small strips give the same result."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    monkeypatch.setattr(cells, "HELD", 50)
    monkeypatch.setattr(cells, "ROWS", 7)
    monkeypatch.setattr(ground, "HELD", 100)
    cells.build(df, str(tmp_path / "index"))
    index = cells.load(spark, str(tmp_path / "index"))
    asked = df.filter("id % 20 = 0")
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in cells.top_k(index, asked, str(tmp_path / "first"), 5).collect())
    assert got == [pytest.approx(x) for x in brute(rows, [i for i, _ in rows if i % 20 == 0], 5)]


def test_top_k_by_products_of_matrices(spark, monkeypatch):
    """Pairs are no rows; scores are those of Spark's own sums, at the edges of rounding too; null vectors, components and other lengths as before."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8)]) for i in range(300)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [1.0, 2.0]), (403, [0.0] * 8), (404, [float("nan")] * 8)]
    rows += [(500 + i, [0.00005, (1 - 0.00005**2) ** 0.5] + [0.0] * 6) for i in range(3)] + [(510, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    asked = df.filter("id % 10 = 0 or id > 399")
    monkeypatch.setattr(ground, "HELD", 400), monkeypatch.setattr(ground, "BLOCK", 60)
    for k in (3, 400):
        out = ground.top_k(asked, df, k)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        pairs = asked.select(F.col("id").alias("query_id"), ground.unit(F.col("v")).alias("q")).crossJoin(df.select("id", ground.unit(F.col("v")).alias("u")))
        pairs = pairs.select("query_id", "id", F.round(ground.dot(F.col("u"), F.col("q")), 4).alias("score"))
        want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
        both = [{(r["query_id"], r["rank"]): repr((r["id"], r["score"])) for r in x.collect()} for x in (out, want)]
        assert both[0] == both[1]
