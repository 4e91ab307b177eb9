"""Sparse training against a dense solver and plain formulas."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.operators import classify
from clauselake.operators.features import trigger_vector
from clauselake.plans import train


def texts(n, seed):
    random.seed(seed)
    words = ["rent", "due", "pets", "allowed", "premises", "shall", "not", "pay", "may", "landlord", "été", "x1"]
    kinds = {"rent": ["rent", "due", "pay"], "pets": ["pets", "allowed"], "access": ["premises", "landlord"]}
    out = []
    for i in range(n):
        kind = random.choice([*kinds, "rent"])
        out.append((i, " ".join(random.choice(kinds[kind] if random.random() < 0.4 else words) for _ in range(random.randint(0, 12))), kind, random.choice(["Tenant", "landlord", None])))
    return out


def dense_tfidf(rows, ngrams, features):
    """The formulas, written out over a full matrix."""
    docs = []
    for t in rows:
        w = re.findall(r"\w\w+", (t or "").lower())
        docs.append([" ".join(w[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)])
    tf = Counter(x for d in docs for x in d)
    terms = sorted(tf, key=lambda x: (-tf[x], x))[:features]
    at, df = {x: i for i, x in enumerate(terms)}, Counter(x for d in docs for x in set(d))
    m = np.zeros((len(docs), len(terms)))
    for i, d in enumerate(docs):
        for x, k in Counter(d).items():
            if x in at:
                m[i, at[x]] = (1 + math.log(k)) * (math.log((1 + len(docs)) / (1 + df[x])) + 1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12), terms


def dense_fit(x, y, c, balanced):
    """Softmax regression by Newton steps on all weights; probabilities. One free weight vector fewer where there are two classes."""
    classes = sorted(set(y))
    n, k = len(y), len(classes)
    hot = np.array([[float(v == q) for q in classes] for v in y])
    weight = np.array([n / (k * y.count(v)) if balanced else 1.0 for v in y])[:, None]
    x1 = np.hstack([x, np.ones((n, 1))])
    free = list(range(k)) if k > 2 else [1]
    w = np.zeros((k, x1.shape[1]))
    ridge = np.append(np.full(x.shape[1], 1 / c), 1e-9)  # the intercept is free
    for _ in range(60):
        z = x1 @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = np.concatenate([((p - hot) * weight)[:, j] @ x1 + ridge * w[j] for j in free])
        h = np.block([[(x1 * (weight[:, 0] * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x1 + (i == j) * np.diag(ridge) for j in free] for i in free])
        step = np.linalg.solve(h + 1e-10 * np.eye(len(h)), g).reshape(len(free), -1)
        w[free] -= step
        if np.abs(step).max() < 1e-10:
            break
    return classes, p, w


@pytest.mark.parametrize(("ngrams", "features"), [(1, 50), (2, 15)])
def test_tfidf_is_sparse_and_exact(spark, ngrams, features):
    rows = texts(60, 1) + [(99, None, "rent", None), (100, "", "rent", None)]
    df = spark.createDataFrame(rows, "id int, text string, type string, party string")
    tfidf = train.Tfidf.fit(df, train.feature_text(df), features, ngrams)
    want, terms = dense_tfidf([r[1] for r in rows], ngrams, features)
    assert tfidf.vocabulary == terms
    got = {r["id"]: r["v"] for r in tfidf.transform(df, train.feature_text(df), "v").collect()}
    assert set(df.columns) < set(tfidf.transform(df, train.feature_text(df), "v").columns) and len(got) == len(rows)
    for (i, *_), w in zip(rows, want, strict=True):
        assert type(got[i]).__name__ == "SparseVector" and np.allclose(got[i].toArray(), w, atol=1e-12)
    full = train.stacked(df, tfidf, party=True).select("id", "party", "features", trigger_vector(F.col("text")).alias("t")).collect()
    for r in full:
        assert r["features"].size == len(terms) + 7 and list(r["features"].toArray()[len(terms) :]) == [*r["t"], float((r["party"] or "").lower() == "tenant")]


@pytest.mark.parametrize(("kinds", "balanced"), [(("rent", "pets", "access"), True), (("rent", "pets"), True), (("rent", "pets", "access"), False)])
def test_head_equals_dense_solver(spark, kinds, balanced):
    rows = [r for r in texts(200, 2) if r[2] in kinds]
    df = spark.createDataFrame(rows, "id int, text string, type string, party string")
    model = train.fit_task(df, features=30, c=2.0, triggers=balanced, tol=1e-9)
    x, _ = dense_tfidf([r[1] for r in rows], 1, 30)
    if balanced:
        x = np.hstack([x, [r["t"] for r in df.orderBy("id").select(trigger_vector(F.col("text")).alias("t")).collect()]])
    classes, p, _ = dense_fit(x, [r[2] for r in rows], 2.0, balanced)
    got = model.predict(df).orderBy("id").collect()
    assert model.heads[0][1] == classes and np.abs(np.array([r["p"] for r in got]) - p).max() < 1e-3
    assert [r["y_pred"] for r in got] == [classes[k] for k in np.array([r["p"] for r in got]).argmax(axis=1)]


def test_labels_and_thresholds(spark):
    rows = texts(150, 3)
    df = spark.createDataFrame(rows, "id int, text string, type string, party string")
    df = df.withColumn("label", F.array((F.col("type") == "rent").cast("int"), F.lit(0), (F.col("text").contains("pets")).cast("int")))
    model = train.fit_task(df, "label", ("rent", "never", "pets"), features=30, tol=1e-9)
    x, _ = dense_tfidf([r[1] for r in rows], 1, 30)
    x = np.hstack([x, [r["t"] for r in df.orderBy("id").select(trigger_vector(F.col("text")).alias("t")).collect()]])
    got = model.predict(df).orderBy("id").collect()
    for i, y in ((0, [int(r[2] == "rent") for r in rows]), (2, [int("pets" in r[1]) for r in rows])):
        _, p, _ = dense_fit(x, y, 1.0, True)
        assert np.abs(np.array([r["p"][i] for r in got]) - p[:, 1]).max() < 1e-3
    assert all(r["p"][1] == 0.0 and r["y_pred"][1] == 0 for r in got)
    better = model.calibrated(df)
    y, p = np.array([r["label"][0] for r in got]), np.array([r["p"][0] for r in got])
    f1 = [2 * (y & (p >= round(k * 0.05, 2))).sum() / max(1, y.sum() + (p >= round(k * 0.05, 2)).sum()) for k in range(1, 20)]
    assert better.thresholds["rent"] == round((int(np.argmax(np.round(f1, 6))) + 1) * 0.05, 2)
    assert [r["y_pred"][0] for r in better.predict(df).orderBy("id").collect()] == [int(v >= better.thresholds["rent"]) for v in p]


def test_exported_head(spark):
    """The head table gives what the model gives, for two classes as for three."""
    random.seed(7)
    rows = [(i, [random.gauss(i % 3, 1.0), random.gauss(0.0, 1.0)], "abc"[i % 3]) for i in range(90)]
    for kinds in ("ab", "abc"):
        df = spark.createDataFrame([r for r in rows if r[2] in kinds], "id int, v array<double>, type string")
        data = df.withColumn("features", train.array_to_vector("v"))
        model, classes = train.fit_head(data, "type", c=10.0)
        want = {(r["id"], k): r["p"][i] for r in train.scored(data, model, classes).collect() for i, k in enumerate(classes)}
        for r in classify.probabilities(df, train.export_head(spark, model, classes), "id", "v").collect():
            assert abs(r["p"] - want[r["id"], r["class"]]) < 1e-9


def test_training_odd(spark):
    df = spark.createDataFrame([(1, "one text", "rent"), (2, None, "rent")], "id int, text string, type string")
    assert [r["y_pred"] for r in train.fit_task(df).predict(df).collect()] == ["rent", "rent"]
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, " ", "a")], "id int, text string, type string")
    assert train.fit_task(blank).predict(blank).count() == 3
    some = spark.createDataFrame([(i, "none of it" if i % 4 else "rent is due", "none" if i % 4 else "rent") for i in range(80)], "id int, text string, type string")
    model = train.fit_task(some, negatives=(["id"], 1))
    assert model.predict(some).filter("y_pred = type").count() == 80
    mixed = train.train_rows(some, some.withColumnRenamed("text", "raw_text"))
    assert mixed.count() == 160 and mixed.filter(train.feature_text(mixed) == "").count() == 0
    out = train.fitted_split(spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(50)] + [(99, [0.0, 0.0], 7)], "id int, v array<double>, y int"), "v", "y", ["id"])
    assert out.count() == 10 and out.filter("y = y_pred").count() == 10


def test_weights_by_arrow_and_one_pass(spark):
    """Weights are made on Arrow arrays, not on a Python vector for each row; what was trained on is scored from its written features."""
    rows = spark.createDataFrame(texts(80, 5), "id int, text string, type string, party string")
    model = train.fit_task(rows, ids=("id",), max_iter=20)
    assert set(model.seen.columns) == {"id", "type", "features"}
    plan = model.predict(model.seen)._jdf.queryExecution().toString()
    assert "Tokenizer" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    a, b = ({r["id"]: (r["y_pred"], [round(x, 9) for x in r["p"]]) for r in model.predict(x).collect()} for x in (model.seen, rows))
    assert a == b and len(a) == 80
    words = Counter(w for _, t, _, _ in texts(80, 5) for w in set(re.findall(r"\w\w+", t.lower())))
    for term, weight in zip(model.tfidf.vocabulary, model.tfidf.weights, strict=True):
        assert abs(weight - (math.log(81 / (1 + words[term])) + 1)) < 1e-12


def test_terms_are_counted_on_arrow_and_texts_lowered_once(spark):
    lists = [["b", "a", "b"], [], ["b"], ["c", "a"]]
    batch = train.pa.RecordBatch.from_arrays([train.pa.array(lists, train.pa.list_(train.pa.string()))], names=["t"])
    empty = train.pa.RecordBatch.from_arrays([train.pa.array([[]], train.pa.list_(train.pa.string()))], names=["t"])
    got = [sorted(zip(*b.to_pydict().values(), strict=True)) for b in train._term_counts(iter([batch, empty]))]
    assert got == [[("a", 2, 2), ("b", 3, 2), ("c", 1, 1)], []]
    rows = spark.createDataFrame([(1, "The Tenant SHALL PAY rent"), (2, None)], "id int, text string")
    hits = rows.select("id", trigger_vector(F.upper("text")).alias("v"))
    assert hits._jdf.queryExecution().optimizedPlan().toString().lower().count("lower(") == 1
    assert {r["id"]: sum(r["v"]) > 0 for r in hits.collect()} == {1: True, 2: False}
