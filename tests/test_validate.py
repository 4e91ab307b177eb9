"""Validators row by row, and the encoder's batches."""

import numpy as np
from pyspark.sql import functions as F

from clauselake.operators import encode, validate


def test_redflag_and_span_errors(spark):
    rows = spark.createDataFrame(
        [(1, "a", "rent", "x", "p"), (2, "a", "rent", "", "p"), (3, "b", "odd", "", None), (4, None, "rent", None, None), (5, None, None, "x", "p"), (6, "c", "rent", "x", None)],
        "id int, source string, type string, raw_text string, part string",
    )
    corpus = spark.createDataFrame([("rent",), ("rent",), (None,), ("pets",)], "type string")
    kept, found = validate.redflags(rows, corpus, ["id", "source"])
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 4, 6] and kept.columns == rows.columns
    base = {(2, "missing raw_text"), (3, "type outside vocabulary"), (4, "missing source"), (4, "missing raw_text"), (5, "missing source"), (5, "type outside vocabulary"), (None, "duplicate source")}
    assert {(r["id"], r["error"]) for r in found.collect()} == base
    _, found = validate.spans(rows, corpus, ["id", "source"])
    assert {(r["id"], r["error"]) for r in found.collect()} == base | {(4, "missing part"), (6, "missing part")}
    assert validate.duplicate_sources(rows).collect()[0]["n"] == 2
    assert validate.redflags(rows.limit(0), corpus, ["id", "source"])[1].count() == 0


def test_multilabel_errors(spark):
    one = lambda k: [int(i == k) for i in range(7)]
    rows = spark.createDataFrame(
        [
            (1, "a", one(0), "tenant", ["obl"]), (2, "b", one(6), "landlord", []), (3, "c", one(6), "landlord", ["none"]), (4, "d", one(6), "tenant", ["obl"]), (5, "e", one(1), "tenant", ["obl"]),
            (6, "f", [0] * 7, "tenant", []), (7, "g", [1, 1, 0, 0, 0, 0, 0], None, ["obl"]), (8, "h", [2, 1, 0, 0, 0, 0, 0], "agent", ["ent"]), (9, "i", [1, 0], "tenant", []), (10, "j", None, "tenant", None), (11, "a", one(2), "tenant", None),
        ],
        "id int, source string, label array<int>, party string, deontic_types array<string>",
    )
    got = {(r["id"], r["error"]) for r in validate.multilabel(rows, ["id", "source"]).collect()}
    assert got == {
        (4, "'none' label with types"), (5, "types disagree"), (6, "non-binary label"), (7, "expected exactly one label"), (7, "bad party"), (8, "non-binary label"), (8, "bad party"), (9, "bad label dim"), (10, "bad label dim"), (11, "types disagree"), (None, "duplicate source"),
    }


def test_batches_by_length():
    lengths = np.array([5, 1, 900, 3, 3, 2, 800])
    got = [b.tolist() for b in encode.batches_of(lengths, texts=3, characters=1000)]
    assert got == [[1, 5, 3], [4, 0], [6], [2]] and sorted(i for b in got for i in b) == list(range(7))
    assert list(encode.batches_of(np.array([], dtype=int))) == [] and [len(b) for b in encode.batches_of(np.array([10**9, 10**9]))] == [1, 1]


def test_encoder_is_asked_once_a_text(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def load():
        import uuid

        made = uuid.uuid4().hex

        def encoder(texts):
            (log / f"{made}-{uuid.uuid4().hex}").write_text("\n".join(texts))
            assert [len(t) for t in texts] == sorted(len(t) for t in texts)
            return np.array([[len(t), 1.0] for t in texts])

        return encoder

    rows = spark.createDataFrame([(i, ["a", "bb", None, "", "cccc"][i % 5]) for i in range(50)], "id int, text string").withColumn("h", F.lit("x")).withColumn("t", F.lit(1))
    out = encode.embed(rows, load=load, normalise=False).collect()
    assert {(r["id"], r["v"][0]) for r in out} == {(i, float(len(["a", "bb", "", "", "cccc"][i % 5]))) for i in range(50)} and out[0]["h"] == "x"
    texts = [t for f in log.iterdir() for t in f.read_text().split("\n")]
    assert sorted(texts) == ["", "a", "bb", "cccc"]
