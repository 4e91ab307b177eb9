"""An index kept up over a stream against one made at once."""

import random

from pyspark.sql import functions as F

from clauselake.operators import index
from clauselake.streaming import unit_index


def test_kept_up_in_batches(spark, tmp_path):
    random.seed(9)
    texts = ["one  text", "one text", "two", " ", None, "three\nlines", "", *[f"t{k}" for k in range(30)]]
    rows = [(i, random.choice(["a", "b", None]), random.choice(texts) if i % 3 else "one text") for i in range(400)]
    schema = "k long, source string, text string"
    given, path, state = (str(tmp_path / x) for x in ("given", "units", "state"))
    order = random.sample(range(400), 400)  # rows do not come in order

    def add(part):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(given)

    def run():
        unit_index.keep(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(given), path, state, "k").awaitTermination()
        return unit_index.units(unit_index.entries(spark, path))

    def shown(df):
        return sorted((r["id"], r["text"], r["n_occurrences"], [str(x) for x in r["sources"]]) for r in df.collect())

    add(order[:150]), add(order[150:200])
    run()
    add(order[200:])
    got = shown(run())
    want = index.unique_units(spark.createDataFrame(rows, schema), ["k"])
    assert got == shown(want) and len(got) > 20
    unit_index.compact(spark, path, str(tmp_path / "small"))
    assert shown(unit_index.units(unit_index.entries(spark, str(tmp_path / "small")))) == got
    # a lookup reads the folders that it needs, and finds texts up to white space
    asked = spark.createDataFrame([(1, "one\ttext"), (2, "absent"), (3, None), (4, " two ")], "q int, text string")
    found = unit_index.lookup(spark, path, asked)
    total = {r["id"]: r["n_occurrences"] for r in want.collect()}
    one, two = (spark.createDataFrame([(t,)], "t string").select(F.sha2("t", 256)).first()[0] for t in ("one text", "two"))
    assert sorted((r["q"], r["n_occurrences"]) for r in found.collect()) == [(1, total[one]), (4, total[two])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    folders = {f.split("bucket=")[1][:2] for f in unit_index.entries(spark, path).inputFiles()}
    assert len(folders) > 10
