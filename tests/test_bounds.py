"""What a task holds, reads or repeats stays bounded."""

from pyspark.sql import functions as F

from clauselake.operators import encode
from clauselake.plans import queries
from clauselake.sources import files
from clauselake.streaming import unit_index


def test_state_without_python(spark, tmp_path):
    """The state of a key is kept by Spark's aggregation; no worker is called for each key."""
    spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, source string, text string").parquet(str(tmp_path / "in"))
    plan = unit_index.updates(stream, "doc_id")._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Pandas" not in plan


def test_micro_batches_are_many_files(spark, tmp_path, monkeypatch):
    """A micro-batch has as many files as the table has splits, so none grows with the table; there are three of them still."""
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("t "), (F.col("id") % 300).cast("string")).alias("text"))
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    monkeypatch.setattr(queries, "scratch", lambda spark, name: made.append(str(tmp_path / name)) or made[-1])
    monkeypatch.setattr(queries, "table", lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet").repartition(5))
    path = queries.kept_index(spark, str(tmp_path))
    assert len(list((tmp_path / "given").glob("part-*"))) == 15 and len(list((tmp_path / "units").glob("batch=*"))) == 3
    got = unit_index.units(unit_index.entries(spark, path)).agg(F.count(F.lit(1)), F.sum("n_occurrences")).first()
    assert tuple(got) == (300, 900)


def test_prompts_are_made_once(spark, sf_dir):
    plan = queries.augmented_pairs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "clause_text" not in plan


def test_many_files_are_read_together(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    monkeypatch.setattr(files, "APART", 1)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4194304")
    try:
        pages, _ = files.read_documents(spark, str(tmp_path))
        assert pages.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and pages.count() == 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_encoder_gets_bounded_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = spark.range(3000).select("id", F.col("id").cast("string").alias("text"))
    assert encode.embed(rows, encode.word_lengths(16)).count() == 3000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == encode.RECORDS
