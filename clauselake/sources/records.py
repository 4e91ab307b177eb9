"""JSON-lines and CSV corpora with explicit schemas, discovery of complete output folders, and saved indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

SCHEMAS = {
    "sections": "source string, section_idx int, text string, raw_text string, type string, start int, `end` int",
    "sentences": "source string, sentence_idx int, party string, text string",
    "manifest": "source string, path string, n_pages int, methods array<string>, pages_by_method map<string,int>, n_error_pages int, error_pages array<int>, chars int, n_sections int, n_sentences int, elapsed_s double",
    "units": "id string, text string, n_occurrences long, sources array<string>",
    "redflags": "source string, text string, raw_text string, type string, start int, `end` int",
    "deontic": "source string, sentence_idx int, party string, text string, label array<int>, deontic_types array<string>, spans map<string,array<array<int>>>, split string",
    "chat": "messages array<struct<role:string,content:string>>, source string, rule_id string",
}
# The files that make an output folder complete.
COMPLETE = ("manifest.json", "sections.jsonl", "sentences.jsonl")


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """One object per line; blank lines are skipped and bad JSON fails. With missing_ok an absent path is an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], schema)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with header, quoted and multi-line fields; every column is a string."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def complete_outputs(spark: SparkSession, root: str) -> DataFrame:
    """(dir): folders below root that hold all files of COMPLETE, in order. Only the files' names are looked at."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    folders = found.filter(F.col("name").isin(*COMPLETE)).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.count_distinct("name").alias("n"))
    return folders.filter(F.col("n") == len(COMPLETE)).select("dir").orderBy("dir")


def save_embeddings(rows: DataFrame, path: str, model: str, dim: int) -> None:
    """Unit vectors (id, embedding) and one row of metadata."""
    rows.write.parquet(f"{path}/vectors")
    rows.sparkSession.createDataFrame([(model, dim)], "model string, dim int").write.parquet(f"{path}/meta")


def load_embeddings(spark: SparkSession, path: str, model: str | None = None, dim: int | None = None) -> DataFrame:
    meta = spark.read.parquet(f"{path}/meta").first()
    if model is not None and meta["model"] != model or dim is not None and meta["dim"] != dim:
        raise ValueError(f"the index holds {meta['model']} vectors of length {meta['dim']}")
    return spark.read.parquet(f"{path}/vectors")


UNITS = "id string, text string, n_occurrences long, sources array<string>"
MANIFEST = "doc_id long, source string, chars long, n_sections long, n_sentences long, sha256 string"


def save_index(documents: DataFrame, sections: DataFrame, sentences: DataFrame, path: str) -> None:
    """The three tables of an index, as JSON lines."""
    for name, rows in (("documents", documents), ("sections", sections), ("sentences", sentences)):
        write_jsonl(rows, f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sections, sentences) of a saved index; a table that was never written is empty."""
    return read_jsonl(spark, f"{path}/documents", MANIFEST, missing_ok=True), *(read_jsonl(spark, f"{path}/{n}", UNITS, missing_ok=True) for n in ("sections", "sentences"))


def load_units(spark: SparkSession, path: str) -> DataFrame:
    """First-seen units as unique_units gives them and write_jsonl wrote them."""
    return read_jsonl(spark, path, UNITS)


def save_head(head: DataFrame, path: str, threshold: float = 0.3, margin: float | None = None) -> None:
    head.withColumn("threshold", F.lit(threshold)).withColumn("margin", F.lit(margin).cast("double")).write.parquet(path)


def load_head(spark: SparkSession, path: str) -> tuple[DataFrame, float, float]:
    """The linear head with its threshold and margin; older ones have no margin and get 0.3."""
    rows = spark.read.parquet(path)
    got = rows.select("threshold", F.coalesce("margin", F.lit(0.3)).alias("margin") if "margin" in rows.columns else F.lit(0.3).alias("margin")).first()
    return rows.drop("threshold", "margin"), got["threshold"], got["margin"]


def merge_annotations(*parts: DataFrame) -> DataFrame:
    """(doc, per annotator flags) of tables (doc, annotator, risk_flags), in order: a later table overwrites the same key."""
    rows = None
    for i, p in enumerate(parts):
        one = p.select("doc", "annotator", "risk_flags", F.lit(i).alias("o"))
        rows = one if rows is None else rows.unionByName(one)
    last = rows.groupBy("doc", "annotator").agg(F.max_by("risk_flags", "o").alias("risk_flags"))
    return last.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("annotator", "risk_flags"))).alias("flags")).select("doc", "flags")
