"""Document files to page rows: text and markdown, word-processing files, and pluggable readers for PDFs and images."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .scratch import scratch

# Suffixes, the least length of a text layer, and the scale at which a page is drawn for recognition.
TEXT_SUFFIXES = ("txt", "md", "")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
LEAST_TEXT, SCALE = 40, 2.0
#: Splits of files that one task reads where there are very many (Spark counts a small file as 4 MB), and splits for each core that stay apart.
TOGETHER, APART = 32, 8
PAGES = "source string, path string, page_idx int, text string, method string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

#: A page reader takes a file's bytes and gives (text layer, recognised text) per page; it is called on executors.
PageReader = Callable[[bytes], list[tuple[str, str]]]


def chosen_text(layer: Column, recognised: Column) -> Column:
    """Struct (text, method): the text layer if long enough, else recognised text, else a short layer, else an error."""
    layer, recognised = F.coalesce(layer, F.lit("")), F.coalesce(recognised, F.lit(""))
    long, seen, short = F.length(strip(layer)) >= LEAST_TEXT, strip(recognised) != "", strip(layer) != ""
    return F.struct(
        F.when(long, layer).when(seen, recognised).when(short, layer).otherwise("").alias("text"), F.when(long, "text").when(seen, "ocr").when(short, "text").otherwise("error").alias("method")
    )


def _run_text(block: ElementTree.Element) -> str:
    """Text of a block's runs; tabs and breaks inside them count."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in block.iter())


def docx_text(data: bytes) -> str:
    """Lines of a word-processing file: the body's paragraphs, then its tables' rows (cells joined by ' | '), then headers, then footers; blank
    ones are left out."""
    lines: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        blocks = list(body) if body is not None else []
        lines += [_run_text(p) for p in blocks if p.tag == f"{_W}p"]
        for row in (r for t in blocks if t.tag == f"{_W}tbl" for r in t.iter(f"{_W}tr")):
            cells = ["\n".join(_run_text(p) for p in c.iter(f"{_W}p")).strip() for c in row.iter(f"{_W}tc")]
            lines.append(" | ".join(c for c in cells if c))
        for kind in ("header", "footer"):
            for name in sorted(n for n in z.namelist() if n.startswith(f"word/{kind}")):
                lines += [_run_text(p) for p in ElementTree.fromstring(z.read(name)).iter(f"{_W}p")]
    return "\n".join(x.strip() for x in lines if x.strip())


def docx_bytes(lines: list[str]) -> bytes:
    """A word-processing file of plain paragraphs."""
    from xml.sax.saxutils import escape

    space = _W.strip("{}")
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def file_pages(path: str, data: bytes, pdf: PageReader | None = None, image: PageReader | None = None) -> list[tuple[str, str, str]]:
    """(text layer, recognised text, method) of a file's pages; the method is open ('') where a reader for pages decides."""
    kind = suffix(path)
    try:
        if kind in TEXT_SUFFIXES:
            return [(data.decode("utf-8", errors="replace"), "", "raw")]
        if kind == "docx":
            return [(docx_text(data), "", "paragraphs")]
        reader = pdf if kind == "pdf" else image
        return [(a, b, "") for a, b in reader(data)] if reader else [("", "", "")]
    except Exception:  # noqa: BLE001 - a broken file or page is a row with method error, not a failed job
        return [("", "", "")]


def _read(pdf: PageReader | None, image: PageReader | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p.rsplit("/", 1)[-1], p, i, a, o, m) for p, c in zip(b["path"], b["content"], strict=True) for i, (a, o, m) in enumerate(file_pages(p, c, pdf, image))]
            yield pd.DataFrame(rows, columns=["source", "path", "page_idx", "layer", "ocr", "fixed"])

    return run


def _empty(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, length, content) of the files without bytes, which Spark lists but never reads: those listed whose path is not among the found
    ones, written once. The listing stays in the JVM, where Spark holds it."""
    spark, jvm = files.sparkSession, files.sparkSession.sparkContext._jvm
    listed = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles())
    paths = spark.sparkContext._jsc.parallelize(jvm.scala.jdk.javaapi.CollectionConverters.asJava(listed))
    rows = DataFrame(spark._jsparkSession.createDataset(paths.rdd(), jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    decoded = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))
    rows = rows.select(F.regexp_replace(decoded, "^([^:/]+):///", "$1:/").alias("path"))  # as Spark writes paths without a host
    own = F.element_at(F.split("path", "/"), -1).rlike("^([.]|_[^=]*$)")  # listed, but taken for Spark's
    at = scratch(spark, "empty")
    rows.filter(~own).join(found, "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")).write.parquet(at)
    return spark.read.parquet(at)


def read_documents(spark: SparkSession, path: str, pdf: PageReader | None = None, image: PageReader | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, rejected): pages of all supported files under a path, and the files of unknown kinds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    splits, apart = files.rdd.getNumPartitions(), APART * spark.sparkContext.defaultParallelism
    if splits > apart:
        files = files.coalesce(max(apart, splits // TOGETHER))
    empty, files = _empty(files, files.select("path")), files.select("path", "length", "content")
    if not empty.isEmpty():
        files = files.unionByName(empty)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    known = kind.isin(*TEXT_SUFFIXES, *IMAGE_SUFFIXES, "docx", "pdf")
    rows = files.filter(known).select("path", "content").mapInPandas(_read(pdf, image), "source string, path string, page_idx int, layer string, ocr string, fixed string")
    made = chosen_text(F.col("layer"), F.col("ocr"))
    blank = strip(F.col("layer")) == ""
    text = F.when(F.col("fixed") == "", made["text"]).otherwise(F.when(blank, "").otherwise(F.col("layer")))
    method = F.when(F.col("fixed") == "", made["method"]).otherwise(F.when(blank, "error").otherwise(F.col("fixed")))
    return rows.select("source", "path", "page_idx", text.alias("text"), method.alias("method")), files.filter(~known).select("path", "length")
