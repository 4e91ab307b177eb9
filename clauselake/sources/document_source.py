"""A data source of document files: spark.dataSource.register(DocumentSource); spark.read.format("clause_documents").load(folder).

Files are packed into partitions by bytes, in the order of their paths, and a task holds one file at a time, where batches of whole files would
hold many. The folder must be one that Python sees on driver and executors (a shared mount); for other stores there is files.read_documents.

Options: path; partition_bytes (64 MB), open_bytes that each file counts at least (1 MB). Text, markdown and word-processing files give their
page, PDFs and images an error page (their readers are plug-ins of read_documents), other kinds nothing. A file that cannot be read is an
error page; an empty folder gives no rows; a missing one is an error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import IMAGE_SUFFIXES, PAGES, TEXT_SUFFIXES, file_pages, suffix

KNOWN = (*TEXT_SUFFIXES, *IMAGE_SUFFIXES, "docx", "pdf")


def local(path: str) -> str:
    """A path as Python opens it."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: not a mounted folder")
    return path


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def packed(files: list[tuple[str, int]], partition_bytes: int, open_bytes: int) -> list[Files]:
    """Runs of files of at most partition_bytes, or one larger file."""
    out, run, held = [], [], 0
    for path, size in files:
        cost = max(size, open_bytes)
        if run and held + cost > partition_bytes:
            out.append(Files(tuple(run)))
            run, held = [], 0
        run.append(path)
        held += cost
    return [*out, Files(tuple(run))] if run else out


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = local(options["path"])
        self.partition_bytes, self.open_bytes = int(options.get("partition_bytes", 64 << 20)), int(options.get("open_bytes", 1 << 20))

    def partitions(self) -> list[Files]:
        if not os.path.isdir(self.path):
            raise FileNotFoundError(self.path)
        found = [(os.path.join(d, n), os.path.getsize(os.path.join(d, n))) for d, _, names in os.walk(self.path) for n in names if not n.startswith((".", "_")) and suffix(n) in KNOWN]
        return packed(sorted(found), self.partition_bytes, self.open_bytes)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths if partition is not None else ():  # without partitions Spark reads once, of none
            try:
                with open(path, "rb") as f:
                    pages = file_pages(path, f.read())
            except OSError:
                pages = [("", "", "")]
            for i, (text, _, method) in enumerate(pages):
                blank = not text.strip()
                yield os.path.basename(path), path, i, "" if blank else text, "error" if blank or not method else method


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clause_documents"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)
