"""WARC archives with a two-level capture index.

Archives: one record per page, uncompressed WARC/1.1 files written by Spark's text writer (a record ends in CR LF CR LF, whose
last LF is the writer's line end), so they can lie in any store. Of records with equal payloads of at least `least` bytes
the smallest page id is a response and the others are revisits of it.

Index: the archives are scanned once; every capture's line (reversed-host URL key, date, place in the archive, digest) is
range-sorted by key into blocks of BLOCK lines, compressed each. A sparse directory keeps every block's first key. A lookup
finds the last directory entry up to the key, searches the block's lines by bisection, and reads the record's byte
range from the archive: lookup() for one URL from the driver, resolve() for a table of URLs in tasks. resolve() searches the directory in
slices of ENTRIES, meets each block with the keys it may hold in one sorted stream, and reads the ranges of an archive in their order; its
workers open the archives by pyarrow, so spark.checkpoint.dir must be in a store that pyarrow opens too (local or mounted folders, HDFS
with its libraries, S3, GCS).

Edge cases: a null html is an empty payload; a null url has the key "-"; repeated rows with the smallest id are all responses;
null page ids never name a response unless all of a payload's are null; odd bytes in URLs are percent-encoded, and looked up so; an empty
table gives empty archives and no captures; a URL that occurs often is looked up once, and each of its captures is given once; URLs without
a capture give no row; only the named columns are read.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from base64 import b32encode
from collections.abc import Callable, Iterator
from contextlib import closing
from hashlib import md5, sha1
from urllib.parse import quote, urlsplit
from uuid import UUID, uuid4

import pandas as pd
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BLOCK, RECORDS = 3000, 2000
#: Repeated payloads, at about 100 bytes each, that may be sent to all executors.
BROADCAST = 50_000
#: Directory entries, at about 100 bytes each, that are searched at once.
ENTRIES = 100_000
DATE = "2024-01-01T00:00:00Z"
LINES = "key string, date string, file string, offset long, length long, page_id long, type string, refers_to long, digest string, payload long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """Reversed-host form: http://www.a.com:80/x?q becomes com,a,www)/x?q."""
    if not url:
        return "-"
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return quote(url.lower(), safe=":/?&=#%,)")
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    at = f":{port}" if port and port != {"http": 80, "https": 443}.get(u.scheme) else ""
    return quote(f"{','.join(reversed(host.split('.')))}{at}){tail}", safe=":/?&=#%,)")


def target(url: str | None) -> str:
    """A URL as a record's header states it."""
    return quote(url or "about:blank", safe=":/?&=#%+,;@!$()*~")


def capture_key(uri: str) -> str:
    """The index key of a header's URI."""
    return surt(None if uri == "about:blank" else uri)


def digest(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: str) -> str:
    return f"<urn:uuid:{UUID(bytes=md5(f'{page_id} {sha}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, html: str | None, first: int | None) -> bytes:
    """A response, or a revisit of page `first` if that is given."""
    payload = (html or "").encode()
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {target(url)}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http;msgtype=response"]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, sha)}", f"X-Refers-To-Page: {first}"]
    head += [f"X-Page: {'' if page_id is None else page_id}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of the records from an offset on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        body = end + 4
        stop = body + int(head["content-length"])
        yield at, stop + 4 - at, head, data[body:stop]
        at = stop + 4


def described(head: dict[str, str], block: bytes) -> dict:
    """What the index keeps of a record; a response's payload and digest are taken from its bytes."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length")))
    sha = digest(payload) if head["warc-type"] == "response" else head["warc-payload-digest"].removeprefix("sha1:")
    number = lambda x: int(x) if x else None
    return {"page_id": number(head["x-page"]), "type": head["warc-type"], "refers_to": number(head.get("x-refers-to-page")), "digest": sha, "payload": len(payload) if head["warc-type"] == "response" else size}


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        number = lambda x: None if x is None or x != x else int(x)
        rows = (record(number(i), u, h, number(f)) for i, u, h, f in zip(b["page_id"], b["url"], b["html"], b["first"], strict=True))
        yield pd.DataFrame({"value": [x[:-1] for x in rows]})  # the writer adds the last byte


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            rows = [(capture_key(h["warc-target-uri"]), h["warc-date"], path, at, n, json.dumps(described(h, block))) for at, n, h, block in parse(content)]
            yield pd.DataFrame(rows, columns=["key", "date", "file", "offset", "length", "fields"])


def write(pages: DataFrame, root: str, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes the archives of pages under root/archive."""
    C.small_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html")).withColumn("sha", F.sha1("html"))
    first = rows.groupBy("sha", "size").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("size") >= least))
    first = C.cut(first.select("sha", "size", "least"))
    if first.count() <= BROADCAST:  # else pages move to meet the payloads that repeat
        first = F.broadcast(first)
    rows = rows.join(first, ["sha", "size"], "left").withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")))
    text = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  beside nulls pandas would turn ids into floats
    rows.select(text("page_id"), "url", "html", text("first")).mapInPandas(_records, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", RECORDS).text(f"{root}/archive")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in C.groups(batches, ["block"]):
        lines = [f"{k} {d} {json.dumps([f, o, n])} {x}" for k, d, f, o, n, x in zip(g["key"], g["date"], g["file"], g["offset"], g["length"], g["fields"], strict=True)]
        yield pd.DataFrame({"block": [g["block"].iloc[0]], "first_key": [g["key"].iloc[0]], "lines": [len(g)], "data": [zlib.compress("\n".join(lines).encode(), 6)]})


def build_index(spark: SparkSession, root: str) -> None:
    """Scans the archives and writes root/index (blocks) and root/directory."""
    files = spark.read.format("binaryFile").load(f"{root}/archive").filter("length > 0").select("path", "content")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "8")  # a row is a file
    captures = C.stage(files.mapInPandas(_scan, "key string, date string, file string, offset long, length long, fields string"), "captures")
    spark.conf.set(batch, before)
    order = [F.col(c) for c in ("key", "date", "file", "offset")]
    lines = C.numbered(captures, order, "at").withColumn("block", F.floor(F.col("at") / BLOCK))
    n = max(1, C.partitions(spark))
    blocks = lines.repartition(n, "block").sortWithinPartitions("block", "at").mapInPandas(_packed, "block long, first_key string, lines long, data binary")
    blocks.write.parquet(f"{root}/index")
    spark.read.parquet(f"{root}/index").select("first_key", "block", "lines").write.parquet(f"{root}/directory")


def unpacked(data: bytes) -> list[tuple[str, str, list, dict]]:
    out = []
    for line in zlib.decompress(data).decode().split("\n"):
        key, date, rest = line.split(" ", 2)
        place, end = json.JSONDecoder().raw_decode(rest)
        out.append((key, date, place, json.loads(rest[end:])))
    return out


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for data in b["data"]:
            rows = [(k, d, f, o, n, x["page_id"], x["type"], x["refers_to"], x["digest"], x["payload"]) for k, d, (f, o, n), x in unpacked(data)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")])
            for c in ("page_id", "refers_to"):
                out[c] = pd.array([r[5 if c == "page_id" else 7] for r in rows], dtype="Int64")
            yield out


def captures(spark: SparkSession, root: str) -> DataFrame:
    """All captures, from the index."""
    return spark.read.parquet(f"{root}/index").select("data").mapInPandas(_opened, LINES)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"key": [capture_key(target(u)) for u in b["url"]]}, dtype="object")


def _placed(firsts, start: int) -> Callable:
    """For each key the blocks that may hold it, by bisection in a slice of the directory that starts at block `start`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = firsts.value
        for b in batches:
            low = [start + max(bisect.bisect_left(f, k) - 1, 0) for k in b["key"]]
            high = [start + bisect.bisect_right(f, k) - 1 for k in b["key"]]
            yield pd.DataFrame({"key": b["key"], "low": low, "high": high})

    return run


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of the captures of keys, from rows sorted by block, where the block itself comes before the keys it may hold."""
    lines: list = []
    for b in batches:
        places = []
        for key, data in zip(b["key"], b["data"], strict=True):
            if data is not None:
                lines = unpacked(data)
                if len(places) > BLOCK:  # one key may fill many blocks
                    yield pd.DataFrame(places, columns=["file", "offset", "length"])
                    places = []
                continue
            at = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while at < len(lines) and lines[at][0] == key:
                places.append(lines[at][2])
                at += 1
        yield pd.DataFrame(places, columns=["file", "offset", "length"])


def _opened_file(uri: str):
    """A file that a worker can seek in; local paths may come without a host and unescaped."""
    store, path = stores.FileSystem.from_uri(re.sub("^file:/+", "/", uri))
    return store.open_input_file(path)


def _fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records of byte ranges, from rows sorted by file; digests of responses are taken from the bytes that were read."""
    for b in batches:
        rows = []
        for file, part in b.groupby("file", sort=False):
            with closing(_opened_file(file)) as stream:
                for at, n in zip(part["offset"], part["length"], strict=True):
                    stream.seek(at)
                    _, _, head, block = next(parse(stream.read(n)))
                    rows.append(described(head, block))
        out = pd.DataFrame(rows, columns=["page_id", "type", "refers_to", "digest", "payload"])
        for c in ("page_id", "refers_to"):
            out[c] = pd.array([r[c] for r in rows], dtype="Int64")
        yield out


def resolve(spark: SparkSession, root: str, urls: DataFrame, url: str = "url") -> DataFrame:
    """(page_id, type, refers_to, digest, payload) of all captures of a table's URLs, through directory, blocks and byte ranges."""
    C.small_batches(spark)
    n = max(1, C.partitions(spark))
    keys = C.stage(urls.select(F.col(url).cast("string").alias("url")).distinct().mapInPandas(_keys, "key string").distinct(), "keys")
    directory, places = spark.read.parquet(f"{root}/directory"), None
    for start in range(0, directory.count(), ENTRIES):
        entries = directory.filter(F.col("block").between(start, start + ENTRIES)).orderBy("block").select("first_key").collect()
        firsts = [r[0] for r in entries]
        here = keys.filter(F.col("key") >= firsts[0])
        if len(firsts) > ENTRIES:  # a key that the next slice starts with may begin in this one's last block
            here = here.filter(F.col("key") <= firsts.pop())
        some = here.mapInPandas(_placed(spark.sparkContext.broadcast(firsts), start), "key string, low long, high long")
        places = some if places is None else places.unionByName(some)
    if places is None:
        return spark.createDataFrame([], "page_id long, type string, refers_to long, digest string, payload long")
    asked = places.select(F.explode(F.sequence("low", "high")).alias("block"), "key", F.lit(None).cast("binary").alias("data"))
    blocks = spark.read.parquet(f"{root}/index").select("block", F.lit(None).cast("string").alias("key"), "data")
    met = blocks.unionByName(asked).repartition(n, "block").sortWithinPartitions("block", F.asc_nulls_first("key"))
    found = met.select("key", "data").mapInPandas(_searched, "file string, offset long, length long")
    return found.repartition(n, "file").sortWithinPartitions("file", "offset").mapInPandas(_fetched, "page_id long, type string, refers_to long, digest string, payload long")


def lookup(spark: SparkSession, root: str, url: str) -> list[tuple[dict, bytes]]:
    """(index fields, record block) of a URL's captures: directory, block, then a range read of the archive."""
    key, found = capture_key(target(url)), []
    directory = spark.read.parquet(f"{root}/directory")
    last = directory.filter(F.col("first_key") < key).agg(F.max("block")).first()[0]
    block = 0 if last is None else last
    while True:
        row = spark.read.parquet(f"{root}/index").filter(F.col("block") == block).select("data").first()
        if row is None:
            return found
        lines = unpacked(bytes(row["data"]))
        at = bisect.bisect_left(lines, key, key=lambda x: x[0])
        while at < len(lines) and lines[at][0] == key:
            _, _, (file, offset, length), fields = lines[at]
            found.append((fields, next(parse(read_range(spark, file, offset, length)))[3]))
            at += 1
        if at < len(lines):
            return found
        block += 1  # the key may go on in the next block


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """Bytes of a file in any store that Spark reaches."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        return bytes(stream.readNBytes(length))
    finally:
        stream.close()


def op7_warc_index(spark, sf_dir: str) -> DataFrame:
    root, pages = f"{C.shared_dir(spark)}/warc-{uuid4().hex}", C.table(spark, sf_dir, "pages")
    C.forget_later(spark, root)
    write(pages, root)
    build_index(spark, root)
    return resolve(spark, root, pages).select(
        "page_id", F.col("payload").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )
