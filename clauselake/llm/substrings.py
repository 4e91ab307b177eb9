"""Exact removal of repeated substrings by prefix-free parsing.

A text's UTF-8 bytes are parsed into phrases at rolling-hash triggers (a GRAM-byte window whose hash falls in one of PERIOD
classes). Triggers depend on their own bytes only, so equal strings hold equal triggers. A string of `length` bytes
belongs to its first trigger: what lies before it is a suffix of that trigger's phrase, what follows it a prefix of the
parse that continues there. So the order of all such strings in the corpus is the order of (suffix of a dictionary phrase,
rank of the parse's suffix), and a string repeats when another one has an equal phrase suffix of the same length and a
continuation with a long enough common prefix.

1. Every trigger gives a row with a group key, the hash of a stretch that every string it owns contains (the HALF bytes
   after it, or for strings that begin further left the HALF before it), and a hash of its whole context. Long phrases
   also own strings without any trigger: these are keyed by themselves.
2. Groups of one row are dropped. Rows that share a whole context are repeated throughout.
3. What is left are edges of repeated passages: for each distinct context of a group its bytes are fetched, phrases are sorted
   backwards and continuations forwards (suffix arrays of dictionary and parse), and adjacent common lengths give, for
   every offset, classes of equal strings. A group of over HOT contexts (a common line with ever other neighbours) is first
   split: its contexts are keyed again by the bytes that all strings of WIDTHS[0] neighbouring offsets contain, those alone
   under their key drop out, and what is still too large goes on with fewer offsets, down to whole strings, which need no sorting.
4. A document's covered runs are merged and cut out.

Equality in steps 1 and 2 is that of two 64-bit hashes, of a group's stretch (or a string without triggers) and of the whole
context, by different functions; that of split groups likewise; edges are compared byte by byte. Copies of a document meet only in counts, and no pairs are made.
Edge cases: null texts are empty; texts shorter than `length` bytes keep everything; repeated rows repeat each other; matches
do not cross documents; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

GRAM, PERIOD_BITS, SEED = 16, 6, 8
CHUNK = 2_000_000
#: Contexts of a group that one worker sorts, and offsets that share a key where a group has more.
HOT, WIDTHS = 1000, (25, 5, 1)
PLACES = "key long, rk long, n long, tau int, lo int, hi int"
ROWS = "key long, full long, rk long, tau int, lo int, hi int"
SPANS = "array<struct<a:int,b:int>>"
_M = np.uint64(0x9E3779B97F4A7C15)


@cache
def _constants() -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(SEED)
    table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    base = (int(rng.integers(0, 1 << 62)) << 3) | 5
    return table, base, pow(base, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        xs = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        xs[0] = 1
        known = np.cumprod(xs, dtype=np.uint64)
        if n <= 2 * CHUNK:
            _powers[base] = known
    return known[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any stretch of some bytes, from prefix sums of table[byte] * base ** position modulo 2 ** 64."""

    def __init__(self, data: np.ndarray):
        table, base, self.inverse = _constants()
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * _power(base, len(data)), out=self.sums[1:])
        self.back = _power(self.inverse, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def grams(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.back[:-n]


def _digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches by another function than that of the keys."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(data[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)), dtype=np.uint64, count=len(start))


def parsed(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Rows (key, full, document, tau, lo, hi) of documents laid end to end; tau is relative to its document."""
    half, raw = length // 2, data.tobytes()
    if len(data) < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    hashes = Hashes(data)
    starts = np.concatenate([[0], ends[:-1]])
    tau = np.flatnonzero(_mixed(hashes.grams(GRAM)) >> np.uint64(64 - PERIOD_BITS) == 0)
    doc = np.searchsorted(ends, tau, side="right")
    inside = tau + GRAM <= ends[doc]
    tau, doc = tau[inside], doc[inside]
    first = np.ones(len(tau), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    before = np.where(first, starts[doc] - 1, np.concatenate([[-1], tau[:-1]]))  # a string owned by tau begins after this
    reach = length - GRAM  # the farthest a string can begin before its trigger
    hi = np.minimum(tau - before - 1, reach)
    lo = np.maximum(length - (ends[doc] - tau), 0)
    keys, fulls, docs, taus, los, his = [], [], [], [], [], []

    def add(key, full, d, t, a, b):
        for xs, x in zip((keys, fulls, docs, taus, los, his), (key, full, d, t, a, b), strict=True):
            xs.append(x)

    near = (lo <= np.minimum(hi, half)) & (tau + half <= ends[doc])
    t, d, a, b = tau[near], doc[near], lo[near], np.minimum(hi[near], half)
    right = np.minimum(ends[d], t + length)
    add(_mixed(hashes.of(t, t + half)), _mixed(_digests(raw, t - b, right) + (b * 1024 + right - t).astype(np.uint64) * _M), d, t, a, b)
    far = (hi > half) & (lo <= hi)
    t, d, a, b = tau[far], doc[far], np.maximum(lo[far], half + 1), hi[far]
    right = np.minimum(ends[d], t + length - half - 1)
    ok = a <= b
    t, d, a, b, right = t[ok], d[ok], a[ok], b[ok], right[ok]
    add(_mixed(hashes.of(t - half - 1, t + GRAM) + np.uint64(1)), _mixed(_digests(raw, t - b, right) + (b * 1024 + right - t).astype(np.uint64) * _M + np.uint64(1)), d, t, a, b)
    # strings without a trigger: between a trigger (or a document's start) and the next one (or its end)
    gap_from = np.concatenate([before + 1, tau + 1, starts])
    gap_doc = np.concatenate([doc, doc, np.arange(len(ends))])
    nxt = np.full(len(tau), np.iinfo(np.int64).max)
    nxt[:-1] = np.where(doc[1:] == doc[:-1], tau[1:], nxt[:-1])
    has = np.zeros(len(ends), dtype=bool)
    has[doc] = True
    gap_to = np.concatenate([tau - reach - 1, nxt - reach - 1, np.where(has, -1, np.iinfo(np.int64).max)])
    gap_to = np.minimum(gap_to, ends[gap_doc] - length)
    ok = gap_to >= gap_from
    if ok.any():
        pairs = np.unique(np.stack([gap_from[ok], gap_to[ok], gap_doc[ok]], axis=1), axis=0)
        n = pairs[:, 1] - pairs[:, 0] + 1
        d = np.repeat(pairs[:, 2], n)
        t = np.repeat(pairs[:, 0] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key = _mixed(hashes.of(t, t + length) + np.uint64(2))
        zero = np.zeros(len(t), dtype=np.int64)
        add(key, _digests(raw, t, t + length), d, t, zero, zero)
    out = [np.concatenate(x) for x in (keys, fulls, docs, taus, los, his)]
    out[3] = out[3] - starts[out[2]]
    return tuple(out)


def _parse(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw, rk = [(t or "").encode() for t in b["text"]], b["rk"].to_numpy()
            at = 0
            while at < len(raw):
                to, size = at, 0
                while to < len(raw) and (to == at or size + len(raw[to]) <= CHUNK):
                    size += len(raw[to])
                    to += 1
                data = np.frombuffer(b"".join(raw[at:to]), dtype=np.uint8)
                key, full, doc, tau, lo, hi = parsed(data, np.cumsum([len(x) for x in raw[at:to]]), length)
                yield pd.DataFrame({"key": key.astype(np.int64), "full": full.astype(np.int64), "rk": rk[at:to][doc], "tau": tau, "lo": lo, "hi": hi})
                at = to

    return run


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "rk": b["rk"], "blob": [z.compress((t or "").encode()) for t in b["text"]]})


def _unpacked(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _contexts(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rk, blob, places in zip(b["rk"], b["blob"], b["places"], strict=True):
                data = _unpacked(blob)
                for p in places:
                    t, right = p["tau"], length - p["lo"]
                    rows.append((p["key"], rk, p["n"], t, p["lo"], p["hi"], data[t - p["hi"] : t][::-1], data[t : t + right]))
            yield pd.DataFrame(rows, columns=["key", "rk", "n", "tau", "lo", "hi", "left", "right"])

    return run


def _split(length: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every context's offsets in runs of `width`, keyed by the bytes that all strings of such a run contain."""
        from xxhash import xxh3_64_intdigest

        for b in batches:
            rows = []
            for rk, blob, places in zip(b["rk"], b["blob"], b["places"], strict=True):
                data = _unpacked(blob)
                for p in places:
                    t = p["tau"]
                    for k in range(p["lo"] // width, p["hi"] // width + 1):
                        core = data[t - k * width : t + length - (k + 1) * width + 1]
                        key = (xxh3_64_intdigest(core, 1 + k % 1000) + p["key"] * 3) % (1 << 64)
                        rows.append((key - (1 << 64) if key >> 63 else key, rk, p["n"], t, max(p["lo"], k * width), min(p["hi"], (k + 1) * width - 1)))
            yield pd.DataFrame(rows, columns=["key", "rk", "n", "tau", "lo", "hi"])

    return run


def _ranked(xs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each string among the distinct ones in order, and the common prefix of each distinct one with the one before."""
    order = sorted(set(xs))
    rank = {x: i for i, x in enumerate(order)}
    grid = np.zeros((len(order), width), dtype=np.uint8)
    for i, x in enumerate(order):
        grid[i, : len(x)] = np.frombuffer(x[:width], dtype=np.uint8)
    common = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        differ = grid[1:] != grid[:-1]
        sizes = np.array([len(x) for x in order])
        common[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(sizes[1:], sizes[:-1]))
    return np.array([rank[x] for x in xs]), common


def repeated_offsets(left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """For each context (row) and offset before its trigger (column, from min(lo)), whether that string repeats in another context."""
    at, to = int(lo.min()), int(hi.max())
    m = len(left)
    lrank, lcommon = _ranked(left, to)
    rrank, rcommon = _ranked(right, length - at)
    out = np.zeros((m, to - at + 1), dtype=bool)
    wide = max(1, 2_000_000 // m)
    for c in range(at, to + 1, wide):
        offsets = np.arange(c, min(c + wide, to + 1))
        phrase = np.cumsum(lcommon[:, None] < offsets, axis=0)[lrank]
        follow = np.cumsum(rcommon[:, None] < length - offsets, axis=0)[rrank]
        cls = phrase * (m + 1) + follow
        cls = np.where((lo[:, None] <= offsets) & (offsets <= hi[:, None]), cls, -1 - np.arange(m)[:, None])
        order = np.argsort(cls, axis=0, kind="stable")
        ranked = np.take_along_axis(cls, order, axis=0)
        same = ranked[1:] == ranked[:-1]
        hit = np.zeros(cls.shape, dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        np.put_along_axis(out[:, c - at : c - at + len(offsets)], order, hit, axis=0)
    return out


def _edges(group: pd.DataFrame, length: int, rows: list) -> None:
    lo, hi = group["lo"].to_numpy(), group["hi"].to_numpy()
    hit = repeated_offsets(list(group["left"]), list(group["right"]), lo, hi, length)
    at = int(lo.min())
    for i in np.flatnonzero((group["n"].to_numpy() == 1) & hit.any(axis=1)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[i].astype(np.int8), [0]])))
        tau = int(group["tau"].iloc[i])
        for x, y in zip(edge[::2], edge[1::2], strict=True):  # offsets x to y - 1
            rows.append((group["rk"].iloc[i], tau - (at + int(y) - 1), tau - (at + int(x)) + length))


def _resolve(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; a group may continue in the next batch."""
        held: list[pd.DataFrame] = []

        def solved(whole: pd.DataFrame, rows: list) -> None:
            keys = whole["key"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y - x > 1:
                    _edges(whole.iloc[x:y], length, rows)

        for b in batches:
            if not len(b):
                continue
            rows: list = []
            if held and b["key"].iloc[-1] == held[0]["key"].iloc[0]:
                held.append(b)
                continue
            last = b["key"].to_numpy() == b["key"].iloc[-1]
            solved(pd.concat([*held, b[~last]]), rows)
            held = [b[last]]
            yield pd.DataFrame(rows, columns=["rk", "a", "b"])
        if held:
            rows = []
            solved(pd.concat(held), rows)
            yield pd.DataFrame(rows, columns=["rk", "a", "b"])

    return run


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, blob, spans in zip(b["doc_id"], b["blob"], b["spans"], strict=True):
            data, runs = _unpacked(blob), []
            for x, y in sorted((s["a"], s["b"]) for s in spans) if spans is not None else ():
                if runs and x <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], y)
                else:
                    runs.append([x, y])
            kept, at = [], 0
            for x, y in runs:
                kept.append(data[at:x])
                at = y
            rows.append((doc_id, len(data), [{"a": x, "b": y} for x, y in runs], b"".join([*kept, data[at:]])))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])


def _met(rows: DataFrame) -> DataFrame:
    """(key, c) of the keys under which a context that occurs once meets others; c: distinct contexts."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("m")).filter("c > 1 and m = 1").select("key", "c")


def _edge_spans(context: DataFrame, blobs: DataFrame, length: int) -> DataFrame:
    """(rk, a, b) of what contexts (key, n, rk, tau, lo, hi; distinct ones) repeat of each other."""
    found = None

    def fetched(places: DataFrame) -> DataFrame:
        places = places.groupBy("rk").agg(F.collect_list(F.struct("key", "n", "tau", "lo", "hi")).alias("places"))
        return blobs.select("rk", "blob").join(places, "rk")  # contexts of a repeated row come again, but with n > 1: as partners only

    for width in (*WIDTHS, 0):
        sizes = C.stage(_met(context), "sizes")
        keyed = context.join(sizes, "key")  # of two tables, so that Spark can split a large key
        calm = keyed if width == 0 else keyed.filter(F.col("c") <= HOT)
        if width == 0:  # runs of one offset: equal keys are equal strings
            edges = calm.filter("n = 1").select("rk", (F.col("tau") - F.col("lo")).alias("a"), (F.col("tau") - F.col("lo") + length).alias("b"))
            return found.unionByName(edges)
        edges = fetched(calm).mapInPandas(_contexts(length), "key long, rk long, n long, tau int, lo int, hi int, left binary, right binary")
        edges = edges.repartition("key").sortWithinPartitions("key").mapInPandas(_resolve(length), "rk long, a int, b int")
        found = edges if found is None else found.unionByName(edges)
        if not sizes.filter(F.col("c") > HOT).head(1):
            return found
        context = C.stage(fetched(keyed.filter(F.col("c") > HOT)).mapInPandas(_split(length, width), PLACES), "split")


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): spans are the maximal removed runs, kept the bytes that are left."""
    spark = docs.sparkSession
    C.small_batches(spark)
    base = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("rk", F.xxhash64("doc_id", "text"))  # equal rows have equal spans
    rows = base.filter(F.octet_length("text") >= length).select("rk", "text").mapInPandas(_parse(length), ROWS)
    shared = C.stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("g")).filter("g > 1").select("key"), "keys")
    found = C.stage(rows.join(shared, "key"), "shared")
    C.release(shared)
    context = found.groupBy("key", "full").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rk", "tau", "lo", "hi")).alias("r"))
    context = C.stage(context.select("key", "full", "n", "r.*"), "contexts")
    whole = found.join(context.filter("n > 1").select("key", "full"), ["key", "full"])
    whole = whole.select("rk", (F.col("tau") - F.col("hi")).alias("a"), (F.col("tau") - F.col("lo") + length).alias("b"))
    blobs = base.mapInPandas(_packed, "doc_id string, rk long, blob binary").repartition(C.partitions(spark), "rk")
    blobs = C.bucketed(blobs, "blobs", "rk")  # texts move once, however often groups are split
    edges = _edge_spans(context.drop("full"), blobs, length)
    spans = whole.unionByName(edges).groupBy("rk").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    out = blobs.join(spans, "rk", "left").select("doc_id", "blob", "spans").mapInPandas(_cut_out, f"doc_id string, n_bytes long, spans {SPANS}, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))  # ids beside nulls would turn into floats in pandas


def op8_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(C.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
