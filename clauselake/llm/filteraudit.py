"""Filter interaction audit: what each of five filters removes in every order of application.

Arrow buffers of whole texts are scanned as bytes: a table of byte classes marks word bytes, capitals, symbols and first bytes of code points;
prefix sums over these marks give the counts per document. Words are hashed by prefix sums of a polynomial, sorted per document, and
neighbours of equal hash are verified byte by byte, so the number of distinct words is exact (a document in which equal hashes meet different
words is counted from its words). What a document fails is one bit mask; masks are counted per part, and the 120 orders are evaluated on counts of
masks alone.

Filters (failure conditions) of a text: A under 100 words; B 100 * distinct words < 80 * words; C 100 * [A-Z] > 10 * code points; D any of
#$%&*|; E identical to the text of any smaller doc_id. Words are maximal runs of other bytes than \\x20 and \\x09-\\x0D, case-sensitive.

Texts move nowhere: rows that are shuffled carry an id, a SHA-256 digest, a part and a mask, and copies are counted before they meet. Edge
cases: null texts are empty; a null part is the empty string; a null doc_id is smaller than none and has no smaller one, so it never fails E;
rows that repeat a doc_id and text are counted each and do not fail E for one another; of repeated labels any 1 counts; null labels are 0;
a text of any length is scanned in slices of SLICE bytes; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
#: Bytes scanned at once; power tables have this length.
SLICE = 1 << 21
WORD, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8


def byte_classes() -> np.ndarray:
    b = np.arange(256)
    white = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
    table = np.where(white, 0, WORD) | np.where((b >= 65) & (b <= 90), CAPITAL, 0) | np.where((b & 0xC0) != 0x80, POINT, 0)
    table[list(SYMBOLS)] |= SYMBOL
    return table.astype(np.uint8)


class Scanner:
    """Counts of words, distinct words, capitals, symbols and code points of many texts in one buffer."""

    def __init__(self, size: int = SLICE, base: int = 0x9E3779B97F4A7C15, classes: np.ndarray | None = None):
        self.size, self.classes = size, byte_classes() if classes is None else classes
        inverse = pow(base, -1, 1 << 64)
        self.power, self.back = (np.cumprod(np.append(np.uint64(1), np.full(size, b, np.uint64)), dtype=np.uint64) for b in (base, inverse))
        self.masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

    def words(self, data: np.ndarray, offsets: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and hashes of all words; none crosses an offset. data has at most `size` bytes."""
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        word = (cls & WORD).astype(bool)
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[inner] |= word[inner]
        last[inner - 1] |= word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.back[starts]
        h ^= h >> np.uint64(29)
        return starts, ends - starts, h * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64)

    def same(self, data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the bytes at a and b are equal; data ends in 8 spare bytes."""
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        out, left = np.ones(len(a), bool), np.arange(len(a))
        for k in range(0, 64, 8):
            if not len(left):
                return out
            keep = self.masks[np.minimum(length[left] - k, 8)]
            out[left] &= ((eight[a[left] + k] ^ eight[b[left] + k]) & keep) == 0
            left = left[length[left] > k + 8]
        for i in left:
            x, y, n = int(a[i]), int(b[i]), int(length[i])
            out[i] &= np.array_equal(data[x : x + n], data[y : y + n])
        return out

    def firsts(self, data: np.ndarray, doc: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word of each hash and document, in sorted order, and the documents in which equal hashes meet different words."""
        order = np.argsort(hashes)
        order = order[np.argsort(doc[order], kind="stable")]
        h, d, s, n = hashes[order], doc[order], starts[order], lengths[order]
        twin = np.flatnonzero((h[1:] == h[:-1]) & (d[1:] == d[:-1]))
        bad = n[twin] != n[twin + 1]
        bad |= ~self.same(data, s[twin], s[twin + 1], np.minimum(n[twin], n[twin + 1]))
        new = np.ones(len(order), bool)
        new[twin + 1] = False
        return order[new], np.unique(d[twin[bad]])

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (words, distinct words, capitals, symbols, code points) of texts that have at most `size` bytes together."""
        n = len(offsets) - 1
        cls = self.classes[data]
        starts, lengths, hashes = self.words(data, offsets, cls)

        def summed(mark: int) -> np.ndarray:
            prefix = np.zeros(len(data) + 1, np.int64)
            np.cumsum((cls & mark) != 0, out=prefix[1:])
            return np.diff(prefix[offsets])

        out = np.empty((n, 5), np.int64)
        out[:, 0] = np.diff(np.searchsorted(starts, offsets))
        out[:, 2:] = np.stack([summed(CAPITAL), summed(SYMBOL), summed(POINT)], axis=1)
        doc = np.repeat(np.arange(n), out[:, 0]).astype(np.uint16 if n < 1 << 16 else np.int64)
        spare = np.concatenate([data, np.zeros(8, np.uint8)])
        kept, bad = self.firsts(spare, doc, starts, lengths, hashes)
        out[:, 1] = np.bincount(doc[kept], minlength=n)
        for i in bad:
            out[i, 1] = len(set(data[offsets[i] : offsets[i + 1]].tobytes().split()))
        return out

    def slices(self, data: np.ndarray):
        """(start, end, giant) of slices that end where words end: of at most `size` bytes, or one word of `size` bytes or more."""
        at = 0
        while at < len(data):
            end, giant = min(at + self.size, len(data)), False
            white = np.flatnonzero((self.classes[data[at:end]] & WORD) == 0)
            if end < len(data) and len(white):
                end = at + int(white[-1]) + 1
            elif not len(white) and end - at == self.size:  # a word of a slice or more: to its end
                giant = True
                while end < len(data) and self.classes[data[end]] & WORD:
                    gap = np.flatnonzero((self.classes[data[end : end + self.size]] & WORD) == 0)
                    end += int(gap[0]) if len(gap) else min(self.size, len(data) - end)
            yield at, end, giant
            at = end

    def long_counts(self, data: np.ndarray) -> np.ndarray:
        """The same of one text of any length, in slices that end at white space; words of `size` bytes or more are told apart by digests."""
        out, giants = np.zeros(5, np.int64), set()
        spare = np.concatenate([data, np.zeros(8, np.uint8)])
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        clash = False
        for at, end, giant in self.slices(data):
            part = data[at:end]
            cls = self.classes[part]
            out[2:] += [np.count_nonzero(cls & m) for m in (CAPITAL, SYMBOL, POINT)]
            if giant:
                giants.add(hashlib.sha256(part).digest())
                out[0] += 1
            else:
                starts, lengths, hashes = self.words(part, np.array([0, len(part)]), cls)
                out[0] += len(starts)
                new = [np.concatenate(x) for x in zip(kept, (starts + at, lengths, hashes), strict=True)]
                pick, bad = self.firsts(spare, np.zeros(len(new[0]), np.uint8), *new)
                clash |= bool(len(bad))
                kept = [x[pick] for x in new]
        out[1] = len(set(data.tobytes().split())) if clash else len(kept[0]) + len(giants)
        return out


def masks(counts: np.ndarray) -> np.ndarray:
    """Bits 1, 2, 4, 8 for failing A, B, C, D."""
    words, distinct, capitals, symbols, points = counts.T
    return (words < FEW_WORDS) * 1 | (100 * distinct < DISTINCT_PERCENT * words) * 2 | (100 * capitals > CAPITAL_PERCENT * points) * 4 | (symbols > 0) * 8


def scan(scanner: Scanner, texts) -> tuple[np.ndarray, list[bytes]]:
    """Counts and digests of an Arrow array of texts, read from its buffers."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out, digests = np.zeros((n, 5), np.int64), [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets, offsets[1:], strict=False)]
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + scanner.size, side="right")) - 1  # texts i to j - 1 have at most a slice of bytes
        if j <= i:
            out[i] = scanner.long_counts(data[offsets[i] : offsets[i + 1]])
            i += 1
        else:
            j = min(j, n)
            out[i:j] = scanner.counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j
    return out, digests


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, words, distinct, capitals, symbols, points, mask) per row of docs."""
    C.small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        scanner = Scanner()
        for b in batches:
            counts, digests = scan(scanner, b.column(2))
            cols = [b.column(0), b.column(1), pa.array(digests, pa.binary()), *(pa.array(c) for c in counts.T), pa.array(masks(counts).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=NAMES)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, words long, distinct long, capitals long, symbols long, points long, mask int")


NAMES = ["doc_id", "part", "digest", "words", "distinct", "capitals", "symbols", "points", "mask"]


def mask_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents that fail exactly the filters of a mask (bits 1 to 16 for A to E)."""
    rows = scanned(docs, doc_id, text, part).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).filter("id is not null")
    known = known.groupBy("id").agg(F.coalesce(F.max(F.col("q") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("t") == 1), F.lit(False)).alias("toxic")).withColumn("spread", F.lit(0))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0).alias("spread")  # rows without an id meet no label and are dealt out
    rows = rows.select("*", spread).withColumnRenamed("doc_id", "id").join(known, ["id", "spread"], "left").na.fill(False, ["good", "toxic"])
    # of one text's rows, those of the smallest id do not fail E
    some = F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)
    kinds = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(some).alias("some"), F.min("id").alias("first"), F.min_by("n", "id").alias("at_first"))
    least = F.min("first").over(Window.partitionBy("digest"))
    late = (F.col("some") - F.when(F.col("first") == least, F.col("at_first")).otherwise(0)).alias("late")
    kinds = kinds.select("part", "mask", "good", "toxic", "n", late)
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("late")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("late").alias("n")))
    split = kinds.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    return split.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def steps(spark: SparkSession) -> DataFrame:
    """(mask, filter_order, step, bit, before): every step of every order for every mask, 19,200 rows at any size of the input."""
    orders = [(o, k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(c) for c in o[:k])) for o in map("".join, permutations(FILTERS)) for k in range(len(o))]
    fixed = spark.createDataFrame(orders, "filter_order string, step int, bit int, before int").coalesce(1)
    return fixed.select(F.explode(F.sequence(F.lit(0), F.lit(31))).alias("mask"), "*")


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    counts = mask_counts(docs, labels, **columns)
    at = counts.join(F.broadcast(steps(spark)), "mask")
    n, mask, bit, before = F.col("n"), F.col("mask"), F.col("bit"), F.col("before")
    fails, gone = mask.bitwiseAND(bit) > 0, mask.bitwiseAND(before) > 0
    removed = fails & ~gone

    def total(when, what=n):
        return F.sum(F.when(when, what).otherwise(0)).cast("long")

    orders = 120
    share = n * (F.lit(orders) / F.bit_count(mask)).cast("long")  # a document is removed first by each filter that it fails in as many orders
    return at.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(removed).alias("removed"), total(fails & gone).alias("redundant"), total(mask == bit).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"), total(removed & F.col("toxic")).alias("toxic_lost"), total(fails, share).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, min(doc_id) over (partition by t) as first from d),
m as (select part, doc_id,
    case when len(words) < 100 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > first then 16 else 0 end as mask from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
c as (select part, mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, count(*) as n from m left join l using (doc_id) group by all),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(f, b)),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from f a, f b, f c, f d, f e
    where len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, (select unnest(range(1, 6)) as step)),
r as (select part, filter_order, step::int as step, bit,
    sum(case when mask & (bit | before) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end)::bigint as removed,
    sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
    sum(case when mask & bit > 0 and mask & before = 0 then n * good else 0 end)::bigint as good_lost,
    sum(case when mask & bit > 0 and mask & before = 0 then n * toxic else 0 end)::bigint as toxic_lost
    from c, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) over (partition by part, bit)::bigint as shapley
from r
"""
