"""Phrase collocation mining: phrases of two to four words that occur more often than their parts suggest, per language.

Three passes over whole texts. The first counts hashes of words and pairs per shard, the second those of triples whose pairs are frequent; counts are
summed over shards, and hashes that reach the least count make a bit filter of bounded size. A filter lets through all that is frequent (equal
hashes only raise a count), so nothing is lost. The third builds count tries of depth four per shard, over what the filters pass: level k holds (node of level k - 1, word) and a count,
and a trie is written in sorted order as (lang, w1, w2, w3, w4, n). Ranges of prefixes are then merged: tries of all shards
are dealt by ranges of (lang, w1 to w4), sorted, and equal paths added; what stays are the nodes with f >= least, exact since
words are compared by their bytes. A walk over each sorted range gives every phrase the counts of its left parts (its ancestors; those of
a range's first path may lie in earlier ranges and are looked up, three a range). Suffix links, from a phrase to itself without its first word,
are joins of neighbouring levels and carry the counts of right parts along.

Definitions: A-Z is lower-cased, texts are cut at [.,;:!?\\x0A-\\x0D] into pieces and those into words [^\\x20\\x09]+; f counts occurrences within
pieces, overlaps included. A cut of a phrase after k words scores floor(2,000,000 a / (l + r)), a = f(phrase), l = f(first k words), r = f(rest); the
lowest-scoring cut counts, of ties the smallest k. A phrase is dropped if a longer one of four words at most, itself dropped or not, holds its
words side by side and has 100 f >= 80 a. Of the rest the first `top` of each language stay, by score and a descending, then phrase by bytes.

Edge cases: null texts are empty; a null lang is 'und'; texts of any length are scanned in slices and their phrases may cross them; repeated
rows count each; no phrase, no rows; other columns are ignored, whatever their names. The filter has at most 2^28 bits (32 MB, broadcast);
beyond some 10^7 frequent pairs it lets more pass, which costs work in later passes and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .filteraudit import POINT, WORD, Scanner

LEAST, TOP, SHARE, DEPTH, SCALE = 30, 2000, 80, 4, 2_000_000
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Words that a worker holds before it writes what it has counted.
HELD = 1 << 20
MOST_BITS = 28
BREAK = 2
PATH = ["w1", "w2", "w3", "w4"]


def byte_classes() -> np.ndarray:
    table = np.full(256, WORD | POINT, np.uint8)
    table[[0x20, 0x09]] = 0
    table[list(SEPARATORS)] = BREAK
    return table


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each hash in a filter of 2^bits bits."""
    x = h * np.uint64(0x9E3779B97F4A7C15)
    y = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return [v >> np.uint64(64 - bits) for v in (x, y, x + y)]


class Bits:
    """A bit filter over hashes."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, (len(words) * 64).bit_length() - 1

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in places(h, self.bits):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


class Words:
    """Words of many texts: hashes (of lang and word), bytes, and whether the next word follows in the same piece. A text may be longer
    than what is held at once: ready() then keeps its last words for the next time, as phrases may begin in them."""

    def __init__(self, size: int | None = None):
        self.classes = byte_classes()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.scanner = Scanner(classes=self.classes) if size is None else Scanner(size, classes=self.classes)
        self.langs: dict[str, int] = {}
        self.lang_hash = np.zeros(0, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.data: list[np.ndarray] = []
        self.held = self.bytes = 0

    def lang(self, name: str) -> int:
        if name not in self.langs:
            import xxhash

            self.langs[name] = len(self.langs)
            self.lang_hash = np.append(self.lang_hash, np.uint64(xxhash.xxh3_64_intdigest(name)))
        return self.langs[name]

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        """Texts that lie one after another in data."""
        i, n = 0, len(langs)
        while i < n:
            j = min(int(np.searchsorted(offsets, offsets[i] + self.scanner.size, side="right")) - 1, n)
            if j > i:
                self._slice(self.lower[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], langs[i:j], False)
                yield from self.ready()
                i = j
            else:
                text = data[offsets[i] : offsets[i + 1]]
                for a, b, giant in self.scanner.slices(text):
                    self._slice(self.lower[text[a:b]], np.array([0, b - a]), langs[i : i + 1], giant, b < len(text))
                    yield from self.ready(b < len(text))
                i += 1

    def _slice(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, giant: bool, goes_on: bool = False) -> None:
        if giant:
            import xxhash

            starts, lengths, hashes = np.array([0]), np.array([len(data)]), np.array([xxhash.xxh3_64_intdigest(data)], np.uint64)
        else:
            starts, lengths, hashes = self.scanner.words(data, offsets, cls := self.classes[data])
        breaks = np.zeros(len(data) + 1, np.int64)
        if not giant:
            np.cumsum(cls == BREAK, out=breaks[1:])
        doc = np.searchsorted(offsets, starts, side="right") - 1
        at, end = breaks[starts], breaks[len(data)]
        link = np.zeros(len(starts), bool)
        link[:-1] = (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])
        tail = goes_on and (at[-1] == end if len(starts) else False)  # the last word may be followed by the next slice's first
        head = breaks[starts[0]] == 0 if len(starts) else not end  # and so the first by the one before
        if self.parts and self.parts[-1][5]:
            if len(starts):
                self.parts[-1][3][-1] = head
            elif head:
                return  # white space: what went before still goes on
        lang = langs[doc]
        if len(starts):
            self.parts.append((hashes ^ self.lang_hash[lang], starts + self.bytes, lengths, link, lang, bool(tail)))
            self.data.append(data)
            self.bytes += len(data)
            self.held += len(starts)
        elif self.parts:
            self.parts[-1] = (*self.parts[-1][:5], False)

    def ready(self, goes_on: bool = False, end: bool = False):
        """What is held, once it is enough: (data, hashes, starts, lengths, link, lang, n), of which phrases begin at the first n words."""
        if not self.parts or self.held < HELD and not end:
            return
        open_end = goes_on and self.parts[-1][5]
        data = np.concatenate([*self.data, np.zeros(8, np.uint8)])
        h, starts, lengths, link, lang = (np.concatenate([p[k] for p in self.parts]) for k in range(5))
        keep = min(DEPTH - 1, len(h)) if open_end else 0
        if open_end and len(h) <= keep:
            return
        n = len(h) - keep
        self.clear()
        if keep:
            first = int(starts[n])
            rest = data[first:-8].copy()
            self.data, self.bytes, self.held = [rest], len(rest), keep
            self.parts = [(h[n:].copy(), starts[n:] - first, lengths[n:].copy(), link[n:].copy(), lang[n:].copy(), True)]
        yield data, h, starts, lengths, link, lang, n


def pairs(part: tuple, bits: Bits | None = None) -> np.ndarray:
    """Whether a word and the next are a pair; with a filter, one that it passes, of words that it passes."""
    _, h, _, _, link, _, _ = part
    out = link.copy()
    if bits is not None:
        passed = bits.has(h)
        out[:-1] &= passed[:-1] & passed[1:]
        some = np.flatnonzero(out)
        out[some] = bits.has(mixed(h[some], h[some + 1]))
    return out


def triples(part: tuple, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where both pairs of three words are in, and the triples' hashes."""
    _, h, *_ = part
    at = np.flatnonzero(pair[:-1] & pair[1:])
    return at, mixed(mixed(h[at], h[at + 1]), h[at + 2])


def hash_counts(part: tuple, bits: Bits | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the hashes of words and pairs, or, with a filter of these, of triples; in order."""
    _, h, _, _, link, _, n = part
    if bits is None:
        at = np.flatnonzero(link[:n])
        return np.unique(np.concatenate([h[:n], mixed(h[at], h[at + 1])]), return_counts=True)
    at, h = triples(part, pairs(part, bits))
    return np.unique(h[at < n], return_counts=True)


def packed(h: np.ndarray, n: np.ndarray, top: int):
    """(bucket, blob) of sorted hashes and their counts: 2^top buckets by the hash's first bits, 40 more bits of each are kept."""
    import pyarrow as pa

    bucket, rest = h >> np.uint64(64 - top), (h << np.uint64(top)) >> np.uint64(24)
    cuts = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(h)]), len(h)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        raw = b"".join([rest[a:b].astype(np.uint32).tobytes(), (rest[a:b] >> np.uint64(32)).astype(np.uint8).tobytes(), n[a:b].astype(np.uint32).tobytes()])
        yield int(bucket[a]), int(b - a), pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(size: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    raw = pa.decompress(blob, 9 * size, codec="zstd", asbytes=True)
    low, high, n = np.frombuffer(raw, np.uint32, size), np.frombuffer(raw, np.uint8, size, 4 * size), np.frombuffer(raw, np.uint32, size, 5 * size)
    return low | high.astype(np.uint64) << np.uint64(32), n.astype(np.int64)


def key(h: np.ndarray, top: int) -> np.ndarray:
    """What packed() keeps of a hash, bucket first."""
    return h >> np.uint64(24 - top)


def vocabulary(part: tuple, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """Ids of the words at `at`, in the order of (lang, bytes), and these. Equal hashes are compared byte by byte."""
    data, h, starts, lengths, _, lang, _ = part
    _, rep, inverse = np.unique(h[at], return_index=True, return_inverse=True)
    one = at[rep][inverse]
    same = (lengths[at] == lengths[one]) & (lang[at] == lang[one])
    same &= Scanner.same(_MASKS, data, starts[at], starts[one], np.minimum(lengths[at], lengths[one]))
    word = lambda i: (int(lang[i]), data[starts[i] : starts[i] + lengths[i]].tobytes())
    if same.all():
        found = [word(i) for i in at[rep]]
    else:  # equal hashes of different words: by the words themselves
        known: dict[tuple[int, bytes], int] = {}
        inverse = np.array([known.setdefault(word(i), len(known)) for i in at])
        found = list(known)
    order = sorted(range(len(found)), key=found.__getitem__)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return rank[inverse], [found[k] for k in order]


class _MASKS:
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def trie(part: tuple, two: Bits, three: Bits) -> tuple[list[np.ndarray], np.ndarray, list[tuple[int, bytes]]]:
    """Paths (ids of words, -1 where a path is shorter) in sorted order, their counts, and the vocabulary; of what the filters of words and
    pairs, and of triples, pass."""
    _, h, _, _, _, _, n = part
    at = np.flatnonzero(two.has(h))
    if not len(at):
        return [np.zeros(0, np.int64)] * DEPTH, np.zeros(0, np.int64), []
    ids, words = vocabulary(part, at)
    word = np.full(len(h), -1, np.int64)
    word[at] = ids
    pair, triple = pairs(part, two), np.zeros(len(h), bool)
    where, hashes = triples(part, pair)
    triple[where[three.has(hashes)]] = True
    goes = {1: pair, 2: triple, 3: np.append(triple[1:], False) & triple}  # whether a path of k words goes on
    begins = at[at < n]
    levels, counts = [], []
    node, place = word[begins], begins
    path = [np.arange(len(words))]
    count = np.bincount(node, minlength=len(words))
    path, used = [path[0][count > 0]], np.cumsum(count > 0) - 1
    node = used[node]
    levels.append(path), counts.append(count[count > 0])
    for k in range(1, DEPTH):
        go = goes[k][place]
        place, node = place[go], node[go]
        key, node, count = np.unique(node * len(words) + word[place + k], return_inverse=True, return_counts=True)
        path = [*(x[key // len(words)] for x in path), key % len(words)]
        levels.append(path), counts.append(count)
    columns = [np.concatenate([p[k] if k < len(p) else np.full(len(p[0]), -1) for p in levels]) for k in range(DEPTH)]
    order = np.lexsort(columns[::-1])
    return [c[order] for c in columns], np.concatenate(counts)[order], words


def _pieces(batches):
    """Words of batches of (lang, text), as they are ready."""
    import pyarrow as pa

    held = Words()
    for b in batches:
        texts = b.column(1).cast(pa.large_binary())
        texts = texts.fill_null(b"") if texts.null_count else texts
        _, at, data = texts.buffers()
        offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        langs = np.array([held.lang(x) for x in b.column(0).to_pylist()], np.int64)
        for part in held.add(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets, langs):
            yield held, part
    for part in held.ready(end=True):
        yield held, part


def _rows(docs: DataFrame, text: str, part: str) -> DataFrame:
    C.small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))


class Passing:
    """A filter that looks hashes up by their keys."""

    def __init__(self, words: np.ndarray, top: int):
        self.bits, self.top = Bits(words), top

    def has(self, h: np.ndarray) -> np.ndarray:
        return self.bits.has(key(h, self.top))


def frequent_bits(rows: DataFrame, least: int, sent=None) -> np.ndarray:
    """The bit filter of all words and pairs that may occur `least` times; with the (broadcast) one of these, that of triples.

    Sorted hashes and counts of a shard are written as one blob per bucket of hashes, and the blobs of a bucket are merged in one task."""
    spark = rows.sparkSession
    top = buckets(spark)

    def run(batches):
        import pyarrow as pa

        bits = sent and Passing(sent.value, top)
        for _, part in _pieces(batches):
            out = list(packed(*hash_counts(part, bits), top))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "size", "blob"])

    def merge(table):
        import pyarrow as pa

        found = [unpacked(s, b) for s, b in zip(table["size"].to_pylist(), table["blob"].to_pylist(), strict=True)]
        h, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h = h[first][np.add.reduceat(n, first) >= least] | np.uint64(table["bucket"][0].as_py() << 40)
        return pa.table({"h": pa.array(h.view(np.int64))})

    often = C.cut(rows.mapInArrow(run, "bucket long, size long, blob binary").groupBy("bucket").applyInArrow(merge, "h long"))
    size = min(max(18, (16 * often.count()).bit_length()), MOST_BITS)

    def ored(batches):
        import pyarrow as pa

        for b in batches:
            p = np.sort(np.concatenate(places(b.column(0).to_numpy().view(np.uint64), size)))
            i = p >> np.uint64(6)
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(p) else np.zeros(0, int)
            x = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first) if len(p) else p
            yield pa.RecordBatch.from_arrays([pa.array(i[first].view(np.int64)), pa.array(x.view(np.int64))], names=["i", "x"])

    def block(table):
        import pyarrow as pa

        x, i = np.zeros(1 << 12, np.int64), table["i"].to_numpy()
        x[i & 4095] = table["x"].to_numpy()
        return pa.table({"k": pa.array([int(i[0]) >> 12]), "x": pa.array([x.tobytes()], pa.binary())})

    bits = often.mapInArrow(ored, "i long, x long").groupBy("i").agg(F.bit_or("x").alias("x"))
    out = np.zeros(1 << (size - 6), np.uint64)
    for r in bits.groupBy(F.shiftright("i", 12).alias("k")).applyInArrow(block, "k long, x binary").collect():  # bounded: 2^28 bits
        out[r["k"] << 12 : (r["k"] + 1) << 12] = np.frombuffer(r["x"], np.uint64)
    return out


def buckets(spark) -> int:
    """Bits of the number of buckets: some eight for each shuffle partition, so that a bucket shrinks as more partitions are given to more data."""
    return min(max(4, (8 * C.partitions(spark)).bit_length()), 20)


def shard_tries(rows: DataFrame, two, three) -> DataFrame:
    """(lang, w1 to w4, n): serialised tries of all shards; a row without words holds all words of its lang."""
    top = buckets(rows.sparkSession)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        filters = Passing(two.value, top), Passing(three.value, top)
        for held, part in _pieces(batches):
            paths, counts, words = trie(part, *filters)
            names = list(held.langs)
            total = np.bincount(part[5][: part[6]], minlength=len(names))
            lang = pa.array(names, pa.string())
            vocabulary_of = pa.array([w for _, w in words], pa.binary()).cast(pa.string())
            of = np.array([g for g, _ in words], np.int64)
            columns = [pc.take(vocabulary_of, pa.array(p, mask=p < 0)) for p in paths]
            none = pa.nulls(len(names), pa.string())
            schema = pa.schema([("lang", pa.string()), *((w, pa.string()) for w in PATH), ("n", pa.int64())])
            yield pa.RecordBatch.from_arrays([lang, *[none] * DEPTH, pa.array(total)], schema=schema)
            whole = pa.RecordBatch.from_arrays([pc.take(lang, pa.array(of[paths[0]])), *columns, pa.array(counts)], schema=schema)
            for k in range(0, len(whole), 50_000):
                yield whole.slice(k, 50_000)

    return rows.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, w4 string, n long")


def walked(nodes: DataFrame) -> DataFrame:
    """nodes plus `left`: the counts of a path's ancestors, from the shallowest, by a walk over each sorted partition."""
    spark = nodes.sparkSession
    key = ["lang", *PATH]
    heads = nodes.filter("w2 is not null").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*key)).alias("first")).collect()  # one row a partition
    above = {(r["first"]["lang"], *(r["first"][w] for w in PATH[:k])) for r in heads for k in (1, 2, 3) if r["first"][PATH[k]] is not None}
    at = {}
    if above:
        wanted = spark.createDataFrame([(*a, *[None] * (5 - len(a))) for a in above], ", ".join(f"{c} string" for c in key))
        same = [nodes["lang"] == wanted["lang"], *[nodes[w].eqNullSafe(wanted[w]) for w in PATH]]
        at = {tuple(x for x in r[:5] if x is not None): r["n"] for r in nodes.join(F.broadcast(wanted), same).select(*[nodes[c] for c in key], "n").collect()}  # three a partition at most
    sent = spark.sparkContext.broadcast(at)

    def run(batches):
        import pyarrow as pa

        stack: list[tuple] = []  # (path, count) of the last path and its ancestors
        for b in batches:
            left = []
            for *path, n in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                path = tuple(x for x in path if x is not None)
                while stack and path[: len(stack[-1][0])] != stack[-1][0]:
                    stack.pop()
                if len(path) > 2 and len(stack) < len(path) - 2:  # the range begins below these
                    stack = [(path[:k], sent.value[path[:k]]) for k in range(2, len(path))]
                left.append([x for _, x in stack])
                if len(path) > 1:
                    stack.append((path, n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(left, pa.list_(pa.int64()))], names=[*key, "n", "left"])

    return nodes.mapInArrow(run, ", ".join(f"{c} string" for c in key) + ", n long, left array<long>")


def linked(nodes: DataFrame) -> DataFrame:
    """Phrases of two words or more with `right`: counts of what is left after the first k words, k = 1, 2, 3, along suffix links."""
    depth = F.size("left") + 1
    level = {k: nodes.filter((depth == k) & F.col("w1").isNotNull()) for k in range(1, DEPTH + 1)}
    none = F.array().cast("array<bigint>")
    below = level[1].select("*", none.alias("right"))
    out = None
    for k in range(2, DEPTH + 1):
        link = below.select(F.col("lang").alias("__g"), *[F.col(PATH[i]).alias(f"__{i}") for i in range(k - 1)], F.concat(F.array("n"), "right").alias("right"))
        on = [F.col("lang") == F.col("__g"), *[F.col(PATH[i + 1]) == F.col(f"__{i}") for i in range(k - 1)]]
        below = C.cut(level[k].join(link, on).select(*level[k].columns, "right"))
        out = below if out is None else out.unionByName(below)
    return out


def mine(docs: DataFrame, text: str = "text", part: str = "lang", least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), the first `top` phrases of each lang."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    rows = _rows(docs, text, part)
    key = ["lang", *PATH]
    two = spark.sparkContext.broadcast(frequent_bits(rows, least))
    three = spark.sparkContext.broadcast(frequent_bits(rows, least, two))
    tries = C.stage(shard_tries(rows, two, three), "tries")
    merged = tries.repartitionByRange(C.partitions(spark), *key).groupBy(*key).agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("w1").isNull())
    nodes = C.cut(merged.sortWithinPartitions(*key))
    C.release(tries)
    phrases = linked(walked(nodes)).withColumnRenamed("n", "a")
    exact = F.col("a").cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(7,0)")
    k = F.sequence(F.lit(1), F.size("left"))
    cuts = F.transform(F.arrays_zip("left", "right"), lambda x, i: F.struct((x["left"] + x["right"]).alias("s"), i.alias("k"), x["left"].alias("l"), x["right"].alias("r")))
    scored = phrases.select(*key, "a", F.explode(cuts).alias("c"), k.alias("ks")).select(*key, "a", exact.alias("e"), "c.*")
    score = F.expr("cast(e div cast(s as decimal(20,0)) as bigint)")
    best = scored.select(*key, "a", F.struct(score.alias("score"), "k", "l", "r").alias("x")).groupBy(*key, "a").agg(F.min("x").alias("x"))
    # a phrase goes if one word more, on either side, keeps most of its count; two words more keep no more than one
    blank = F.lit(None).cast("string")
    longer = phrases.filter("w3 is not null").select("lang", "a", F.explode(F.array(
        F.when(F.col("w4").isNull(), F.struct("w1", "w2", blank.alias("w3"))).otherwise(F.struct("w1", "w2", "w3")),
        F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("w4").alias("w3")))).alias("q"))
    longer = longer.groupBy(F.col("lang").alias("__g"), F.col("q.w1").alias("__1"), F.col("q.w2").alias("__2"), F.coalesce("q.w3", F.lit("")).alias("__3")).agg(F.max("a").alias("__a"))
    on = [F.col("lang") == F.col("__g"), F.col("w1") == F.col("__1"), F.col("w2") == F.col("__2"), F.coalesce("w3", F.lit("")) == F.col("__3"), F.col("w4").isNull()]
    wide = "decimal(22,0)"
    absorbed = F.lit(100).cast(wide) * F.col("__a") >= F.lit(share).cast(wide) * F.col("a")
    kept = best.join(longer, on, "left").filter(F.col("__a").isNull() | ~absorbed)
    kept = kept.select("lang", F.concat_ws(" ", *PATH).alias("phrase"), "a", "x.l", "x.r", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # Spark limits groups in each task before it deals them out
    total = nodes.filter("w1 is null").select(F.col("lang").alias("__g"), F.col("n"))
    return first.join(total, F.col("lang") == F.col("__g")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return mine(C.table(spark, sf_dir, "documents"))


SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as materialized (select row_number() over () as p, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as words from p),
t as materialized (select p, lang, unnest(words) as w1, unnest(range(1, len(words) + 1)) as i from w),
q as (select lang, w1, lead(w1) over v as w2, lead(w1, 2) over v as w3, lead(w1, 3) over v as w4 from t window v as (partition by p order by i)),
g as (select lang, 1 as m, w1 as ws, count(*) as a from q group by all having count(*) >= 30
    union all select lang, 2, w1 || ' ' || w2, count(*) from q where w2 is not null group by all having count(*) >= 30
    union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from q where w3 is not null group by all having count(*) >= 30
    union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) from q where w4 is not null group by all having count(*) >= 30),
f as materialized (select *, string_split(ws, ' ') as words from g),
n as (select lang, count(*)::bigint as n from t group by lang),
k as (select lang, ws, m, a, k, array_to_string(words[1:k], ' ') as x, array_to_string(words[k + 1:m], ' ') as y from f, (select unnest([1, 2, 3]) as k) where k < m),
c as (select k.*, l.a as l, r.a as r, (2000000 * k.a::hugeint) // (l.a + r.a) as score from k join f l on l.lang = k.lang and l.ws = k.x join f r on r.lang = k.lang and r.ws = k.y),
b as (select * from c qualify row_number() over (partition by lang, ws order by score, k) = 1),
s as (select lang, array_to_string(words[1:m - 1], ' ') as ws, a from f where m > 2 union all select lang, array_to_string(words[2:m], ' '), a from f where m > 2),
x as (select lang, ws, max(a) as longer from s group by all),
d as (select b.* from b left join x using (lang, ws) where longer is null or 100 * longer::hugeint < 80 * a::hugeint),
o as (select lang, ws as phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, ws) as rank from d)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from o join n using (lang) where rank <= 2000
"""
