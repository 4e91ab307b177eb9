"""Exact Jaccard join on word shingles by partitioned universes (PTJ: Deng, Li, Wen and Feng, 2015).

Sets are grouped in size bands. For two sets with similarity t or more whose smaller one has n shingles, the symmetric
difference is at most n (1 - t) / t. A band's universe is hashed into segments; every set signs its first segments, and two
such sets share a signature by the pigeonhole principle as long as the smaller one's segments count for more than that
difference: a segment signed exactly counts 1, one signed with its one-deletion neighbourhood 2. A cost model per band picks
between exact segments and half as many with deletions (Allocation). Empty subsets are never signed, as they would bring all
texts together; segments left so count less, for which some spare ones are signed. A set for which even these do not
suffice (`short`) has its band signed by hash-ordered prefixes as well, in a second pass over that band only.

Texts with equal sets are one node. The spare segments also say how many signatures a similar pair shares at least. So in
buckets of up to SMALL nodes, pairs of fitting sizes are counted and those with that many are verified, exactly. In
larger ones the least node (a hash) is the pivot, all others are verified against it, and components are found; where a bucket
then still holds several, and a text in it whose spare signatures do not outnumber its large buckets, its texts are signed
again by their rarest shingles (`_prefixes`): as many as a similar text cannot all lack, in an order by a count sketch of fixed
size, so that a common passage leaves no bucket behind. Small ones of these buckets give pairs to verify, where their places in
both texts allow the similarity; in large ones with several components, where one member is near enough to its text's start for
the smaller of a pair, the texts that they connect are compared in blocks, without rows for pairs: counts of shared shingles
along posting lists give the links between components. So a large bucket costs one pair per member, no link between different
texts is lost, and no row holds a bucket.

Shingles and sets are known by 64-bit hashes. Edge cases: null texts and texts without words have an empty set and link with
nothing; texts of fewer words than a shingle are one shingle; repeated rows are copies; null ids take part but never name
a class; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Standard deviations by which the segments of a set suffice.
SURE = 5.5
#: Share of spare segments, which large buckets may use up before a text has to be compared in blocks.
SPARE = 0.18
#: Nodes of a bucket up to which all its pairs are looked at.
SMALL = 16
#: Texts of a group that one task compares.
BLOCK = 2000
#: Signatures of a part, held in memory at most (repeats included), and nodes from which a signature leaves it early. Parts are large, as a
#: text is named once for all its signatures of a part.
PART, HELD, HOT = 1_500_000, 3_000_000, 256
#: Cells of the sketch that counts shingles in the texts of large buckets; every order by it is right, a finer one has fewer pairs.
CELLS = 1 << 18
#: Chance that an unrelated text holds a given shingle, for the cost model.
COMMON = 0.02


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted hashes of a text's distinct word n-grams; A-Z are lowered, words stand between space and \\x09-\\x0D."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = mixed(h + w[i : len(w) - k + 1 + i])
    return np.unique(h)


@dataclass(frozen=True)
class Allocation:
    """How the sets of one band sign: number of segments, what each counts, and the sizes it is for."""

    band: int
    low: int
    high: int
    segments: int
    counts: int
    need: int

    def used(self, need: int) -> int:
        """Segments that a set signs which has to reach `need`; the more, the larger that is."""
        return min(self.segments, -(-need * self.segments // self.need))


def needed(size: int, percent: int) -> int:
    return size * (100 - percent) // percent + 1


def band_of(size: int) -> tuple[int, int, int]:
    band, low = 0, 1
    while True:
        high = low + low // 2
        if size <= high:
            return band, low, high
        band, low = band + 1, high + 1


def allocate(band: int, low: int, high: int, percent: int) -> Allocation:
    """The cheapest number of segments, exact or with one-deletion neighbourhoods, for which a set of the band hardly ever falls short:
    its segments are Poisson-filled, empty ones count 0 and, with deletions, single ones 1."""
    top, found = needed(high, percent), []
    for counts in (1, 2):
        for m in sorted({-(-top // counts) + k * max(1, top // 24) for k in range(97)}):
            at = Allocation(band, low, high, m, counts, top)
            sure, cost, least = np.inf, 0.0, np.inf
            for size in (max(low * percent // 100, 1), high):  # sets of the band below sign too, if they may be similar
                used, c = at.used(needed(size, percent)), size / m
                none, one = np.exp(-c), c * np.exp(-c)
                lost = none if counts == 1 else 2 * none + one
                spread = lost * (1 - lost) if counts == 1 else 4 * none + one - lost * lost
                sure = min(sure, (used * (counts - lost) - needed(size, percent)) / max(np.sqrt(used * spread), 0.1))
                least = min(least, used * (counts - lost) - needed(size, percent) - 1 - SPARE * needed(size, percent))
                cost += used * (1 - none) + (0 if counts == 1 else size * used / m)
            found.append((max(SURE - sure, 0.0), max(-least, 0.0), cost, at))
    return min(found, key=lambda x: x[:3])[3]


class Signer:
    def __init__(self, percent: int, prefixed: frozenset[int]):
        self.percent, self.prefixed, self.known = percent, prefixed, {}

    def allocation(self, size: int) -> Allocation:
        band, low, high = band_of(size)
        if band not in self.known:
            self.known[band] = allocate(band, low, high, self.percent)
        return self.known[band]

    def sign(self, xs: np.ndarray) -> tuple[np.ndarray, list[int], int]:
        """Signatures of a set, the bands in which its segments do not suffice, and how many signatures more than one it shares at
        least with any larger set that it is similar to."""
        own = self.allocation(len(xs))
        schemes = [own]
        if 100 * len(xs) >= self.percent * (own.high + 1):  # it may be the smaller one of a pair whose other is in the next band
            schemes.append(self.allocation(own.high + 1))
        out, short, slack = [], [], 1 << 30
        need = needed(len(xs), self.percent)
        for a in schemes:
            salt = np.uint64((a.band * 4 + 1) * 0x51_7C_C1B7_2722_0A95 & (1 << 64) - 1)
            if a.band in self.prefixed:
                order = np.sort(mixed(xs + salt))
                out.append(mixed(order[: len(xs) - (len(xs) * self.percent + 99) // 100 + 1] + np.uint64(3)))
                slack = 0
                continue
            h = mixed(xs + salt)
            used = a.used(need)
            segment = ((h >> np.uint64(33)) % np.uint64(a.segments)).astype(np.int64)
            mine = segment < used
            h, segment = h[mine], segment[mine]
            size = np.bincount(segment, minlength=used)
            total = np.zeros(used, dtype=np.uint64)
            np.add.at(total, segment, h)
            label = mixed(np.arange(used, dtype=np.uint64) + salt)
            out.append(mixed(total + label)[size > 0])
            if a.counts == 2:
                out.append(mixed(total[segment] - h + label[segment])[size[segment] > 1])
            more = int(np.minimum(size, a.counts).sum()) - need  # of the segments, no more than need - 1 can be spoilt
            if more < 0:
                short.append(a.band)
            slack = min(slack, max(more, 0) // a.counts)
        return np.unique(np.concatenate(out)), short, slack


def _described(n: int, percent: int, prefixed: frozenset[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(percent, prefixed)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                xs = shingle_set(text, n)
                signatures, short, slack = signer.sign(xs) if len(xs) else ((), [], 0)
                rows.append((doc_id, len(xs), node_of(xs) if len(xs) else None, len(signatures), short, slack))
            ids, sizes, nodes, signed, shorts, slacks = zip(*rows, strict=True) if rows else ([],) * 6
            # columns of their own: ids and hashes beside nulls must not turn into floats
            yield pd.DataFrame({"doc_id": ids, "n": sizes, "node": pd.array(nodes, dtype="Int64"), "signed": signed, "short": shorts, "slack": slacks})

    return run


def _packed(n: int, percent: int, prefixed: frozenset[int], parts: int):
    """A batch's signatures, 32 bits each beside their part, with places in a list of the batch's nodes, which ascend and are compressed: a third
    of the bytes to move of rows of two longs. Some PART / 2^32 of the signatures of a part collide, at any size of the input; candidates are
    verified."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        signer = Signer(percent, prefixed)
        for b in (whole.iloc[i : i + 50_000] for whole in batches for i in range(0, len(whole), 50_000)):  # places have 16 bits
            known: dict[int, np.ndarray] = {}
            for text in b["text"]:
                xs = shingle_set(text, n)
                if len(xs) and (node := node_of(xs)) not in known:
                    known[node] = signer.sign(xs)[0]
            if not known:
                continue
            s = np.concatenate(list(known.values()))
            nodes = np.array(list(known), dtype=np.int64)
            place = np.repeat(np.arange(len(nodes), dtype=np.uint16), [len(x) for x in known.values()])
            part = (s % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            s, place, part = (s[order] >> np.uint64(32)).astype("<u4"), place[order], part[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            rows = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                used, at = np.unique(place[x:y], return_inverse=True)
                rows.append((int(part[x]), s[x:y].tobytes(), z.compress(np.diff(at, prepend=0).astype("<u2").tobytes()), nodes[used].tobytes()))
            yield pd.DataFrame(rows, columns=["part", "s", "place", "nodes"])

    return run


def _shared(parts: int, tell: bool = False):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(s, node) of signatures that two nodes or more have; rows come sorted by part. Beyond HELD signatures, those with HOT nodes leave
        memory, and what else arrives for them goes straight through. Only the rows of those may repeat; column `again` tells, if asked for."""
        import zstandard

        z = zstandard.ZstdDecompressor()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        hot = np.zeros(0, dtype=np.uint32)
        size, now = 0, None

        def frame(key: np.ndarray, node: np.ndarray, again: bool) -> pd.DataFrame:
            return pd.DataFrame(({"again": np.full(len(key), again)} if tell else {}) | {"s": key.astype(np.int64) * parts + now, "node": node})

        def split(least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Held pairs without repeats, and which are of signatures with `least` nodes or more."""
            key = np.concatenate([np.zeros(0, dtype=np.uint32), *[k for k, _ in held]])
            node = np.concatenate([np.zeros(0, dtype=np.int64), *[n for _, n in held]])
            held.clear()
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[fresh], node[fresh]
            starts = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), dtype=bool), key[1:] != key[:-1]]))
            n = np.diff(np.append(starts, len(key)))
            return key, node, np.repeat(n >= least, n)

        def whole() -> pd.DataFrame:
            key, node, many = split(2)
            return frame(key[many], node[many], False)

        for b in batches:
            for part, s, place, nodes in zip(b["part"], b["s"], b["place"], b["nodes"], strict=True):
                if part != now:
                    if now is not None:
                        yield whole()
                    size, now, hot = 0, part, np.zeros(0, dtype=np.uint32)
                key = np.frombuffer(s, dtype="<u4")
                node = np.frombuffer(nodes, dtype=np.int64)[np.cumsum(np.frombuffer(z.decompress(place), dtype="<u2"))]
                if len(hot):
                    through = np.isin(key, hot)
                    yield frame(key[through], node[through], True)
                    key, node = key[~through], node[~through]
                held.append((key, node))
                size += len(key)
                if size > HELD:
                    key, node, many = split(HOT)
                    hot = np.unique(np.concatenate([hot, key[many]]))
                    held.append((key[~many], node[~many]))
                    size = len(held[0][0])
                    yield frame(key[many], node[many], True)
        if now is not None:
            yield whole()

    return run


def node_of(xs: np.ndarray) -> int:
    return int(mixed(np.array([mixed(xs).sum() + np.uint64(len(xs))], dtype=np.uint64)).astype(np.int64)[0])


def _blobs(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            known = {}
            for t in b["text"]:
                xs = shingle_set(t, n)
                if len(xs) and (node := node_of(xs)) not in known:
                    known[node] = z.compress(t.encode())
            yield pd.DataFrame({"node": pd.array(list(known), dtype="int64"), "blob": list(known.values())})

    return run


def _verified(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        z, held, kept = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            rows = []
            for x, y, bx, by in zip(b["x"], b["y"], b["bx"], b["by"], strict=True):
                if held != x:
                    held, kept = x, shingle_set(z.decompress(bx).decode(), n)
                other = shingle_set(z.decompress(by).decode(), n)
                both = np.searchsorted(kept, other)
                both = int((kept[np.minimum(both, len(kept) - 1)] == other).sum())
                rows.append((x, y, both, len(kept) + len(other) - both))
            yield pd.DataFrame(rows, columns=["x", "y", "both", "either"])

    return run


def _weighed(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells of a partition's shingles, with counts."""
        import zstandard

        z, total = zstandard.ZstdDecompressor(), np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            for blob in b["blob"]:
                cells, m = np.unique(shingle_set(z.decompress(blob).decode(), n) % np.uint64(CELLS), return_counts=True)
                total[cells.astype(np.int64)] += m
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "m": total[cells]})

    return run


def _filled(key, rows: pd.DataFrame) -> pd.DataFrame:
    """A run of 1,024 cells as one value."""
    held = np.zeros(1024, dtype=np.int64)
    held[rows["cell"].to_numpy() % 1024] = rows["m"].to_numpy()
    return pd.DataFrame({"run": [key[0]], "m": [held.tobytes()]})


def _prefixes(n: int, percent: int, weights):
    """(s, at, inner) of a text's rarest shingles. If two texts are similar, the first shingle that they share in this order is among
    these of both, and among the inner ones of the smaller: those after which enough of its shingles are left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        z, weight = zstandard.ZstdDecompressor(), weights.value
        for b in batches:
            out = []
            for node, size, blob in zip(b["node"], b["n"], b["blob"], strict=True):
                xs = shingle_set(z.decompress(blob).decode(), n)
                first = np.lexsort((xs, weight[(xs % np.uint64(CELLS)).astype(np.int64)]))[: len(xs) - (len(xs) * percent + 99) // 100 + 1]
                at = np.arange(len(first))
                out.append(pd.DataFrame({"s": xs[first].view(np.int64), "node": node, "n": size, "at": at, "inner": at * (100 + percent) <= len(xs) * (100 - percent)}))
            if out:
                yield pd.concat(out)

    return run


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, where each one's holders begin, and the holders."""
    key, posting = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    return key, np.concatenate([[0], np.cumsum(np.bincount(posting, minlength=len(key)))]), owner[np.argsort(posting, kind="stable")]


def _compared(n: int, percent: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Links from a block of texts outside their group's largest class to a block of its texts: shared shingles are counted along posting
        lists. A pair counts if one of the two is bare; at most one link for each two classes that meet comes out."""
        import zstandard

        z, found = zstandard.ZstdDecompressor(), []
        if len(left) and len(right):
            left, right = left.sort_values("node"), right.sort_values(["bare", "node"], ascending=[False, True])
            node, other = left["node"].to_numpy(), right["node"].to_numpy()
            sets = [shingle_set(z.decompress(x).decode(), n) for x in right["blob"]]
            size = np.array([len(x) for x in sets])
            bare = int(right["bare"].sum())  # these stand first
            indexes = {True: (_postings(sets), len(sets)), False: (_postings(sets[:bare]), bare)}
            _, label = np.unique(np.concatenate([left["component"], right["component"]]), return_inverse=True)
            for x, (blob, own) in enumerate(zip(left["blob"], left["bare"], strict=True)):
                (keys, at, holders), m = indexes[bool(own)]
                if not m:
                    continue
                xs = shingle_set(z.decompress(blob).decode(), n)
                k = np.searchsorted(keys, xs)
                k = k[keys[np.minimum(k, len(keys) - 1)] == xs]
                lo, length = at[k], at[k + 1] - at[k]
                upto = np.cumsum(length)
                if not len(upto):
                    continue
                both = np.bincount(holders[np.repeat(lo - upto + length, length) + np.arange(upto[-1])], minlength=m)
                near = (100 * both >= percent * (size[:m] + len(xs) - both)) & (label[len(left) : len(left) + m] != label[x])
                for y in np.flatnonzero(near):
                    if label[len(left) + y] != label[x]:
                        found.append((min(node[x], other[y]), max(node[x], other[y])))
                        label[label == label[x]] = label[len(left) + y]
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: classes of texts linked by similarities of `percent` hundredths or more."""
    spark = docs.sparkSession
    C.small_batches(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def described(prefixed: frozenset[int]) -> DataFrame:
        kind = "doc_id string, n long, node long, signed long, short array<int>, slack long"
        out = base.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_described(n, percent, prefixed), kind)
        return C.cut(out.withColumn("doc_id", F.col("doc_id").cast("long")))

    table, short = described(frozenset()), frozenset()
    found = frozenset(r[0] for r in table.select(F.explode("short").alias("b")).distinct().collect())  # bands: some dozens
    if found:
        short = found
        table = described(short)
    total = table.agg(F.sum("signed")).first()[0] or 0
    parts = max(C.partitions(spark), total // PART)
    signatures = base.select("text").mapInPandas(_packed(n, percent, short, parts), "part long, s binary, place binary, nodes binary")
    shared = signatures.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(_shared(parts, tell=True), "again boolean, s long, node long")
    found = C.stage(shared, "shared")
    shared = found.filter("not again").select("s", "node").unionByName(found.filter("again").select("s", "node").distinct())
    # texts whose sets are in a bucket, with their size, slack and number of large buckets
    sizes = shared.groupBy("s").agg(F.count(F.lit(1)).alias("m"))
    buckets = C.stage(shared.join(sizes, "s"), "buckets")
    C.release(found)
    wanted = buckets.groupBy("node").agg(F.count_if(F.col("m") > SMALL).alias("big"))
    first = table.filter("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("slack").alias("slack"))
    known = C.cut(first.join(wanted, "node").select("node", "n", (F.col("slack") - F.col("big")).alias("spare")))
    # a text moves once, to its node
    texts = base.select("text").mapInPandas(_blobs(n), "node long, blob binary").dropDuplicates(["node"])
    texts = C.bucketed(texts.join(known.select("node"), "node", "left_semi"), "texts", "node")
    placed = C.stage(buckets.join(known.select("node", "n", "spare"), "node"), "placed")
    C.release(buckets)

    def verify(pairs: DataFrame, held: DataFrame = texts) -> DataFrame:
        x = held.select(F.col("node").alias("x"), F.col("blob").alias("bx"))
        y = texts.select(F.col("node").alias("y"), F.col("blob").alias("by"))
        return pairs.join(y, "y").join(x, "x").mapInPandas(_verified(n), "x long, y long, both long, either long")

    linked = 100 * F.col("both") >= percent * F.col("either")
    alike = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    # small buckets: all pairs, of which a similar one shares so many signatures
    side = lambda k: placed.filter(F.col("m") <= SMALL).select("s", F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("spare").alias(f"c{k}"))
    met = side("x").join(side("y"), "s").filter((F.col("x") < F.col("y")) & alike(F.col("nx"), F.col("ny")))
    spare_ = F.when(F.col("nx") < F.col("ny"), F.col("cx")).when(F.col("nx") > F.col("ny"), F.col("cy")).otherwise(F.least("cx", "cy"))
    pairs = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.first(spare_).alias("spare")).filter("c >= 1 + spare").select("x", "y")
    # large buckets: against the pivot, the least node, where small buckets need not show a pair
    large = placed.filter(F.col("m") > SMALL)
    pivots = large.groupBy("s").agg(F.min(F.struct("node", "n", "spare")).alias("p"), F.min("spare").alias("least")).filter("least < 0")
    pivots = pivots.select("s", F.col("p.node").alias("pivot"), F.col("p.n").alias("np"), F.col("p.spare").alias("cp"))
    starred = C.stage(large.join(pivots, "s"), "starred")
    stars = starred.filter((F.col("node") != F.col("pivot")) & alike(F.col("n"), F.col("np")) & ((F.col("spare") < 0) | (F.col("cp") < 0))).select(F.least("pivot", "node").alias("x"), F.greatest("pivot", "node").alias("y"))
    # a pivot may be frequent: for it texts move, so that Spark can split it
    loose = spark.read.schema(texts.schema).parquet(texts.staged_path)
    links = C.stage(verify(pairs.unionByName(stars).distinct(), loose).filter(linked).select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
    classes = C.cut(components(links))
    # large buckets that hold several classes and a text that may share no small bucket with what it is similar to: groups of texts
    # that these connect, compared in blocks
    named = C.stage(starred.filter("node <> pivot").select("s", "node", "n", "spare").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    C.release(placed, starred, links)
    several = named.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("spare").alias("spare"), F.min("node").alias("anchor")).filter("lo <> hi and spare < 0").select("s", "anchor")
    several = C.stage(several, "several")
    met = C.stage(named.join(several, "s").groupBy("node", "component", "n").agg((F.min("spare") < 0).alias("bare")), "met")
    C.release(named, several)
    new = _linked_by_rare(spark, met, texts, n, percent, verify, linked)
    C.release(met, texts)
    if new is not None:
        classes = C.cut(components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new)))
    return _labelled(table.select("doc_id", "n", "node"), classes)


def _linked_by_rare(spark, met: DataFrame, texts: DataFrame, n: int, percent: int, verify, linked) -> DataFrame | None:
    """Links (a, b) between components of met (node, component, n, bare), where one of the two is bare: all pairs in small buckets of
    rare shingles, blocks in large ones. None if there are none."""
    if not met.head(1):
        return None
    own = texts.join(met.select("node", "n"), "node")
    cells = own.select("blob").mapInPandas(_weighed(n), "cell long, m long").groupBy("cell").agg(F.sum("m").alias("m"))
    weight = np.zeros(CELLS, dtype=np.int64)
    for r in cells.groupBy(F.shiftright("cell", 10).alias("run")).applyInPandas(_filled, "run long, m binary").collect():  # CELLS / 1024 rows
        weight[r["run"] * 1024 : (r["run"] + 1) * 1024] = np.frombuffer(r["m"], dtype=np.int64)
    weights = spark.sparkContext.broadcast(weight)
    rare = own.select("node", "n", "blob").mapInPandas(_prefixes(n, percent, weights), "s long, node long, n long, at long, inner boolean")
    rare = C.stage(rare.join(met.select("node", "component", "bare"), "node"), "rare")
    buckets = rare.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("inner").alias("any"), F.max("bare").alias("bare"), F.min("node").alias("anchor"))
    buckets = C.stage(buckets.filter("lo <> hi and any and bare").select("s", "m", "anchor"), "several")
    small = rare.join(buckets.filter(F.col("m") <= SMALL).select("s"), "s")
    side = lambda k: small.select("s", *[F.col(c).alias(c + k) for c in ("node", "n", "at", "component", "bare")])
    enough = (100 + percent) * F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty")) >= percent * (F.col("nx") + F.col("ny"))
    pairs = side("x").join(side("y"), "s").filter((F.col("nodex") < F.col("nodey")) & (F.col("componentx") != F.col("componenty")) & (F.col("barex") | F.col("barey")) & enough)
    pairs = pairs.select(F.col("nodex").alias("x"), F.col("nodey").alias("y")).distinct()
    new = C.cut(verify(pairs).filter(linked).select(F.col("x").alias("a"), F.col("y").alias("b")))
    rest = C.stage(rare.join(buckets.filter(F.col("m") > SMALL), "s").select("anchor", "node", "component", "inner", "n").distinct(), "rest")
    C.release(rare, buckets)
    if rest.head(1):
        new = new.unionByName(_linked_by_blocks(rest, texts, n, percent))
    C.release(rest)
    return new if new.head(1) else None


def _linked_by_blocks(rest: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between components of rest (anchor, node, component, inner, n), where one of the two is inner."""
    group = components(rest.select(F.col("anchor").alias("a"), F.col("node").alias("b")).distinct())
    # similar texts are in one class of sizes or in neighbouring ones
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9)
    member = rest.groupBy("node", "component", size_class.alias("c")).agg(F.max("inner").alias("bare"))
    member = C.stage(member.join(group.select("node", F.col("component").alias("group")), "node"), "member")
    # what is outside the largest class of its group meets all of the group, in blocks
    most = member.groupBy("group", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("group").agg(F.max_by("component", F.struct("m", "component")).alias("most"))
    member, met = C.stage(member.join(C.cut(most), "group").withColumn("out", F.col("component") != F.col("most")).drop("most"), "placed"), member
    C.release(met)
    sizes = member.groupBy("group", "c").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("all"), F.ceil(F.count_if("out") / BLOCK).alias("out"))
    around = sizes.withColumn("d", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))).groupBy("group", (F.col("c") - F.col("d")).alias("c"))
    around = C.cut(around.agg(F.collect_list(F.struct("d", "all", "out")).alias("near"), F.max(F.when(F.col("d") == 0, F.col("all"))).alias("rows"), F.max(F.when(F.col("d") == 0, F.col("out"))).alias("outs")))
    placed = member.join(around, ["group", "c"])
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    block = lambda k: F.pmod(F.xxhash64("node"), F.col(k))
    keys = ["group", "at", "d", "i", "j"]
    # a block of class `at` meets one of class at + d
    to = F.flatten(F.transform("near", lambda x: F.transform(upto(x["all"]), lambda j: F.struct(F.col("c").alias("at"), x["d"].alias("d"), block("outs").alias("i"), j.alias("j")))))
    left = placed.filter("out").select("group", F.explode(to).alias("p"), "node", "component", "bare").select("group", "p.*", "node", "component", "bare")
    to = F.flatten(F.transform("near", lambda x: F.transform(upto(x["out"]), lambda i: F.struct((F.col("c") + x["d"]).alias("at"), (-x["d"]).alias("d"), i.alias("i"), block("rows").alias("j")))))
    right = placed.select("group", F.explode(to).alias("p"), "node", "component", "bare").select("group", "p.*", "node", "component", "bare")
    side = lambda x: x.join(texts, "node").select(*[F.col(c).alias(c) for c in (*keys, "node", "component", "bare", "blob")]).groupBy(*keys)  # noqa: E731  new names, as both sides come from one table
    met = side(left).cogroup(side(right))
    new = C.cut(met.applyInPandas(_compared(n, percent), "a long, b long").distinct())
    C.release(member)
    return new


def _labelled(table: DataFrame, classes: DataFrame) -> DataFrame:
    nodes = table.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "component").select("node", "component_id")
    out = table.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(C.table(spark, sf_dir, "documents"), n=3, percent=90)
