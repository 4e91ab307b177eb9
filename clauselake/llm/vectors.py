"""Near-duplicate vectors by collision counting on sorted projections (after C2LSH and QALSH).

1. Equal vectors become one, with a multiplicity.
2. Vectors within CELL of a leader (the smallest id of their bucket of sign bits, in ROUNDS rounds) become its cell. Two members of a
   cell are less than twice that angle apart, so all link: dense groups of near copies shrink to a row, without pairs.
3. Leaders are projected on many random lines. A line is sorted and only its ends are kept, beyond a height that about END
   leaders pass, since there a query-centred window holds few strangers. Lines come in SETS; those of a set run along the sums of
   a direction of one list and one of another, each of `side` directions: a vector's 2 * side projections say at which of the
   side ** 2 lines' ends it lies, so the work for a vector grows with the root of the number of lines. `side` follows from the
   wanted recall of the least similar leaders that may hold a link, by simulation. Each end is sorted by its projection; the collisions of two
   leaders within a query-centred window are counted over COUNTED more projections (whether they fall into each other's
   window there), and only pairs with a calibrated count go on. Ends are passed through in order: what is held is a window.
4. Leaders of such pairs are compared exactly, then the members of cells that may link, in blocks, giving counts.

Links found are exact; a link between different cells is missed with a probability of about 1 - RECALL at the very threshold
and less above. Edge cases: null, empty and zero vectors, and those with null or non-finite components, link with nothing;
vectors of different lengths do not link; repeated rows are copies; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, cos, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

CELL, ROUNDS, END, RECALL, SEED = 0.99, 4, 64, 0.995, 3
COUNTED, SCALE, WINDOW = 64, 24.0, 1.0
#: Width of a window at an end, in standard deviations of the difference of a pair; pairs that are simulated.
REACH, SIMULATED = 2.5, 4000
SETS = 16
BLOCK = 2048


def _unit(vs) -> np.ndarray:
    m = np.array(list(vs), dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@lru_cache(64)
def _directions(d: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([SEED, seed, d]).standard_normal((d, n))


def both_beyond(t: float, rho: float) -> float:
    """P(y > t | x > t) of standard normals with correlation rho."""
    x = np.linspace(t, t + 8, 4001)
    density = np.exp(-x * x / 2)
    above = np.array([1 - NormalDist().cdf((t - rho * v) / sqrt(1 - rho * rho)) for v in x[::20]])
    return float((density * np.interp(x, x[::20], above)).sum() / density.sum())


def met_at_an_end(t: float, rho: float, side: int, pairs: int = SIMULATED) -> float:
    """Share of simulated pairs of similarity rho that lie in one window at an end of some line of a set."""
    rng, found = np.random.default_rng([SEED, side]), 0
    top, width = t * sqrt(2), REACH * sqrt(2 - 2 * rho) * sqrt(2)
    for _ in range(pairs):
        x = rng.standard_normal((2, side))
        y = rho * x + sqrt(1 - rho * rho) * rng.standard_normal((2, side))
        for sign in (1, -1):
            (a, b), (c, d) = sign * x, sign * y
            i = np.flatnonzero((a > top - b.max()) & (c > top - d.max()))
            j = np.flatnonzero((b > top - a.max()) & (d > top - c.max()))
            p, q = a[i][:, None] + b[j], c[i][:, None] + d[j]
            if ((p > top) & (q > top) & (np.abs(p - q) <= width)).any():
                found += 1
                break
    return found / pairs


def calibrated(n: int, rho: float) -> tuple[float, int, int]:
    """Height of the ends, directions in each list and least count of collisions for n leaders and pairs of similarity rho."""
    share = min(END / max(n, 1), 0.25)
    t = NormalDist().inv_cdf(1 - share)
    side = max(1, int(sqrt(-np.log(1 - RECALL) / (2 * share * both_beyond(t, rho) * SETS))))  # enough if lines were independent
    while (1 - met_at_an_end(t, rho, side)) ** SETS > 1 - RECALL:
        side += max(1, side // 16)
    return t, side, least_count(rho)


def least_count(rho: float) -> int:
    p = 2 * NormalDist().cdf((WINDOW + 0.5 / SCALE) / sqrt(2 - 2 * rho)) - 1
    return int(COUNTED * p - 3.5 * sqrt(COUNTED * p * (1 - p)))


def _bits(round_: int, bits: int):
    def key(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), dtype=np.int64)
        sizes = v.map(len)
        for d in sizes.unique():
            at = (sizes == d).to_numpy()
            signs = (np.array(list(v[at]), dtype=np.float64) @ _directions(int(d), bits, 100 + round_)) > 0
            out[at] = (signs @ (1 << np.arange(bits, dtype=np.int64))) * 65536 + d
        return pd.Series(out)

    return F.pandas_udf(key, "long")("v")


def cosine(a: Column, b: Column) -> Column:
    """In the JVM: one Python worker less beside each task. Vectors of different lengths are opposite."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) != F.size(b), F.lit(-1.0)).otherwise(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))


def _cells(reps: DataFrame, n: int) -> DataFrame:
    """(cell, leader's vector, rep, v, mult, c): every vector with its cell and its cosine to the leader."""
    done, bits = None, max(8, min(40, n.bit_length()))
    rest = reps
    for i in range(ROUNDS):
        rest = rest.withColumn("key", _bits(i, bits))
        leaders = rest.groupBy("key").agg(F.min(F.struct("rep", "v")).alias("l"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "l")
        at = rest.join(leaders, "key", "left").withColumn("c", F.when(F.col("l").isNull(), 2.0).when(F.col("l.rep") == F.col("rep"), 1.0).otherwise(cosine(F.col("l.v"), F.col("v"))))
        at = C.cut(at.withColumn("near", F.col("l").isNotNull() & (F.col("c") >= CELL)))
        led = at.filter("near").groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
        own = at.filter("near").join(led, "key").select(F.col("l.rep").alias("cell"), F.col("l.v").alias("lv"), "rep", "v", "mult", "c")
        done = own if done is None else done.unionByName(own)
        alone = at.join(led.withColumn("led", F.lit(True)), "key", "left").filter(~F.col("near") | F.col("led").isNull())
        rest = C.cut(alone.select("rep", "v", "mult"))
    return C.cut(done.unionByName(rest.select(F.col("rep").alias("cell"), F.col("v").alias("lv"), "rep", "v", "mult", F.lit(1.0).alias("c"))))


def ends_of(unit: np.ndarray, t: float, side: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, line, projection's height) of the ends at which unit vectors lie; lines of the lower ends are negative."""
    d, top = unit.shape[1], t * sqrt(2)
    step = max(1, 4_000_000 // side)
    for k in range(SETS):
        both = [unit @ _directions(d, side, 1000 + 2 * k + x) for x in (0, 1)]
        for sign in (1, -1):
            a, b = sign * both[0], sign * both[1]
            row, i = np.nonzero(a > (top - b.max(axis=1))[:, None])
            for at in range(0, max(len(row), 1), step):
                r, p = row[at : at + step], i[at : at + step]
                hit, q = np.nonzero(b[r] > (top - a[r, p])[:, None])
                yield r[hit], sign * ((k * side + p[hit]) * side + q + 1), (a[r[hit], p[hit]] + b[r[hit], q]) / sqrt(2)


def _ends(t: float, side: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            step = max(1, min(len(whole), 4_000_000 // side))
            for b in (whole.iloc[i : i + step] for i in range(0, len(whole), step)):
                sizes = b["v"].map(len)
                for d in sizes.unique():
                    own = b[sizes == d]
                    unit = _unit(own["v"])
                    codes = np.clip(np.round(unit @ _directions(int(d), COUNTED, 2) * SCALE), -127, 127).astype(np.int8)
                    row, line, x = (np.concatenate(z) for z in zip(*ends_of(unit, t, side), strict=True))
                    code = [c.tobytes() for c in codes]
                    yield pd.DataFrame({"line": line * 65536 + int(d), "cell": own["cell"].to_numpy()[row], "fat": own["fat"].to_numpy()[row], "x": x, "code": [code[i] for i in row]})

    return run


def _counted(least: tuple[int, int, int], width: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of a window with enough collisions, least[k] if k of the two stand for more than themselves; rows come sorted by line and projection, and only a window of them is held."""
        reach, enough = np.int16(WINDOW * SCALE), np.array(least)
        held: list[np.ndarray] = []
        last, tail = None, None

        def pairs() -> pd.DataFrame:
            found = np.unique(np.sort(np.concatenate(held), axis=1), axis=0)
            held.clear()
            return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

        for b in batches:
            if not len(b):
                continue
            lines, all_codes = b["line"].to_numpy(), np.frombuffer(b"".join(b["code"]), dtype=np.int8).reshape(len(b), COUNTED).astype(np.int16)
            cuts = [0, *(np.flatnonzero(lines[1:] != lines[:-1]) + 1), len(b)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = (b["x"].to_numpy()[lo:hi], b["cell"].to_numpy()[lo:hi], b["fat"].to_numpy()[lo:hi], all_codes[lo:hi])
                first = 0
                if last == lines[lo]:
                    first = len(tail[0])
                    part = tuple(np.concatenate(z) for z in zip(tail, part, strict=True))
                x, cell, fat, codes = part
                at = 0
                while at < len(x):
                    upto = int(np.searchsorted(x, x[at] + width, side="right"))
                    step = max(1, min(len(x) - at, 2_000_000 // (COUNTED * max(upto - at, 1))))
                    upto = int(np.searchsorted(x, x[at + step - 1] + width, side="right"))
                    start = max(at, first)  # earlier rows have met each other
                    near = (np.abs(codes[at : at + step, None, :] - codes[None, start:upto, :]) <= reach).sum(axis=2) >= enough[fat[at : at + step, None] + fat[None, start:upto]]
                    i, j = np.nonzero(near)
                    i, j = at + i, start + j
                    ok = (j > i) & (x[j] - x[i] <= width)
                    held.append(np.stack([cell[i[ok]], cell[j[ok]]], axis=1))
                    at += step
                last, keep = lines[lo], x >= x[-1] - width
                tail = (x[keep], cell[keep], fat[keep], codes[keep])
            if sum(map(len, held)) > 100_000:
                yield pairs()
        if held:
            yield pairs()

    return run


def _blocks(least: float):
    def run(key, owners: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        """Links between one block of a cell and one block of its partners' members; counts per vector, and the cells that link."""
        out = [pd.DataFrame({"rep": [], "n": [], "a": [], "b": [], "edge": []})]
        if len(owners) and len(others):
            hit = _unit(owners["v"]) @ _unit(others["v"]).T >= least
            cell = owners["cell"].iloc[0]
            out.append(pd.DataFrame({"rep": owners["rep"], "n": hit @ others["mult"].to_numpy(), "a": cell, "b": cell, "edge": False}))
            out.append(pd.DataFrame({"rep": others["rep"], "n": hit.T @ owners["mult"].to_numpy(), "a": others["cell"], "b": cell, "edge": hit.any(axis=0)}))
        found = pd.concat(out[1:] or out)
        return found[found["n"] > 0]

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors; links have cosine `least` or more."""
    C.small_batches(vectors.sparkSession)
    theta, cell = acos(least), acos(CELL)
    v = F.col(vector)
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    big = F.lit(1.7e308)
    finite = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= big)) & F.exists("v", lambda x: x != 0)
    # lengths do not count: with a largest component of 1 no square overflows or vanishes; the largest is a lambda's variable, found once and not per component
    largest = F.array(F.array_max(F.transform("v", F.abs)))
    base = base.withColumn("v", F.when(finite, F.transform(largest, lambda m: F.transform("v", lambda x: x / m + 0.0))[0]))
    live = base.filter("v is not null and vec_id is not null")
    reps = C.cut(live.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")))
    n = reps.count()
    cells = _cells(reps, n)
    leaders = C.cut(cells.groupBy("cell").agg(F.first("lv").alias("v"), F.count(F.lit(1)).alias("size"), F.sum("mult").alias("mult"), F.acos(F.least(F.min("c"), F.lit(1.0))).alias("r")))
    fat = leaders.filter("size > 1").head(1)
    rho = cos(theta + (2 * cell if fat else 0))
    t, side, _ = calibrated(leaders.count(), rho)
    ends = leaders.select("cell", (F.col("size") > 1).cast("int").alias("fat"), "v").mapInPandas(_ends(t, side), "line long, cell long, fat int, x double, code binary")
    counts = tuple(least_count(cos(theta + k * cell)) for k in range(3))
    pairs = ends.repartition("line").sortWithinPartitions("line", "x").mapInPandas(_counted(counts, REACH * sqrt(2 - 2 * rho)), "a long, b long").distinct()
    side = lambda k: leaders.select(F.col("cell").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("v", "size", "mult", "r")])
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("c", cosine(F.col("a_v"), F.col("b_v")))
    met = C.cut(met.filter(F.acos(F.least("c", F.lit(1.0))) <= F.lit(theta + 1e-9) + F.col("a_r") + F.col("b_r")).drop("a_v", "b_v"))
    single = met.filter((F.col("a_size") == 1) & (F.col("b_size") == 1) & (F.col("c") >= least))
    links = single.select(F.col("a").alias("rep"), F.col("b_mult").alias("n"), "a", "b", F.lit(True).alias("edge"))
    links = links.unionByName(single.select(F.col("b").alias("rep"), F.col("a_mult").alias("n"), "a", "b", F.lit(True).alias("edge")))
    first = F.col("a_size") >= F.col("b_size")
    thick = met.filter("a_size > 1 or b_size > 1").select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("owner"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("partner"), F.greatest("a_size", "b_size").alias("own"), F.least("a_size", "b_size").alias("part")
    )
    total = thick.groupBy("owner").agg(F.max("own").alias("own"), F.sum("part").alias("part"))
    total = C.cut(total.select("owner", F.ceil(F.col("own") / BLOCK).alias("rows"), F.ceil(F.col("part") / BLOCK).alias("cols")))
    member = cells.select("cell", "rep", "v", "mult")
    spread = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    owned = member.join(total, member["cell"] == total["owner"]).withColumn("row", spread("rows")).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    other = member.join(thick.select("owner", F.col("partner").alias("cell")), "cell").join(total, "owner").withColumn("col", spread("cols")).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    pick = [F.col(c).alias(c) for c in ("owner", "row", "col", "cell", "rep", "v", "mult")]
    blocks = owned.select(*pick).groupBy("owner", "row", "col").cogroup(other.select(*pick).groupBy("owner", "row", "col"))
    links = C.cut(links.unionByName(blocks.applyInPandas(_blocks(least), "rep long, n long, a long, b long, edge boolean")))
    parts = components(links.filter("edge").select("a", "b").distinct())
    added = links.groupBy("rep").agg(F.sum("n").alias("added"))
    named = cells.select("cell", "rep", "mult").join(leaders.select("cell", F.col("mult").alias("all")), "cell").join(added, "rep", "left").join(parts, F.col("cell") == F.col("node"), "left")
    named = C.cut(named.select("rep", F.coalesce("component", "cell").alias("component"), (F.col("all") - 1 + F.coalesce("added", F.lit(0))).alias("n_links")))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "component").select("rep", "n_links", "component_id")
    out = base.join(reps.select("v", "rep"), "v", "left").join(named, "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op3_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))
