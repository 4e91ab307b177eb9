"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - theta_k): one weight vector shared by ordered thresholds, fitted by full-batch Adam with an L2
penalty. Features are sparse: for every distinct word of a text, the hashed word and its prefixes of 4 and 5 letters (stems).
Labels say toxic or not; the severity grades are 0 for the others and, for toxic ones, 1 to 3 by terciles of the
number of their distinct words that carry a selected feature. The fit sees a bounded sample of labelled rows, chosen by hash: at most
`most` of each class (documented parameter). Everything else reads all rows. Selected are features that 1 % of the toxic rows have,
with log-odds over 3, or over 2 where these cannot be chance (`SURE`): stems of a language with few toxic rows are in clean words, too.

Output per document: p1 to p3 (probability of grade 1, 2, 3 or above), severity (expected grade) and rejected
(p1 >= 0.5). Edge cases: null and empty texts have no words and keep the intercept's probabilities; labels that are null or miss
their document are not used; without labels of both classes all severities are 0; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WORDS = re.compile(r"[^\W\d_]+")
GRADES, SPACE_BITS, FEATURES = 3, 26, 4096
MOST, PENALTY, STEPS, RATE = 4000, 1e-4, 600, 0.1
SURE = 15
KEPT = 100_000


def features(word: str) -> list[int]:
    import xxhash

    parts = [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(p) >> (64 - SPACE_BITS) for p in parts]


def distinct_words(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text's distinct words, and how many of these have each."""
    return np.unique(np.array([f for w in distinct_words(text) for f in features(w)], dtype=np.uint32), return_counts=True)


def fit(texts: list[str | None], toxic: np.ndarray) -> dict[str, np.ndarray] | None:
    """Weights of selected features and ordered thresholds; None without both classes."""
    toxic = np.asarray(toxic).astype(bool)
    if not toxic.any() or toxic.all():
        return None
    bags = [counted(t) for t in texts]  # arrays: the sample's features take some tens of MB
    np_, nn = int(toxic.sum()), int((~toxic).sum())
    every = lambda y: np.unique(np.concatenate([bag for (bag, _), v in zip(bags, toxic, strict=True) if v == y]), return_counts=True)
    (found, pos), (clean, neg) = every(True), every(False)
    at_clean = np.minimum(np.searchsorted(clean, found), max(len(clean) - 1, 0))
    other = np.where(clean[at_clean] == found, neg[at_clean], 0) if len(clean) else np.zeros(len(found))
    odds = np.log((pos + 0.5) / (np_ + 1)) - np.log((other + 0.5) / (nn + 1))
    both = (pos + other) / (np_ + nn)
    sure = 2 * (pos * np.log(pos / (both * np_)) + other * np.log(np.maximum(other, 1) / (both * nn)))  # the likelihood ratio's statistic
    usual = (pos >= max(3, int(0.01 * np_))) & ((odds > 3) | (odds > 2) & (sure > SURE))
    found, worth = found[usual], (odds * np.sqrt(pos))[usual]
    chosen = np.sort(found[np.lexsort((found, -worth))[:FEATURES]])
    if not len(chosen):
        return None
    known = set(chosen.tolist())
    row, col, val = [], [], []
    for i, (bag, n) in enumerate(bags):
        at = np.minimum(np.searchsorted(chosen, bag), len(chosen) - 1)
        hit = chosen[at] == bag
        row.append(np.full(int(hit.sum()), i)), col.append(at[hit]), val.append(np.log1p(n[hit]))
    row, col, val = (np.concatenate(x) for x in (row, col, val))
    hits_of = np.array([sum(any(f in known for f in features(w)) for w in distinct_words(t)) if y else 0 for t, y in zip(texts, toxic, strict=True)])
    grade = np.where(toxic, 1 + np.searchsorted(np.quantile(hits_of[toxic], [1 / 3, 2 / 3]), hits_of, side="right"), 0)
    grade = np.where(toxic, np.clip(grade, 1, GRADES), 0)
    above = (grade[:, None] > np.arange(GRADES)).astype(float)
    w, base, gaps = np.zeros(len(chosen)), 0.5, np.zeros(GRADES - 1)
    state = [np.zeros(len(chosen) + GRADES) for _ in range(2)]
    for step in range(1, STEPS + 1):
        theta = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.bincount(row, weights=w[col] * val, minlength=len(texts))
        miss = (1 / (1 + np.exp(-np.clip(score[:, None] - theta, -30, 30))) - above) / len(texts)
        gw = np.bincount(col, weights=miss.sum(axis=1)[row] * val, minlength=len(chosen)) + PENALTY * w
        gt = -miss.sum(axis=0)
        g = np.concatenate([gw, [gt.sum()], [gt[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 1)]])
        for s, b, x in zip(state, (0.9, 0.999), (g, g * g), strict=True):
            s *= b
            s += (1 - b) * x
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        w, base, gaps = w - move[: len(w)], base - move[len(w)], gaps - move[len(w) + 1 :]
    return {"feature": chosen, "weight": w, "theta": base + np.concatenate([[0], np.cumsum(np.exp(gaps))])}


_NEW: list[int] = []


def _scored(feature: list[int], weight: list[float], theta: list[float]):
    known = dict(zip(feature, weight, strict=True))
    cut = np.array(theta)

    hits: dict[str, list[int]] = {}

    def run(texts: pd.Series) -> pd.DataFrame:
        score = np.zeros(len(texts))
        for i, text in enumerate(texts):
            found: Counter = Counter()
            for w in distinct_words(text):
                fs = hits.get(w, _NEW)
                if fs is _NEW:
                    if len(hits) > KEPT:
                        hits.clear()
                    hits[w] = fs = [f for f in features(w) if f in known] or None
                if fs:
                    found.update(fs)
            score[i] = sum(known[f] * np.log1p(n) for f, n in sorted(found.items()))
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - cut, -30, 30)))
        return pd.DataFrame({f"p{k + 1}": above[:, k] for k in range(GRADES)})

    return run


def sampled(docs: DataFrame, labels: DataFrame, most: int = MOST, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """At most `most` labelled texts of each class."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("toxic")).filter("toxic in (0, 1) and __id is not null")
    order = [F.xxhash64(F.lit(5), "__id"), "__id"]
    pick = known.filter("toxic = 1").orderBy(*order).limit(most).unionByName(known.filter("toxic = 0").orderBy(*order).limit(most))
    return docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("text")).join(F.broadcast(pick), "__id")  # at most 2 * most rows


def trained(docs: DataFrame, labels: DataFrame, **how) -> dict[str, list] | None:
    """The model, fitted in one task on the bounded sample: at most FEATURES weights come back."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__id", "text"], na_position="first")
        m = fit(list(part["text"]), part["toxic"].to_numpy())
        rows = [] if m is None else [(int(f), float(w)) for f, w in zip(m["feature"], m["weight"], strict=True)] + [(-1 - k, float(t)) for k, t in enumerate(m["theta"])]
        return pd.DataFrame(rows, columns=["feature", "weight"])

    rows = sampled(docs, labels, **how).groupBy(F.lit(0).alias("one")).applyInPandas(run, "feature long, weight double").collect()
    if not rows:
        return None
    theta = sorted((r for r in rows if r["feature"] < 0), key=lambda r: -r["feature"])
    known = [r for r in rows if r["feature"] >= 0]
    return {"feature": [r["feature"] for r in known], "weight": [r["weight"] for r in known], "theta": [r["weight"] for r in theta]}


def with_severity(docs: DataFrame, labels: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs plus __tox_1 to __tox_3, probabilities of those grades or above. Other columns pass through, whatever their names."""
    C.small_batches(docs.sparkSession)
    model = trained(docs, labels, text=text, **how)
    if model is None:
        return docs.select("*", *[F.lit(0.0).alias(f"__tox_{k + 1}") for k in range(GRADES)])
    score = _scored(**model)

    def probabilities(text: pd.Series) -> pd.DataFrame:
        return score(text)

    at = F.pandas_udf(probabilities, ", ".join(f"p{k + 1} double" for k in range(GRADES)))(F.col(f"`{text}`").cast("string"))
    scored = docs.select(*[F.col(f"`{c}`") for c in docs.columns], at.alias("__tox"))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"__tox.p{k + 1}").alias(f"__tox_{k + 1}") for k in range(GRADES)])


def severity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, p1, p2, p3, severity, rejected) per row of docs."""
    light = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = with_severity(light, labels, **how)
    p = [F.col(f"__tox_{k + 1}") for k in range(GRADES)]
    return out.select("doc_id", *[x.alias(f"p{k + 1}") for k, x in enumerate(p)], (p[0] + p[1] + p[2]).alias("severity"), (p[0] >= 0.5).alias("rejected"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return severity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
