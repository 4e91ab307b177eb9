"""The ordinal fit against a dense one: same features and grades, the same objective, another solver."""

import random

import numpy as np

from clauselake.llm import toxicity


def corpus():
    random.seed(21)
    clean = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    bad = ["grumble", "vexing", "odious", "wretch", "fiendish", "ghastly", "horrid", "loathe"]
    texts, toxic = [], []
    for i in range(260):
        y = i % 3 == 0
        words = [random.choice(clean) for _ in range(random.randint(3, 30))]
        words += [random.choice(bad) for _ in range(random.randint(1, 6) if y else int(random.random() < 0.06))]
        random.shuffle(words)
        texts.append(" ".join(words)), toxic.append(y)
    return [*texts, None, ""], np.array([*toxic, False, True])


def dense(texts, chosen):
    at = {int(f): i for i, f in enumerate(chosen)}
    x = np.zeros((len(texts), len(chosen)))
    for row, t in zip(x, texts, strict=True):
        for w in toxicity.distinct_words(t):
            for f in toxicity.features(w):
                if f in at:
                    row[at[f]] += 1
    return np.log1p(x)


def grades(texts, toxic, chosen):
    known = set(map(int, chosen))
    hits = np.array([sum(any(f in known for f in toxicity.features(w)) for w in toxicity.distinct_words(t)) for t in texts])
    thirds = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, np.clip(1 + (hits >= thirds[0]).astype(int) + (hits >= thirds[1]), 1, toxicity.GRADES), 0)


def objective(x, above, w, theta):
    z = np.clip(x @ w[:, None] - theta, -30, 30)
    return (np.logaddexp(0, z) - above * z).sum(axis=1).mean() + toxicity.PENALTY / 2 * w @ w


def solved(x, above):
    """Ordered thresholds by base and log gaps; Newton steps on a numerical Hessian, halved until they descend."""
    k = above.shape[1]
    unpack = lambda v: (v[: x.shape[1]], v[x.shape[1]] + np.concatenate([[0], np.cumsum(np.exp(v[x.shape[1] + 1 :]))]))
    value = lambda v: objective(x, above, *unpack(v))

    def gradient(v):
        w, theta = unpack(v)
        miss = (1 / (1 + np.exp(-np.clip(x @ w[:, None] - theta, -30, 30))) - above) / len(x)
        gt = -miss.sum(axis=0)
        return np.concatenate([x.T @ miss.sum(axis=1) + toxicity.PENALTY * w, [gt.sum()], [gt[j + 1 :].sum() * np.exp(v[x.shape[1] + 1 + j]) for j in range(k - 1)]])

    v = np.concatenate([np.zeros(x.shape[1]), [0.5], np.zeros(k - 1)])
    for _ in range(40):
        g = gradient(v)
        if np.abs(g).max() < 1e-9:
            break
        h = np.array([(gradient(v + 1e-5 * e) - gradient(v - 1e-5 * e)) / 2e-5 for e in np.eye(len(v))])
        h = (h + h.T) / 2
        step = np.linalg.solve(h + max(1e-8, -np.linalg.eigvalsh(h)[0] + 1e-8) * np.eye(len(v)), g)
        t = 1.0
        while value(v - t * step) > value(v) and t > 1e-8:
            t /= 2
        v = v - t * step
    return unpack(v)


def test_fit_equals_dense_solver():
    texts, toxic = corpus()
    got = toxicity.fit(texts, toxic)
    x, grade = dense(texts, got["feature"]), grades(texts, toxic, got["feature"])
    assert 5 < x.shape[1] < 80 and set(grade) == {0, 1, 2, 3}
    above = (grade[:, None] > np.arange(toxicity.GRADES)).astype(float)
    w, theta = solved(x, above)
    assert np.all(np.diff(got["theta"]) > 0) and np.all(np.diff(theta) > 0)
    best, found = objective(x, above, w, theta), objective(x, above, got["weight"], got["theta"])
    assert best <= found + 1e-9 and found - best < 0.02 * best + 1e-4
    p = lambda w, theta: 1 / (1 + np.exp(-(x @ w[:, None] - theta)))
    assert np.abs(p(w, theta) - p(got["weight"], got["theta"])).mean() < 0.02
    # the sparse scorer gives what the dense formula gives
    scored = toxicity._scored(got["feature"].tolist(), got["weight"].tolist(), got["theta"].tolist())
    import pandas as pd

    assert np.abs(scored(pd.Series(texts)).to_numpy() - p(got["weight"], got["theta"])).max() < 1e-9
