"""Filter audit, collocations and rule lists against brute force, and their edge cases."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from clauselake.llm import collocations, filteraudit, rulelist

DOCS = "doc_id long, text string, lang string, source string, mask int, n int, part string"
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """(id, text, lang) as documents with columns of clashing names."""
    return spark.createDataFrame([(i, t, g, None, 7, 8, "x") for i, t, g in rows], DOCS)


@pytest.fixture(scope="module")
def mixed():
    random.seed(11)
    words = ["alpha", "Beta", "GAMMA", "d$", "é", "ünï", "x|y", "a\x0bb", "z", "0", "#", "LONGWORDLONGWORD", "\xa0", "\x85", "\x1c", "😀"]
    out = []
    for _ in range(150):
        pool = random.sample(words, random.randint(1, len(words)))
        n = random.choice([0, 1, 5, 99, 100, 101, 300])
        t = "".join(random.choice(pool) + random.choice(" \t\n\r\x0c  ") for _ in range(n))
        out.append(t + " ".join(f"w{random.randint(0, 400)}" for _ in range(random.choice([0, 100, 250]))))
    out += [None, "", " \n", "A", "a" * 5000, *out[:30], None]
    return [(i, t, random.choice(["en", "de", None, ""])) for i, t in enumerate(out)]


# --- 11 filter audit


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search("[#$%&*|]", t)) + "E" * (i is not None and i > first[t])
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own, removals = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                here = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removals[f] += len(here)
                gone = sum(f in d[1] for d in own) - len(here)
                out[part, order, k + 1] = [len(left), len(here), gone, sum(d[1] == f for d in own), sum(d[2] for d in here), sum(d[3] for d in here)]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(removals[order[k - 1]])
    return out


def audited(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


def test_audit_brute_force(spark, mixed):
    random.seed(2)
    rows = [*mixed, (None, mixed[3][1], "en"), (None, None, None), mixed[4], (1 << 60, mixed[5][1], "de")]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i, *_ in mixed if random.random() < 0.5] + [(None, 1, 1), (2, 1, 0), (2, 0, 1), (10_000, 1, 1)]
    got = audited(filteraudit.audit(frame(spark, rows), spark.createDataFrame(labels, LABELS)))
    want = brute_audit(rows, labels)
    assert len(got) == 600 * 3 and got == want


def test_audit_empty(spark):
    none = frame(spark, [(1, "a", "en")]).limit(0)
    assert filteraudit.audit(none, spark.createDataFrame([], LABELS)).count() == 0
    got = audited(filteraudit.audit(frame(spark, [(1, None, None)]), spark.createDataFrame([], LABELS)))
    assert got == brute_audit([(1, None, None)], [])


@pytest.mark.parametrize("size", [64, 1000, filteraudit.SLICE])
def test_scan_slices(mixed, size):
    """Texts shorter and longer than a slice, words longer than one, an array with an offset."""
    random.seed(5)
    texts = [t for _, t, _ in mixed] + ["x" * 64, "x" * 63 + " " + "y" * 65, ("v" * 200 + " ") * 3 + "v" * 199, " " * 300 + "q" * 64 + " " * 64, "é" * 333]
    counts, _ = filteraudit.scan(filteraudit.Scanner(size), pa.array(["skip", *texts])[1:])
    for t, got in zip(texts, counts.tolist(), strict=True):
        t = t or ""
        w = WORD.findall(t)
        assert got == [len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t)), len(t)]


def test_scan_equal_hashes():
    """Words of equal hash are told apart: with base 1 the hash is a sum of bytes, so anagrams meet."""
    scanner = filteraudit.Scanner(1 << 12, base=1)
    texts = ["ab ba ab", "abc cab bca abc", "same same", "x" * 70 + "ab " + "x" * 70 + "ba", ("ab ba " * 2000)]
    counts, _ = filteraudit.scan(scanner, pa.array(texts))
    assert counts[:, 1].tolist() == [2, 3, 1, 2, 2]


def test_scan_long_text():
    text = " ".join(f"w{k % 70_001}" for k in range(2_000_000))
    counts, _ = filteraudit.scan(filteraudit.Scanner(), pa.array([text, "a b"]))
    assert counts[0, :2].tolist() == [2_000_000, 70_001] and counts[1, :2].tolist() == [2, 2]
    assert filteraudit.masks(np.array(counts)).tolist() == [2, 1]


# --- 13 quality rules


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {x for x in triples if triples.count(x) > 1} if len(triples) < 3000 else {x for x, n in Counter(triples).items() if n > 1}
    covered = {i + k for i, x in enumerate(triples) if x in often for k in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)]


def test_statistics_brute_force(spark, mixed):
    random.seed(4)
    texts = [t for _, t, _ in mixed] + ["a b c a b c a b c", "x x x x", "a b c d a b c", "l\nl\n\n \nl\r\nl", "a b", "é é é é <b>|</b>", "one two three\nfour " * 900, "w " * 20_000, "\x1c \x85 \xa0\n\x1c \x85 \xa0"]
    texts += [" ".join(random.choice("abc") for _ in range(random.randint(0, 30))) for _ in range(60)]
    got = {r["doc_id"]: [r[c] for c in rulelist.COUNTS] for r in rulelist.statistics(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(texts)}


def prose(n):
    return " ".join(f"word{random.randint(0, 9999)}" for _ in range(n))


def test_rules_learn(spark):
    """Two kinds of junk, each by a rule of its own; a held-out half is judged by the list that the other half taught."""
    random.seed(6)
    n = lambda: random.randint(60, 160)
    kinds = {0: lambda: prose(n()), 1: lambda: " ".join(x + "##" for x in prose(n()).split()), 2: lambda: prose(n()).upper()}
    rows = [(i, kinds[0 if i % 3 else 1 + i % 2](), "en") for i in range(600)]
    junk = {i for i, *_ in rows if not i % 3}
    labels = [(i, int(i not in junk), 0) for i in range(300)] + [(None, 0, 0), (1, None, 0), (700, 0, 0)]
    known = spark.createDataFrame(labels, LABELS)
    out = rulelist.judge(frame(spark, rows), known).collect()
    assert {r["doc_id"] for r in out if not r["kept"]} == junk and not any(r["base_failed"] for r in out)
    assert len({r["rule"] for r in out} - {None}) == 2


def test_rules_odd(spark, mixed):
    rows = [*mixed, (None, None, None), (None, prose(60), "en"), mixed[0], mixed[0], (5000, "x" * 5000 + " y" * 80, "en")]
    for labels in ([], [(1, 1, 1)], [(1, 1, 1), (1, 0, 1), (2, None, None)]):
        out = rulelist.judge(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
        assert len(out) == len(rows)
        for r in out:
            fails = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
            assert r["base_failed"] == fails and r["kept"] == (not fails) and r["rule"] is None
    assert rulelist.judge(frame(spark, rows).limit(0), spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0


# --- 12 collocations


def pieces_of(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", t)]


def counts_of(rows):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        for w in pieces_of(t):
            g = "und" if lang is None else lang
            n[g] += len(w)
            f.update((g, *w[i : i + m]) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    return f, n


def brute_phrases(rows, least=30, top=2000):
    f, n = counts_of(rows)
    out = {}
    for key, a in f.items():
        g, w = key[0], key[1:]
        if len(w) < 2 or a < least:
            continue
        cut = min(((2_000_000 * a) // (f[g, *w[:k]] + f[g, *w[k:]]), k) for k in range(1, len(w)))
        score, k = cut
        out[key] = (score, a, f[g, *w[:k]], f[g, *w[k:]])
    dropped = {(key[0], *key[i:j]) for key in out for i in range(1, len(key)) for j in range(i + 2, len(key) + 1) if j - i < len(key) - 1 and 100 * out[key][1] >= 80 * f[key[0], *key[i:j]]}
    result = []
    for g in n:
        left = sorted(((-s, -a, " ".join(key[1:]).encode(), left, right) for key, (s, a, left, right) in out.items() if key[0] == g and key not in dropped))
        result += [(g, k + 1, p.decode(), -a, left, right, n[g], -s) for k, (s, a, p, left, right) in enumerate(left[:top])]
    return sorted(result)


@pytest.fixture(scope="module")
def phrases():
    """Few words, so that many phrases are frequent; separators, tabs, capitals, control characters, a text of thousands of words."""
    random.seed(12)
    words = ["a", "B", "b", "a\x01", "A\x01b", "é", "É", "c-c", "d", "the", "\xa0", "😀", "of"]
    some = lambda n: "".join(random.choice(words) + random.choice(["\t", " ", " ", " ", "  ", ". ", "\n", "!"]) for _ in range(n))
    rows = [(i, some(random.choice([0, 1, 3, 40, 200])), random.choice(["en", "de", None, "und", ""])) for i in range(120)]
    return [*rows, (200, some(6000), "en"), (201, None, None), (202, "", "fr"), (203, "the same of it " * 50, "fr"), (None, "x y z. " * 40, "fr"), (204, "q" * 4000 + " end", "fr")]


def test_collocations_brute_force(spark, phrases):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for top in (2000, 7):
        got = sorted(tuple(r[c] for c in names) for r in collocations.mine(frame(spark, phrases), top=top).collect())
        assert got == brute_phrases(phrases, top=top)


def test_collocations_empty(spark):
    for rows in ([(1, None, "en")], [(1, "a b. c", None)]):
        assert collocations.mine(frame(spark, rows)).count() == 0
    assert collocations.mine(frame(spark, [(1, "a", "en")]).limit(0)).count() == 0


@pytest.mark.parametrize(("size", "held"), [(64, 50), (200, 7), (1 << 21, 1000), (64, 1), (97, 10**9)])
def test_tries_of_shards(phrases, monkeypatch, size, held):
    """Sums over the tries of all parts equal plain counts, however texts are sliced and when parts are written; paths are sorted."""
    monkeypatch.setattr(collocations, "HELD", held)
    words, got, total = collocations.Words(size), Counter(), Counter()
    texts = pa.array([t for _, t, _ in phrases] + ["g" * 300 + " h " + "g" * 300 + " h", "x " * 100 + "\n" + " " * 200 + "x x"]).fill_null("").cast(pa.large_binary())
    langs = [g if g is not None else "und" for _, _, g in phrases] + ["en", "en"]
    _, at, data = texts.buffers()
    every = collocations.Bits(np.full(1 << 12, 2**64 - 1, np.uint64))
    parts = [*words.add(np.frombuffer(data, np.uint8), np.frombuffer(at, np.int64), np.array([words.lang(g) for g in langs])), *words.ready(end=True)]
    names = list(words.langs)
    for part in parts:
        paths, counts, known = collocations.trie(part, every, every)
        keys = [tuple(known[i] for i in path if i >= 0) for path in zip(*paths, strict=True)]
        assert keys == sorted(keys)
        for key, n in zip(keys, counts.tolist(), strict=True):
            got[names[key[0][0]], *(w.decode() for _, w in key)] += n
        total.update(names[g] for g in part[5][: part[6]])
    f, n = counts_of([(0, t.decode(), g) for t, g in zip(texts.to_pylist(), langs, strict=True)])
    assert got == f and total == +n


def test_tries_of_equal_hashes(monkeypatch):
    """Different words of one hash keep apart."""
    words = collocations.Words()
    monkeypatch.setattr(words.scanner, "words", lambda d, o, c, f=words.scanner.words: (*(x := f(d, o, c))[:2], x[2] & np.uint64(1)))
    text = "one two three four five six one two three"
    list(words.add(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), np.array([words.lang("en")])))
    (part,) = words.ready(end=True)
    paths, counts, known = collocations.trie(part, *[collocations.Bits(np.full(1 << 12, 2**64 - 1, np.uint64))] * 2)
    got = {" ".join(known[i][1].decode() for i in p if i >= 0): n for p, n in zip(zip(*paths, strict=True), counts.tolist(), strict=True)}
    assert got["one two three"] == 2 and got["six one"] == 1 and got["one"] == 2 and "two one" not in got


def test_hash_blobs():
    """What is packed comes back, bucket by bucket, and a filter made of keys passes all of them."""
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    n = rng.integers(1, 100_000, len(h))
    for top in (4, 11, 20):
        got = [(np.uint64(b << 40) | x, k) for b, s, blob in collocations.packed(h, n, top) for x, k in [collocations.unpacked(s, blob)]]
        assert (np.concatenate([x for x, _ in got]) == collocations.key(h, top)).all() and (np.concatenate([k for _, k in got]) == n).all()
    words = np.zeros(1 << 12, np.uint64)
    for p in collocations.places(collocations.key(h[:2500], 11), 18):
        np.bitwise_or.at(words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
    passing = collocations.Passing(words, 11)
    assert passing.has(h[:2500]).all() and passing.has(h[2500:]).mean() < 0.01
    assert list(collocations.packed(h[:0], n[:0], 4)) == []
