"""Operators on documents against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clauselake.llm import common, graph, mixing, packing, pii, queries, setjoin, substrings, toxicity

DOCS = "doc_id long, text string, source string, key string, size int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = "word " * 30_000
    rows = [
        (1, None, "a", "x", 1), (2, "", None, None, None), (3, "  \t\n", "a", "x", 1), (4, "one", "b", "x", 1), (4, "one", "b", "x", 1), (None, "a text without id here", "b", "y", 2), (None, None, None, None, None), (5, long, "c", "x", 1),
        (6, "é😀 ünïcode " * 20, "c", "z", 3), ((1 << 60) + 1, "big id " * 3, "a", "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    random.seed(3)
    words = ["".join(random.choice("abcdeé ") for _ in range(random.randint(1, 9))) for _ in range(3000)]
    some = lambda n: " ".join(random.choice(words) for _ in range(n))
    passages = [some(150) for _ in range(4)]
    out = []
    for _ in range(120):
        t = some(random.randint(0, 300))
        for _ in range(random.randint(0, 2)):
            p, a = random.choice(passages), random.randint(0, 200)
            t += p[a : a + random.randint(380, 700)] + some(random.randint(0, 60))
        out.append(t)
    out += ["a" * 1500, "ab" * 900, "a" * 420, None, "", "x" * 399, out[5], out[5], "line one two three. " * 80]
    return out + [t[:50] + "Z" + t[51:] for t in out[:20] if len(t) > 60]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", "k", i) for i, t in enumerate(texts)], DOCS)


# --- 1 packing


def test_packing_round_trip(spark, texts):
    pieces = packing.pack(frame(spark, texts), length=256).toPandas()
    tok = packing.Words(packing.tokenizer_path()).tokenizer
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, t in enumerate(texts)}
    for doc, part in pieces.sort_values("start").groupby("doc_id"):
        assert b"".join(part["ids"]) == want[doc].tobytes()
        assert (part["start"] == part["length"].cumsum() - part["length"]).all() and (part["doc_tokens"] == len(want[doc])).all()
    assert all(zlib.crc32(a) == b for a, b in zip(pieces["ids"], pieces["ids_crc32"], strict=True))
    for _, seq in pieces.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"] == seq["length"].cumsum() - seq["length"]).all()
    sizes = pieces.groupby("sequence_id")["length"].sum().sort_index()
    assert (sizes.iloc[:-1] == 256).all() and list(sizes.index) == list(range(len(sizes)))
    joined = packing.sequences(packing.pack(frame(spark, texts[:9]), length=64)).orderBy("sequence_id").collect()
    assert sum(len(r["ids"]) for r in joined) == 4 * sum(len(want[i]) for i in range(9))


def test_packing_odd(spark, odd):
    rows = packing.pack(odd).collect()
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_id"] == 1) == 1
    assert len({r["doc_id"] for r in rows if r["doc_id"]}) == 7 and (1 << 60) + 1 in {r["doc_id"] for r in rows}
    assert packing.pack(odd.limit(0)).count() == 0


def test_pieces_are_what_the_tokenizer_gives():
    w = packing.Words(packing.tokenizer_path())
    random.seed(1)
    alphabet = [*"aBz09 .,'-_\n\t<|>", "é", "ß", "ñ", "İ", "Σ", "ς", "\x1c", "\x85", "\xa0", " ", "é", "你", "😀", "<|endoftext|>", "it's", "WE'LL"]
    for _ in range(400):
        t = "".join(random.choice(alphabet) for _ in range(random.randint(0, 40)))
        assert list(w.ids([t])[0]) == w.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_other_tokenizers_encode_themselves(spark):
    path = packing.tokenizer_path("byte_bpe_50k.json")
    w, t = packing.Words(path), "Hello World, it is a test"
    assert not w.plain and list(w.ids([t, None])[0]) == w.tokenizer.encode(t, add_special_tokens=False).ids
    got = packing.pack(frame(spark, [t]), path=path).first()
    assert np.frombuffer(got["ids"], dtype="<u4").tolist() == [*w.ids([t])[0], 2]
    assert packing.id_type(50_000, 2) == "<u2" and packing.id_type(70_000, 2) == packing.id_type(10, 1 << 16) == "<u4"


def test_hilbert_curve_is_a_walk():
    cells = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    keys = packing.hilbert(cells, 3)
    walk = cells[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# --- 2 personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v * 2 > 9) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    random.seed(1)
    texts = ["".join(random.choice("aB9.@-+ ()0125%_é😀,\n") for _ in range(random.randint(0, 60))) for _ in range(1500)]
    texts += ["4111 1111 1111 1111 x", "a@b.com_x@c.org a@b.c@d.e", "300.1.1.1 1.2.3.4.5.6.7.8", "9" * 20_000, "a" * 20_000 + "@", "1 " * 5000, None, "", "000000000001.2.3.4", "1.2.3.4 " * 3000]
    got = pii.spans(frame(spark, texts)).toPandas().set_index("doc_id")["spans"]
    for i, t in enumerate(texts):
        assert [(x["kind"], x["start"], x["end"]) for x in got[i] if x["kind"] in PATTERNS] == base_spans(t), repr(t)[:80]


def test_pii_validators_and_context(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32.", "iban GB82 WEST 1234 5698 7654 33.", "tel 555-123-4567", "order 555-123-4567", "social security 123-45-6789", "amex card 378282246310005", "card 378282246310006"]
    got = [[x["kind"] for x in r["spans"]] for r in pii.spans(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [["iban"], [], ["local_phone"], [], ["ssn"], ["short_card"], []]


def test_redaction(spark):
    t = "call +1 (555) 123-4567 or a@b.com now é😀 4111111111111111"
    rows = pii.redact(spark.createDataFrame([(1, t, 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, spans int")).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["call [phone] or [email] now é😀 [card]", None, ""] and [r["spans"] for r in rows] == [5, 6, 7]


def test_pii_is_native(spark, sf_dir):
    plan = queries.QUERIES["op2_pii_spans"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_odd(spark, odd):
    assert pii.spans(odd).count() == 10 and pii.redact(odd).columns == odd.columns and pii.redact(odd.limit(0)).count() == 0


# --- 5 toxicity


def test_toxicity_held_out(spark):
    random.seed(2)
    clean, bad = [f"w{i}" for i in range(400)], ["vilest", "scummy", "wretch", "dolt"]
    rows = []
    for i in range(600):
        words = random.choices(clean, k=random.randint(5, 80))
        if i % 4 == 0:
            for _ in range(random.randint(1, 4)):
                words.insert(random.randrange(len(words)), random.choice(bad))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t, "s", "k", 1) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    got = toxicity.severity(docs, labels).toPandas().set_index("doc_id")
    held = [(got.loc[i, "rejected"], y) for i, _, y in rows if i % 3 == 0]
    assert sum(a and y for a, y in held) >= 0.95 * sum(y for _, y in held) and not any(a and not y for a, y in held)
    assert ((got["p1"] >= got["p2"]) & (got["p2"] >= got["p3"])).all()
    many, few = [i for i, t, _ in rows if sum(w in bad for w in t.split()) == 4], [i for i, t, _ in rows if sum(w in bad for w in t.split()) == 1]
    assert got.loc[many, "severity"].mean() > got.loc[few, "severity"].mean()


@pytest.mark.parametrize(("n", "whole"), [(24, True), (48, False)])
def test_toxicity_of_a_rare_language(n, whole):
    """Toxic words in 1.5 % of the toxic texts each, or inflected ones, whose stems are in clean texts, too."""
    random.seed(3)
    clean, rare, letters = [f"w{i}" for i in range(400)], ["bomel", "achlu", "ursit", "gavop"], "abcdefghijklmnopqrstuvwxyz"
    texts = [random.choices(clean, k=20) + (["vilest"] if i < 400 - n else []) for i in range(2000)]
    for i in range(400 - n, 400):
        texts[i].append(rare[i % 4] + ("o" if whole else letters[i % 26] + letters[i // 26]))
    for i in range(1600, 1616):
        texts[i].append(rare[i % 4] + letters[i - 1600] + "zz")
    texts = [" ".join(t) for t in texts]
    model = toxicity.fit(texts, np.arange(len(texts)) < 400)
    caught = toxicity._scored(**{k: v.tolist() for k, v in model.items()})(pd.Series(texts))["p1"].to_numpy() >= 0.5
    assert caught[: 400 - n].mean() >= 0.95 and caught[400 - n : 400].mean() >= 0.9 and caught[400:].mean() <= 0.01


def test_toxicity_of_labelled_documents(spark):
    path = "/root/testdata/sf0.01"
    got = toxicity.op5_toxicity(spark, path).toPandas().merge(pd.read_parquet(f"{path}/labels.parquet"), on="doc_id")
    assert got.loc[got["toxic"] == 1, "rejected"].mean() >= 0.8 and not got.loc[got["toxic"] == 0, "rejected"].any()


def test_toxicity_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(4, 1), (None, 1), (5, None), (6, 0), (99, 1)], "doc_id long, toxic int")
    for labels in (none, some):
        rows = toxicity.severity(odd, labels).collect()
        assert len(rows) == 10 and all(0 <= r["severity"] <= 3 for r in rows)
    assert toxicity.severity(odd.limit(0), some).count() == 0


# --- 6 mixing


def test_mix_meets_targets(spark):
    random.seed(4)
    rows = [(i, " ".join(["w"] * min(int(random.paretovariate(1) * 5), 4000)), random.choice([None, "b", "ä", "a", "zz", "c"]), "k", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).toPandas()
    source = got["doc_id"].map({r[0]: r[2] or "￿" for r in rows})
    sizes = got.groupby(source)["size"].sum()
    weights = {s: w for s, w in zip(sorted(sizes.index, key=str.encode), [3, 1, 2] * 2, strict=True)}
    fixed, left = {}, 1.5 * sizes.sum()
    while True:
        rest = [s for s in sizes.index if s not in fixed]
        share = {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest}
        full = [s for s in rest if share[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]
    want = fixed | share
    for s, part in got.groupby(source):
        assert part["target"].iloc[0] == pytest.approx(want[s]) and part["source_size"].iloc[0] == sizes[s]
        assert part["taken"].sum() == pytest.approx(want[s], rel=0.005)
    assert (got["taken"] <= 2 * got["size"]).all()
    again = mixing.mix(docs.orderBy(F.rand())).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_mix_one_long_document(spark):
    docs = spark.createDataFrame([(1, "w " * 5000, "a", "k", 1), (2, "w " * 40, "a", "k", 1), (3, "w " * 3000, "b", "k", 1), (4, "w", "c", "k", 1)], DOCS)
    got = mixing.mix(docs).toPandas()
    sums = got.groupby("target")["taken"].sum()
    assert all(v == pytest.approx(t, rel=0.01, abs=1) for t, v in sums.items()) and (got["taken"] <= 2 * got["size"]).all()


def test_mix_large_classes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    docs = spark.createDataFrame([(i, "a b c", "x" if i % 2 else "y", "k", 1) for i in range(1000)], DOCS)
    got = mixing.mix(docs).toPandas()
    for t, part in got.groupby("target"):
        assert abs(part["taken"].sum() - t) <= 3


def test_mix_odd(spark, odd):
    got = mixing.mix(odd).toPandas()
    assert len(got) == 10 and (got["taken"] <= 2 * got["size"]).all() and mixing.mix(odd.limit(0)).count() == 0


def test_word_count(spark, texts):
    got = frame(spark, texts).select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()
    assert all(r["n"] == len((texts[r["doc_id"]] or "").encode().split()) for r in got)


# --- 8 repeated substrings


def repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "hot"), [(400, 1000), (100, 1000), (100, 1)])
def test_substrings_exact(spark, texts, length, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    out = substrings.remove_repeats(frame(spark, texts), length=length).toPandas().sort_values("doc_id")
    got = [(r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out.itertuples()]
    assert got == repeats(texts, length) and sum(x[1] for x in got) > 10_000


def test_substrings_texts_move_once(spark, texts, monkeypatch):
    """However often groups are split, every text is packed and moved once."""
    monkeypatch.setattr(substrings, "HOT", 1)
    packed, packs = spark.sparkContext.accumulator(0), substrings._packed

    def counted(batches):
        def seen():
            for b in batches:
                packed.add(len(b))
                yield b

        yield from packs(seen())

    monkeypatch.setattr(substrings, "_packed", counted)
    assert substrings.remove_repeats(frame(spark, texts), length=100).count() == len(texts) == packed.value


def test_substrings_odd(spark, odd):
    got = {r["doc_id"]: r for r in substrings.remove_repeats(odd).collect()}
    assert got[1]["n_bytes"] == 0 and got[5]["kept"] == b"" and got[(1 << 60) + 1]["n_bytes"] == 21
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


# --- 9 Jaccard join


def classes(ids, texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least: dict = {}
    for i in range(len(sets)):
        least[find(i)] = min(least.get(find(i), 1 << 62), ids[i])
    return [(ids[i], len(sets[i]), least[find(i)]) for i in range(len(sets))]


@pytest.mark.parametrize(("n", "percent", "small"), [(3, 90, 16), (5, 80, 16), (5, 80, 2), (3, 90, 1)])
def test_jaccard_classes(spark, n, percent, small, monkeypatch):
    monkeypatch.setattr(setjoin, "SMALL", small)
    random.seed(5)
    words = ["".join(random.choice("abcdeXé") for _ in range(random.randint(1, 6))) for _ in range(300)]
    texts = []
    for _ in range(80):
        base = [random.choice(words) for _ in range(random.choice([1, 2, 3, 5, 8, 13, 20, 40, 80, 150, 300]))]
        for _ in range(random.randint(1, 6)):
            c = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                k = random.randrange(len(c))
                c[k : k + random.randint(0, 1)] = [random.choice(words)] * random.randint(0, 2)
            texts.append(" ".join(c))
    texts += [None, "", "  ", texts[3], texts[3].upper()]
    docs = spark.createDataFrame([(i + 7, t, "s", "k", 1) for i, t in enumerate(texts)], DOCS)
    got = [tuple(r) for r in setjoin.jaccard_classes(docs, n, percent).orderBy("doc_id").collect()]
    assert got == classes([i + 7 for i in range(len(texts))], texts, n, percent)


def test_jaccard_chain_in_one_bucket(spark, monkeypatch):
    """Near copies of which neighbours link and the ends do not, over several blocks."""
    monkeypatch.setattr(setjoin, "BLOCK", 7)
    monkeypatch.setattr(setjoin, "SMALL", 3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"x{j}" if j < 5 * i else w for j, w in enumerate(base)) for i in range(24)]
    docs = spark.createDataFrame([(i, t, "s", "k", 1) for i, t in enumerate(texts)], DOCS)
    got = [tuple(r) for r in setjoin.jaccard_classes(docs, 3, 90).orderBy("doc_id").collect()]
    assert got == classes(list(range(24)), texts, 3, 90)


@pytest.mark.parametrize("small", [16, 3])
def test_jaccard_common_passage(spark, small, monkeypatch):
    """Texts that share a passage but are not similar, some of which have near copies: large buckets, few of which are left when the
    rarest shingles sign."""
    monkeypatch.setattr(setjoin, "SMALL", small)
    monkeypatch.setattr(setjoin, "BLOCK", 9)
    blocks, links = [], setjoin._linked_by_blocks
    monkeypatch.setattr(setjoin, "_linked_by_blocks", lambda rest, *x: blocks.append(rest.select("node").distinct().count()) or links(rest, *x))
    random.seed(8)
    passage = [f"p{i}" for i in range(50)]
    texts = []
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(random.choice([6, 9, 12, 16]))]
        texts.append(" ".join(passage + own))
        if i % 4 == 0:
            texts.append(" ".join(["new", *passage, *own[:-1]]))
    random.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "s", "k", 1) for i, t in enumerate(texts)], DOCS)
    got = [tuple(r) for r in setjoin.jaccard_classes(docs, 5, 80).orderBy("doc_id").collect()]
    assert got == classes(list(range(len(texts))), texts, 5, 80)
    assert sum(blocks) <= len(texts)


def test_jaccard_texts_stay(spark, monkeypatch):
    """Where texts that share a passage sign again, what joins their texts moves, not the texts."""
    monkeypatch.setattr(setjoin, "SMALL", 3)
    plans, rare = [], setjoin._linked_by_rare

    def seen(session, met, held, *x):
        plan = held.join(met.select("node", "n"), "node").select("blob")
        plans.append(plan._jdf.queryExecution().executedPlan().toString())
        return rare(session, met, held, *x)

    monkeypatch.setattr(setjoin, "_linked_by_rare", seen)
    passage = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(i, f"{passage} " + " ".join(f"o{i}x{j}" for j in range(9)), "s", "k", 1) for i in range(40)], DOCS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert setjoin.jaccard_classes(docs, 5, 80).select("component_id").distinct().count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1]


def test_rarest_shingles_meet(monkeypatch):
    """Of two similar texts, the first shared shingle is among the prefixes of both and an inner one of the smaller, whatever the weights."""
    import zstandard

    random.seed(2)
    z = zstandard.ZstdCompressor()
    seen = 0
    for cells in (1, 16, 1 << 20):
        monkeypatch.setattr(setjoin, "CELLS", cells)
        weights = type("Held", (), {"value": np.random.default_rng(3).integers(0, 4, cells)})
        for _ in range(150):
            x = [f"w{random.randrange(30)}" for _ in range(random.randint(1, 60))]
            y = list(x)
            for _ in range(random.randint(0, 3)):
                y.insert(random.randrange(len(y) + 1), f"w{random.randrange(30)}")
            sets = [setjoin.shingle_set(" ".join(t), 2) for t in (x, y)]
            both = len(np.intersect1d(*sets))
            if 100 * both < 80 * (len(sets[0]) + len(sets[1]) - both):
                continue
            seen += 1
            rows = pd.DataFrame({"node": [0, 1], "n": [len(s) for s in sets], "blob": [z.compress(" ".join(t).encode()) for t in (x, y)]})
            out = pd.concat(setjoin._prefixes(2, 80, weights)(iter([rows])))
            a, b = out[out["node"] == 0].set_index("s"), out[out["node"] == 1].set_index("s")
            met = a.join(b, how="inner", lsuffix="x", rsuffix="y")
            first = met.sort_values("atx").iloc[0]
            assert first["aty"] == met["aty"].min()
            assert first["innerx"] if len(sets[0]) <= len(sets[1]) else first["innery"]
            assert 180 * min(len(sets[0]) - first["atx"], len(sets[1]) - first["aty"]) >= 80 * (len(sets[0]) + len(sets[1]))
    assert seen > 100


def test_hot_signatures_leave_memory_early(spark, monkeypatch):
    """What is held, split and passed through gives the same buckets."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 30)) for _ in range(60)] + [" ".join(f"v{j}" for j in range(120) if j != i) for i in range(60)]
    batches = lambda: iter([pd.DataFrame({"text": texts[i : i + 10]}) for i in range(0, 120, 10)])
    packed = pd.concat(setjoin._packed(3, 80, frozenset(), 3)(batches())).sort_values("part", kind="stable")
    whole = pd.concat(setjoin._shared(3)(iter([packed]))).drop_duplicates().sort_values(["s", "node"])
    monkeypatch.setattr(setjoin, "HELD", 40)
    monkeypatch.setattr(setjoin, "HOT", 3)
    early = pd.concat(setjoin._shared(3)(iter([packed.iloc[i : i + 1] for i in range(len(packed))]))).drop_duplicates().sort_values(["s", "node"])
    assert len(whole) > 500 and whole.to_numpy().tolist() == early.to_numpy().tolist()


def test_signatures_move_in_four_bytes():
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(20)]
    signer = setjoin.Signer(80, frozenset())
    signed = sum(len(signer.sign(setjoin.shingle_set(t, 3))[0]) for t in texts)
    packed = pd.concat(setjoin._packed(3, 80, frozenset(), 5)(iter([pd.DataFrame({"text": texts})])))
    assert packed["s"].map(len).sum() == 4 * signed and set(packed["part"]) == set(range(5))


def test_texts_without_ids_are_compared(spark):
    """A text that occurs only in a row without an id is linked, too, and its text moves with its node."""
    words = [f"w{i}" for i in range(200)]
    rows = [(None, " ".join(words)), (7, " ".join(words[:-1])), (8, "nothing like it")]
    out = setjoin.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=90)
    assert {(r["doc_id"], r["component_id"]) for r in out.collect()} == {(None, 7), (7, 7), (8, 8)}


@pytest.mark.parametrize("forced", [True, False])
def test_signatures_cover_the_pigeonhole(monkeypatch, forced):
    """Every pair above the threshold shares more signatures than the smaller set's slack, with and without deletions."""
    if forced:
        monkeypatch.setattr(setjoin, "allocate", lambda band, low, high, percent: setjoin.Allocation(band, low, high, setjoin.needed(high, percent), 2, setjoin.needed(high, percent)))
    rng = np.random.default_rng(0)
    signer = setjoin.Signer(80, frozenset())
    for _ in range(300):
        n = int(rng.integers(10, 200))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        cut = int(rng.integers(0, max(1, n // 10)))
        y = np.unique(np.concatenate([x[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        (a, short, slack), (b, other, _) = (signer.sign(z) for z in sorted((x, y), key=len))
        if 100 * both >= 80 * (len(x) + len(y) - both) and not short and not other:
            assert len(np.intersect1d(a, b)) > slack


def test_jaccard_odd(spark, odd):
    got = setjoin.jaccard_classes(odd, 3, 90).toPandas()
    assert len(got) == 10 and got.loc[got["doc_id"] == 1, "n_shingles"].tolist() == [0]
    assert setjoin.jaccard_classes(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_numbered_and_running_sum(spark):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "x int")
    assert [r["x"] for r in common.numbered(rows, [F.col("x")], "at").orderBy("at").collect()] == list(range(101))
    arrays = [[], [5], list(range(100)), [1] * 1000]
    got = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<long>").select("i", common.running_sum(F.col("a")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [list(np.cumsum(a)) for a in arrays]


def test_registered_queries_run(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    for name in ("op1_curve_packing", "op6_source_mix", "op8_repeated_substrings", "op9_jaccard_join", "op5_toxicity"):
        got = queries.QUERIES[name](spark, sf_dir)
        assert got.select("doc_id").distinct().count() == len(docs), name
