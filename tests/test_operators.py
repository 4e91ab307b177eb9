"""Operators of the contract domain on small fixtures."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.functions import lexicon, rulebook
from clauselake.functions import text as T
from clauselake.operators import classify, dataset, eda, encode, features, ground, index, metrics, prompt, risk, segment, synth


def texts(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, text string")


# --- configuration


def test_configuration():
    assert set(lexicon.TRIGGERS) == set(lexicon.TAXONOMY) and len(lexicon.TAXONOMY) == 16 and sum(map(len, lexicon.TRIGGERS.values())) == 86
    assert len(rulebook.RULES) == 27 and len({r.rule_id for r in rulebook.RULES}) == 27 and len(lexicon.CONCEPTS) == 28
    for r in rulebook.RULES:
        assert set(r.clause_types) <= set(lexicon.TAXONOMY) and r.level in lexicon.RISK_LEVELS and r.triggers and r.anchors and r.query and r.fallback and r.concept in lexicon.CONCEPTS
        assert set(re.findall(r"\{(\w+)\}", r.rationale)) <= set(r.extractors)


def test_patterns_compile_everywhere(spark):
    patterns = [p for ps in lexicon.TRIGGERS.values() for p in ps] + [p for r in rulebook.RULES for p in (*r.triggers, *r.exclusions, *r.extractors.values())] + list(lexicon.CONCEPTS.values())
    con = duckdb.connect()
    row = spark.range(1).select(*[F.lit("some text").rlike(T.java(p)).alias(f"c{i}") for i, p in enumerate(patterns)]).first()
    for i, p in enumerate(patterns):
        assert row[i] == bool(re.search(p, "some text")) == con.execute("SELECT regexp_matches('some text', ?)", [p]).fetchone()[0]


# --- text and segmentation


def test_text_helpers(spark):
    row = texts(spark, ["a  b\tc\x1cd "]).select(T.collapse(F.col("text")), T.first_filled(F.lit(None).cast("string"), F.lit(""), F.lit("x")), T.phrase_count(F.lit("May may dismay"), "may"), T.captured(F.lit("pay $1,234 now"), r"\$([\d,]+)|(never)")).first()
    assert list(row) == ["a b c d", "x", 3, "1,234"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One block.\n\nAnother block.", ["One block.", "Another block."]),
        ("4.1 First thing here\n4.2 Second thing here", ["4.1 First thing here", "4.2 Second thing here"]),
        ("(a) alpha part\n(b) beta part\n43. RIGHT OF ENTRY", ["(a) alpha part", "(b) beta part", "43. RIGHT OF ENTRY"]),
        ("a single line", ["a single line"]),
        ("", []),
        (" \n \n", []),
        ("1. One thing\r\n2. Two things\r\n\r\ntail", ["1. One thing", "2. Two things", "tail"]),
        ("Premises and Term\nThe rooms are let.\nRent\nIt is due.\nRepairs\nThey are shared.\nKeys\nTwo.", ["Premises and Term The rooms are let.", "Rent It is due.", "Repairs They are shared.", "Keys Two."]),
        ("It may\nconstitute a breach of this lease.\nwrapped on", ["It may constitute a breach of this lease. wrapped on"]),
    ],
)
def test_paragraphs(spark, text, want):
    assert [r["text"] for r in segment.split_paragraphs(texts(spark, [text]), "id").orderBy("section_idx").collect()] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("First one. Second one!", ["First one.", "Second one!"]),
        ("One part; another part.", ["One part; another part."]),
        ("Dr. Who met No. Six, e.g. there. Then left.", ["Dr. Who met No. Six, e.g. there.", "Then left."]),
        ('He said "stop." Then went.', ['He said "stop."', "Then went."]),
        ("12.2 Clause two.", ["2 Clause two."]),
        (None, []),
    ],
)
def test_sentences(spark, text, want):
    assert [r["text"] for r in segment.split_sentences(texts(spark, [text]), "id").orderBy("sentence_idx").collect()] == want


def test_page_rows(spark):
    pages = spark.createDataFrame([("d", 1, "Third one."), ("d", 0, "First one. Second one.\n\nNext part.")], "source string, page_idx int, text string")
    assert [(r["section_idx"], r["raw_text"]) for r in segment.section_rows(pages).orderBy("section_idx").collect()] == [(0, "First one. Second one."), (1, "Next part."), (2, "Third one.")]
    assert [(r["sentence_idx"], r["text"]) for r in segment.sentence_rows(pages).orderBy("sentence_idx").collect()] == [(0, "First one."), (1, "Second one."), (2, "Next part."), (3, "Third one.")]


# --- index


def test_index(spark):
    rows = spark.createDataFrame([("b", 0, "x  y", 1), ("b", 1, "only b", 2), ("a", 0, "x y ", 3), ("a", 1, " ", 4)], "source string, section_idx int, text string, pos int")
    got = {r["text"]: (r["n_occurrences"], r["sources"]) for r in index.unique_units(rows, ["pos"]).collect()}
    assert got == {"x  y": (2, ["b", "a"]), "only b": (1, ["b"])}
    units = index.unique_units(rows, ["pos"])
    assert {r["kind"] for r in index.lookup(units, units.limit(0), " x\ny").collect()} == {"section"} and index.lookup(units, units, "absent").count() == 0
    m = spark.createDataFrame([("a", 10, 2, 3), ("b", 20, 2, 4)], "source string, chars int, n_sections int, n_sentences int")
    s = index.statistics(m, units, units).first()
    assert (s["total_sections"], s["unique_sections"], s["duplicate_sections"], s["duplicate_sentences"]) == (4, 2, 2, 5)
    kept = index.keep_first(spark.createDataFrame([(None, 1), (None, 2), ("k", 3)], "k string, pos int"), ["k"], ["pos"])
    assert sorted(r["pos"] for r in kept.collect()) == [1, 3]


# --- classification


def test_fast_lane(spark):
    cases = {
        "On termination the tenant may cancel this lease and terminate this agreement; the deposit shall be refunded.": "termination",
        "enter the premises, entering premises, enters the premises, entered the premises, access to the premises": "access",
        "The tenant at sufferance pays for a period of one month": "holdover",
        "The premises are clean.": "unknown",
        "": "unknown",
    }
    got = classify.fast_lane(texts(spark, list(cases))).orderBy("id").collect()
    assert [r["clause_type"] for r in got] == list(cases.values()) and got[-1]["count"] == 0 and got[-1]["confidence"] == 0
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (2,), (-3,)], "n int").select(classify.confidence(F.col("n"))).collect()] == [0, 0.5, 0.75, 0]
    once = classify.with_evidence(texts(spark, ["base rent", "base rent", None]), once=True).orderBy("id").collect()
    assert [r["evidence"]["rent"] for r in once] == [1, 1, 0]


def test_evidence_counts_match_python(spark):
    xs = ["gas charges and gas bills, water rates; sewer", "expires on or after; expiration of the term", "keep it clean and in good repair\nkeep\nin good condition", "Rs. deposit of Rs. 5 and deposit of $7"]
    got = classify.with_evidence(texts(spark, xs)).orderBy("id").collect()
    for x, r in zip(xs, got, strict=True):
        assert r["evidence"].asDict() == {t: sum(len(re.findall(p, x)) for p in ps) for t, ps in lexicon.TRIGGERS.items()}


def test_head_and_fallback(spark):
    head = spark.createDataFrame([(0, "rent", [1.0, 0.0], 0.0), (1, "term", [0.0, 1.0], 0.1)], "class_idx int, class string, w array<double>, b double")
    vs = spark.createDataFrame([("a", [5.0, 0.0]), ("b", [0.1, 0.0]), ("c", [0.0, 0.0])], "id string, v array<double>")
    probs = classify.probabilities(vs, head)
    assert all(abs(r[1] - 1) < 1e-12 for r in probs.groupBy("id").agg(F.sum("p")).collect())
    got = {r["id"]: (r["clause_type"], round(r["confidence"], 3)) for r in classify.refuse(probs).collect()}
    assert got["a"][0] == "rent" and got["b"] == ("unknown", 0.5) and got["c"][0] == "unknown"
    rows = spark.createDataFrame([("x", "base rent", None), ("a", "", "nothing"), ("b", "nothing", None), ("z", None, None)], "id string, text string, raw_text string")
    out = {r["id"]: (r["clause_type"], r["method"], round(r["confidence"], 2)) for r in classify.analyze(rows, classify.refuse(probs)).collect()}
    assert out == {"x": ("rent", "fast_lane", 0.5), "a": ("rent", "classifier", 0.99), "b": ("unknown", "unknown", 0.5), "z": ("unknown", "unknown", 0.0)}
    assert classify.analyze(rows).filter("method = 'unknown'").count() == 3
    assert classify.refuse(spark.createDataFrame([("o", 0, "rent", 1.0)], "id string, class_idx int, class string, p double")).first()["clause_type"] == "rent"


# --- risk

POSITIVE = {
    "deposit.cap_exceeded": ("deposit", "A security deposit of $4,800 is due."), "deposit.guaranty_transfer": ("deposit", "The guaranty passes to successors by assignment."),
    "rent.excessive_escalation": ("rent", "Rent shall increase by 5% annually, every year."), "rent.no_offset": ("rent", "Rent is paid without deduction."), "rent.uncapped_passthrough": ("rent", "Operating costs are a pass-through."),
    "holdover.punitive_rate": ("holdover", "Holding over costs double rent."), "late_fee.excessive": ("late_fee", "A late fee of 5% applies."), "termination.landlord_only": ("termination", "Landlord may terminate this lease."),
    "termination.sole_discretion": ("termination", "In its sole discretion."), "subletting.change_of_control": ("subletting", "A change of control over 50% needs consent."), "dispute_resolution.jury_waiver": ("dispute_resolution", "Parties waive a jury trial."),
    "dispute_resolution.one_way_indemnity": ("dispute_resolution", "Tenant shall indemnify the owner; the indemnity is broad."), "dispute_resolution.contra_proferentem": ("dispute_resolution", "Contra proferentem is excluded."),
    "maintenance.liability_disclaim": ("maintenance", "Owner has no liability for theft."), "maintenance.weak_warranty": ("maintenance", "Owner warrants to its knowledge."), "maintenance.incorporation_by_ref": ("maintenance", "See the rider."),
    "termination.no_mitigate": ("termination", "No duty to mitigate."), "access.unrestricted_entry": ("access", "Landlord may enter at any time."), "transaction.registration_costs": ("registration", "Tenant shall pay stamp duty."),
    "reinstatement.as_is_restoration": ("maintenance", "Restore to the original condition."), "dispute_resolution.mandatory_arbitration": ("dispute_resolution", "Binding arbitration."), "dispute_resolution.fee_shifting": ("dispute_resolution", "Tenant shall pay attorney's fees."),
    "termination.no_early_exit": ("termination", "Tenant may not terminate."), "termination.automatic": ("termination", "It shall automatically terminate."), "rent.upfront_payment": ("rent", "The full rent is due in advance."),
    "insurance.tenant_pays_all": ("premises", "The landlord's insurance is a cost."), "no_obligation.go_dark": ("no_obligation", "Tenant may cease operations."),
}


def sections(spark, rows):
    return spark.createDataFrame([(i, x, t) for i, (t, x) in enumerate(rows)], "id int, text string, type string")


def test_every_rule_fires(spark):
    got = {(r["id"], r["rule_id"]) for r in risk.findings(sections(spark, POSITIVE.values())).collect()}
    assert set(POSITIVE) == {r.rule_id for r in rulebook.RULES}
    for i, rule in enumerate(POSITIVE):
        assert (i, rule) in got, rule


def test_rules_that_must_not_fire(spark):
    rows = [("deposit", "No security deposit is required."), ("holdover", "Surrender the rooms on time."), ("pets", "Landlord may enter at any time."), ("termination", "Each side gives notice.")]
    assert risk.findings(sections(spark, rows)).count() == 0


def test_findings(spark):
    rows = sections(spark, [("deposit", "A deposit of $1,234 secures the rent."), ("unknown", "Tenant may cease operations."), ("deposit", "The net worth is $9 million. " + "x" * 50 + " deposit of a letter"), ("rent", None)])
    got = {(r["id"], r["rule_id"]): r for r in risk.findings(rows).collect()}
    first = got[0, "deposit.cap_exceeded"]
    assert first["extracted_values"] == {"deposit_amount": "1,234"} and first["rationale"].endswith("Extracted: 1,234") and first["confidence"] == 1.0
    assert got[1, "no_obligation.go_dark"]["confidence"] == 0.75 and got[2, "deposit.cap_exceeded"]["extracted_values"] == {}
    assert not any("{" in r["rationale"] for r in got.values())
    assert [r["risk_level"] for r in risk.ordered(risk.findings(sections(spark, [("no_obligation", "May cease business."), ("deposit", "security deposit")]))).collect()] == ["medium", "info"]
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    s = risk.with_findings(spark.createDataFrame([(1, "deposit", "Guaranty transfers."), (1, "unknown", None)], "doc_id int, type string, text string"))
    assert [tuple(r) for r in risk.summary(docs, s).orderBy("doc_id").collect()] == [(1, 2, 1, 1, 0, 0, 1, 0), (2, 0, 0, 0, 0, 0, 0, 0)]


# --- vectors and grounding


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>").select(ground.unit(F.col("a")), ground.unit(F.col("z"))).first()
    assert list(row) == [[0.6, 0.8], [0.0, 0.0]]
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0])], "id int, v array<double>")
    got = ground.top_k(rows.filter("id = 1"), rows, 9).orderBy("rank").collect()
    assert [(r["rank"], r["id"], r["score"]) for r in got] == [(1, 1, 1.0), (2, 2, 0.7071), (3, 3, 0.0)] and ground.top_k(rows, rows, 1).count() == 3
    m = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 1), (1, [9.0, 9.0], 0)], "k int, v array<double>, m int")
    assert ground.mean_pool(m, "k", "v", "m").first()["v"] == [2.0, 3.0]
    v = encode.embed(texts(spark, ["a b", "b a", ""]), encode.hashed_words(16)).orderBy("id").collect()
    assert v[0]["v"] == v[1]["v"] and abs(np.linalg.norm(v[0]["v"]) - 1) < 1e-6 and not any(v[2]["v"])


def test_vectors_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(ground, "ASKED", 16), monkeypatch.setattr(ground, "BLOCK", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        vs = np.random.default_rng(4).standard_normal((200, 8))
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], "id int, v array<double>")
        df = ground.top_k(rows.filter("id % 4 = 0"), rows, 3)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    us = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    for q in range(0, 200, 4):
        want = sorted((-round(float(s), 4), i) for i, s in enumerate(us @ us[q]))[:3]
        assert [got[q, r + 1] for r in range(3)] == [(i, -s) for s, i in want]
    assert len(got) == 150


def test_grounding(spark):
    chunks = spark.createDataFrame([(0, "c0", "Only rent here."), (1, "c1", "Rent  OFFSET and\ncounterclaim."), (2, "c2", "rent offset counterclaim")], "chunk_idx int, id string, text string")
    words = ground.lexical(rulebook.RULES, chunks)
    assert {r["rule_id"]: r["id"] for r in words.collect()} == {"rent.no_offset": "c1"}
    found = spark.createDataFrame([("rent.no_offset", "s", ""), ("late_fee.excessive", "s", ""), ("holdover.punitive_rate", "s", ""), ("other", "s", "g")], "rule_id string, statute string, grounding string")
    dense = spark.createDataFrame([("late_fee.excessive", "v1", "dense text")], "rule_id string, id string, text string")
    got = {r["rule_id"]: (r["statute"], r["statute_citation"], r["grounding"]) for r in ground.ground(found, ground.rule_table(spark), words, dense).collect()}
    assert got["rent.no_offset"] == ("c1", "general", "Rent  OFFSET and\ncounterclaim.") and got["late_fee.excessive"] == ("v1", "general", "dense text")
    assert got["holdover.punitive_rate"] == ("MTA 2021 s.23", "MTA 2021 s.23", "") and got["other"] == ("s", "s", "g")


# --- datasets


def test_ingest(spark):
    csv = spark.createDataFrame([("d1-lease_3", "p", "t", "r", "none", "5", "x"), ("d1-lease_4", "p", "t", "r", "riders", "-3", " 5"), ("d2", "p", "t", "r", "riders", None, "")], "uuid string, part string, text string, raw_text string, type string, start string, end string")
    assert [(r["source"], r["start"], r["end"]) for r in dataset.redflags(csv).collect()] == [("d1", 5, None), ("d1", -3, None), ("d2", None, None)]
    assert dataset.redflags(csv, easy=True).count() == 2
    row = spark.createDataFrame([("[ Lessee ] shall pay", "c/x/lease-a-7", "[0, 1, 0, 0, 0, 0, 0]", "{'ent': [[0, 4], [6, 9]]}", "train")], "text string, cid string, label string, span string, split string")
    got = dataset.annotated(row).first()
    assert (got["source"], got["sentence_idx"], got["party"], got["text"], got["deontic_types"], got["spans"]) == ("lease-a", 7, "tenant", "shall pay", ["ent"], {"ent": [[0, 4], [6, 9]]})
    odd = spark.createDataFrame([("no party", "plain"), ("[Guest] x", "a/b-c")], "t string, c string").select(dataset.party(F.col("t"))["party"], dataset.contract(F.col("c"))["source"], dataset.contract(F.col("c"))["idx"]).collect()
    assert [tuple(r) for r in odd] == [("unknown", "plain", -1), ("guest", "b", -1)]


def test_clean_and_validate(spark):
    rows = spark.createDataFrame([("a  b", "warrantees_of_the_owner"), ("x" * 600, "holdover"), ("x" * 599, None)], "text string, type string")
    got = dataset.clean(rows, fix=True).collect()
    assert [(r["truncated"], r["type"]) for r in got] == [(None, "warranties_of_the_owner"), (True, "holdover"), (None, None)] and got[0]["text"] == "a b"
    assert [r["errors"] for r in dataset.violations(rows, {"type": None, "text": F.length("text") < 600}).collect()] == [[], ["bad text"], ["missing type"]]
    lab = spark.createDataFrame([([1, 0, 0, 0, 0, 0, 0], ["obl"], "tenant"), ([1, 1, 0, 0, 0, 0, 0], ["obl", "ent"], "x"), ([0, 1], [], None), ([0, 0, 0, 0, 0, 0, 1], [], "landlord"), ([2, 1, 0, 0, 0, 0, 0], ["ent"], "tenant")], "label array<int>, deontic_types array<string>, party string")
    assert [len(r["errors"]) for r in dataset.multilabel_errors(lab).collect()] == [0, 2, 2, 0, 2]


def test_synthesis(spark):
    d, r, s = synth.deontic_rows(spark), synth.redflag_rows(spark), synth.span_rows(spark)
    assert (d.count(), r.count(), s.count()) == (1750, 390, 116)
    assert d.filter(F.col("text").contains("{")).count() == 0 and r.filter(F.col("raw_text").contains("{")).count() == 0 and index.repeated_sources(d).count() == 0
    assert abs(d.filter("party = 'tenant'").count() / 1750 - 0.5) < 0.05 and dataset.multilabel_errors(d).filter(F.size("errors") > 0).count() == 0


# --- profiles and metrics


def test_profiles(spark):
    rows = spark.createDataFrame([(1, "a", "x" * 600), (2, "a", "x" * 700), (3, None, ""), (4, "b", "yy")], "pos int, source string, text string")
    s = eda.summarize(rows).first()
    assert (s["rows"], s["mean"], s["min"], s["p50"], s["p90"], s["max"], s["unique_sources"], s["per_source_p50"], s["truncated"], s["truncated_pct"], s["empty_text"]) == (4, 325.5, 0, 2, 600, 700, 3, 1, 2, 50.0, 1)
    assert [(r["value"], r["n"]) for r in eda.distribution(rows, "source", ["pos"]).collect()] == [("a", 2), (None, 1), ("b", 1)]
    assert tuple(eda.overlap(rows, rows.filter("source = 'a'")).first()) == (2, 0, 1)
    assert eda.text_stats(rows.limit(0)).first()["rows"] == 0
    assert {(r["value"], r["truncated_pct"]) for r in eda.cut_by(rows, "source").collect()} == {("a", 100.0), ("None", 0.0), ("b", 0.0)}


def test_metrics(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "y_true string, y_pred string")
    assert {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.per_class(pairs).collect()} == {"a": (1.0, 0.5, 0.6667), "b": (0.6667, 1.0, 0.8)}
    m = metrics.multiclass(pairs).first()
    assert (m["n"], m["accuracy"], m["macro_f1"]) == (4, 0.75, 0.7333) or m["macro_f1"] == 0.7334
    assert metrics.multiclass(pairs.limit(0)).first()["accuracy"] == 0
    ml = spark.createDataFrame([([1, 0], [1, 0]), ([0, 1], [1, 1]), ([1, 1], [1, 1])], "y_true array<int>, y_pred array<int>")
    assert metrics.exact_match(ml).first()["exact_match_ratio"] == 0.6667
    assert {r["label"]: r["tp"] for r in metrics.multilabel(ml, ("p", "q")).collect()} == {"p": 2, "q": 2, "micro": 4}
    scored = spark.createDataFrame([("l", 1, 0.9), ("l", 0, 0.4), ("l", 1, 0.6)], "label string, y int, p double")
    assert tuple(metrics.calibrate(scored).first()) == ("l", 0.45, 1.0)
    assert texts(spark, ["Late FEE and jury", "none"]).select(metrics.concepts_of(F.col("text")).alias("c")).collect()[0]["c"] == ["late_fee", "jury_waiver"]


def test_splits_and_features(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 2)
    a, b = features.split(rows, "g", ["id"]), features.split(rows, "g", ["id"], seed=7)
    assert {r["split"]: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 800, "val": 100, "test": 100}
    same = a.join(b.select("id", F.col("split").alias("other")), "id").filter("split = other").count()
    assert features.split(rows, "g", ["id"]).exceptAll(a).count() == 0 and same < 1000
    tiny = features.split(spark.range(3).withColumn("g", F.lit(0)), "g", ["id"], ratios=(0.1, 0.1), least=1)
    assert sorted(r["split"] for r in tiny.collect()) == ["test", "train", "val"]
    v = texts(spark, ["Tenant shall pay and shall not leave", "dismay", None]).orderBy("id").select(features.trigger_vector(F.col("text")).alias("v"), features.trigger_counts(F.col("text")).alias("c")).collect()
    assert [r["v"] for r in v] == [[1, 0, 1, 0, 0, 0], [0, 0, 0, 1, 0, 0], [0] * 6] and v[0]["c"] == [1, 0, 1, 0, 0, 0]


def test_prompts(spark):
    rows = spark.createDataFrame([("clause", "why", "low", "", None), ("c" * 700, "why", "low", "S1", "g" * 950)], "c string, r string, l string, s string, g string")
    a, b = (r[0] for r in rows.select(prompt.finding_prompt(F.col("c"), F.col("r"), F.col("l"), F.col("s"), F.col("g"))).collect())
    assert a == "Lease clause:\nclause\n\nRisk: low. why\n\nRewrite in plain language for the tenant." and "c" * 600 + "\n" in b and "\n\n" + "g" * 900 + "\n" in b
    good = '{"clause_type": "rent", "risk_level": "low", "statute": "s", "plain_explanation": "e", "tenant_impact": "i"}'
    got = texts(spark, [good, "garbage", good.replace("rent", "x"), good.replace('"e"', '""')]).orderBy("id").select(prompt.parse(F.col("text")).alias("p"), prompt.obeys_grammar(F.col("text")).alias("o")).collect()
    assert [(r["p"]["parse_ok"], r["o"]) for r in got] == [(True, True), (False, False), (True, False), (True, False)] and got[1]["p"]["plain_explanation"] == "garbage"
    assert prompt.augmented(spark.range(5).withColumn("prompt", F.lit("a\n\nb")), ["id"]).count() == 12


# --- literal gates

SAMPLES = (
    "The TERM of this Licence; initial  term. Base rent is due, a deposit of Rs. 5 (security deposit).", "keeps it in good repair and maintenance of\nutilities, gas bills", "terminat terminates TERMINATION not renewed",
    "leaſe aſſign this leaſe", "LİCENSE to enter the premises, lıcense", "\u212aeep in good condition; boo\u212akeeping", "tenant at sufferance holds over, twice the monthly rent", "", "rent", "pets. domestic animal", "no", "Flat No. 5 demised premises leased to",
    "as is, same condition, prior to", "letter of credit; without deduction or offset; governing law; jury trial", "term of this leaſe. ſublet, sublease, SUBLET, \u017fewer",
)


def test_gates_never_miss(spark):
    """A gate allows every text that its pattern matches, as Spark matches it; and gated counts equal plain ones."""
    from clauselake.functions import gates
    from clauselake.functions.lexicon import TRIGGERS
    from clauselake.functions.rulebook import RULES
    from clauselake.functions.text import count, matches
    from clauselake.plans.overlay import CLAUSES

    patterns = list(dict.fromkeys([p for t in TRIGGERS.values() for p in t] + [p for r in RULES for p in (*r.triggers, *r.exclusions)]))
    texts = [*SAMPLES, *[t for _, t in CLAUSES], *[t.upper() for _, t in CLAUSES], " ".join(t for _, t in CLAUSES)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    g = gates.Gates(patterns)
    got = g.add(rows, F.col("t")).select("t", F.array(*[matches(F.col("t"), p) for p in patterns]).alias("m"), F.array(*[g.may(p) for p in patterns]).alias("g")).collect()
    assert sum(sum(r["m"]) for r in got) > 200
    for r in got:
        for p, m, may in zip(patterns, r["m"], r["g"], strict=True):
            assert may >= m and may == gates.allows(r["t"], p), (p, r["t"])
    assert sum(sum(r["g"]) for r in got) < 0.2 * len(got) * len(patterns)
    plain = rows.select("i", classify.evidence(F.col("t")).alias("e"))
    gated = classify.with_evidence(rows, "t").select("i", F.col("evidence").alias("e"))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, gated.collect()))
    assert count(F.col("t"), patterns[0]) is not None and len([p for p in patterns if not gates.gate(p)]) <= 1


def test_gates_fold_all_letters(spark):
    """Every character that matches an ASCII letter where case is ignored is folded to it."""
    from clauselake.functions import gates

    chars = spark.range(1, 0x11000).filter("id not between 55296 and 57343").select(F.expr("decode(encode(char(65), 'utf-8'), 'utf-8')").alias("x"), "id")
    rows = spark.createDataFrame([(chr(r["id"]),) for r in chars.select("id").collect()], "c string")
    odd = rows.filter(F.col("c").rlike("(?iU)[a-z]")).select("c", gates.fold(F.col("c")).alias("f")).collect()
    assert {r["c"] for r in odd if not r["c"].isascii()} == set(gates._ODD) and all(r["f"].isascii() for r in odd)


@pytest.mark.parametrize(("pattern", "want"), [(r"(?i)\bab\b", ()), (r"abc(?:def)?", ("abc",)), (r"(?:foo|ba)r", ()), (r"(?:foo|bar)\s+bazz", ("bazz", "bar|foo")), (r"x{2}yes*", ()), (r"(?i)\bNo\.?\s+(Way)", ("way",)), (r"(?:one)+two", ("one", "two"))])
def test_gate_of(pattern, want):
    from clauselake.functions.gates import gate

    assert sorted("|".join(sorted(c)) for c in gate(pattern)) == sorted(want)


def test_sentences_equal_the_pattern(spark):
    """The marks give what the pattern with a look ahead finds, over texts made of all that matters to it."""
    import random

    random.seed(8)
    bits = ["a", "12", ".", "!", "?", "'", '"', ")", "]", " ", " ", " ", "e.g.", "Dr.", "No.", "#.", "x#.", "St.", "\n", "é", "Ave.", "..", "it.s"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 25))) for _ in range(3000)]
    texts += ["12.2 Clause two.", "One. Two! Three?", 'He said "go." Then left.', "a.. . b", ". x", ".) y", "foo. ) ] bar", "foo. )x", "Dr. Smith e.g. here. End"]

    def found(t):
        t = " ".join(t.split())
        t = re.sub(segment.ABBREVIATIONS, lambda m: m[0].replace(".", "\0"), t)
        return [m.strip().replace("\0", ".") for m in re.findall(segment.SENTENCE.replace(r"\z", r"\Z"), t) if m.strip()]

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", segment.sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r["s"] == found(texts[r["i"]]), texts[r["i"]]
    con = duckdb.connect()
    con.execute("create table x (i int, t varchar)")
    con.executemany("insert into x values (?, ?)", list(enumerate(texts)))
    from clauselake.plans.queries import sql_sentences

    for i, s in con.execute(f"select i, {sql_sentences('t')} from x").fetchall():
        assert s == found(texts[i]), texts[i]
