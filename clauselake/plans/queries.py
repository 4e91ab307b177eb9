"""Queries over the driver's tables, one or more per operator, each with SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import CONCEPTS, DEONTIC_LABELS, DEONTIC_PHRASES, PARTY_ALIASES, RISK_LEVELS, TAXONOMY, TRIGGERS, TYPE_WEIGHTS, UNKNOWN
from ..functions.rulebook import RULES
from ..operators import cells, classify, dataset, eda, encode, features, ground, index, metrics, prompt, reports, risk, segment, synth, validate
from ..sources import document_source, files, records
from ..sources.scratch import scratch
from ..streaming import unit_index
from . import overlay as O
from . import train
from .overlay import quoted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL twins of the Column functions ---------------------------------------------------------------------------------


def sql_match(c: str, p: str) -> str:
    return f"regexp_matches({c}, {quoted(p)})"


def sql_count(c: str, p: str) -> str:
    return f"len(regexp_extract_all({c}, {quoted(p)}))"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def sql_capture(c: str, p: str) -> str:
    got = ", ".join(f"nullif(regexp_extract({c}, {quoted(p)}, {i}), '')" for i in range(1, T.groups(p) + 1))
    return f"CASE WHEN {sql_match(c, p)} THEN coalesce({got}) END"


def sql_rationale(rule, c: str) -> str:
    import re

    parts = re.split(r"\{(\w+)\}", rule.rationale)
    return " || ".join(quoted(x) if i % 2 == 0 else f"coalesce({sql_capture(c, rule.extractors[x])}, '')" for i, x in enumerate(parts) if x)


EVIDENCE_SQL = f"""{O.SECTIONS_SQL},
evidence AS (SELECT id, k, gold, source, text, {", ".join(f"CAST({' + '.join(sql_count('text', p) for p in TRIGGERS[t])} AS INTEGER) AS e_{t}" for t in TAXONOMY)} FROM sections),
ranked AS (SELECT *, list_max([{", ".join(f"struct_pack(score := e_{t} * {TYPE_WEIGHTS.get(t, 1.0)}::DOUBLE, o := {-i}, t := '{t}', n := e_{t})" for i, t in enumerate(TAXONOMY))}]) AS best FROM evidence),
typed AS (SELECT id, k, gold, source, text, CASE WHEN best.score > 0 THEN best.t ELSE '{UNKNOWN}' END AS type, CASE WHEN best.score > 0 THEN best.n ELSE 0 END AS n FROM ranked)"""

_RULES_SQL = " UNION ALL ".join(
    f"""SELECT id, gold, source, type AS clause_type, text, {i} AS rule_ord, '{r.rule_id}' AS rule_id, '{r.level}' AS risk_level, CASE WHEN type = '{UNKNOWN}' THEN 0.75 ELSE 1.0 END::DOUBLE AS confidence,
{sql_rationale(r, "text")} AS rationale, {" || ".join(f"coalesce('{n}=' || ({sql_capture('text', p)}) || ';', '')" for n, p in r.extractors.items()) or "''"} AS extracted, {quoted(r.fallback)} AS statute
FROM typed WHERE type IN ({", ".join(f"'{t}'" for t in (*r.clause_types, UNKNOWN))}) AND {" AND ".join(sql_match("text", p) for p in r.triggers)}{"".join(f" AND NOT {sql_match('text', p)}" for p in r.exclusions)}"""
    for i, r in enumerate(RULES)
)
FINDINGS_SQL = f"{EVIDENCE_SQL}, findings AS ({_RULES_SQL})"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.fast_lane(O.sections(spark, sf_dir))
    return rows.withColumnRenamed("clause_type", "type")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.findings(typed(spark, sf_dir), keep=("gold", "source"))


# --- risk ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {FINDINGS_SQL} SELECT rule_id, risk_level, count(*) AS n FROM findings GROUP BY ALL")
def risk_rule_counts(spark, d):
    return found(spark, d).groupBy("rule_id", "risk_level").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FINDINGS_SQL} SELECT id, clause_type, rule_ord, rule_id, risk_level, confidence, rationale, left(text, 600) AS clause_text, statute FROM findings")
def risk_findings(spark, d):
    return found(spark, d).select("id", "clause_type", "rule_ord", "rule_id", "risk_level", "confidence", "rationale", "clause_text", "statute")


@query(
    f"""WITH {FINDINGS_SQL}, f AS (SELECT id, count(*) AS n_findings, {", ".join(f"count(*) FILTER (risk_level = '{x}') AS n_{x}" for x in RISK_LEVELS)} FROM findings GROUP BY id)
SELECT d.doc_id, coalesce(s.a, 0) AS total_sections, coalesce(s.b, 0) AS classified_sections, coalesce(f.n_findings, 0) AS n_findings, {", ".join(f"coalesce(f.n_{x}, 0) AS n_{x}" for x in RISK_LEVELS)}
FROM documents d LEFT JOIN (SELECT id, count(*) AS a, count(*) FILTER (type <> '{UNKNOWN}') AS b FROM typed GROUP BY id) s ON d.doc_id = s.id LEFT JOIN f ON d.doc_id = f.id"""
)
def risk_summary_by_doc(spark, d):
    return risk.summary(table(spark, d, "documents"), risk.with_findings(typed(spark, d).withColumnRenamed("id", "doc_id")))


@query(f"WITH {FINDINGS_SQL} SELECT id, rule_id, extracted FROM findings WHERE extracted <> ''")
def extracted_values(spark, d):
    rows = found(spark, d).filter(F.size("extracted_values") > 0)
    names = [n for r in RULES for n in r.extractors]
    parts = [F.coalesce(F.concat(F.lit(f"{n}="), F.try_element_at("extracted_values", F.lit(n)), F.lit(";")), F.lit("")) for n in dict.fromkeys(names)]
    return rows.select("id", "rule_id", F.concat(*parts).alias("extracted"))


@query(
    f"""WITH {FINDINGS_SQL}, hit AS (SELECT DISTINCT id FROM findings), per AS (SELECT gold AS type, count(*) AS n, count(h.id) AS caught FROM sections s LEFT JOIN hit h ON s.id = h.id GROUP BY gold),
c AS (SELECT gold AS type, rule_id, count(*) AS c FROM findings GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY c DESC, rule_id) AS r FROM c)
SELECT per.type, n, caught, coalesce(string_agg(rule_id, ',' ORDER BY r), '') AS top_rules FROM per LEFT JOIN (SELECT * FROM r WHERE r <= 4) r ON per.type = r.type GROUP BY ALL"""
)
def trigger_recall(spark, d):
    rows = risk.with_findings(typed(spark, d)).withColumn("rule_ids", F.transform("findings", lambda f: f["rule_id"]))
    return eda.trigger_recall(rows, "gold")


# --- classification -----------------------------------------------------------------------------------------------------


@query(f"WITH {EVIDENCE_SQL} SELECT id, {', '.join(f'e_{t}' for t in TAXONOMY)} FROM evidence")
def evidence_counts(spark, d):
    rows = classify.with_evidence(O.sections(spark, d))
    return rows.select("id", *[F.col(f"evidence.{t}").alias(f"e_{t}") for t in TAXONOMY])


@query(f"WITH {EVIDENCE_SQL} SELECT id, type AS clause_type, n AS count, 1 - pow(0.5, n) AS confidence FROM typed")
def classify_fast_lane(spark, d):
    return classify.fast_lane(O.sections(spark, d)).select("id", "clause_type", "count", "confidence")


@query(
    f"""WITH {EVIDENCE_SQL} SELECT count(*) AS n, count(*) FILTER (type <> '{UNKNOWN}') AS fired, round(count(*) FILTER (type <> '{UNKNOWN}') / count(*)::DOUBLE, 4) AS coverage,
round(count(*) FILTER (type = gold) / count(*)::DOUBLE, 4) AS agreement FROM typed"""
)
def coverage_report(spark, d):
    n, fired = F.count(F.lit(1)), F.count_if(F.col("type") != UNKNOWN)
    return typed(spark, d).agg(n.alias("n"), fired.alias("fired"), F.round(fired / n, 4).alias("coverage"), F.round(F.count_if(F.col("type") == F.col("gold")) / n, 4).alias("agreement"))


HEAD_SQL = """e AS (SELECT vec_id, label, embedding FROM embeddings),
cells AS (SELECT label, unnest(generate_series(1, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM e),
head AS (SELECT label AS class_idx, list(w ORDER BY i) AS w FROM (SELECT label, i, round(avg(x) * 4, 4) AS w FROM cells GROUP BY ALL) GROUP BY label),
z AS (SELECT vec_id, class_idx, list_sum(list_transform(list_zip(embedding, w), lambda p: p[1]::DOUBLE * p[2])) AS z FROM e, head),
m AS (SELECT vec_id, max(z) AS top FROM z GROUP BY vec_id), ex AS (SELECT vec_id, class_idx, exp(z - top) AS x FROM z JOIN m USING (vec_id)),
prob AS (SELECT vec_id, class_idx, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM ex)"""


def head_of(spark, d) -> DataFrame:
    """A linear head from the class means of the vectors: ten rows."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    w = rows.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")) * 4, 4).alias("w"))
    parts = F.array_sort(F.collect_list(F.struct("i", "w")))
    return w.groupBy("label").agg(F.transform(parts, lambda p: p["w"]).alias("w")).select(F.col("label").alias("class_idx"), F.concat(F.lit("c"), "label").alias("class"), "w", F.lit(0.0).alias("b"))


def head_probabilities(spark, d) -> DataFrame:
    return classify.probabilities(table(spark, d, "embeddings").select("vec_id", "embedding"), head_of(spark, d), "vec_id", "embedding")


@query(f"WITH {HEAD_SQL} SELECT vec_id, class_idx, round(p, 6) AS p FROM prob")
def softmax_head(spark, d):
    return head_probabilities(spark, d).select("vec_id", "class_idx", F.round("p", 6).alias("p"))


REFUSED_SQL = f"""{HEAD_SQL}, r AS (SELECT vec_id, class_idx, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_idx) AS r FROM prob),
refused AS (SELECT a.vec_id, CASE WHEN a.p >= 0.15 AND a.p - b.p >= 0.02 THEN 'c' || a.class_idx ELSE '{UNKNOWN}' END AS clause_type, a.p FROM r a JOIN r b USING (vec_id) WHERE a.r = 1 AND b.r = 2)"""


@query(f"WITH {REFUSED_SQL} SELECT vec_id, clause_type, round(p, 6) AS confidence FROM refused")
def refuse_head(spark, d):
    return classify.refuse(head_probabilities(spark, d), "vec_id", 0.15, 0.02).select("vec_id", "clause_type", F.round("confidence", 6).alias("confidence"))


@query(
    f"""WITH {EVIDENCE_SQL}, {REFUSED_SQL} SELECT t.id, CASE WHEN t.type <> '{UNKNOWN}' THEN t.type ELSE coalesce(f.clause_type, '{UNKNOWN}') END AS clause_type,
CASE WHEN t.type <> '{UNKNOWN}' THEN 'fast_lane' WHEN coalesce(f.clause_type, '{UNKNOWN}') <> '{UNKNOWN}' THEN 'classifier' ELSE 'unknown' END AS method,
round(CASE WHEN t.type <> '{UNKNOWN}' THEN 1 - pow(0.5, t.n) ELSE coalesce(f.p, 0) END, 6) AS confidence FROM typed t LEFT JOIN refused f ON t.id = f.vec_id"""
)
def hybrid_classify(spark, d):
    fallback = classify.refuse(head_probabilities(spark, d), "vec_id", 0.15, 0.02).withColumnRenamed("vec_id", "id")
    return classify.analyze(O.sections(spark, d), fallback).select("id", "clause_type", "method", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {EVIDENCE_SQL} SELECT DISTINCT type, CASE {' '.join(f'WHEN type = {quoted(t)} THEN {i}' for i, t in enumerate(TAXONOMY))} ELSE {len(TAXONOMY)} END AS idx FROM typed")
def taxonomy_index(spark, d):
    return typed(spark, d).select("type").distinct().select("type", classify.taxonomy_index(F.col("type")).alias("idx"))


# --- grounding and vectors ------------------------------------------------------------------------------------------------

_HITS_SQL = " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, {quoted(r.fallback)} AS fallback, chunk_idx, id, text FROM chunk_dim WHERE {' AND '.join(f'contains(lower(text), {quoted(a)})' for a in r.anchors)}" for r in RULES)
LEXICAL_SQL = f"{O.CHUNK_SQL}, hits AS ({_HITS_SQL}), lex AS (SELECT rule_id, arg_min(id, chunk_idx) AS id, arg_min(text, chunk_idx) AS text FROM hits GROUP BY rule_id)"


_ALL_HITS_SQL = _HITS_SQL.replace("chunk_dim", "all_chunks")


@query(
    f"""WITH {O.CHUNK_SQL}, all_chunks AS (SELECT doc_id AS chunk_idx, 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 1000000000000 + chunk_idx, id, text FROM chunk_dim), hits AS ({_ALL_HITS_SQL})
SELECT rule_id, arg_min(id, chunk_idx) AS id, arg_min(text, chunk_idx) AS text FROM hits GROUP BY rule_id"""
)
def lexical_grounding(spark, d):
    """The first text that holds all anchors of a rule, of all documents and then the chunks."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_idx"), F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    chunks = O.chunk_table(spark).withColumn("chunk_idx", F.col("chunk_idx") + F.lit(1_000_000_000_000))
    return ground.lexical(RULES, docs.unionByName(chunks))


@query(
    f"WITH {FINDINGS_SQL}, {LEXICAL_SQL} SELECT f.id, f.rule_id, coalesce(l.id, f.statute) AS statute, f.statute AS statute_citation, left(coalesce(l.text, ''), 900) AS grounding FROM findings f LEFT JOIN lex l USING (rule_id)"
)
def grounded_findings(spark, d):
    rows = ground.ground(found(spark, d), ground.rule_table(spark), ground.lexical(RULES, O.chunk_table(spark)))
    return rows.select("id", "rule_id", "statute", "statute_citation", "grounding")


@query(
    """WITH u AS (SELECT vec_id, embedding, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-9) AS n FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / n)), 5) AS total, round(embedding[1]::DOUBLE / n, 6) AS first FROM u"""
)
def vector_normalize(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", ground.unit(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.col("u")[0], 6).alias("first"))


@query(
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-9)) AS u FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(list_zip(q.u, v.u), lambda p: p[1] * p[2])), 4) AS score FROM u q, u v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, id, score FROM r WHERE rank <= 5"""
)
def cosine_topk(spark, d):
    rows = table(spark, d, "embeddings")
    return ground.top_k(rows.filter("vec_id % 20 = 0"), rows, 5, "vec_id", "embedding")


@query(ORACLE_SQL["cosine_topk"])
def pruned_topk(spark, d):
    """The same search through a saved index of cells."""
    rows, path = table(spark, d, "embeddings"), scratch(spark, "cells")
    cells.build(rows, path, "vec_id", "embedding")
    return cells.top_k(cells.load(spark, path), rows.filter("vec_id % 20 = 0"), scratch(spark, "first"), 5, "vec_id", "embedding")


@query(
    """WITH c AS (SELECT label, unnest(generate_series(1, 64)) AS i, unnest(embedding)::DOUBLE AS x, CASE WHEN vec_id % 3 > 0 THEN 1.0 ELSE 0.0 END AS m FROM embeddings),
p AS (SELECT label, i, sum(x * m) / greatest(sum(m), 1e-9) AS x FROM c GROUP BY ALL) SELECT label, round(sum(x), 6) AS total, round(max(x), 6) AS most FROM p GROUP BY label"""
)
def mean_pool_by_label(spark, d):
    rows = table(spark, d, "embeddings").withColumn("mask", F.when(F.col("vec_id") % 3 > 0, 1.0).otherwise(0.0))
    pooled = ground.mean_pool(rows, "label", "embedding", "mask")
    return pooled.select("label", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.array_max("v"), 6).alias("most"))


@query(
    """WITH w AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents), c AS (SELECT doc_id, least(length(w), 16) AS i, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
s AS (SELECT doc_id, sqrt(sum(n * n)) AS norm, coalesce(max(n) FILTER (i = 2), 0) AS two, coalesce(max(n) FILTER (i = 16), 0) AS most, count(*) AS filled FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(filled, 0) AS filled, round(coalesce(two / greatest(norm, 1e-9), 0), 4) AS two, round(coalesce(most / greatest(norm, 1e-9), 0), 4) AS most FROM documents d LEFT JOIN s USING (doc_id)"""
)
def encoder_embed(spark, d):
    """Every document by an encoder that counts word lengths."""
    rows = encode.embed(table(spark, d, "documents").select("doc_id", "text"), load=lambda: encode.word_lengths(16))
    filled = F.size(F.filter("v", lambda x: x > 0)).cast("long")
    return rows.select("doc_id", filled.alias("filled"), F.round(F.col("v")[1].cast("double"), 4).alias("two"), F.round(F.col("v")[15].cast("double"), 4).alias("most"))


@query()
def hashed_embed(spark, d):
    rows = encode.embed(table(spark, d, "benchmark"), encode.hashed_words(32))
    return rows.select("item_id", F.round(F.aggregate("v", F.lit(0.0).cast("double"), lambda s, x: s + x * x), 4).alias("norm"))


#: Iterations of the fits over all documents.
ITERATIONS = 60


def typed_text(spark, d) -> DataFrame:
    return O.sections(spark, d).select("id", F.col("gold").alias("type"), "text")


@query()
def tfidf_logreg(spark, d):
    """Every document's type by a head trained on all of them, with sparse TF-IDF and phrase features."""
    rows = typed_text(spark, d)
    model = train.fit_task(rows, max_iter=ITERATIONS, ids=("id",))
    return model.predict(model.seen).select("id", F.col("type").alias("y_true"), "y_pred", F.round(F.array_max("p"), 3).alias("p"))


@query()
def tfidf_report(spark, d):
    """How often the predictions of tfidf_logreg agree with the types."""
    return metrics.multiclass(tfidf_logreg(spark, d))


@query()
def tfidf_multilabel(spark, d):
    """Quality and toxicity of every document, by one model a label trained on the labelled ones, with thresholds of the best F1 there."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    known = table(spark, d, "labels").select("doc_id", F.array("quality", "toxic").alias("label"))
    base = docs.join(known, "doc_id")
    model = train.fit_task(base, "label", ("quality", "toxic"), triggers=False, max_iter=ITERATIONS).calibrated(base)
    return model.predict(docs).select("doc_id", *[F.round(F.col("p")[i], 3).alias(f"p_{k}") for i, k in enumerate(model.labels)], *[F.col("y_pred")[i].alias(k) for i, k in enumerate(model.labels)])


@query(
    "WITH b AS (SELECT doc_id AS id, text, lang AS type, NULL AS raw_text FROM documents WHERE lang = 'en' UNION ALL SELECT conv_id * 100 + turn, NULL, role, text FROM conversations) SELECT id, type, coalesce(nullif(raw_text, ''), nullif(text, ''), '') AS text FROM b"
)
def train_rows(spark, d):
    base = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("type"))
    more = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("raw_text"), F.col("role").alias("type"))
    rows = train.train_rows(base, more)
    return rows.select("id", "type", train.feature_text(rows).alias("text"))


@query()
def classifier_training(spark, d):
    """Labels of the held-out fifth of the vectors, by a balanced head trained on the rest."""
    return train.fitted_split(table(spark, d, "embeddings"), "embedding", "label", ["vec_id"]).select("vec_id", "label", "y_pred", F.round("p", 3).alias("p"))


# --- segmentation ---------------------------------------------------------------------------------------------------------


def sql_paragraphs(c: str) -> str:
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    head = f"(length({strip('l')}) BETWEEN 3 AND 48 AND NOT regexp_matches({strip('l')}, '[.!?:;,]$') AND regexp_matches({strip('l')}, {quoted(segment.HEADING)}))"
    start = f"regexp_matches(l, {quoted(segment.CLAUSE_START)})"
    line = f"CASE WHEN i > 1 AND ({start} OR {head}) THEN chr(64976) || l ELSE chr(10) || l END"
    lines = f"string_split_regex({strip('b')}, '[\\n\\x0b\\x0c\\x1c\\x1d\\x1e]')"
    chunks = f"string_split(array_to_string(list_transform({lines}, lambda l, i: {line}), ''), chr(64976))"
    blocks = f"string_split(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), chr(10) || chr(10))"
    return f"list_filter(list_transform(flatten(list_transform({blocks}, lambda b: {chunks})), lambda p: {sql_collapse('p')}), lambda p: p <> '')"


_PARAGRAPHS = "SELECT doc_id, CAST(unnest(range(len(ps))) AS INTEGER) AS section_idx, unnest(ps) AS text FROM (SELECT doc_id, {} AS ps FROM ({}))"


@query(_PARAGRAPHS.format(sql_paragraphs("text"), "SELECT doc_id, text FROM documents"))
def paragraph_split(spark, d):
    return segment.split_paragraphs(table(spark, d, "documents").select("doc_id", "text"))


@query(f"WITH {O.SECTIONS_SQL} " + _PARAGRAPHS.format(sql_paragraphs("text"), "SELECT id AS doc_id, text FROM sections"))
def clause_paragraphs(spark, d):
    return segment.split_paragraphs(O.sections(spark, d).withColumnRenamed("id", "doc_id"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line FROM documents), s AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM l)
SELECT doc_id, regexp_matches(line, {quoted(segment.CLAUSE_START)}) AS clause_start, length(t) BETWEEN 3 AND 48 AND NOT regexp_matches(t, '[.!?:;,]$') AND regexp_matches(t, {quoted(segment.HEADING)}) AS heading, count(*) AS n FROM s GROUP BY ALL"""
)
def heading_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\r?\n")).alias("line"))
    kinds = lines.select("doc_id", segment.is_clause_start(F.col("line")).alias("clause_start"), segment.is_heading(F.col("line")).alias("heading"))
    return kinds.groupBy("doc_id", "clause_start", "heading").agg(F.count(F.lit(1)).alias("n"))


def sql_sentences(c: str) -> str:
    """The same marks in SQL, with letters and digits of any script spelt out for word boundaries."""
    x, cut, end = "chr(64977)", "chr(64976)", "chr(64978)"
    names = segment.ABBREVIATIONS.removeprefix("\\b(").removesuffix("|#)\\.")
    shield = lambda t: f"regexp_replace({t}, {quoted(f'(^|[^' + chr(92) + 'pL' + chr(92) + f'pN_])({names})' + chr(92) + '.')}, '\\1\\2' || {x}, 'g')"
    t = shield(shield(sql_collapse(c)))  # twice: abbreviations may follow one another
    t = f"regexp_replace({t}, '([\\pL\\pN_])#\\.', '\\1#' || {x}, 'g')"
    t = f"replace(replace({t}, 'e.g' || {x}, 'e' || {x} || 'g' || {x}), 'i.e' || {x}, 'i' || {x} || 'e' || {x})"
    begun = f"CASE WHEN regexp_matches(t, {quoted(segment.WITHIN)}) THEN {cut} || regexp_replace(regexp_replace(t, {quoted(segment.AFTER_LAST)}, '\\1'), '^[.!?]', '') WHEN i = 1 THEN regexp_replace(t, '^[.!?]', '') ELSE t END"
    ended = f"CASE WHEN regexp_matches(t, {quoted(segment.AT_END)}) THEN t || {end} ELSE t END"
    marked = f"array_to_string(list_transform(list_transform(string_split({t}, ' '), lambda t, i: {begun}), lambda t: {ended}), ' ')"
    parts = f"string_split(regexp_replace({marked}, {end} || {quoted(segment.CLOSED)}, '\\1' || {cut}, 'g'), {cut})"
    return f"list_filter(list_transform({parts}, lambda s: replace(trim(s), {x}, '.')), lambda s: s <> '')"


_SENTENCES = "SELECT {key}, CAST(unnest(range(len(xs))) AS INTEGER) AS sentence_idx, unnest(xs) AS text FROM (SELECT {key}, {xs} AS xs FROM {table})"


@query(f"WITH {O.SECTIONS_SQL} " + _SENTENCES.format(key="id", xs=sql_sentences("text"), table="sections"))
def sentence_split_simple(spark, d):
    return segment.split_sentences(O.sections(spark, d), "id")


@query(_SENTENCES.format(key="doc_id", xs=sql_sentences("text"), table="documents"))
def sentence_split_full(spark, d):
    return segment.split_sentences(table(spark, d, "documents"))


def pages_of(spark, d) -> DataFrame:
    """Conversations as paged documents."""
    return table(spark, d, "conversations").select(F.concat(F.lit("v"), "conv_id").alias("source"), F.col("turn").cast("int").alias("page_idx"), "text")


@query(
    f"""WITH p AS (SELECT 'v' || conv_id AS source, turn, {sql_paragraphs("text")} AS ps FROM conversations), r AS (SELECT source, turn, unnest(range(len(ps))) AS pos, unnest(ps) AS raw_text FROM p)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY turn, pos) - 1 AS INTEGER) AS section_idx, '' AS text, raw_text, '' AS type, 0 AS start, 0 AS "end" FROM r"""
)
def section_rows(spark, d):
    return segment.section_rows(pages_of(spark, d))


@query(
    f"""WITH p AS (SELECT 'v' || conv_id AS source, turn, {sql_sentences("text")} AS xs FROM conversations), r AS (SELECT source, turn, unnest(range(len(xs))) AS pos, unnest(xs) AS text FROM p)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY turn, pos) - 1 AS INTEGER) AS sentence_idx, '' AS party, text FROM r"""
)
def sentence_rows(spark, d):
    return segment.sentence_rows(pages_of(spark, d))


# --- index ------------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, length({sql_collapse('text')}) AS n, sha256({sql_collapse('text')}) AS id FROM documents")
def text_normalize_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(T.collapse(F.col("text"))).cast("long").alias("n"), T.content_hash(F.col("text")).alias("id"))


def units_of(spark, d) -> DataFrame:
    return index.unique_units(table(spark, d, "documents").select("doc_id", "source", "text"), ["doc_id"])


UNITS_SQL = f"""n AS (SELECT doc_id, source, text, sha256({sql_collapse("text")}) AS id FROM documents WHERE {sql_collapse("text")} <> ''),
f AS (SELECT id, source, min(doc_id) AS first, count(*) AS c FROM n GROUP BY ALL),
units AS (SELECT f.id, CAST(sum(c) AS BIGINT) AS n_occurrences, string_agg(source, ',' ORDER BY first) AS sources, min(first) AS first FROM f GROUP BY f.id)"""


@query(f"WITH {UNITS_SQL} SELECT u.id, length(d.text) AS n_chars, n_occurrences, sources FROM units u JOIN documents d ON u.first = d.doc_id")
def unit_dedup(spark, d):
    return units_of(spark, d).select("id", F.length("text").cast("long").alias("n_chars"), "n_occurrences", F.array_join("sources", ",").alias("sources"))


def kept_index(spark, d) -> str:
    """The folder of an index kept up over all documents, which come in three micro-batches, of as many files each as the table has splits."""
    docs, given, path = table(spark, d, "documents"), scratch(spark, "given"), scratch(spark, "units")
    splits = docs.rdd.getNumPartitions()
    docs.select("doc_id", "source", "text").repartition(3 * splits).write.parquet(given)
    stream = spark.readStream.schema("doc_id long, source string, text string").option("maxFilesPerTrigger", splits).parquet(given)
    query = unit_index.keep(stream, path, scratch(spark, "state"), "doc_id")
    query.awaitTermination()
    return path


@query(ORACLE_SQL["unit_dedup"])
def streamed_units(spark, d):
    rows = unit_index.units(unit_index.entries(spark, kept_index(spark, d)))
    return rows.select("id", F.length("text").cast("long").alias("n_chars"), "n_occurrences", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {UNITS_SQL} SELECT doc_id, n_occurrences, sources FROM units JOIN n USING (id)")
def batch_lookup(spark, d):
    """Every document's text, with its white space doubled, in an index kept up over the documents."""
    asked = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", " ", "  ").alias("text"))
    return unit_index.lookup(spark, kept_index(spark, d), asked).select("doc_id", "n_occurrences", F.array_join("sources", ",").alias("sources"))


@query(
    f"""WITH {UNITS_SQL}, m AS (SELECT count(DISTINCT source) AS n_documents, CAST(sum(length(text)) AS BIGINT) AS total_chars, count(*) AS total_sections, CAST(count(*) * 2 AS BIGINT) AS total_sentences FROM documents)
SELECT m.*, u.n AS unique_sections, u.n AS unique_sentences, total_sections - u.n AS duplicate_sections, total_sentences - u.n AS duplicate_sentences FROM m, (SELECT count(*) AS n FROM units) u"""
)
def index_stats(spark, d):
    docs = table(spark, d, "documents")
    manifests = docs.groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n_sections"), (F.count(F.lit(1)) * 2).alias("n_sentences"))
    u = units_of(spark, d)
    return index.statistics(manifests, u, u)


@query(
    f"WITH {UNITS_SQL}, q AS (SELECT sha256({sql_collapse('text')}) AS id FROM documents WHERE doc_id = 1) SELECT u.id, n_occurrences, sources, k.kind FROM units u JOIN q USING (id), (VALUES ('section'), ('sentence')) k(kind)"
)
def exact_lookup(spark, d):
    row = table(spark, d, "documents").filter("doc_id = 1").select("text").first()
    u = units_of(spark, d)
    return index.lookup(u, u, "  " + row["text"].replace(" ", "  ") + "\n").select("id", "n_occurrences", F.array_join("sources", ",").alias("sources"), "kind")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_first(spark, d):
    return index.keep_first(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"])


@query("SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1 OR source IS NULL")
def repeated_sources(spark, d):
    return index.repeated_sources(table(spark, d, "documents"))


@query("SELECT 'v' || conv_id AS source, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id")
def document_hashes(spark, d):
    rows = pages_of(spark, d).select("source", F.col("page_idx").alias("section_idx"), F.lit("").alias("raw_text"), "text")
    return index.document_hashes(rows)


# --- profiles -----------------------------------------------------------------------------------------------------------------

STATS_SQL = """l AS (SELECT length(coalesce(text, '')) AS len FROM documents), o AS (SELECT list(len ORDER BY len) AS xs, count(*) AS n FROM l),
stats AS (SELECT n AS rows, round((SELECT avg(len) FROM l), 1) AS mean, xs[1] AS min, xs[CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1] AS p50, xs[CAST(floor(0.9 * (n - 1)) AS BIGINT) + 1] AS p90, xs[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1] AS p95, xs[n] AS max FROM o)"""
_LONGS = ("min", "p50", "p90", "p95", "max")


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in names})


def as_text(df: DataFrame, *names: str) -> DataFrame:
    """Nullable integers as text, so that both engines show them alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in names})


@query(f"WITH {STATS_SQL} SELECT * FROM stats")
def text_stats(spark, d):
    return longs(eda.text_stats(table(spark, d, "documents")), *_LONGS)


@query(
    f"""WITH {STATS_SQL}, s AS (SELECT source, count(*) AS k FROM documents GROUP BY source), p AS (SELECT list(k ORDER BY k) AS ks, count(*) AS n FROM s),
c AS (SELECT count(*) FILTER (length(coalesce(text, '')) >= 600) AS truncated, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty_text FROM documents)
SELECT stats.*, p.n AS unique_sources, ks[1] AS per_source_min, ks[p.n] AS per_source_max, ks[p.n // 2 + 1] AS per_source_p50, truncated, empty_text, round(100.0 * truncated / rows, 1) AS truncated_pct FROM stats, p, c"""
)
def summarize_rows(spark, d):
    return longs(eda.summarize(table(spark, d, "documents")), *_LONGS)


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def column_distribution(spark, d):
    return eda.distribution(table(spark, d, "documents"), "lang", ["doc_id"])


@query("WITH h AS (SELECT left(text, 12) AS value, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1 ORDER BY n DESC, f LIMIT 25) SELECT value, n FROM h")
def top_headings(spark, d):
    return eda.distribution(table(spark, d, "documents").withColumn("heading", F.substring("text", 1, 12)), "heading", ["doc_id"], 25)


@query("SELECT coalesce(lang, 'None') AS value, count(*) AS n, count(*) FILTER (length(coalesce(text, '')) >= 600) AS truncated, round(100.0 * count(*) FILTER (length(coalesce(text, '')) >= 600) / count(*), 1) AS truncated_pct FROM documents GROUP BY 1")
def truncation_by_column(spark, d):
    return eda.cut_by(table(spark, d, "documents"), "lang")


@query("SELECT coalesce(lang, 'None') AS a, coalesce(source, 'None') AS b, count(*) AS n FROM documents GROUP BY ALL")
def crosstab(spark, d):
    return eda.cross_tab(table(spark, d, "documents"), "lang", "source")


@query(
    """WITH a AS (SELECT DISTINCT doc_id AS v FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT doc_id AS v FROM labels)
SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS left_only, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS right_only, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS shared"""
)
def source_overlap(spark, d):
    return eda.overlap(table(spark, d, "documents").filter("lang = 'en'"), table(spark, d, "labels"), "doc_id")


# One report a query, as JSON: nested, with values in the order that the report gives them.

LEASES_SQL = "SELECT doc_id AS id, source, text, lang AS type_fast_lane, split_part(text, chr(10), 1) AS heading FROM documents"
TALKS_SQL = "SELECT conv_id * 1000 + turn AS id, 'src' || (conv_id % 30) AS source, text, role AS type, 't' || (turn % 3) AS redflag_type FROM conversations"


def sql_summary(t: str, text: str = "text", more: str = "") -> str:
    """The summary of a table (id, source, text), as fields of a struct."""
    n, cut = f"(SELECT count(*) FROM {t})", f"(SELECT count(*) FROM {t} WHERE length(coalesce({text}, '')) >= 600)"
    per = f"(SELECT list(k ORDER BY k) FROM (SELECT count(*) AS k FROM {t} GROUP BY source))"
    xs = f"(SELECT list(length(coalesce({text}, '')) ORDER BY length(coalesce({text}, ''))) FROM {t})"
    at = lambda q: f"{xs}[CAST(floor({q} * ({n} - 1)) AS BIGINT) + 1]"
    return f"""rows := {n}, unique_sources := len({per}), rows_per_source := struct_pack(min := {per}[1], p50 := {per}[len({per}) // 2 + 1], max := {per}[-1]),
text := struct_pack(rows := {n}, mean := (SELECT round(avg(length(coalesce({text}, ''))), 1) FROM {t}), min := {xs}[1], p50 := {at(0.5)}, p90 := {at(0.9)}, p95 := {at(0.95)}, max := {xs}[-1]),
truncated_at_limit := {cut}, truncated_pct := round(100.0 * {cut} / {n}, 1), empty_text := (SELECT count(*) FROM {t} WHERE trim(coalesce({text}, '')) = '')"""


def sql_distribution(t: str, c: str, limit: int | None = None) -> str:
    return f"(SELECT list(struct_pack(value := coalesce({c}, 'None'), n := n) ORDER BY n DESC, f) FROM (SELECT {c}, count(*) AS n, min(id) AS f FROM {t} GROUP BY {c} ORDER BY n DESC, f {f'LIMIT {limit}' if limit else ''}))"


def sql_truncation(t: str, c: str) -> str:
    cut = "count(*) FILTER (length(coalesce(text, '')) >= 600)"
    return f"(SELECT list(struct_pack(value := coalesce({c}, 'None'), n := n, truncated := k, truncated_pct := round(100.0 * k / n, 1)) ORDER BY k DESC, f) FROM (SELECT {c}, count(*) AS n, {cut} AS k, min(id) AS f FROM {t} GROUP BY {c}))"


def sql_cross(t: str, a: str, b: str) -> str:
    return f"""(SELECT list(struct_pack(value := a, "values" := x) ORDER BY f) FROM (SELECT a, min(f) AS f, list(struct_pack(value := b, n := n) ORDER BY f) AS x FROM (SELECT {a} AS a, {b} AS b, count(*) AS n, min(id) AS f FROM {t} GROUP BY ALL) GROUP BY a))"""


@query(
    f"""WITH l AS ({LEASES_SQL}), r AS ({TALKS_SQL}), a AS (SELECT DISTINCT source FROM l), b AS (SELECT DISTINCT source FROM r)
SELECT CAST(to_json(struct_pack(leases := struct_pack({sql_summary("l")}, type_fast_lane := {sql_distribution("l", "type_fast_lane")}, truncation_by_type_fast_lane := {sql_truncation("l", "type_fast_lane")}, top_headings := {sql_distribution("l", "heading", 25)}),
redflags := struct_pack({sql_summary("r")}, type := {sql_distribution("r", "type")}, redflag_type := {sql_distribution("r", "redflag_type")}, truncation_by_type := {sql_truncation("r", "type")}, type_x_redflag_type := {sql_cross("r", "type", "redflag_type")}),
cross_corpus := struct_pack(source_overlap := struct_pack(leases_only := (SELECT count(*) FROM a ANTI JOIN b USING (source)), redflags_only := (SELECT count(*) FROM b ANTI JOIN a USING (source)), shared := (SELECT count(*) FROM a JOIN b USING (source)))))) AS VARCHAR) AS report"""
)
def corpus_report(spark, d):
    leases = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text", F.col("lang").alias("type_fast_lane"), F.split("text", "\n")[0].alias("heading"))
    turn = F.col("turn").cast("long")
    talks = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + turn).alias("id"), F.concat(F.lit("src"), F.col("conv_id") % 30).alias("source"), "text", F.col("role").alias("type"), F.concat(F.lit("t"), turn % 3).alias("redflag_type")
    )
    return reports.report(leases, talks, ("id",)).select(F.to_json(F.struct("leases", "redflags", "cross_corpus")).alias("report"))


def methods_of(spark, d) -> DataFrame:
    n = F.length("text")
    return pages_of(spark, d).withColumn("method", F.when(n % 7 == 0, "error").when(n % 3 == 0, "ocr").otherwise("text"))


@query(
    """WITH p AS (SELECT 'v' || conv_id AS source, turn, CASE WHEN length(text) % 7 = 0 THEN 'error' WHEN length(text) % 3 = 0 THEN 'ocr' ELSE 'text' END AS method FROM conversations)
SELECT source, count(*) AS n_pages, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (method = 'error'), '') AS error_pages FROM p GROUP BY source"""
)
def page_methods(spark, d):
    return eda.page_methods(methods_of(spark, d))


@query("SELECT 'v' || conv_id AS source, count(*) AS n_pages, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS full_text FROM conversations GROUP BY conv_id")
def full_text(spark, d):
    return eda.full_text(pages_of(spark, d))


@query(
    """WITH p AS (SELECT conv_id, turn, left(text, CAST(turn * 15 AS INTEGER)) AS layer, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS ocr FROM conversations)
SELECT conv_id, turn, CASE WHEN length(trim(layer)) >= 40 THEN 'text' WHEN trim(ocr) <> '' THEN 'ocr' WHEN trim(layer) <> '' THEN 'text' ELSE 'error' END AS method,
length(CASE WHEN length(trim(layer)) >= 40 THEN layer WHEN trim(ocr) <> '' THEN ocr WHEN trim(layer) <> '' THEN layer ELSE '' END) AS n FROM p"""
)
def page_choice(spark, d):
    from ..sources.files import chosen_text

    rows = table(spark, d, "conversations").withColumn("layer", F.expr("substring(text, 1, cast(turn * 15 as int))")).withColumn("ocr", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(""))
    chosen = chosen_text(F.col("layer"), F.col("ocr"))
    return rows.select("conv_id", "turn", chosen["method"].alias("method"), F.length(chosen["text"]).cast("long").alias("n"))


# --- splits, samples ----------------------------------------------------------------------------------------------------------


def labelled(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "lang", "quality", "toxic", "text", F.when(F.col("toxic") == 1, "toxic").otherwise("none").alias("type"))


LABELLED_SQL = "lab AS (SELECT doc_id, lang, quality, toxic, text, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'none' END AS type FROM documents JOIN labels USING (doc_id))"
_HASH = "md5(doc_id || '|42')"
SPLIT_SQL = f"""{LABELLED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_HASH}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM lab),
split AS (SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' WHEN r <= floor(n * 0.8 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM r)"""


@query(f"WITH {SPLIT_SQL} SELECT doc_id, split FROM split")
def stratified_split_members(spark, d):
    return features.split(labelled(spark, d), "lang", ["doc_id"]).select("doc_id", "split")


@query(f"WITH {SPLIT_SQL} SELECT lang, split, count(*) AS n FROM split GROUP BY ALL")
def stratified_split_counts(spark, d):
    return features.split(labelled(spark, d), "lang", ["doc_id"]).groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {LABELLED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY {_HASH}, doc_id) AS r, count(*) OVER (PARTITION BY quality, toxic) AS n FROM lab)
SELECT quality, toxic, CASE WHEN r <= greatest(floor(n * 0.7 + 1e-9), 1) THEN 'train' WHEN r <= greatest(floor(n * 0.7 + 1e-9), 1) + greatest(floor(n * 0.15 + 1e-9), 1) THEN 'val' ELSE 'test' END AS split, count(*) AS k FROM r GROUP BY ALL"""
)
def split_with_minimum(spark, d):
    rows = labelled(spark, d).withColumn("stratum", F.concat_ws("|", "quality", "toxic"))
    return features.split(rows, "stratum", ["doc_id"], ratios=(0.7, 0.15), least=1).groupBy("quality", "toxic", "split").agg(F.count(F.lit(1)).alias("k"))


@query(
    f"""WITH {LABELLED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {_HASH}, doc_id) AS r, count(*) FILTER (type <> 'none') OVER () AS pos FROM lab) SELECT doc_id, type FROM r WHERE type <> 'none' OR r <= 3 * pos"""
)
def downsample_none(spark, d):
    return features.downsample(labelled(spark, d), "type", ["doc_id"]).select("doc_id", "type")


@query(f"SELECT doc_id FROM documents ORDER BY {_HASH}, doc_id LIMIT 20")
def sample_rows(spark, d):
    return features.sample(table(spark, d, "documents"), 20, ["doc_id"]).select("doc_id")


@query(f"WITH {O.SECTIONS_SQL}, f AS (SELECT *, count(*) OVER (PARTITION BY gold) AS n FROM sections WHERE gold <> '{UNKNOWN}' AND trim(text) <> '') SELECT id, gold FROM f WHERE n >= 30")
def frequent_labels(spark, d):
    return features.frequent_labels(O.sections(spark, d), "gold", least=30).select("id", "gold")


# --- metrics ----------------------------------------------------------------------------------------------------------------------


def pairs_of(spark, d) -> DataFrame:
    return typed(spark, d).select("id", F.col("gold").alias("y_true"), F.col("type").alias("y_pred"))


PAIRS_SQL = f"{EVIDENCE_SQL}, pairs AS (SELECT id, gold AS y_true, type AS y_pred FROM typed)"
CLASS_SQL = """x AS (SELECT y_true AS label, true AS gold, y_true = y_pred AS same FROM pairs UNION ALL SELECT y_pred, false, y_true = y_pred FROM pairs),
c AS (SELECT label, count(*) FILTER (gold AND same) AS tp, count(*) FILTER (NOT gold AND NOT same) AS fp, count(*) FILTER (gold AND NOT same) AS fn, count(*) FILTER (gold) AS g FROM x GROUP BY label),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn)::DOUBLE END AS r FROM c),
s AS (SELECT label, tp, fp, fn, g, p, r, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f FROM pr)"""


@query(f"WITH {PAIRS_SQL}, {CLASS_SQL} SELECT label, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1 FROM s")
def per_class_metrics(spark, d):
    return metrics.per_class(pairs_of(spark, d))


@query(
    f"""WITH {PAIRS_SQL}, {CLASS_SQL} SELECT (SELECT count(*) FROM pairs) AS n, (SELECT round(count(*) FILTER (y_true = y_pred) / count(*)::DOUBLE, 4) FROM pairs) AS accuracy,
round(avg(round(p, 4)), 4) AS macro_precision, round(avg(round(r, 4)), 4) AS macro_recall, round(avg(round(f, 4)), 4) AS macro_f1 FROM s"""
)
def multiclass_metrics(spark, d):
    return metrics.multiclass(pairs_of(spark, d))


@query(
    f"""WITH {PAIRS_SQL}, {CLASS_SQL}, t AS (SELECT sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, avg(p) AS p, avg(r) AS r, avg(f) AS f FROM s WHERE g > 0), u AS (SELECT *, tp / (tp + fp) AS mp, tp / (tp + fn) AS mr FROM t)
SELECT round(mp, 3) AS micro_precision, round(mr, 3) AS micro_recall, round(2 * mp * mr / (mp + mr), 3) AS micro_f1, round(p, 3) AS macro_precision, round(r, 3) AS macro_recall, round(f, 3) AS macro_f1 FROM u"""
)
def pooled_metrics(spark, d):
    return metrics.pooled(pairs_of(spark, d))


def label_pairs(spark, d) -> DataFrame:
    rows = labelled(spark, d)
    return rows.select(F.array("quality", "toxic").alias("y_true"), F.array((F.length("text") > 500).cast("int"), F.lower("text").contains("idiot").cast("int")).alias("y_pred"))


LABEL_SQL = f"{LABELLED_SQL}, lp AS (SELECT quality AS t1, toxic AS t2, CAST(length(text) > 500 AS INTEGER) AS p1, CAST(contains(lower(text), 'idiot') AS INTEGER) AS p2 FROM lab)"


@query(
    f"""WITH {LABEL_SQL}, z AS (SELECT 'quality' AS label, t1 AS t, p1 AS p FROM lp UNION ALL SELECT 'toxic', t2, p2 FROM lp), y AS (SELECT label, t, p FROM z UNION ALL SELECT 'micro', t, p FROM z),
a AS (SELECT label, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn FROM y GROUP BY label),
b AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn)::DOUBLE END AS r FROM a)
SELECT label, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM b"""
)
def multilabel_metrics(spark, d):
    return longs(metrics.multilabel(label_pairs(spark, d), ("quality", "toxic")), "tp", "fp", "fn")


@query(f"WITH {LABEL_SQL} SELECT count(*) AS n, round(count(*) FILTER (t1 = p1 AND t2 = p2) / count(*)::DOUBLE, 4) AS exact_match_ratio FROM lp")
def exact_match(spark, d):
    return metrics.exact_match(label_pairs(spark, d))


@query(
    f"""WITH {LABELLED_SQL}, s AS (SELECT lang AS label, quality AS y, least(length(text) / 2000.0, 1.0)::DOUBLE AS p FROM lab), g AS (SELECT *, unnest(generate_series(1, 19)) AS i FROM s),
a AS (SELECT label, i, count(*) FILTER (p >= round(i * 0.05, 2) AND y = 1) AS tp, count(*) FILTER (p >= round(i * 0.05, 2) AND y = 0) AS fp, count(*) FILTER (p < round(i * 0.05, 2) AND y = 1) AS fn FROM g GROUP BY ALL),
b AS (SELECT *, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1 FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, i) AS r FROM b)
SELECT label, round(i * 0.05, 2)::DOUBLE AS threshold, f1 FROM r WHERE r = 1"""
)
def threshold_calibration(spark, d):
    rows = labelled(spark, d).select(F.col("lang").alias("label"), F.col("quality").alias("y"), F.least(F.length("text") / 2000.0, F.lit(1.0)).alias("p"))
    return metrics.calibrate(rows)


def sql_concepts(c: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_match(f'lower({c})', p)} THEN '{n}' END" for n, p in CONCEPTS.items()) + "], lambda x: x IS NOT NULL)"


CONCEPT_SQL = f"""{FINDINGS_SQL}, flags AS (SELECT DISTINCT s.source, unnest({sql_concepts("c.clause_text")}) AS concept FROM sections s JOIN clause_dim c USING (k)),
rc(rule_id, concept) AS (VALUES {", ".join(f"('{r.rule_id}', '{r.concept}')" for r in RULES)}), got AS (SELECT DISTINCT source, concept FROM findings JOIN rc USING (rule_id)),
cells AS (SELECT source, concept, max(g) AS g, max(p) AS p FROM (SELECT source, concept, 1 AS g, 0 AS p FROM flags UNION ALL SELECT source, concept, 0, 1 FROM got) GROUP BY ALL),
per AS (SELECT source, sum(g * p) AS b, sum(g) AS g, sum(p) AS p FROM cells GROUP BY source)"""


def concept_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    clauses = O.clause_table(spark).select("k", metrics.concepts_of(F.col("clause_text")).alias("concepts"))  # patterns run once a clause
    rows = O.sections(spark, d).select("source", "k").join(F.broadcast(clauses), "k")
    rules = ground.rule_table(spark)
    return rows.select("source", F.explode("concepts").alias("concept")).distinct(), metrics.finding_concepts(found(spark, d), rules, "source")


@query(f"WITH {CONCEPT_SQL} SELECT source, concept FROM flags")
def flag_concepts(spark, d):
    return concept_tables(spark, d)[0]


@query(f"WITH {CONCEPT_SQL} SELECT source, concept FROM got")
def finding_concepts(spark, d):
    return concept_tables(spark, d)[1]


@query(f"WITH {CONCEPT_SQL} SELECT source, round(b / (g + p - b)::DOUBLE, 3) AS jaccard, round(CASE WHEN p = 0 THEN 0 ELSE b / p::DOUBLE END, 3) AS precision, round(CASE WHEN g = 0 THEN 0 ELSE b / g::DOUBLE END, 3) AS recall FROM per")
def set_agreement(spark, d):
    return metrics.set_agreement(*concept_tables(spark, d), "source", "concept")


@query(
    f"""WITH {CONCEPT_SQL}, coh AS (SELECT DISTINCT source, CASE WHEN length(source) = 4 THEN 'seen' ELSE 'held_out' END AS cohort FROM documents)
SELECT cohort, count(*) AS n_docs, round(sum(b) / nullif(sum(g), 0)::DOUBLE, 4) AS recall, round(sum(b) / nullif(sum(p), 0)::DOUBLE, 4) AS precision FROM coh LEFT JOIN per USING (source) GROUP BY cohort"""
)
def concept_recall(spark, d):
    cohorts = table(spark, d, "documents").select("source").distinct().withColumn("cohort", F.when(F.length("source") == 4, "seen").otherwise("held_out"))
    return metrics.cohort_recall(*concept_tables(spark, d), cohorts, "source", "concept")


@query(
    f"""WITH {PAIRS_SQL}, a AS (SELECT g.y_true, coalesce(p.y_pred, '{UNKNOWN}') AS y_pred FROM pairs g LEFT JOIN (SELECT * FROM pairs WHERE id % 5 > 0) p USING (id))
SELECT count(*) AS n, round(count(*) FILTER (y_true = y_pred) / count(*)::DOUBLE, 4) AS accuracy, round(count(*) FILTER (y_true <> '{UNKNOWN}' AND y_true = y_pred) / count(*) FILTER (y_true <> '{UNKNOWN}')::DOUBLE, 4) AS clause_accuracy,
count(*) FILTER (y_true <> '{UNKNOWN}' AND y_pred = '{UNKNOWN}') AS missed, count(*) FILTER (y_true = '{UNKNOWN}' AND y_pred <> '{UNKNOWN}') AS invented FROM a"""
)
def ood_report(spark, d):
    """A fifth of the rows gets no prediction on purpose: what is not predicted counts as unknown."""
    rows = pairs_of(spark, d)
    gold = rows.select("id", F.col("y_true").alias("type"))
    pred = rows.filter("id % 5 > 0").select("id", F.col("y_pred").alias("type"))
    return metrics.ood_report(metrics.aligned(gold, pred, ["id"], "type"))


# --- datasets ---------------------------------------------------------------------------------------------------------------------

_PARTIES = ("[Tenant] ", "[ lessor ]", "", "[Guarantor]", "[Subtenant]  ")


def deontic_csv(spark, d) -> DataFrame:
    """Documents and clauses in the shape of the annotated corpus' CSV: everything is a string."""
    n = F.col("id") % 5
    lead = F.element_at(F.array(*[F.lit(p) for p in _PARTIES]), (n + 1).cast("int"))
    hot = F.pmod("id", F.lit(7))
    label = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when((i == hot) | ((hot < 3) & (i == hot + 1)), "1").otherwise("0")), ", "), F.lit("]"))
    span = F.concat(F.lit("{'obl': [[0, "), (F.col("id") % 40).cast("string"), F.lit("], [50, 60]], 'ent': []}"))
    cid = F.concat(F.lit("corpus/part"), (F.col("id") % 3).cast("string"), F.lit("/lease-"), "source", F.when(F.col("id") % 11 == 0, "").otherwise(F.concat(F.lit("-"), (F.col("id") % 100).cast("string"))))
    return O.sections(spark, d).select("id", cid.alias("cid"), F.concat(lead, "text").alias("text"), label.alias("label"), span.alias("span"), F.lit("train").alias("split"))


_LEAD_SQL = "[" + ", ".join(quoted(p) for p in _PARTIES) + "][id % 5 + 1]"
_ACTIVE_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN id % 7 = {i} OR (id % 7 < 3 AND id % 7 + 1 = {i}) THEN '{n}' END" for i, n in enumerate(DEONTIC_LABELS)) + "], lambda x: x IS NOT NULL), ',')"
_ALIAS_SQL = "CASE " + " ".join(f"WHEN p = '{a}' THEN '{b}'" for a, b in PARTY_ALIASES.items()) + " ELSE p END"


@query(
    f"""WITH {O.SECTIONS_SQL}, t AS (SELECT id, {_LEAD_SQL} || text AS text FROM sections), n AS (SELECT id, text, regexp_matches(text, '^\\s*\\[[^\\]]*\\]') AS has, lower(trim(regexp_extract(text, '^\\s*\\[([^\\]]*)\\]', 1))) AS p FROM t)
SELECT id, CASE WHEN has THEN {_ALIAS_SQL} ELSE '{UNKNOWN}' END AS party, regexp_replace(regexp_replace(text, '^\\s*\\[[^\\]]*\\]', ''), '^\\s+|\\s+$', '', 'g') AS text FROM n"""
)
def party_split(spark, d):
    return deontic_csv(spark, d).select("id", dataset.party(F.col("text")).alias("p")).select("id", "p.party", "p.text")


@query(
    f"""WITH {O.SECTIONS_SQL} SELECT id, CASE WHEN id % 11 = 0 THEN 'lease' ELSE 'lease-' || source END AS source, CASE WHEN id % 11 = 0 THEN -1 ELSE CAST(id % 100 AS INTEGER) END AS idx FROM sections"""
)
def contract_ids(spark, d):
    return deontic_csv(spark, d).select("id", dataset.contract(F.col("cid")).alias("c")).select("id", F.col("c.source").alias("source"), "c.idx")


def deontic_rows(spark, d) -> DataFrame:
    return dataset.annotated(deontic_csv(spark, d))


@query(f"WITH {O.SECTIONS_SQL}, l AS (SELECT unnest(string_split({_ACTIVE_SQL}, ',')) AS label FROM sections) SELECT label, count(*) AS n FROM l GROUP BY label")
def label_explode(spark, d):
    return eda.label_counts(deontic_rows(spark, d))


@query(f"WITH {O.SECTIONS_SQL} SELECT count(*) AS rows, count(*) FILTER (id % 7 < 3) AS multi_label_rows, CAST(2 * count(*) AS BIGINT) AS spans FROM sections")
def deontic_report(spark, d):
    return eda.deontic_report(deontic_rows(spark, d))


@query(f"WITH {O.SECTIONS_SQL} SELECT id, {_ACTIVE_SQL} AS types FROM sections")
def deontic_types(spark, d):
    return deontic_csv(spark, d).select("id", F.array_join(dataset.active_types(dataset.labels(F.col("label"))), ",").alias("types"))


@query(f"WITH {O.SECTIONS_SQL} SELECT id, 2 AS n_spans, CAST(id % 40 AS INTEGER) AS first_end FROM sections")
def span_counts(spark, d):
    rows = deontic_csv(spark, d).select("id", dataset.spans(F.col("span")).alias("s"))
    return rows.select("id", dataset.span_count(F.col("s")).alias("n_spans"), F.col("s")["obl"][0][1].alias("first_end"))


@query(
    f"""WITH {O.SECTIONS_SQL}, {LABELLED_SQL} SELECT id, CASE WHEN id % 7 < 3 THEN 'expected exactly one label' ELSE '' END || CASE WHEN id % 5 IN (2, 3) THEN (CASE WHEN id % 7 < 3 THEN ',' ELSE '' END) || 'bad party' ELSE '' END AS errors FROM sections"""
)
def multilabel_errors(spark, d):
    rows = deontic_csv(spark, d).select("id", dataset.party(F.col("text"))["party"].alias("party"), dataset.labels(F.col("label")).alias("label"))
    rows = dataset.multilabel_errors(rows.withColumn("deontic_types", dataset.active_types(F.col("label"))))
    return rows.select("id", F.array_join("errors", ",").alias("errors"))


def redflag_csv(spark, d) -> DataFrame:
    kind = F.element_at(F.array(F.lit("riders"), F.lit("none"), F.lit("compalsory_reconstraction"), F.lit("holdover")), (F.col("id") % 4 + 1).cast("int"))
    start = F.when(F.col("id") % 6 == 0, F.lit(" 5")).when(F.col("id") % 6 == 1, F.lit("")).when(F.col("id") % 6 == 2, F.lit("-7")).otherwise(F.col("id").cast("string"))
    return O.sections(spark, d).select(
        F.concat("source", F.lit("-lease_"), "id").alias("uuid"), F.lit("p1").alias("part"), F.lit("").alias("text"), F.col("text").alias("raw_text"), kind.alias("type"), start.alias("start"), F.col("id").cast("string").alias("end")
    )


_KIND_SQL = "['riders', 'none', 'compalsory_reconstraction', 'holdover'][id % 4 + 1]"
REDFLAG_SQL = f"""{O.SECTIONS_SQL}, rf AS (SELECT source, text AS raw_text, {_KIND_SQL} AS type, CAST(CASE WHEN id % 6 IN (0, 1) THEN NULL WHEN id % 6 = 2 THEN -7 ELSE id END AS INTEGER) AS start, CAST(id AS INTEGER) AS "end" FROM sections)"""


@query(f"""WITH {REDFLAG_SQL} SELECT source, '' AS text, raw_text, type, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end" FROM rf""")
def redflag_ingest(spark, d):
    return as_text(dataset.redflags(redflag_csv(spark, d)), "start", "end")


@query(f"""WITH {REDFLAG_SQL} SELECT source, 'p1' AS part, '' AS text, raw_text, type, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end" FROM rf WHERE type <> 'none'""")
def easy_redflag_ingest(spark, d):
    return as_text(dataset.redflags(redflag_csv(spark, d), easy=True), "start", "end")


@query("SELECT source, lang AS document_class, text FROM documents")
def docid_ingest(spark, d):
    csv = table(spark, d, "documents").select(F.concat("source", F.lit("-lease_"), "doc_id", F.lit("-lease_x")).alias("uuid"), F.col("lang").alias("document_class"), F.col("text").alias("document_full_text"))
    return dataset.documents(csv)


@query(
    f"""WITH {O.SECTIONS_SQL} SELECT source, 'p' || id AS part, 'lessee' AS class_id, left(text, 10) AS entity_text, CAST(CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS VARCHAR) AS entity_start, CAST(id + 10 AS VARCHAR) AS entity_end FROM sections"""
)
def entity_ingest(spark, d):
    start = F.when(F.col("id") % 3 == 0, F.lit("-4")).otherwise(F.col("id").cast("string"))
    csv = O.sections(spark, d).select(
        F.concat("source", F.lit("-lease_1")).alias("uuid"), F.concat(F.lit("p"), "id").alias("part_id"), F.lit("lessee").alias("class_id"), F.substring("text", 1, 10).alias("entity_text"), start.alias("entity_start"), (F.col("id") + 10).cast("string").alias("entity_end")
    )
    return as_text(dataset.entities(csv), "entity_start", "entity_end")


@query(f"WITH {O.SECTIONS_SQL} SELECT source, 'p' || id AS part, text, id % 2 = 0 AS clause_begin, gold AS clause_type FROM sections")
def clause_ingest(spark, d):
    begin = F.when(F.col("id") % 2 == 0, "True").otherwise("False")
    csv = O.sections(spark, d).select(F.concat("source", F.lit("-lease_1")).alias("uuid"), F.concat(F.lit("p"), "id").alias("part"), "text", begin.alias("clause_begin"), F.col("gold").alias("clause_type"))
    return dataset.clauses(csv)


@query(
    f"""WITH {REDFLAG_SQL} SELECT source, {sql_collapse("raw_text")} AS raw_text, length({sql_collapse("raw_text")}) >= 600 AS truncated, CASE WHEN type = 'compalsory_reconstraction' THEN 'compulsory_reconstruction' ELSE type END AS type FROM rf"""
)
def clean_rows(spark, d):
    return dataset.clean(dataset.redflags(redflag_csv(spark, d)), "raw_text", fix=True).select("source", "raw_text", F.coalesce("truncated", F.lit(False)).alias("truncated"), "type")


@query(f"WITH {REDFLAG_SQL} SELECT source, raw_text, CASE WHEN start IS NULL THEN 'missing start' WHEN start < 0 THEN 'bad start' ELSE '' END AS errors FROM rf")
def validation_errors(spark, d):
    rows = dataset.violations(dataset.redflags(redflag_csv(spark, d)), {"source": None, "type": None, "start": F.col("start") >= 0})
    return rows.select("source", "raw_text", F.array_join("errors", ",").alias("errors"))


# Rows to validate, made of all documents: some without text, part or party, some of a type that the real corpus lacks, some with odd labels.
MADE_SQL = """made AS (SELECT doc_id AS id, CASE WHEN doc_id % 97 = 0 THEN NULL ELSE 's' || (doc_id // 2 * 2 + CASE WHEN doc_id % 10 = 1 THEN 0 ELSE doc_id % 2 END) END AS source, CASE WHEN doc_id % 11 = 0 THEN 'odd' ELSE lang END AS type,
CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS raw_text, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 'p' || doc_id END AS part, ['tenant', 'landlord', 'agent', NULL][doc_id % 4 + 1] AS party,
[[1, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 1], [0, 1, 0, 1, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0], [0, 2, 1, 0, 0, 0, 0], [1, 0], NULL][doc_id % 7 + 1] AS label,
[['obl'], ['none'], ['per'], []][doc_id % 4 + 1] AS deontic_types FROM documents)"""


def made_rows(spark, d) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda xs, n: F.try_element_at(F.array(*xs), (i % n + 1).cast("int"))
    vector = lambda *xs: F.array(*map(F.lit, xs))
    number = i - i % 2 + F.when(i % 10 == 1, 0).otherwise(i % 2)
    return table(spark, d, "documents").select(
        i.alias("id"), F.when(i % 97 != 0, F.concat(F.lit("s"), number)).alias("source"), F.when(i % 11 == 0, "odd").otherwise(F.col("lang")).alias("type"), F.when(i % 7 == 0, "").otherwise(F.col("text")).alias("raw_text"),
        F.when(i % 13 != 0, F.concat(F.lit("p"), i)).alias("part"), pick([F.lit("tenant"), F.lit("landlord"), F.lit("agent"), F.lit(None).cast("string")], 4).alias("party"),
        pick([vector(1, 0, 0, 0, 0, 0, 0), vector(0, 0, 0, 0, 0, 0, 1), vector(0, 1, 0, 1, 0, 0, 0), vector(0, 0, 0, 0, 0, 0, 0), vector(0, 2, 1, 0, 0, 0, 0), vector(1, 0), F.lit(None).cast("array<int>")], 7).alias("label"),
        pick([vector("obl"), vector("none"), vector("per"), F.array().cast("array<string>")], 4).alias("deontic_types"),
    )


def sql_violations(constraints, rows: str) -> str:
    """One select a constraint, of rows and of their repeated sources."""
    parts = [f"SELECT id, source, {quoted(name)} AS error FROM {rows} WHERE {p}" for name, p in constraints]
    return " UNION ALL ".join(parts) + f" UNION ALL SELECT NULL, source, '{validate.DUPLICATE}' FROM made WHERE source IS NOT NULL GROUP BY source HAVING count(*) > 1"


_KNOWN_SQL = f"{MADE_SQL}, k AS (SELECT *, coalesce(type IN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), false) AS known FROM made)"


def _as_rows(found: DataFrame) -> DataFrame:
    return as_text(found, "id").select("id", "source", "error")


@query(f"WITH {_KNOWN_SQL} SELECT CAST(id AS VARCHAR) AS id, source, error FROM ({sql_violations(validate.REDFLAG, 'k')})")
def redflag_validation(spark, d):
    corpus = table(spark, d, "documents").select(F.col("lang").alias("type"))
    return _as_rows(validate.redflags(made_rows(spark, d), corpus, ["id", "source"])[1])


@query(f"WITH {_KNOWN_SQL} SELECT CAST(id AS VARCHAR) AS id, source, error FROM ({sql_violations(validate.SPAN, 'k')})")
def span_validation(spark, d):
    corpus = table(spark, d, "documents").select(F.col("lang").alias("type"))
    return _as_rows(validate.spans(made_rows(spark, d), corpus, ["id", "source"])[1])


@query(f"WITH {_KNOWN_SQL} SELECT id, source, type FROM k WHERE known")
def validated_rows(spark, d):
    corpus = table(spark, d, "documents").select(F.col("lang").alias("type"))
    return validate.redflags(made_rows(spark, d), corpus, ["id", "source"])[0].select("id", "source", "type")


@query(
    f"""WITH {MADE_SQL}, k AS (SELECT *, len(label) AS label_size, len(list_filter(coalesce(label, []), lambda x: x = 1)) AS ones, len(list_filter(coalesce(label, []), lambda x: x NOT IN (0, 1))) AS odd,
[{", ".join(f"'{x}'" for x in DEONTIC_LABELS)}][list_position(label, 1)] AS active, array_to_string(deontic_types, ',') AS types FROM made) SELECT CAST(id AS VARCHAR) AS id, source, error FROM ({sql_violations(validate.MULTILABEL, "k")})"""
)
def multilabel_validation(spark, d):
    return _as_rows(validate.multilabel(made_rows(spark, d), ["id", "source"]))


@query(f"WITH {REDFLAG_SQL} SELECT type, count(*) AS n FROM rf WHERE type IN ('riders', 'holdover') GROUP BY type")
def vocabulary_filter(spark, d):
    vocabulary = spark.createDataFrame([("riders",), ("holdover",), ("damage",)], "type string")
    return dataset.in_vocabulary(dataset.redflags(redflag_csv(spark, d)), vocabulary).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {REDFLAG_SQL} SELECT count(*) AS rows, count(DISTINCT source) AS docs, count(*) FILTER (type <> 'none') AS positive, count(*) FILTER (type = 'none') AS negative_none,
count(DISTINCT type) FILTER (type <> 'none') AS positive_types, count(DISTINCT source) FILTER (type <> 'none') AS docs_with_positive FROM rf"""
)
def redflag_report(spark, d):
    return eda.redflag_report(dataset.redflags(redflag_csv(spark, d)))


_FULL_SQL = f"""{REDFLAG_SQL}, docs AS (SELECT doc_id AS id, source, lang AS document_class, text FROM documents), red AS (SELECT "end" AS id, * FROM rf), easy AS (SELECT * FROM red WHERE type <> 'none'),
ent AS (SELECT id, source, 'lessee' AS class_id FROM sections), cl AS (SELECT id, source, id % 2 = 0 AS clause_begin, gold AS clause_type FROM sections),
last AS (SELECT list(length(coalesce(x, '')) ORDER BY length(coalesce(x, ''))) AS xs FROM (SELECT arg_max(coalesce(text, ''), id) AS x FROM docs GROUP BY source))"""


def sql_counts(t: str) -> str:
    return f"rows := (SELECT count(*) FROM {t}), docs := (SELECT count(DISTINCT source) FROM {t})"


@query(
    f"""WITH {_FULL_SQL} SELECT CAST(to_json(struct_pack(docs := struct_pack({sql_summary("docs")}, document_class := {sql_distribution("docs", "document_class")}, len_chars := (SELECT struct_pack(min := xs[1], p50 := xs[len(xs) // 2 + 1], max := xs[-1]) FROM last)),
redflags := struct_pack({sql_counts("red")}, positive := (SELECT count(*) FROM easy), negative_none := (SELECT count(*) FROM red WHERE type = 'none'), positive_types := (SELECT count(DISTINCT type) FROM easy), docs_with_positive := (SELECT count(DISTINCT source) FROM easy), type := {sql_distribution("red", "type")}),
easy_redflags := struct_pack({sql_counts("easy")}, types := (SELECT count(DISTINCT type) FROM easy), type := {sql_distribution("easy", "type")}), entities := struct_pack({sql_counts("ent")}, class_id := {sql_distribution("ent", "class_id")}),
clauses := struct_pack({sql_counts("cl")}, clause_begin_true := (SELECT count(*) FROM cl WHERE clause_begin), clause_type := {sql_distribution("cl", "clause_type")}))) AS VARCHAR) AS report"""
)
def full_corpus_report(spark, d):
    red = dataset.redflags(redflag_csv(spark, d))
    sections = O.sections(spark, d)
    entities = sections.select("id", "source", F.lit("lessee").alias("class_id"))
    clauses = sections.select("id", "source", (F.col("id") % 2 == 0).alias("clause_begin"), F.col("gold").alias("clause_type"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("document_class"), "text")
    order = {"docs": ("id",), "redflags": ("end",), "easy_redflags": ("end",), "entities": ("id",), "clauses": ("id",)}
    out = reports.full_report(docs, red, red.filter("type <> 'none'"), entities, clauses, order)
    return out.select(F.to_json(F.struct(*out.columns)).alias("report"))


@query(
    "WITH a AS (SELECT conv_id, role, turn, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) SELECT 'v' || conv_id AS doc, role AS annotator, text AS flag FROM a WHERE r = 1"
)
def annotations_merge(spark, d):
    """Two tables of annotations; where both have a key the later one counts."""
    from ..sources.records import merge_annotations

    rows = table(spark, d, "conversations").select(F.concat(F.lit("v"), "conv_id").alias("doc"), F.col("role").alias("annotator"), "turn", F.array("text").alias("risk_flags"))
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc", "annotator").orderBy(F.desc("turn"))))
    merged = merge_annotations(last.filter("r > 1").groupBy("doc", "annotator").agg(F.first("risk_flags").alias("risk_flags")), last.filter("r = 1"))
    return merged.select("doc", F.explode("flags").alias("annotator", "f")).select("doc", "annotator", F.col("f")[0].alias("flag"))


# --- features, prompts, synthesis ---------------------------------------------------------------------------------------------------


def _sql_phrases(counts: bool) -> str:
    out = []
    for g, ps in DEONTIC_PHRASES.items():
        if counts:
            out.append(f"CAST({' + '.join(f'(length(t) - length(replace(t, {quoted(p)}, {quoted("")}))) // {len(p)}' for p in ps)} AS INTEGER) AS c_{g}")
        else:
            out.append(f"CAST({' OR '.join(f'contains(t, {quoted(p)})' for p in ps)} AS INTEGER) AS b_{g}")
    return ", ".join(out)


_LOW_SQL = f"{O.SECTIONS_SQL}, low AS (SELECT id, lower(text) AS t FROM sections)"


@query(f"WITH {_LOW_SQL} SELECT id, {_sql_phrases(False)}, {_sql_phrases(True)} FROM low")
def deontic_features(spark, d):
    rows = O.sections(spark, d).select("id", features.trigger_vector(F.col("text")).alias("v"), features.trigger_counts(F.col("text")).alias("c"))
    return rows.select("id", *[F.col("v")[i].alias(f"b_{g}") for i, g in enumerate(DEONTIC_PHRASES)], *[F.col("c")[i].alias(f"c_{g}") for i, g in enumerate(DEONTIC_PHRASES)])


@query(f"""WITH {_LOW_SQL}, b AS (SELECT {_sql_phrases(False)} FROM low) {" UNION ALL ".join(f'SELECT {quoted(g)} AS "group", CAST(sum(b_{g}) AS BIGINT) AS n FROM b' for g in DEONTIC_PHRASES)}""")
def deontic_group_counts(spark, d):
    return features.group_counts(O.sections(spark, d))


PROMPT_SQL = f"""{FINDINGS_SQL}, {LEXICAL_SQL}, g AS (SELECT f.*, coalesce(l.id, f.statute) AS st, left(coalesce(l.text, ''), 900) AS gr FROM findings f LEFT JOIN lex l USING (rule_id)),
prompts AS (SELECT id, source, rule_id, 'Lease clause:' || chr(10) || left(text, 600) || CASE WHEN st <> '' THEN chr(10) || chr(10) || 'Statute reference:' || chr(10) || st ELSE '' END || CASE WHEN gr <> '' THEN chr(10) || chr(10) || gr ELSE '' END
|| chr(10) || chr(10) || 'Risk: ' || risk_level || '. ' || rationale || chr(10) || chr(10) || 'Rewrite in plain language for the tenant.' AS prompt, left(rationale, 300) AS answer FROM g)"""


def prompts_of(spark, d) -> DataFrame:
    rows = ground.ground(found(spark, d), ground.rule_table(spark), ground.lexical(RULES, O.chunk_table(spark)))
    return rows.withColumn("prompt", prompt.finding_prompt(F.col("clause_text"), F.col("rationale"), F.col("risk_level"), F.col("statute"), F.col("grounding")))


@query(f"WITH {PROMPT_SQL} SELECT id, rule_id, prompt FROM prompts")
def finding_prompt(spark, d):
    return prompts_of(spark, d).select("id", "rule_id", "prompt")


@query(f"""WITH {PROMPT_SQL} SELECT source, rule_id, 3 AS turns, {quoted(prompt.SYSTEM)} AS first, prompt AS "user", answer FROM prompts""")
def chat_pairs(spark, d):
    rows = prompts_of(spark, d).withColumn("messages", prompt.chat_pair(F.col("prompt"), F.substring("rationale", 1, 300)))
    m = F.col("messages")
    return rows.select("source", "rule_id", F.size(m).alias("turns"), m[0]["content"].alias("first"), m[1]["content"].alias("user"), m[2]["content"].alias("answer"))


def outputs_of(spark, d) -> DataFrame:
    """Made-up model outputs: valid ones, ones with an unknown type, and garbage."""
    words = F.regexp_replace(F.substring("text", 1, 40), r"[^A-Za-z ]", "")
    good = lambda t: F.concat(F.lit('{"clause_type": "' + t + '", "risk_level": "low", "statute": "s", "plain_explanation": "'), words, F.lit('x", "tenant_impact": "none"}'))
    raw = F.when(F.col("conv_id") % 3 == 0, good("rent")).when(F.col("conv_id") % 3 == 1, good("other")).otherwise(F.concat(F.lit("no json "), words))
    return table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))


_WORDS_SQL = "regexp_replace(substring(text, 1, 40), '[^A-Za-z ]', '', 'g')"


@query(
    f"SELECT conv_id, turn, conv_id % 3 < 2 AS parse_ok, CASE WHEN conv_id % 3 < 2 THEN {_WORDS_SQL} || 'x' ELSE left('no json ' || {_WORDS_SQL}, 500) END AS plain_explanation, CASE WHEN conv_id % 3 < 2 THEN 'none' ELSE '' END AS tenant_impact, conv_id % 3 = 0 AS obeys FROM conversations"
)
def slm_parse(spark, d):
    rows = outputs_of(spark, d).select("conv_id", "turn", prompt.parse(F.col("raw")).alias("p"), prompt.obeys_grammar(F.col("raw")).alias("obeys"))
    return rows.select("conv_id", "turn", "p.parse_ok", "p.plain_explanation", "p.tenant_impact", "obeys")


@query("SELECT count(*) AS n, round(count(*) FILTER (conv_id % 3 < 2) / count(*)::DOUBLE, 4) AS parse_rate, round(count(*) FILTER (conv_id % 3 = 0) / count(*)::DOUBLE, 4) AS valid_type_rate FROM conversations")
def output_rates(spark, d):
    return prompt.output_rates(outputs_of(spark, d))


def echo(prompts: list[str]) -> list[str]:
    """A stand-in for a text generator."""
    import json

    return [json.dumps({"clause_type": "rent", "risk_level": "low", "statute": "s", "plain_explanation": p[14:40], "tenant_impact": "none"}) for p in prompts]


@query(f"WITH {PROMPT_SQL} SELECT id, rule_id, substring(prompt, 15, 26) AS plain_explanation, true AS parse_ok FROM prompts")
def simplified_findings(spark, d):
    rows = ground.ground(found(spark, d), ground.rule_table(spark), ground.lexical(RULES, O.chunk_table(spark)))
    return prompt.simplify(rows, echo).select("id", "rule_id", "plain_explanation", "parse_ok")


@query(
    f"""WITH {PROMPT_SQL}, r AS (SELECT id, rule_id, prompt, row_number() OVER (ORDER BY md5(id || '|' || rule_id || '|42'), id, rule_id) AS r, count(*) OVER () AS n FROM prompts),
c AS (SELECT id, rule_id, prompt, unnest(CASE WHEN r <= n // 2 THEN [0, 1, 2] ELSE [0, 1] END) AS copy FROM r)
SELECT id, rule_id, copy, CASE WHEN copy = 0 THEN prompt ELSE array_to_string(list_transform(list_sort(list_transform(string_split(prompt, chr(10) || chr(10)), lambda p: struct_pack(h := md5(p || '|' || copy), p := p))), lambda x: x.p), chr(10) || chr(10)) END AS prompt FROM c"""
)
def augmented_pairs(spark, d):
    """Prompts are written once, as ranks need them twice."""
    path = scratch(spark, "prompts")
    prompts_of(spark, d).select("id", "rule_id", "prompt").write.parquet(path)
    return prompt.augmented(spark.read.parquet(path), ["id", "rule_id"])


@query(
    "SELECT * FROM (VALUES "
    + ", ".join([f"('deontic', '{k}', {synth.PER_LABEL}::BIGINT)" for k in DEONTIC_LABELS] + [f"('redflag', '{k}', {synth.MANY.get(k, synth.USUAL)}::BIGINT)" for k in (*synth.REDFLAG_TYPES, "none")])
    + ", "
    + ", ".join(f"('span', '{k}', {synth.RARE_SPANS if k in synth.MANY else synth.USUAL_SPANS}::BIGINT)" for k in synth.REDFLAG_TYPES)
    + ") t(corpus, kind, n)"
)
def synthetic_corpus(spark, d):
    a = synth.deontic_rows(spark).select(F.lit("deontic").alias("corpus"), F.col("deontic_types")[0].alias("kind"))
    rows = a.unionByName(synth.redflag_rows(spark).select(F.lit("redflag").alias("corpus"), F.col("type").alias("kind"))).unionByName(synth.span_rows(spark).select(F.lit("span").alias("corpus"), F.col("type").alias("kind")))
    return rows.groupBy("corpus", "kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def synthetic_rows(spark, d):
    return synth.deontic_rows(spark).select("source", "party", "text")


# --- sources ------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, d):
    """JSON lines written and read with a schema."""
    rows, path = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), scratch(spark, "jsonl")
    records.write_jsonl(rows, path)
    return records.read_jsonl(spark, path, rows._jdf.schema().toDDL())


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations")
def csv_read(spark, d):
    """A CSV with quoted, multi-line fields; every column is a string."""
    rows, path = table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), scratch(spark, "csv")
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return records.read_csv(spark, path, rows.columns)


@query("SELECT item_id, 0 AS page_idx, text || chr(10) AS text, CASE WHEN trim(text) = '' THEN 'error' ELSE 'raw' END AS method FROM benchmark")
def text_files(spark, d):
    """Every benchmark item as a text file of its own, read as documents."""
    path = scratch(spark, "files")
    table(spark, d, "benchmark").select(F.col("item_id").alias("file"), "text").write.partitionBy("file").text(path)
    pages, _ = files.read_documents(spark, path)
    return pages.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("item_id"), "page_idx", "text", "method")


@query(ORACLE_SQL["vector_normalize"])
def embedding_index(spark, d):
    """Unit vectors saved as an index with its metadata, and loaded again."""
    path = scratch(spark, "vectors")
    records.save_embeddings(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), ground.unit(F.col("embedding")).alias("embedding")), path, "given", 64)
    rows = records.load_embeddings(spark, path, "given", 64)
    return rows.select(F.col("id").alias("vec_id"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.col("embedding")[0], 6).alias("first"))


@query(f"WITH {HEAD_SQL} SELECT class_idx, 'c' || class_idx AS class, round(list_sum(w), 1) AS total, 0.15 AS threshold, 0.02 AS margin FROM head")
def saved_head(spark, d):
    path = scratch(spark, "head")
    records.save_head(head_of(spark, d), path, 0.15, 0.02)
    head, threshold, margin = records.load_head(spark, path)
    total = F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x), 1)
    return head.select("class_idx", "class", total.alias("total"), F.lit(threshold).alias("threshold"), F.lit(margin).alias("margin"))


def written_files(spark, d) -> str:
    """A folder with every document as a word-processing file (even ids) or a text file (odd ones), written by the tasks."""
    path = scratch(spark, "documents")
    folder = document_source.local(path)

    def write(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                even = i % 2 == 0
                with open(f"{folder}/{i}.{'docx' if even else 'TXT'}", "wb") as f:
                    f.write(files.docx_bytes((t or "").split("\n")) if even else (t or "").encode())
            yield b[["doc_id"]]

    table(spark, d, "documents").select("doc_id", "text").mapInPandas(write, "doc_id long").write.format("noop").mode("overwrite").save()
    return path


_LINES = "array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"


@query(
    f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_LINES} ELSE coalesce(text, '') END AS text, CASE WHEN doc_id % 2 = 0 THEN 'paragraphs' ELSE 'raw' END AS method FROM documents)
SELECT doc_id, 0 AS page_idx, CASE WHEN trim(text) = '' THEN '' ELSE text END AS text, CASE WHEN trim(text) = '' THEN 'error' ELSE method END AS method FROM r"""
)
def document_files(spark, d):
    """Every document written as a file and read by the data source."""
    spark.dataSource.register(document_source.DocumentSource)
    pages = spark.read.format("clause_documents").option("partition_bytes", 32 << 20).option("open_bytes", 64 << 10).load(written_files(spark, d))
    return pages.select(F.regexp_extract("source", "^([0-9]+)", 1).cast("long").alias("doc_id"), "page_idx", "text", "method")


@query(ORACLE_SQL["document_files"])
def binary_documents(spark, d):
    """The same files through Spark's reader of whole files."""
    pages, _ = files.read_documents(spark, written_files(spark, d))
    return pages.select(F.regexp_extract("source", "^([0-9]+)", 1).cast("long").alias("doc_id"), "page_idx", "text", "method")


@query(
    f"""WITH {UNITS_SQL}, m AS (SELECT source, sum(length(text))::BIGINT AS chars, count(*) AS k FROM documents GROUP BY source)
SELECT 'documents' AS part, source AS id, chars AS n, '' AS sources FROM m UNION ALL SELECT p, id, n_occurrences, sources FROM units, (VALUES ('sections'), ('sentences')) v(p)"""
)
def saved_index(spark, d):
    """All three tables of an index, written and loaded again."""
    docs, path = table(spark, d, "documents"), scratch(spark, "index")
    manifest = docs.groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n_sections"))
    u = units_of(spark, d).select("id", "text", "n_occurrences", "sources")
    records.save_index(manifest, u, u, path)
    documents, sections, sentences = records.load_index(spark, path)
    rows = documents.select(F.lit("documents").alias("part"), F.col("source").alias("id"), F.col("chars").alias("n"), F.lit("").alias("sources"))
    for name, part in (("sections", sections), ("sentences", sentences)):
        rows = rows.unionByName(part.select(F.lit(name).alias("part"), "id", F.col("n_occurrences").alias("n"), F.array_join("sources", ",").alias("sources")))
    return rows


@query("SELECT 'run' || source AS dir FROM (SELECT DISTINCT source FROM documents) WHERE right(source, 1) IN ('1', '2', '3')")
def complete_folders(spark, d):
    """Of a folder per source, those that hold all three files of a run; the others lack one."""
    path = scratch(spark, "runs")
    root = document_source.local(path)

    def write(batches):
        import os

        for b in batches:
            for s in b["source"]:
                os.makedirs(f"{root}/run{s}", exist_ok=True)
                for n in records.COMPLETE[: 3 if s[-1] in "123" else 2]:
                    with open(f"{root}/run{s}/{n}", "w") as f:
                        f.write("{}")
            yield b

    table(spark, d, "documents").select("source").distinct().mapInPandas(write, "source string").write.format("noop").mode("overwrite").save()
    return records.complete_outputs(spark, path).select(F.regexp_extract("dir", "([^/]+)$", 1).alias("dir"))


@query(ORACLE_SQL["unit_dedup"])
def saved_units(spark, d):
    """The index of first-seen units written as JSON lines and loaded again."""
    units, path = units_of(spark, d).select("id", "text", "n_occurrences", "sources"), scratch(spark, "units")
    records.write_jsonl(units, path)
    rows = records.load_units(spark, path)
    return rows.select("id", F.length("text").cast("long").alias("n_chars"), "n_occurrences", F.array_join("sources", ",").alias("sources"))


@query(
    f"""WITH {FINDINGS_SQL}, {LEXICAL_SQL}, rules(rule_ord, rule_id) AS (VALUES {", ".join(f"({i}, '{r.rule_id}')" for i, r in enumerate(RULES))}),
u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-9)) AS u FROM embeddings),
s AS (SELECT r.rule_id, v.vec_id, round(list_sum(list_transform(list_zip(q.u, v.u), lambda p: p[1] * p[2])), 4) AS score FROM rules r JOIN u q ON q.vec_id = r.rule_ord JOIN u v ON v.vec_id >= {len(RULES)}),
near AS (SELECT rule_id, 'chunk-' || arg_min(vec_id, (-score, vec_id)) AS id FROM s GROUP BY rule_id)
SELECT f.id, f.rule_id, coalesce(l.id, n.id, f.statute) AS statute, f.statute AS statute_citation, left(coalesce(l.text, 'text of ' || n.id, ''), 900) AS grounding FROM findings f LEFT JOIN lex l USING (rule_id) LEFT JOIN near n USING (rule_id)"""
)
def vector_grounding(spark, d):
    """Rules without a lexical hit take the chunk whose vector is nearest to theirs: the embeddings with the rules' numbers ask, the others
    are chunks."""
    rows, rules = table(spark, d, "embeddings").select("vec_id", "embedding"), ground.rule_table(spark)
    asked = rows.join(F.broadcast(rules.select("rule_id", "rule_ord")), F.col("vec_id") == F.col("rule_ord"))
    best = ground.top_k(asked.select("vec_id", "embedding"), rows.filter(F.col("vec_id") >= len(RULES)), 1, "vec_id", "embedding")
    name = F.concat(F.lit("chunk-"), F.col("id"))
    by_vectors = best.join(F.broadcast(rules.select("rule_id", "rule_ord")), F.col("query_id") == F.col("rule_ord")).select("rule_id", name.alias("id"), F.concat(F.lit("text of "), name).alias("text"))
    out = ground.ground(found(spark, d), rules, ground.lexical(RULES, O.chunk_table(spark)), by_vectors)
    return out.select("id", "rule_id", "statute", "statute_citation", "grounding")
