"""Personal data: patterns propose spans, checksums confirm them, context words move their score. DataFrame functions only.

Base kinds are email, ip (parts at most 255), card (16 to 19 digits, Luhn) and phone (8 to 15 digits); a match that fails its
check is dropped and not retried. Beside these the operator proposes IBANs (mod 97), short cards (13 to 15 digits, Luhn),
social-security-like numbers and national phone numbers. A score starts from the kind, gains what its validator adds,
and is moved by words within WINDOW characters before the span; base spans always stay, others from THRESHOLD up.

The patterns carry look-behinds and possessive quantifiers that do not change what matches: a run of name characters is
entered only at its start or where the last match ended, so long runs cost linear time.

A span is (kind, start, end, score) with code point offsets, end exclusive, ordered by kind as in KINDS, then start. Edge
cases: null and empty texts have no spans; kinds may overlap; repeated rows are kept; extra columns are ignored by spans()
and kept by redact(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "short_card": r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9A-Za-z.-])",
    "ssn": r"(?<![0-9A-Za-z.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
}
KINDS = (*BASE, *MORE)
#: score of a bare match, what a passed validator adds, words that raise it
SCORES = {
    "email": (0.9, 0.0, "mail|e-mail|contact|write"),
    "ip": (0.6, 0.2, "ip|address|host|server"),
    "card": (0.3, 0.5, "card|visa|credit|payment|karte|carte|tarjeta"),
    "phone": (0.7, 0.1, "phone|tel|call|fax|mobile"),
    "iban": (0.2, 0.6, "iban|account|bank|konto|compte|cuenta"),
    "short_card": (0.1, 0.3, "card|visa|amex|credit|payment|karte|carte|tarjeta"),
    "ssn": (0.3, 0.0, "ssn|social|security|taxpayer"),
    "local_phone": (0.3, 0.0, "phone|tel|call|fax|mobile|contact"),
}
RAISE, LOWER, THRESHOLD, WINDOW = 0.3, 0.3, 0.6, 40
AGAINST = "order|invoice|version|isbn|serial|part no|sku|tracking"
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(x)

    def weighed(i: Column) -> Column:
        d = F.substring(x, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + weighed(i)) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97 (ISO 13616)."""
    moved = F.concat(F.substring(x, F.lit(5), F.length(x) - 4), F.substring(x, 1, 4))

    def step(r: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, r * 10 + v).otherwise(r * 100 + v) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> tuple[Column, Column]:
    """Whether the match stays, and whether a validator vouches for it."""
    true, n = F.lit(True), F.length(digits(m))
    if kind == "ip":
        ok = F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
        return ok, true
    if kind == "card":
        ok = F.when(n.between(16, 19), luhn(digits(m))).otherwise(False)
        return ok, true
    if kind == "phone":
        return n.between(8, 15), true
    if kind == "iban":
        bare = F.regexp_replace(m, " ", "")
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False), true
    if kind == "short_card":
        return luhn(digits(m)), true
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)|-00-|-0000$"), true
    return true, true


def _may(text: Column, kind: str) -> Column:
    """A cheap test that every text with a match passes."""
    return {
        "email": F.contains(text, F.lit("@")),
        "phone": F.contains(text, F.lit("+")),
        "iban": text.rlike("[A-Z]{2}[0-9]{2}"),
        "ssn": text.rlike("[0-9]-[0-9]{2}-[0-9]"),
        "short_card": text.rlike("[0-9](?:[\\x20-]?[0-9]){12}"),
        "local_phone": text.rlike("[0-9][.-][0-9]{4}"),
    }.get(kind, text.rlike("[0-9]"))


def with_spans(docs: DataFrame, text: str, out: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """docs plus column `out`: all spans of the text. Names that begin with __pii are the operator's own."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    patterns = BASE | MORE
    none = F.array().cast("array<string>")
    df = docs.withColumn("__pii_t", t)
    t = F.col("__pii_t")
    for k in kinds:  # what stands between the matches gives their offsets
        df = df.withColumn(f"__pii_m_{k}", F.when(_may(t, k), F.regexp_extract_all(t, F.lit(patterns[k]), F.lit(0))).otherwise(none))
    for k in kinds:
        m = F.col(f"__pii_m_{k}")
        df = df.withColumn(f"__pii_g_{k}", F.when(F.size(m) > 0, F.split(t, patterns[k], -1)).otherwise(none))
    for k in kinds:
        m, g = F.col(f"__pii_m_{k}"), F.col(f"__pii_g_{k}")
        length = F.zip_with(m, F.slice(g, 1, F.size(m)), lambda a, b: (F.length(a) + F.length(b)).cast("long"))
        df = df.withColumn(f"__pii_e_{k}", F.when(F.size(m) > 0, C.running_sum(length)).otherwise(F.array().cast("array<bigint>")))
    lists = []
    for k in kinds:
        lists.append(_spans_of(k, t))
    own = ["__pii_t", *[f"__pii_{x}_{k}" for x in "mge" for k in kinds]]
    return df.withColumn(out, F.concat(*lists)).drop(*own)


def _spans_of(k: str, t: Column) -> Column:
    score, gain, words = SCORES[k]

    def span(m: Column, e: Column) -> Column:
        start = e - F.length(m)
        near = F.lower(F.substring(t, F.greatest(start - WINDOW + 1, F.lit(1)).cast("int"), F.least(start, F.lit(WINDOW)).cast("int")))
        ok, sure = _confirmed(k, m)
        moved = F.when(near.rlike(rf"\b(?:{words})\b"), RAISE).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{AGAINST})\b"), LOWER).otherwise(0.0)
        s = F.lit(score) + F.when(sure, gain).otherwise(0.0) + moved
        s = F.round(F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0)), 3)
        return F.when(ok, F.struct(F.lit(k).alias("kind"), start.alias("start"), e.alias("end"), s.alias("score")))

    found = F.filter(F.zip_with(F.col(f"__pii_m_{k}"), F.col(f"__pii_e_{k}"), span), lambda x: x.isNotNull() & (F.lit(k in BASE) | (x["score"] >= THRESHOLD)))
    return F.when(F.size(f"__pii_m_{k}") > 0, found).otherwise(F.array().cast(SPAN))


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) for every row of docs."""
    return with_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "spans").select("doc_id", "spans")


def written(xs: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by [kind]; overlapping spans become one, named for the first. Null texts stay null."""
    df = with_spans(docs, text, "__pii_all")
    t = F.col(f"`{text}`")
    ordered = F.sort_array(F.transform("__pii_all", lambda x: F.struct(x["start"], x["end"], x["kind"])))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")

    def put(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > x["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(x)))

    df = df.withColumn("__pii_merged", F.when(F.size("__pii_all") > 0, F.aggregate(ordered, empty, put)).otherwise(empty))
    merged = F.col("__pii_merged")
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(merged, lambda x: x["end"]))
    pieces = F.zip_with(
        begins,
        merged,
        lambda b, x: F.when(x.isNull(), F.substring(t, (b + 1).cast("int"), F.lit(2147483647))).otherwise(
            F.concat(F.substring(t, (b + 1).cast("int"), (x["start"] - b).cast("int")), F.lit("["), x["kind"], F.lit("]"))
        ),
    )
    changed = F.when(F.size(merged) > 0, F.array_join(pieces, "")).otherwise(t)
    return df.withColumn("__pii_text", changed).select(*[(F.col("__pii_text").alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns])


def op2_pii_spans(spark, sf_dir: str) -> DataFrame:
    found = spans(C.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.sha2(written(F.filter("spans", lambda x: x["kind"].isin(*BASE))), 256)
    return found.select("doc_id", *[count(k) for k in BASE], base.alias("base_sha256"), written(F.col("spans")).alias("spans"))
