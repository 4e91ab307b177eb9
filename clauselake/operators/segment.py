"""Segmentation of document text into paragraphs and sentences. Each text is handled within its row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, java, strip

# Clause starts, headings, abbreviations and sentences.
CLAUSE_START = r"^\s*(?:\(?\d+(?:\.\d+)*\)?\.?|[A-Z]\d+-\d+|\([a-z]\))\s*[^\n]{2,}"
HEADING = r"^[A-Z][A-Za-z0-9 ,&'()\-]{1,47}$"
ABBREVIATIONS = r"\b(Mr|Mrs|Ms|Dr|Prof|No|Art|Sec|Sect|Cl|Clause|Inc|Ltd|Corp|Co|e\.g|i\.e|et al|vs|Fig|St|Ave|Rd|#)\."
SENTENCE = r"""[^.!?]+(?:[.!?]['")\] ]*)?(?=\s|$|\z)"""
LINE_ENDS = "[\n\x0b\x0c\x1c\x1d\x1e\x85  ]"
_CUT, _END = "﷐", "﷑"  # noncharacters
#: Without a look ahead: a terminator within a token, what follows the last of these, and a terminator that ends a token.
CLOSERS = """['")\\]]"""
WITHIN = rf"""[.!?]{CLOSERS}*[^'")\]]"""
AFTER_LAST = rf"""^.*[.!?]({CLOSERS}*[^'")\]].*)$"""
AT_END = rf"[.!?]{CLOSERS}*$"
CLOSED = rf"((?: {CLOSERS}+)*)(?: |$)"


def is_clause_start(line: Column) -> Column:
    return line.rlike(java(CLAUSE_START))


def is_heading(line: Column) -> Column:
    s = strip(line)
    return F.length(s).between(3, 48) & ~s.rlike("[.!?:;,]$") & s.rlike(HEADING)


def paragraphs(text: Column) -> Column:
    """Array of paragraphs: blank lines split, and within a block numbered clauses and headings do from its second line on."""
    lf = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    marked = lambda line, i: F.when((i > 0) & (is_clause_start(line) | is_heading(line)), F.concat(F.lit(_CUT), line)).otherwise(F.concat(F.lit("\n"), line))
    chunks = lambda block: F.split(F.array_join(F.transform(F.split(strip(block), LINE_ENDS), marked), ""), _CUT)
    return F.filter(F.transform(F.flatten(F.transform(F.split(lf, "\n\n"), chunks)), collapse), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Array of sentences; periods of known abbreviations do not end one. Text before a terminator inside a token is dropped.

    Boundaries are marked token by token, then the text is split at the marks: a token that ends in a terminator and closing marks ends a sentence,
    with the tokens of closing marks alone that follow; of a token with a terminator inside, what comes after the last one begins a
    sentence. A terminator right after such a cut, or at the text's start, is dropped, as no sentence is left for it to end."""
    shielded = F.regexp_replace(collapse(F.coalesce(text, F.lit(""))), java(ABBREVIATIONS), "$1\x00")
    shielded = F.regexp_replace(shielded, r"\be\.g\x00", "e\x00g\x00")
    shielded = F.regexp_replace(shielded, r"\bi\.e\x00", "i\x00e\x00")
    bare = lambda t: F.regexp_replace(t, "^[.!?]", "")

    def begun(t: Column, i: Column) -> Column:
        return F.when(t.rlike(WITHIN), F.concat(F.lit(_CUT), bare(F.regexp_replace(t, AFTER_LAST, "$1")))).when(i == 0, bare(t)).otherwise(t)

    ended = lambda t: F.when(t.rlike(AT_END), F.concat(t, F.lit(_END))).otherwise(t)
    marked = F.array_join(F.transform(F.transform(F.split(shielded, " "), begun), ended), " ")
    parts = F.split(F.regexp_replace(marked, _END + CLOSED, "$1" + _CUT), _CUT)
    return F.filter(F.transform(parts, lambda s: F.replace(strip(s), F.lit("\x00"), F.lit("."))), lambda s: s != "")


def split_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_idx, text)."""
    return docs.select(key, F.posexplode(paragraphs(F.col(text))).alias("section_idx", "text"))


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_idx, text)."""
    return docs.select(key, F.posexplode(sentences(F.col(text))).alias("sentence_idx", "text"))


def _per_page(pages: DataFrame, parts: Column, index: str, value: str) -> DataFrame:
    rows = pages.select("source", "page_idx", F.posexplode(parts).alias("pos", value))
    return rows.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("page_idx", "pos")) - 1).alias(index), value)


def section_rows(pages: DataFrame) -> DataFrame:
    """Pages (source, page_idx, text) to section rows in document order."""
    rows = _per_page(pages, paragraphs(F.col("text")), "section_idx", "raw_text")
    return rows.select("source", "section_idx", F.lit("").alias("text"), "raw_text", F.lit("").alias("type"), F.lit(0).alias("start"), F.lit(0).alias("end"))


def sentence_rows(pages: DataFrame) -> DataFrame:
    """Pages to sentence rows; the index runs over a document's pages."""
    return _per_page(pages, sentences(F.col("text")), "sentence_idx", "text").select("source", "sentence_idx", F.lit("").alias("party"), "text")
