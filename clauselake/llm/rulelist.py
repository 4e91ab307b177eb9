"""Quality rules: a learned decision list over statistics of whole texts. DataFrame functions only.

Sequential covering in the manner of RIPPER: labelled rows are split by a hash into a part to grow on and a part to prune on. A rule is a
conjunction of thresholds (statistic at most, or above, a cut); it grows by the condition of the largest FOIL gain until it covers no clean row,
loses trailing conditions where that lifts (p - n) / (p + n) on the part to prune on, and joins the list if its share of rejected rows that are
junk there is at least PRECISION. Rows that it covers leave both parts, and the next rule is grown on the rest. The list is emitted as one
ordered conditional expression (`verdict`), so texts are judged in place.

Cuts are quantiles of each class and the middles between them (under 4 * CUTS a statistic); of cuts that serve alike the middle one is taken. Growing and pruning read counts per statistic and bin, made by Spark from a staged
table of the labelled rows' bins: what comes to the driver is bounded by statistics times cuts, whatever the input; every labelled row
counts. Texts are read once: statistics are staged, learned from, and then judged.

Words are maximal runs of other characters than \\x20 and \\x09-\\x0D. Edge cases: null and empty texts have no words and fail the base; repeated
rows are judged each; labels that are null, of a null id, or that disagree on an id are not used; without labels of both classes
there are no rules and the base decides alone; an empty table gives no rows; other columns are ignored, whatever their names. A row's words
are held at once, as arrays: a text of some 100 MB needs an executor of several GB.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Quantiles of a class that serve as cuts; rules in a list; conditions in a rule; least share of junk among what a rule rejects.
CUTS, RULES, CONDITIONS, PRECISION = 32, 12, 4, 0.9
#: A rule covers at least this share of the junk it is grown on, and at least LEAST rows.
SHARE, LEAST = 0.005, 3
MIN_WORDS, REPEAT_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _left(text: Column, pattern: str) -> Column:
    """Characters that are left without the pattern's matches."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def windows(words: Column) -> Column:
    """All three-word windows."""
    n = F.size(words)
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2]))


def _covered(sorted_windows: Column) -> Column:
    """Places covered by windows that equal a neighbour in an array of (window, place) sorted by both."""
    s, n = sorted_windows, F.size(sorted_windows)
    same = lambda i, j: F.get(s, i)["w"].eqNullSafe(F.get(s, j)["w"])
    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: same(i, i - 1) | same(i, i + 1))
    places = F.sort_array(F.transform(hits, lambda i: s[i]["at"]))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda acc: acc["n"])


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, COUNTS, chars, capitals, digits, marks, lines, distinct_words) per row of docs, all but doc_id long."""
    t, w = F.col("t"), F.col("w")
    white = r"[\x20\x09-\x0D]"
    df = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    df = df.select("doc_id", "t", F.filter(F.split(t, white + "+"), lambda x: x != "").alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(C.WORD)).alias("l"))
    df = df.select("*", windows(w).alias("v"))
    v = F.col("v")
    again = F.size(F.array_distinct(v)) < F.size(v)
    placed = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("w"), i.alias("at"))))
    df = df.select("*", F.when(again, placed).alias("s"))
    counts = {
        "n_words": F.size("w"), "word_chars": _left(t, white + "+"), "n_symbols": _left(t, "[^#*$%&|<>]+"), "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_repeat_words": F.when(F.col("s").isNull(), 0).otherwise(_covered(F.col("s"))), "chars": F.length(t), "capitals": _left(t, r"\P{Lu}+"), "digits": _left(t, r"\P{Nd}+"),
        "marks": _left(t, r"[\p{L}\p{M}\p{N}\s]+"), "lines": F.size("l"), "distinct_words": F.size(F.array_distinct("w")),
    }
    return df.select("doc_id", *[c.cast("long").alias(k) for k, c in counts.items()])


def _per(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """What conditions are about, over the columns of statistics()."""
    per = {
        "word_length": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "repeated_lines": ("n_dup_lines", "lines"), "repeated_words": ("n_repeat_words", "n_words"),
        "capitals": ("capitals", "word_chars"), "digits": ("digits", "word_chars"), "marks": ("marks", "word_chars"), "distinct_words": ("distinct_words", "n_words"), "words_per_line": ("n_words", "lines"),
    }
    return {"words": F.col("n_words").cast("double")} | {k: _per(*v) for k, v in per.items()}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: Column) -> Column:
        return x > self.cut if self.above else x <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _both(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


class Learner:
    """Grows and prunes over a staged table (junk, grow, f): f holds a double per feature in the order of names; cuts are per feature, sorted."""

    def __init__(self, rows: DataFrame, names: list[str], cuts: dict[str, list[float]]):
        self.rows, self.names, self.cuts = rows, names, cuts
        binned = F.array(*[self._bin(F.col("f")[i], cuts[n]) for i, n in enumerate(names)])
        self.binned = C.stage(rows.select("junk", "grow", binned.alias("b")).groupBy("junk", "grow", "b").agg(F.count(F.lit(1)).alias("n")), "rules")

    @staticmethod
    def _bin(x: Column, cuts: list[float]) -> Column:
        """How many of the cuts lie below x."""
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < x)) if cuts else F.lit(0)

    def _holds(self, c: Condition) -> Column:
        at = self.cuts[c.feature].index(c.cut)  # bin k: above the first k cuts
        b = F.col("b")[self.names.index(c.feature)]
        return b > at if c.above else b <= at

    def _in(self, rule: Rule) -> Column:
        return _both([self._holds(c) for c in rule])

    def _rest(self, found: list[Rule]) -> DataFrame:
        return self.binned.filter(_both([~self._in(r) for r in found]))

    def _gains(self, rest: DataFrame, rule: Rule) -> tuple[list[tuple[float, Condition, int, int]], int, int]:
        """FOIL gains of all conditions for a rule so far, from one count per feature and bin."""
        at = rest.filter(F.col("grow") & self._in(rule)).select("junk", "n", F.posexplode("b").alias("feature", "bin"))
        counts = at.groupBy("feature", "bin").agg(F.sum(F.when(F.col("junk"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("junk"), 0).otherwise(F.col("n"))).alias("q")).collect()
        bins = {(r["feature"], r["bin"]): (r["p"], r["q"]) for r in counts}
        p0, q0 = (sum(v[k] for (f, _), v in bins.items() if f == 0) for k in (0, 1))
        out = []
        for i, name in enumerate(self.names):
            p = q = 0
            for k, cut in enumerate(self.cuts[name]):
                dp, dq = bins.get((i, k), (0, 0))
                p, q = p + dp, q + dq
                for above, a, b in ((False, p, q), (True, p0 - p, q0 - q)):
                    if a and (a, b) != (p0, q0):
                        out.append((a * (log2(a / (a + b)) - log2(p0 / (p0 + q0))), Condition(name, above, cut), a, b))
        return out, p0, q0

    def grown(self, rest: DataFrame, least: float) -> Rule:
        rule: Rule = ()
        while len(rule) < CONDITIONS:
            gains, p, q = self._gains(rest, rule)
            usable = [g for g in gains if g[0] > 1e-9 and g[2] >= least]
            if not q or not usable:
                break
            best = max(g[0] for g in usable)
            ties = [g[1] for g in usable if g[0] == best]
            alike = [c for c in ties if (c.feature, c.above) == (ties[0].feature, ties[0].above)]
            rule = (*rule, alike[len(alike) // 2])  # of cuts that serve alike, the middle one: furthest from both classes
        return rule

    def pruned(self, rest: DataFrame, rule: Rule) -> tuple[Rule, float]:
        """The best prefix on the part to prune on, and its precision there."""
        sums = [F.sum(F.when(self._in(rule[:k]) & (F.col("junk") == y), F.col("n")).otherwise(0)).alias(f"x{k}_{int(y)}") for k in range(1, len(rule) + 1) for y in (False, True)]
        got = rest.filter(~F.col("grow")).agg(*sums).first()
        of = [(got[f"x{k}_1"] or 0, got[f"x{k}_0"] or 0) for k in range(1, len(rule) + 1)]
        worth = [(p - q) / (p + q) if p + q else -1.0 for p, q in of]
        k = max(range(len(worth)), key=lambda i: (worth[i], -i))
        p, q = of[k]
        return rule[: k + 1], p / (p + q) if p + q else 0.0

    def rules(self) -> list[Rule]:
        found: list[Rule] = []
        junk = self.binned.filter(F.col("grow") & F.col("junk")).agg(F.sum("n")).first()[0] or 0
        least = max(LEAST, SHARE * junk)
        while len(found) < RULES:
            rest = self._rest(found)
            rule = self.grown(rest, least)
            if not rule:
                break
            rule, precision = self.pruned(rest, rule)
            if precision < PRECISION or rule in found:
                break
            found.append(rule)
        return found


def learned(stats: DataFrame, labels: DataFrame, label: str = "quality") -> list[Rule]:
    """An ordered list of rules that reject, from rows of stats that pass the base and labels 0 (junk) and 1."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z")
    names = list(features())
    rows = stats.filter(~base_failed()).join(known, F.col("doc_id") == F.col("id"))
    rows = C.stage(rows.select((F.col("y") == 0).alias("junk"), (F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(3)) > 0).alias("grow"), F.array(*features().values()).alias("f")), "labelled")
    shares = [F.lit((k + 0.5) / CUTS) for k in range(CUTS)]
    of = rows.groupBy("junk").agg(*[F.percentile_approx(F.col("f")[i], F.array(*shares), F.lit(10_000)).alias(n) for i, n in enumerate(names)]).collect()
    if len(of) < 2:
        C.release(rows)
        return []
    found = {n: sorted({x for r in of for x in r[n]}) for n in names}
    cuts = {n: sorted({*x, *((a + b) / 2 for a, b in zip(x, x[1:], strict=False))}) for n, x in found.items()}
    learner = Learner(rows, names, cuts)
    found = learner.rules()
    C.release(rows, learner.binned)
    return found


def verdict(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that rejects a row of statistics(); null where none does."""
    if not rules:
        return F.lit(None).cast("int")
    out = F
    for k, rule in enumerate(rules):
        out = out.when(_both([c.holds(features()[c.feature]) for c in rule]), F.lit(k + 1))
    return out


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept, rule): rule tells in words which rule rejects what passes the base."""
    stats = C.stage(statistics(docs, doc_id, text), "statistics")
    rules = learned(stats, labels)
    named = F.array(*[F.lit(" and ".join(map(str, r))) for r in rules]) if rules else F.array().cast("array<string>")
    out = stats.withColumn("base_failed", base_failed()).withColumn("by", F.when(~F.col("base_failed"), verdict(rules)))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("by").isNull()).alias("kept"), F.get(named, F.col("by") - 1).alias("rule"))


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
