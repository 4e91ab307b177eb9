"""Training plans on Spark ML over sparse vectors: TF-IDF stacked with phrase and party features, weighted heads, one model per label,
thresholds, and export of a linear head.

A row's features are one sparse vector from the tokens on; nothing is as wide as the vocabulary but the model itself. The vocabulary and its
document frequencies (at most `features` of each) are all that comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled
from ..operators.encode import RECORDS
from ..operators.features import downsample, is_tenant, trigger_vector
from ..operators.metrics import calibrate
from ..sources.scratch import scratch

FEATURES, MAX_ITER, TOL = 20_000, 1000, 1e-5


def feature_text(rows: DataFrame) -> Column:
    """raw_text where it is filled, else text, else ''."""
    return first_filled(*[F.col(c) for c in ("raw_text", "text") if c in rows.columns])


def train_rows(base: DataFrame, mixed: DataFrame | None = None) -> DataFrame:
    """Rows to train on: the base ones and, plainly after them, those mixed in; a column that one side lacks is null there."""
    return base if mixed is None else base.unionByName(mixed, allowMissingColumns=True)


def _sublinear(vectors: DataFrame, counts: str, out: str) -> DataFrame:
    """vectors plus column `out`: 1 + ln(count) of what sparse vectors hold, over an Arrow batch's values at once."""

    def run(v: pa.Array) -> pa.Array:
        v = v.storage if isinstance(v, pa.ExtensionArray) else v
        values = v.field("values")
        logs = pa.ListArray.from_arrays(values.offsets, pa.array(1 + np.log(values.values.to_numpy(zero_copy_only=False))))
        return pa.StructArray.from_arrays([logs if f.name == "values" else v.field(f.name) for f in v.type], names=[f.name for f in v.type])

    return vectors.withColumn(out, F.arrow_udf(run, VectorUDT())(counts))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n, df) of each batch of term lists: occurrences, and lists that hold the term."""
    for b in batches:
        lists = b.column(0)
        coded = lists.flatten().dictionary_encode()
        codes, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        at = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        n = np.bincount(codes, minlength=terms)
        df = np.bincount(np.unique(at * max(terms, 1) + codes) % max(terms, 1), minlength=terms)
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n, pa.int64()), pa.array(df, pa.int64())], names=["term", "n", "df"])


@dataclass
class Tfidf:
    """Sublinear tf times ln((1 + n) / (1 + df)) + 1 over 1- to n-grams of words of two characters or more, in lower case, of unit length."""

    vocabulary: list[str]
    weights: np.ndarray
    ngrams: int = 1

    @staticmethod
    def terms(rows: DataFrame, text: Column, ngrams: int) -> DataFrame:
        """rows plus __terms."""
        words = RegexTokenizer(inputCol="__t", outputCol="__w", pattern=r"(?U)\w\w+", gaps=False).transform(rows.withColumn("__t", F.coalesce(text, F.lit(""))))
        terms = F.col("__w")
        for n in range(2, ngrams + 1):
            words = NGram(n=n, inputCol="__w", outputCol=f"__g{n}").transform(words)
            terms = F.concat(terms, F.col(f"__g{n}"))
        return words.withColumn("__terms", terms).drop("__t", "__w", *[f"__g{n}" for n in range(2, ngrams + 1)])

    @classmethod
    def fit(cls, rows: DataFrame, text: Column, features: int = FEATURES, ngrams: int = 1) -> Tfidf:
        """The most frequent terms, ties by the term, in that order."""
        data = cls.terms(rows.select(text.alias("__x")), F.col("__x"), ngrams)
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"  # plans read it late, so it stays
        rows.sparkSession.conf.set(key, str(min(RECORDS, int(rows.sparkSession.conf.get(key)))))
        counts = data.select("__terms").mapInArrow(_term_counts, "term string, n long, df long")
        top = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).orderBy(F.desc("n"), "term").limit(features).collect()
        if not top:  # at most `features`
            return cls([], np.zeros(0), ngrams)
        documents = rows.count()
        return cls([r["term"] for r in top], np.log((1 + documents) / (1 + np.array([r["df"] for r in top], float))) + 1, ngrams)

    @staticmethod
    def _counts(vocabulary: list[str]) -> CountVectorizerModel:
        return CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__terms", outputCol="__c")

    def transform(self, rows: DataFrame, text: Column, out: str) -> DataFrame:
        if not self.vocabulary:
            return rows.withColumn(out, array_to_vector(F.array().cast("array<double>")))
        counts = _sublinear(self._counts(self.vocabulary).transform(self.terms(rows, text, self.ngrams)), "__c", "__s")
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(self.weights), inputCol="__s", outputCol="__p").transform(counts)
        return Normalizer(p=2.0, inputCol="__p", outputCol=out).transform(scaled).drop("__terms", "__c", "__s", "__p")


def stacked(rows: DataFrame, tfidf: Tfidf, triggers: bool = True, party: bool = False, out: str = "features") -> DataFrame:
    """rows plus one sparse vector: TF-IDF, then the phrase groups, then whether the party is the tenant."""
    text = feature_text(rows)
    side = [F.transform(trigger_vector(text), lambda x: x.cast("double"))] * triggers + [F.array(is_tenant(F.col("party")).cast("double"))] * party
    data = tfidf.transform(rows, text, "__tfidf")
    if not side:
        return data.withColumnRenamed("__tfidf", out)
    data = data.withColumn("__side", array_to_vector(F.concat(*side)))
    return VectorAssembler(inputCols=["__tfidf", "__side"], outputCol=out).transform(data).drop("__tfidf", "__side")


def fit_head(rows: DataFrame, label: str, features: str = "features", c: float = 1.0, balanced: bool = True, tol: float = TOL, max_iter: int = MAX_ITER) -> tuple[LogisticRegressionModel | None, list[str]]:
    """Logistic regression with penalty 1 / (c n), intercepts free, features as they are; balanced weights are n / (k * class size). With
    fewer than two classes there is no model."""
    counts = {r[0]: r[1] for r in rows.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    classes, n = sorted(counts), sum(counts.values())
    if len(classes) < 2:
        return None, classes
    table = F.create_map(*[x for i, k in enumerate(classes) for x in (F.lit(k), F.lit(float(i)))])
    weight = F.create_map(*[x for k in classes for x in (F.lit(k), F.lit(n / (len(classes) * counts[k]) if balanced else 1.0))])
    data = rows.filter(F.col(label).isNotNull()).select(F.col(features).alias("features"), table[F.col(label)].alias("label"), weight[F.col(label)].alias("weight"))
    lr = LogisticRegression(regParam=1 / (c * n), standardization=False, weightCol="weight", family="binomial" if len(classes) == 2 else "multinomial", maxIter=max_iter, tol=tol)
    return lr.fit(data), classes


def scored(rows: DataFrame, model: LogisticRegressionModel | None, classes: list, features: str = "features") -> DataFrame:
    """rows plus array<double> `p`, probabilities in the order of classes; a single class has probability 1."""
    if model is None:
        return rows.withColumn("p", F.array(*[F.lit(1.0) for _ in classes]).cast("array<double>"))
    model = model.copy().setFeaturesCol(features).setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__y")
    return model.transform(rows).withColumn("p", vector_to_array("__p")).drop("__p", "__r", "__y")


def export_head(spark: SparkSession, model: LogisticRegressionModel, classes: list[str]) -> DataFrame:
    """The head table (class_idx, class, w, b). A model of two classes has one row of weights; its first class gets zeros."""
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if len(w) < len(classes):
        w, b = np.vstack([np.zeros_like(w), w]), np.concatenate([np.zeros_like(b), b])
    return spark.createDataFrame([(i, k, [float(x) for x in w[i]], float(b[i])) for i, k in enumerate(classes)], "class_idx int, class string, w array<double>, b double")


@dataclass
class TextModel:
    """A fitted task: of one label a row (`label`), or of a 0/1 array with a name for each place (`labels`)."""

    tfidf: Tfidf
    triggers: bool
    party: bool
    label: str
    labels: tuple[str, ...]
    heads: list[tuple[LogisticRegressionModel | None, list]]
    thresholds: dict[str, float] = field(default_factory=dict)
    #: What it was trained on: ids, label, features, as written.
    seen: DataFrame | None = None

    def scores(self, rows: DataFrame) -> DataFrame:
        """rows plus `p`: probabilities of the classes, or of each label's 1. Rows with `features` keep these, so what was trained on is not
        tokenised again."""
        data = rows if "features" in rows.columns else stacked(rows, self.tfidf, self.triggers, self.party)
        if not self.labels:
            return scored(data, *self.heads[0]).drop("features")
        for i, (model, classes) in enumerate(self.heads):
            data = scored(data, model, classes).withColumn(f"__p{i}", F.col("p")[classes.index(1)] if 1 in classes else F.lit(0.0)).drop("p")
        return data.withColumn("p", F.array(*[F.col(f"__p{i}") for i in range(len(self.heads))])).drop("features", *[f"__p{i}" for i in range(len(self.heads))])

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows plus p and y_pred: the likeliest class, ties to the earlier one; or 0/1 per label, by its threshold or one half."""
        out = self.scores(rows)
        if self.labels:
            return out.withColumn("y_pred", F.array(*[(F.col("p")[i] >= self.thresholds.get(k, 0.5)).cast("int") for i, k in enumerate(self.labels)]))
        names = F.array(*[F.lit(k) for k in self.heads[0][1]])
        return out.withColumn("y_pred", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")))

    def calibrated(self, rows: DataFrame) -> TextModel:
        """The same with the threshold of the best F1 on rows for each label."""
        cells = F.array(*[F.struct(F.lit(k).alias("label"), F.try_element_at(self.label, F.lit(i + 1)).alias("y"), F.col("p")[i].alias("p")) for i, k in enumerate(self.labels)])
        best = calibrate(self.scores(rows).select(F.inline(cells))).collect()  # one row a label
        return TextModel(self.tfidf, self.triggers, self.party, self.label, self.labels, self.heads, {r["label"]: r["threshold"] for r in best}, self.seen)


def fit_task(rows: DataFrame, label: str = "type", labels: tuple[str, ...] = (), triggers: bool = True, party: bool = False, features: int = FEATURES, ngrams: int = 1, c: float = 1.0, negatives: tuple[list[str], int] | None = None, tol: float = TOL, max_iter: int = MAX_ITER, ids: tuple[str, ...] = ()) -> TextModel:
    """A model of rows; it keeps `seen`, with the columns `ids`. With triggers, classes are balanced; `negatives` (ids, factor) keeps at most so many `none` rows per other one. Feature rows are
    written once for all heads."""
    if negatives is not None:
        rows = downsample(rows, label, negatives[0], factor=negatives[1])
    tfidf = Tfidf.fit(rows, feature_text(rows), features, ngrams)
    spark = rows.sparkSession
    path = scratch(spark, "features")
    stacked(rows, tfidf, triggers, party).select(*ids, label, "features").write.parquet(path)
    data = spark.read.parquet(path)
    targets = [F.try_element_at(label, F.lit(i + 1)).cast("int") for i in range(len(labels))] or [F.col(label)]
    heads = [fit_head(data.select(y.alias("y"), "features"), "y", c=c, balanced=triggers, tol=tol, max_iter=max_iter) for y in targets]
    return TextModel(tfidf, triggers, party, label, labels, heads, seen=data)


def fitted_split(rows: DataFrame, vector: str, label: str, ids: list[str], c: float = 10.0, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows (ids, label, y_pred, p) of the held-out part: classes of two rows or more, split by strata, a balanced head on dense encodings of bounded width."""
    from ..operators.features import split

    large = rows.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__k")).filter("__k >= 2")
    data = rows.join(large, F.col(label) == F.col("__l"), "left_semi").select(*ids, F.col(label), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    parts = split(data, label, ids, seed, (1 - test, 0.0))
    model, classes = fit_head(parts.filter("split = 'train'"), label, c=c)
    out = scored(parts.filter("split <> 'train'"), model, classes)
    names = F.array(*[F.lit(k) for k in classes])
    return out.select(*ids, label, F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("y_pred"), F.array_max("p").alias("p"))
