"""Classifiers over the three feature blocks, on Spark ML, and their tables for relational scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import resources as R
from sieveline.functions import signals, text, traced
from sieveline.operators import explain
from sieveline.operators import features as X
from sieveline.sources.stored import stash


@dataclass
class Blocks:
    """What a fit learns of the features: weights of terms by block and the signals' scales."""

    terms: dict[str, DataFrame]
    scales: dict[str, tuple[float, float]]
    settings: dict


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """label, weight: n / (classes * count)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all"), F.count("*").alias("k")))).select(label, (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))


def grams(df: DataFrame, block: str, settings: dict) -> DataFrame:
    own = df.select("doc", text.preprocess(F.col("text"), settings["normalise"], settings["fold"]).alias("own"))
    return X.term_counts(own, "doc", X.char_grams(F.col("own")) if block == "char" else X.word_grams(F.col("own")))


def fit_blocks(df: DataFrame, blocks=("char", "word", "signals"), normalise: bool = True, fold: bool = True, scaler: str = "maxabs") -> Blocks:
    """df: doc, text. At least one block."""
    if not blocks:
        raise ValueError("at least one feature block must be enabled")
    settings, n = {"blocks": tuple(blocks), "normalise": normalise, "fold": fold}, df.count()
    terms = {b: X.idf(X.vocabulary(grams(df, b, settings), 2, 60_000 if b == "char" else None), n) for b in blocks if b != "signals"}
    scales = {}
    if "signals" in blocks:
        made = signals.with_signals(df.select("doc", "text"))
        if scaler == "maxabs":
            row = made.agg(*(F.max(F.abs(c)).alias(c) for c in R.FEATURES)).first()
            scales = {c: (0.0, row[c] or 1.0) for c in R.FEATURES}
        else:
            row = made.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in R.FEATURES)).first()
            scales = {c: (row[c]["m"], row[c]["s"] or 1.0) for c in R.FEATURES}
    return Blocks(terms, scales, settings)


def long_features(df: DataFrame, blocks: Blocks) -> DataFrame:
    """doc, term (`block::name`), value."""
    out = None
    for b in blocks.settings["blocks"]:
        if b == "signals":
            made = signals.with_signals(df.select("doc", "text"))
            pairs = F.explode(F.array(*(F.struct(F.lit(f"signal::{c}").alias("term"), ((F.col(c) - blocks.scales[c][0]) / blocks.scales[c][1]).alias("value")) for c in R.FEATURES)))
            own = made.select("doc", pairs.alias("p")).select("doc", "p.term", "p.value").filter("value != 0")
        else:
            own = X.tfidf(grams(df, b, blocks.settings), blocks.terms[b]).withColumn("term", F.concat(F.lit(f"{b}::"), "term"))
        out = own if out is None else out.unionByName(own)
    return out


def index(features: DataFrame) -> dict[str, int]:
    """A place for each term; a model's terms are bounded by its vocabulary."""
    return {r["term"]: i for i, r in enumerate(features.select("term").distinct().orderBy("term").collect())}


def vectors(features: DataFrame, places: dict[str, int], more: int = 0) -> DataFrame:
    """doc, features as sparse vectors. `more`: constant ones at the end."""
    spark, n = features.sparkSession, len(places)
    table = F.broadcast(spark.createDataFrame(list(places.items()), "term string, at int"))

    @F.udf(VectorUDT())
    def vector(pairs):
        own = {p["at"]: p["value"] for p in pairs} | {n + i: 1.0 for i in range(more)}
        return SparseVector(n + more, own)

    return features.join(table, "term").groupBy("doc").agg(vector(F.collect_list(F.struct("at", "value"))).alias("features"))


def gathered(rows: DataFrame, n: int, least: int = 10_000) -> DataFrame:
    """In partitions of at least so many rows: each step of a fit is a job, and tasks of a few rows would take most of its time."""
    return rows.coalesce(max(1, n // least))


def fit_logistic(features: DataFrame, labels: DataFrame, c: float = 4.0) -> tuple[DataFrame, float]:
    """(term, weight) and the intercept, which is penalised like a weight. labels: doc, label (0, 1).

    A constant column stands for the intercept; a row of zeros with next to no weight keeps Spark from dropping it.
    """
    spark, places = features.sparkSession, index(features)
    rows = vectors(features, places, 1).join(labels, "doc").join(F.broadcast(class_weights(labels)), "label").select("label", "features", "weight")
    n, total = rows.agg(F.count("*"), F.sum("weight")).first()
    blank = spark.createDataFrame([(0, SparseVector(len(places) + 1, {}), 1e-6)], rows.schema)
    fitted = LogisticRegression(weightCol="weight", regParam=1 / (c * total), standardization=False, fitIntercept=False, maxIter=500, tol=1e-9).fit(gathered(rows.unionByName(blank).withColumn("label", F.col("label").cast("double")), n))
    weights = fitted.coefficients.toArray()
    table = spark.createDataFrame([(t, float(weights[i])) for t, i in places.items()], "term string, weight double")
    return table, float(weights[-1])


def fit_other(kind: str, features: DataFrame, labels: DataFrame, trees: int = 300):
    """The linear SVC or the forest on the same vectors: (model, places)."""
    places = index(features)
    rows = vectors(features, places).join(labels, "doc").join(F.broadcast(class_weights(labels)), "label").withColumn("label", F.col("label").cast("double"))
    n, total = rows.agg(F.count("*"), F.sum("weight")).first()
    rows = gathered(rows, n)
    if kind == "svc":
        return LinearSVC(weightCol="weight", regParam=1 / (0.5 * total), standardization=False, maxIter=200).fit(rows), places
    if kind == "rf":
        return RandomForestClassifier(weightCol="weight", numTrees=trees, minInstancesPerNode=2, maxDepth=20, seed=0).fit(rows), places
    raise ValueError(f"unknown model: {kind}")


@dataclass
class Fitted:
    """A model that can score, explain, be saved and loaded. terms and intercept: of the logistic regression; other and places: of the rest."""

    kind: str
    blocks: Blocks
    terms: DataFrame | None = None
    intercept: float = 0.0
    other: object = None
    places: dict[str, int] | None = None

    def scored(self, df: DataFrame) -> DataFrame:
        """doc, score, label of every row of df (doc, text); of the SVC and the forest the score is the side, 0 or 1."""
        rows = long_features(df, self.blocks)
        if self.kind == "logreg":
            return explain.scores(df, explain.contributions(rows, self.terms), self.intercept)
        found = self.other.transform(vectors(rows, self.places)).select(F.col("doc").alias("_doc"), F.col("prediction").alias("score"))
        blank = self.other.predict(SparseVector(len(self.places), {}))  # of a text without known terms
        score = F.coalesce("score", F.lit(float(blank)))
        return df.select("doc").join(found, F.col("doc") == F.col("_doc"), "left").select("doc", score.alias("score")).withColumn("label", F.when(F.col("score") >= 0.5, "scam").otherwise("ham"))


def fit(df: DataFrame, kind: str = "logreg", blocks=("char", "word", "signals"), normalise: bool = True, fold: bool = True, scaler: str = "maxabs", c: float = 4.0) -> Fitted:
    """df: doc, text, label (0, 1). kind: logreg, svc or rf."""
    learnt = fit_blocks(df.select("doc", "text"), blocks, normalise, fold, scaler)
    learnt.terms = {b: stash(t) for b, t in learnt.terms.items()}
    rows, labels = stash(long_features(df.select("doc", "text"), learnt)), df.select("doc", "label")
    if kind == "logreg":
        terms, intercept = fit_logistic(rows, labels, c)
        return Fitted(kind, learnt, terms, intercept)
    other, places = fit_other(kind, rows, labels)
    return Fitted(kind, learnt, other=other, places=places)


def predicted(fitted: Fitted, df: DataFrame, k: int = 8, language: str = "en") -> DataFrame:
    """df with score, label, confidence, verdict, reasons (the k first, with glosses), ngrams (the first 14 of them) and spans of the raw text."""
    if fitted.kind != "logreg":
        raise ValueError("only the logistic regression can be explained term by term")
    docs = df.select("doc", "text")
    parts = stash(explain.contributions(long_features(docs, fitted.blocks), fitted.terms))
    scored = stash(explain.scores(docs, parts, fitted.intercept))
    plain = F.when(F.startswith("term", F.lit("signal::")), F.expr("substring(term, 9)")).otherwise(F.col("term"))
    reasons = explain.described(explain.top_reasons(parts, scored, k).withColumn("term", plain), language)
    listed = reasons.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "gloss", "value", "weight", "contribution"))).alias("reasons"))
    grams = explain.top_reasons(parts.filter("term not like 'signal::%'"), scored, 14)
    grams = grams.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term", "contribution"))), lambda g: F.struct(g["term"].alias("term"), g["contribution"].alias("contribution"))).alias("ngrams"))
    own = df.join(scored.select("doc", "score", "label"), "doc") if "label" not in df.columns else df.drop("label").join(scored, "doc")
    out = own.join(listed, "doc", "left").join(grams, "doc", "left")
    return out.withColumns({"confidence": explain.confidence(F.col("score"), F.col("label")), "verdict": explain.verdict(F.col("label"), language), "spans": traced.merge_spans(traced.spans(F.coalesce("text", F.lit(""))))})
