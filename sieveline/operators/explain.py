"""Relational scoring and explanations: a linear model is a table (term, weight), a message a set of rows (doc, term, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import resources as R


def contributions(features: DataFrame, model: DataFrame) -> DataFrame:
    """doc, term, value, weight, contribution. Whether the model is broadcast is left to its size as Spark finds it when it runs."""
    return features.join(model, "term").withColumn("contribution", F.col("value") * F.col("weight"))


def scores(docs: DataFrame, parts: DataFrame, intercept: float, digits: int | None = None) -> DataFrame:
    """doc, score, label for every document, also those without a known term.

    With `digits` the label is that of the rounded score, so a sum at the threshold doesn't depend on the order of its parts.
    """
    sums = parts.groupBy("doc").agg(F.sum("contribution").alias("z"))
    score = 1 / (1 + F.exp(-(F.coalesce("z", F.lit(0.0)) + intercept)))
    score = score if digits is None else F.round(score, digits)
    return docs.select("doc").join(sums, "doc", "left").select("doc", score.alias("score")).withColumn("label", F.when(F.col("score") >= 0.5, "scam").otherwise("ham"))


def top_reasons(parts: DataFrame, scored: DataFrame, k: int = 8, by: str = "signed") -> DataFrame:
    """doc, rank, term, contribution: the k largest toward the predicted class among the first 4k, without those below 1e-9.

    by="absolute" ranks by size alone.
    """
    rows = parts.join(scored.select("doc", "label"), "doc")
    toward = F.when(F.col("label") == "scam", F.col("contribution")).otherwise(-F.col("contribution"))
    order = [F.desc(toward if by == "signed" else F.abs("contribution")), F.col("term")]
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(*order))).filter(F.col("place") <= 4 * k).filter(F.abs("contribution") >= 1e-9)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("place"))).filter(F.col("rank") <= k).select("doc", "rank", "term", "value", "weight", "contribution")


def glosses(spark, language: str = "en") -> DataFrame:
    at = R.LANGUAGES.index(language)
    return spark.createDataFrame([(k, v[at]) for k, v in R.GLOSSES.items()], "term string, gloss string")


def described(reasons: DataFrame, language: str = "en") -> DataFrame:
    """Adds the gloss; a term without one is its own."""
    return reasons.join(F.broadcast(glosses(reasons.sparkSession, language)), "term", "left").withColumn("gloss", F.coalesce("gloss", "term"))


def verdict(label: Column, language: str = "en") -> Column:
    at = R.LANGUAGES.index(language)
    return F.when(label == "scam", R.VERDICTS["scam"][at]).otherwise(R.VERDICTS["ham"][at])


def shown_reasons(reasons: DataFrame, most: int = 7) -> DataFrame:
    """Without a count whose twin is there too, at most `most` a document, with the width of its bar."""
    twins = F.when(F.col("term") == "url_count", "url_present").when(F.col("term") == "phone_count", "phone_present")
    there = reasons.select(F.col("doc").alias("_doc"), F.col("term").alias("_term"))
    left = reasons.join(there, (F.col("doc") == F.col("_doc")) & (twins == F.col("_term")), "left_anti")
    by_doc = Window.partitionBy("doc")
    kept = left.withColumn("place", F.row_number().over(by_doc.orderBy("rank"))).filter(F.col("place") <= most)
    peak = F.max(F.abs("contribution")).over(by_doc)
    return kept.withColumn("width", F.when(peak > 0, F.greatest(F.lit(4.0), F.abs("contribution") / peak * 100)).otherwise(0.0)).drop("rank")


def confidence(score: Column, label: Column) -> Column:
    return F.when(label == "scam", score).otherwise(1 - score)
