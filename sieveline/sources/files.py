"""Reading and writing seeds, corpora, text lines and model tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import resources as R

SEED = "id string, text string, label string, lang string, category string, source string"
CORPUS = "text string, label string, lang string, category string, source string, seed_id string, concept_id string, variant int"


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped."""
    return spark.read.schema(SEED).json(path).filter("id is not null")


def write_corpus(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """The corpus fields alone, as Parquet or CSV."""
    own = df.select(*(c.split()[0] for c in CORPUS.split(", ")))
    if kind == "csv":
        own.write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    else:
        own.write.mode("overwrite").parquet(path)


def read_corpus(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    if kind == "csv":
        return spark.read.schema(CORPUS).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return spark.read.schema(CORPUS).parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """text: the lines that are not blank."""
    return spark.read.text(path).select(F.col("value").alias("text")).filter(F.trim("text") != "")


def write_model(terms: DataFrame, intercept: float, path: str) -> None:
    """A linear model as tables."""
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    terms.sparkSession.createDataFrame([(float(intercept),)], "intercept double").write.mode("overwrite").parquet(f"{path}/intercept")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/intercept").first()[0]


def model_json(terms: DataFrame, intercept: float) -> DataFrame:
    """One JSON document per feature block: its terms, in order, and their weights."""
    block = F.substring_index("term", "::", 1)
    rows = terms.select(block.alias("block"), F.struct(F.expr("substring(term, instr(term, '::') + 2)").alias("name"), "weight").alias("t"))
    return rows.groupBy("block").agg(F.sort_array(F.collect_list("t")).alias("terms")).select("block", F.to_json(F.struct(F.lit(intercept).alias("intercept"), F.col("terms.name").alias("names"), F.col("terms.weight").alias("coef"))).alias("json"))


def save_fitted(fitted, path: str) -> None:
    """A whole model: term weights, vocabularies with idf, scales and settings; SVC and forest as Spark ML saves them."""
    spark = SparkSession.active()
    info = {"kind": fitted.kind, "intercept": fitted.intercept, "scales": fitted.blocks.scales, "settings": fitted.blocks.settings, "vocabularies": sorted(fitted.blocks.terms)}
    spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/info")
    for block, terms in fitted.blocks.terms.items():
        terms.write.mode("overwrite").parquet(f"{path}/vocabulary-{block}")
    if fitted.kind == "logreg":
        fitted.terms.write.mode("overwrite").parquet(f"{path}/terms")
    else:
        fitted.other.write().overwrite().save(f"{path}/model")
        spark.createDataFrame(list(fitted.places.items()), "term string, at int").write.mode("overwrite").parquet(f"{path}/places")


def load_fitted(spark: SparkSession, path: str):
    from pyspark.ml.classification import LinearSVCModel, RandomForestClassificationModel

    from sieveline.operators.model import Blocks, Fitted

    info = json.loads(spark.read.text(f"{path}/info").first()[0])
    settings = info["settings"] | {"blocks": tuple(info["settings"]["blocks"])}
    blocks = Blocks({b: spark.read.parquet(f"{path}/vocabulary-{b}") for b in info["vocabularies"]}, {k: tuple(v) for k, v in info["scales"].items()}, settings)
    if info["kind"] == "logreg":
        return Fitted("logreg", blocks, spark.read.parquet(f"{path}/terms"), info["intercept"])
    other = {"svc": LinearSVCModel, "rf": RandomForestClassificationModel}[info["kind"]].load(f"{path}/model")
    return Fitted(info["kind"], blocks, other=other, places={r["term"]: r["at"] for r in spark.read.parquet(f"{path}/places").collect()})


def browser_json(fitted, n_rows: int) -> str:
    """All that a scorer outside Spark needs, as one JSON document: blocks in order with offsets, weights, tables and patterns.

    A model is bounded by its vocabularies, so it is put together in the driver.
    """
    from sieveline.functions import signals

    weights = {r["term"]: r["weight"] for r in fitted.terms.collect()}
    blocks, coef = {}, []
    for name in fitted.blocks.settings["blocks"]:
        if name == "signals":
            own, more = R.FEATURES, {"scale": [fitted.blocks.scales[c][1] for c in R.FEATURES], "names": R.FEATURES}
            prefix = "signal"
        else:
            rows = fitted.blocks.terms[name].select("term", "idf").orderBy("term").collect()
            own, prefix = [r["term"] for r in rows], name
            more = {"terms": own, "idf": [r["idf"] for r in rows], "ngram_range": [2, 5] if name == "char" else [1, 2], "sublinear_tf": True, "analyzer": "char_wb" if name == "char" else "word"}
        blocks[name] = {"offset": len(coef), "size": len(own)} | more
        coef += [weights.get(f"{prefix}::{t}", 0.0) for t in own]
    words, brands = signals.lexicons()
    return json.dumps({
        "meta": {"model": fitted.kind, "n_rows": n_rows, "classes": ["ham", "scam"], "dims": len(coef), "note": "Scores P(scam)."},
        "order": list(blocks), "blocks": blocks, "coef": coef, "intercept": fitted.intercept,
        "normalize": {"invisible": list(R.INVISIBLE), "tatweel": R.TATWEEL, "letter_fold": dict(zip(R.FOLD_FROM, R.FOLD_TO, strict=True)), "diacritics_re": R.DIACRITICS},
        "regex": {"url": R.URL_PATTERN, "phone": R.PHONE_PATTERN, "money": R.MONEY_PATTERN, "long_num": R.NUMBER_PATTERN},
        "signals": {"feature_names": R.FEATURES, "lexicons": words, "brands": brands, "legit_domains": sorted(R.LEGIT_DOMAINS), "shorteners": sorted(R.SHORTENERS), "suspicious_tlds": sorted(R.SUSPICIOUS_TLDS), "brand_tokens": R.BRAND_TOKENS},
    }, ensure_ascii=False, separators=(",", ":"))
