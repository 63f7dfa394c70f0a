"""Fitted models end to end: saving, explaining, exporting and the evaluation runners, on the fixture of test_model and a small corpus."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sieveline.operators import evaluate, model
from sieveline.sources import files
from tests.test_model import BAD, GOOD

LIGHT = {"blocks": ("word",)}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(40):
        for y, own in ((0, GOOD), (1, BAD)):
            n = 2 * i + y
            rows.append((n, f"{own[i % 6]} {'today' if i % 2 else 'now'} {i}", y, "ar" if i % 4 < 2 else "ckb", i // 2 * 2 + y, f"c{i // 2}-{y}", "collected" if i >= 34 else "authored"))
    return spark.createDataFrame(rows, "doc long, text string, label int, lang string, grp int, concept string, source string").cache()


@pytest.fixture(scope="module")
def fitted(corpus):
    return model.fit(corpus)


def test_saved_models_score_alike(spark, corpus, fitted, tmp_path):
    unseen = spark.createDataFrame([(1, "you won a prize http://a.top"), (2, ""), (3, None), (4, "weather at noon")], "doc long, text string")
    files.save_fitted(fitted, str(tmp_path / "m"))
    back = files.load_fitted(spark, str(tmp_path / "m"))
    assert sorted(back.scored(unseen).collect()) == sorted(fitted.scored(unseen).collect())
    for kind in ("svc", "rf"):
        rows = model.long_features(corpus, model.fit_blocks(corpus.select("doc", "text"), **LIGHT))
        other, places = model.fit_other(kind, rows, corpus.select("doc", "label"), trees=5)
        own = model.Fitted(kind, model.fit_blocks(corpus.select("doc", "text"), **LIGHT), other=other, places=places)
        files.save_fitted(own, str(tmp_path / kind))
        a, b = own.scored(unseen).collect(), files.load_fitted(spark, str(tmp_path / kind)).scored(unseen).collect()
        assert sorted(a) == sorted(b) and len(a) == 4 and {r["score"] for r in a} <= {0.0, 1.0}
        right = own.scored(corpus).withColumnRenamed("label", "told").join(corpus, "doc").filter((F.col("told") == "scam") == (F.col("label") == 1)).count()
        assert right >= 76


def test_predictions_explain_themselves(spark, fitted):
    row = model.predicted(fitted, spark.createDataFrame([(7, "URGENT you won, click here www.korek.top")], "doc long, text string")).first()
    assert row["label"] == "scam" and row["confidence"] == row["score"] > 0.5 and row["verdict"] == "Likely a SCAM"
    assert [r["rank"] for r in row["reasons"]] == list(range(1, len(row["reasons"]) + 1)) and len(row["reasons"]) == 8
    assert any(r["gloss"] != r["term"] for r in row["reasons"]) and 0 < len(row["ngrams"]) <= 14
    assert {s["label"] for s in row["spans"]} >= {"link", "urgency", "prize"}


def test_exported_models_can_be_scored_without_spark(spark, fitted):
    out = json.loads(files.browser_json(fitted, 80))
    assert out["order"] == ["char", "word", "signals"] and out["meta"]["dims"] == len(out["coef"]) == sum(b["size"] for b in out["blocks"].values())
    text = "you won a prize now"
    z, signals = out["intercept"], out["blocks"]["signals"]
    rows = model.long_features(spark.createDataFrame([(1, text)], "doc long, text string"), fitted.blocks).collect()
    place = {f"{b}::{t}": out["blocks"][b]["offset"] + i for b in ("char", "word") for i, t in enumerate(out["blocks"][b]["terms"])} | {f"signal::{t}": signals["offset"] + i for i, t in enumerate(signals["names"])}
    z += sum(r["value"] * out["coef"][place[r["term"]]] for r in rows)
    assert fitted.scored(spark.createDataFrame([(1, text)], "doc long, text string")).first()["score"] == pytest.approx(1 / (1 + math.exp(-z)))


QUICK = {"kind": "svc", "blocks": ("word",)}


def test_cross_validation_and_robustness(corpus):
    cv = {(r["config"], r["slice"]): r for r in evaluate.cross_validated(corpus, {"a": QUICK}, 2).collect()}
    assert set(cv) == {("a", s) for s in ("all", "ar", "ckb")} and all(r["folds"] == 2 and r["mean_f1"] > 0.9 for r in cv.values())
    train, test = evaluate.S.group_split(corpus, "grp", ["label", "lang"])
    tough = {r["variant"]: r for r in evaluate.robustness(model.fit(train, **QUICK), test).collect()}
    assert len(tough) == 7 and tough["none"]["f1_drop"] == 0 and all(0 <= r["fpr"] <= 1 for r in tough.values())


def test_transfer_and_collected(corpus):
    moves = {(r["train"], r["test"], r["signals"]) for r in evaluate.transfer_matrix(corpus, ("ar", "ckb"), **QUICK).collect()}
    assert moves == {(a, b, False) for a in ("ar", "ckb", "joint") for b in ("ar", "ckb")}
    assert {r["name"]: r["support"] for r in evaluate.collected(corpus, **QUICK).collect()}["macro"] == 12
    assert evaluate.collected(corpus.filter("source = 'authored'")) is None
    with pytest.raises(ValueError):
        evaluate.run(corpus.filter("source = 'authored'"), collected_only=True)


def test_ablation_and_shift(corpus):
    train, test = evaluate.S.group_split(corpus, "grp", ["label", "lang"])
    table = evaluate.ablation(train, test, {"words": QUICK})
    assert {(r["config"], r["slice"]) for r in table.collect()} == {("words", "all"), ("words", "ar"), ("words", "ckb")}
    shift = {r["normalise"]: r for r in evaluate.under_shift(train, test, **QUICK).collect()}
    assert shift[True]["delta"] == 0  # the marks are dropped
    assert shift[False]["delta"] == shift[False]["shifted_f1"] - shift[False]["clean_f1"]
