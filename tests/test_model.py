"""Fits on a small fixture: relational scores against the vectors' own, sources and sinks, streams."""

import numpy as np
import pytest

from sieveline.operators import explain, features, metrics, model, perturb, splits
from sieveline.sources import files
from sieveline.streaming import score

GOOD = ["your package arrived today", "meeting at noon tomorrow", "the code review is done", "see you at lunch", "weather is fine today", "call me when home"]
BAD = ["urgent win a prize now http://a.top", "you won click here bit.ly/x", "send the code urgent", "free prize act now www.x.xyz", "winner pay a fee now", "congratulations lucky winner"]


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(i, t, int(i % 2)) for i, t in enumerate(x for pair in zip(GOOD, BAD, strict=True) for x in pair)]
    return spark.createDataFrame(rows, "doc long, text string, label int").cache()


def test_logistic_regression_reaches_its_optimum(spark, messages):
    blocks = model.fit_blocks(messages.select("doc", "text"))
    rows = model.long_features(messages.select("doc", "text"), blocks).cache()
    terms, intercept = model.fit_logistic(rows, messages.select("doc", "label"))
    scored = explain.scores(messages, explain.contributions(rows, terms), intercept).toPandas().set_index("doc")
    assert ((scored.score >= 0.5).astype(int) == scored.index.to_series() % 2).all()
    places = model.index(rows)
    x = np.zeros((12, len(places)))
    for r in rows.collect():
        x[r["doc"], places[r["term"]]] = r["value"]
    weights = dict(terms.collect())
    w = np.array([weights[t] for t in places])
    y = np.where(np.arange(12) % 2, 1, -1)
    p = 1 / (1 + np.exp(-(x @ w + intercept)))
    assert np.allclose(p, scored.score.sort_index(), atol=1e-6)
    slope = w - 4.0 * x.T @ (y / (1 + np.exp(y * (x @ w + intercept))))  # of |w|^2 / 2 + C * loss
    assert np.abs(slope).max() < 0.1  # a hundredth of the slope at zero


def test_other_models_fit(messages):
    blocks = model.fit_blocks(messages.select("doc", "text"), ("word",))
    rows = model.long_features(messages.select("doc", "text"), blocks)
    fitted, places = model.fit_other("svc", rows, messages.select("doc", "label"))
    assert len(fitted.coefficients) == len(places)
    with pytest.raises(ValueError):
        model.fit_blocks(messages, ())


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "ar-1", "text": "x, \\"y\\"", "label": "ham", "lang": "ar", "category": "legit", "source": "authored"}\n\n')
    seeds = files.read_seeds(spark, str(tmp_path / "a.jsonl"))
    corpus = perturb.augment(seeds, 3)
    for kind in ("csv", "parquet"):
        files.write_corpus(corpus, str(tmp_path / kind), kind)
        assert sorted(files.read_corpus(spark, str(tmp_path / kind), kind).collect()) == sorted(corpus.select(*files.read_corpus(spark, str(tmp_path / kind), kind).columns).collect())
    terms = spark.createDataFrame([("word::a", 1.5), ("signal::b", -1.0)], "term string, weight double")
    files.write_model(terms, 0.5, str(tmp_path / "model"))
    back, intercept = files.read_model(spark, str(tmp_path / "model"))
    assert sorted(back.collect()) == sorted(terms.collect()) and intercept == 0.5
    assert files.model_json(terms, 0.5).count() == 2
    (tmp_path / "lines.txt").write_text("a\n\n b\n")
    assert [r[0] for r in files.read_lines(spark, str(tmp_path / "lines.txt")).collect()] == ["a", " b"]


def test_stream_scores_as_a_table(spark, messages, tmp_path):
    messages.select("doc", "text").write.parquet(str(tmp_path / "in"))
    out = score.signal_scores(score.read_messages(spark, str(tmp_path / "in")), {"url_present": 2.0}, -1.0)
    query = out.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    want = score.signal_scores(messages, {"url_present": 2.0}, -1.0)
    assert sorted(spark.table("scored").collect()) == sorted(want.collect())


def test_metric_edges(spark):
    none = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5)], "label int, pred int, score double")
    assert metrics.average_precision(none).first()[0] == 0.0
    assert metrics.binary_report(none).first()["f1"] == 0.0
    ties = spark.createDataFrame([(1, 1, 0.5), (0, 1, 0.5), (1, 1, 0.5)], "label int, pred int, score double")
    assert metrics.average_precision(ties).first()[0] == pytest.approx(2 / 3)


def test_splits_do_not_leak(spark, messages):
    rows = messages.withColumn("grp", messages["doc"] % 5)
    train, test = splits.group_split(rows, "grp", ["label"])
    assert splits.leaked(train, test, "grp").count() == 0 and train.count() + test.count() == 12


def test_char_grams(spark):
    got = spark.createDataFrame([("ab c",)], "t string").select(features.char_grams(features.F.col("t"))).first()[0]
    assert got == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]
