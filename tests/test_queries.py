"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.functions import traced
from sieveline.operators import perturb
from sieveline.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return con


def rows(frame, columns):
    return sorted((tuple(None if x != x else x for x in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.SQL])
def test_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_traced_spans_give_labels(spark):
    found = registry.traced_spans(spark, SMALL).toPandas()
    assert len(found) == 1500 and found.fired.str.contains("phone").all() and found.html.str.contains("<mark").all()


def test_traced_spans_in_one_pass_over_all_cores(spark):
    found = registry.traced_spans(spark, SMALL)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()


def test_marked_is_spans_merged_and_highlighted(spark):
    texts = [None, "", "  ", "<b>'zain' & \"korek\"</b> https://zain.com/a zaincash", "IQD 250,000 call 0750 123 4567", "ز\u200bیـــن ١٢٣٤٥ iqd ﷺ½", "act now act now", "no", "\U0001d7ce\U0001d7ce bit.ly/x"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    t, spans, own = F.col("text"), F.col("spans"), traced.marked(F.col("text"))
    fired = F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    apart = df.withColumn("spans", traced.spans(t)).select(traced.merge_spans(spans).alias("spans"), fired.alias("fired"), F.size(traced.trace(t)["offsets"]).alias("n"), traced.highlight(t, spans).alias("html"))
    assert df.select(own.alias("m")).select("m.*").collect() == apart.collect()


def test_augmented_corpus(spark):
    found = registry.augmented_corpus(spark, SMALL).toPandas()
    assert not found.duplicated(["seed_id", "text"]).any()
    assert (found.groupby("seed_id").variant.apply(sorted).map(lambda v: v == list(range(len(v))))).all()
    assert found.groupby("seed_id").size().max() == 8


def test_augmented_corpus_keeps_the_first_distinct_attempts_without_a_shuffle(spark):
    rows = [("ar-1", "عزيزي زین کاش 250000 call 0750 123 4567 www.korek.com", "ham", "ar"), ("ckb-2", "", "scam", "ckb"), ("ckb-3", None, "ham", "ckb"), ("ar-4", "a", None, None)]
    seeds = spark.createDataFrame(rows, "id string, text string, label string, lang string")
    found = perturb.augment(seeds, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    tries = seeds.select("*", F.explode(F.sequence(F.lit(1), F.lit(48))).alias("i"))
    made = tries.select("id", "i", perturb.attempt(F.col("text"), F.concat_ws("|", "id", "i"), F.col("lang"), F.col("label") == "scam").alias("made"))
    got, made = found.collect(), made.orderBy("id", "i").collect()
    for id_, text, *_ in rows:
        want = list(dict.fromkeys([text, *(r.made for r in made if r.id == id_)]))[:4]
        assert [r.text for r in sorted(got, key=lambda r: r.variant) if r.seed_id == id_] == want


def test_augmented_corpus_takes_every_message(spark):
    found = registry.augmented_corpus(spark, SMALL)
    assert found.select("seed_id").distinct().count() == registry.messages(spark, SMALL).count() == 1500


def plan_of(spark, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_evasions_make_each_text_once(spark):
    plan = plan_of(spark, "evasions")
    assert plan.count("zw2|") + plan.count("zw2,") == 1 and "RepartitionByExpression" in plan


def test_message_signals_look_for_amounts_once(spark):
    plan = plan_of(spark, "message_signals")
    assert plan.count(T.MONEY) == 1 and "RepartitionByExpression" in plan


@pytest.fixture(scope="module")
def at_threshold(spark, tmp_path_factory):
    """A conversation whose contributions add up to the threshold, but by doubles in any order to a little less."""
    path = str(tmp_path_factory.mktemp("threshold"))
    spark.createDataFrame([(1, 0, " ".join(["w033 w224"] * 36)), (2, 0, None)], "conv_id long, turn long, text string").write.parquet(path + "/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["relational_scores", "top_reasons", "top_reasons_by_size"])
def test_label_is_that_of_the_rounded_score(spark, at_threshold, name):
    path, con = at_threshold
    got, want = registry.QUERIES[name](spark, path).toPandas(), con.sql(registry.SQL[name]).df()
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.fixture(scope="module")
def odd_turns(spark, tmp_path_factory):
    """Turns with an id of their own or not, by a repeated key, by a turn beyond 999 and by null; capitals whose lower case depends on the engine."""
    path = str(tmp_path_factory.mktemp("odd"))
    data = [(1, 0, "alpha beta gamma alpha"), (1, 0, "alpha delta beta gamma"), (2, 1000, "beta beta gamma"), (3, 0, "gamma beta delta"), (None, 0, "beta alpha"), (4, None, "beta alpha"), (5, 0, None), (6, 0, "İSTANBUL DİYAR İİ foo"), (7, 0, "ΟΔΟΣ ΣΑΣ Σ ΣΣ ΑΣ.")]
    spark.createDataFrame(data, "conv_id long, turn long, text string").write.parquet(path + "/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["top_reasons", "top_reasons_by_size", "relational_scores", "word_vocabulary", "word_tfidf", "char_vocabulary"])
def test_shared_ids_and_odd_capitals_equal_sql(spark, odd_turns, name):
    path, con = odd_turns
    got, want = registry.QUERIES[name](spark, path).toPandas(), con.sql(registry.SQL[name]).df()
    assert len(got) and rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(registry.QUERIES) <= set(entry.queries())
