"""Evaluation metrics as aggregations. `pred` frames: label and pred as int (1: positive), score where needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def cells(positive: int = 1) -> list[Column]:
    y, p = F.col("label") == positive, F.col("pred") == positive
    return [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


def binary_report(pred: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of the positive class, overall or by slice."""
    return rates(pred.groupBy(*by).agg(*cells()))


def confusion(pred: DataFrame, labels: list[int]) -> DataFrame:
    """label and one column per predicted label, zeros filled in."""
    counts = pred.groupBy("label").pivot("pred", labels).count()
    named = counts.select("label", *(F.coalesce(F.col(str(c)), F.lit(0)).alias(f"pred_{c}") for c in labels))
    return named.sparkSession.createDataFrame([(c,) for c in labels], "label int").join(named, "label", "left").na.fill(0)


def class_report(pred: DataFrame, labels: list[int]) -> DataFrame:
    """precision, recall, f1 and support of each class, and their macro and weighted means."""
    ones = None
    for c in labels:
        own = rates(pred.agg(*cells(c))).select(F.lit(str(c)).alias("name"), "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"))
        ones = own if ones is None else ones.unionByName(own)
    means = ["precision", "recall", "f1"]
    macro = ones.agg(*(F.avg(m).alias(m) for m in means), F.sum("support").alias("support")).select(F.lit("macro").alias("name"), *means, "support")
    weighted = ones.agg(*((F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in means), F.sum("support").alias("support")).select(F.lit("weighted").alias("name"), *means, "support")
    return ones.unionByName(macro).unionByName(weighted)


def average_precision(pred: DataFrame) -> DataFrame:
    """One row, `average_precision`: the sum over distinct scores, descending, of the step in recall times the precision there.

    Rows are summed by score first; the running sums are over the distinct scores.
    """
    by_score = pred.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = by_score.select("hits", F.sum("n").over(down).alias("seen"), F.sum("hits").over(down).alias("found"))
    return run.agg(F.coalesce(F.sum(F.col("hits") * F.col("found") / F.col("seen")) / F.nullif(F.sum("hits"), F.lit(0)), F.lit(0.0)).alias("average_precision"))


def threshold_sweep(pred: DataFrame, low: int = 20, high: int = 80, step: int = 5) -> DataFrame:
    """The report at each threshold, in hundredths: rows are counted by where their score falls, thresholds add up the counts."""
    marks = pred.sparkSession.range(low, high + 1, step).select((F.col("id") / 100).alias("threshold"))
    rows = pred.select("label", F.least(F.floor(F.round(F.col("score") * 100, 6)), F.lit(100)).alias("mark")).groupBy("label", "mark").agg(F.count("*").alias("n"))
    sums = F.broadcast(marks).crossJoin(rows)  # at most 101 marks a label
    above = F.col("mark") >= F.round(F.col("threshold") * 100)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    y = F.col("label") == 1
    return rates(sums.groupBy("threshold").agg(total(y & above).alias("tp"), total(~y & above).alias("fp"), total(y & ~above).alias("fn"), total(~y & ~above).alias("tn")))


def against_baseline(report: DataFrame, slice_col: str, baseline: str, metric: str = "f1") -> DataFrame:
    """Adds the drop of the metric against the slice named baseline."""
    base = report.filter(F.col(slice_col) == baseline).select(F.col(metric).alias("_base"))
    return report.crossJoin(F.broadcast(base)).withColumn(f"{metric}_drop", F.col("_base") - F.col(metric)).drop("_base")


def parity(a: DataFrame, b: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """How far two scorers are apart: rows, max and mean difference, labels that differ. Frames: key, score."""
    both = a.select(key, F.col("score").alias("a")).join(b.select(key, F.col("score").alias("b")), key).withColumn("d", F.abs(F.col("a") - F.col("b")))
    return both.agg(F.count("*").alias("rows"), F.max("d").alias("max_diff"), F.avg("d").alias("mean_diff"), F.count_if((F.col("a") >= 0.5) != (F.col("b") >= 0.5)).alias("label_mismatches"), F.count_if(F.col("d") > tolerance).alias("beyond"), F.max_by(key, F.struct("d", key)).alias("worst"))
