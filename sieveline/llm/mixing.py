"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Targets: the sources share the total size by weight; a target stops at `cap` times its source's size and the excess goes to the
others by weight, until none is above. A source with the target t and the size s takes each document floor(t / s) times,
and once more if the document's hash is below the source's threshold, which is chosen so that these add up to about the rest
of t. The threshold is found without sorting documents: sizes are summed by source and hash bucket (pre-aggregated
before the shuffle, so a hot source is no hot task), a running sum over a source's at most 4096 buckets finds the bucket in
which the rest is reached, and only that bucket is split further by the next 12 bits of the hash. The cut is
put before or after the last document in question, whichever comes nearer to the target.

Defined cases: a null source is one source of its own and comes last; an empty or null text has size 0 and is taken 0
words; rows with the same id have the same hash and share one decision; an empty table gives no rows; if every size is 0
every target is 0. Other columns are ignored, whatever their names. Results depend on ids and sizes alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.llm.common import WORD, stash

BITS, LEVELS = 12, 5
#: Up to so many sources (of about 100 bytes each), the table of sources is broadcast.
MOST_SOURCES = 50_000
SALTS = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: Column) -> Column:
    """60 bits, from the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """The rank (from 0) of each source by code point, nulls last: ranges are sorted apart and shifted by the counts before them."""
    parts = stash(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    sizes = parts.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("own", own).join(before, "range").select("source", "source_size", (F.col("own") + F.col("before")).alias("rank"))


def targets(sizes: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """`sizes`: source, source_size. Adds weight and target."""
    pick = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    known = stash(ranked(sizes).withColumn("weight", pick))
    total, level = known.agg(F.sum("source_size")).first()[0] or 0, 0.0
    share = F.lit(0.0)
    while total:
        above = F.col("weight").cast("double") * F.lit(level) > cap * F.col("source_size")
        spent, free = known.agg(F.sum(F.when(above, cap * F.col("source_size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if not free:
            share = (cap * F.col("source_size")).cast("double")
            break
        share = F.when(above, (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight").cast("double") * F.lit(total - spent) / F.lit(free))
        if (total - spent) / free <= level:
            break
        level = (total - spent) / free
    return known.select("source", "source_size", "weight", share.alias("target"))


def attach(docs: DataFrame, sources: DataFrame, many: bool) -> DataFrame:
    """docs with the columns of their source: a broadcast of a table of checked size, or else a salted join."""
    if not many:
        plain = F.broadcast(sources.withColumnRenamed("source", "own_source"))
        return docs.join(plain, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source")
    salted = sources.withColumnRenamed("source", "own_source").withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = docs.withColumn("salt", F.pmod(F.col("hash"), F.lit(SALTS)).cast("int"))
    return left.join(salted, F.col("source").eqNullSafe(F.col("own_source")) & (F.col("salt") == F.col("own_salt"))).drop("own_source", "own_salt", "salt")


def thresholds(docs: DataFrame, sources: DataFrame, many: bool) -> DataFrame:
    """For each source the hash below which its documents are taken once more. `docs`: source, size, hash."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = sources.withColumn("epochs", epochs.cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("threshold", F.lit(None).cast("long"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = attach(docs, state.filter("threshold is null").select("source", "rest", "prefix"), many).filter(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        bucket = F.shiftright("hash", shift).alias("bucket")
        sums = inside.groupBy("source", bucket).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.first("rest").alias("rest"))
        running = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        first = running.filter(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "size", "n", "low", "high")).alias("b"))
        left = F.col("rest") - (F.col("b.upto") - F.col("b.size"))
        single = F.col("b.low") == F.col("b.high")
        cut = F.when(F.col("b").isNull(), F.lit(1 << 60)).when(single & (2 * left >= F.col("b.size")), F.col("b.high") + 1).when(single, F.col("b.low"))
        found = F.coalesce("threshold", cut)
        moved = state.withColumnRenamed("source", "own_source").join(first, F.col("source").eqNullSafe(F.col("own_source")), "left").select(
            F.col("own_source").alias("source"), "source_size", "target", "epochs",
            F.when(F.col("threshold").isNull() & F.col("b").isNotNull(), left).otherwise(F.col("rest")).alias("rest"),
            F.when(F.col("threshold").isNull() & F.col("b").isNotNull(), F.col("b.bucket")).otherwise(F.col("prefix")).alias("prefix"),
            found.alias("threshold"),
        )
        state = stash(moved)
        if state.filter("threshold is null").isEmpty():
            break
    return state


def plan(narrow: DataFrame, weights: Sequence[float], cap: int) -> tuple[DataFrame, bool]:
    """The sources' targets, epochs and thresholds, and whether they are too many to broadcast. `narrow`: stored source, size, hash."""
    sizes = stash(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    many = sizes.count() > MOST_SOURCES
    return thresholds(narrow, targets(sizes, weights, cap), many).select("source", "source_size", "target", "epochs", "threshold"), many


def copies() -> Column:
    return F.when(F.col("size") > 0, F.col("epochs") + (F.col("hash") < F.col("threshold")).cast("int")).otherwise(0)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col).cast("string")).alias("size"), *more).withColumn("hash", hash_of(F.col("doc_id")))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (size times copies), one row per document."""
    narrow = stash(sized(docs, id_col, text_col, source_col))
    state, many = plan(narrow, weights, cap)
    out = attach(narrow, state, many).select("doc_id", "source", "size", "source_size", "target", copies().alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, columns: Sequence[str] = ("text", "lang", "n_chars"), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: doc_id, source and `columns` of each document, as many times as it is taken. Texts are not shuffled."""
    state, many = plan(stash(sized(docs, id_col, text_col, source_col)), weights, cap)
    rows = attach(sized(docs, id_col, text_col, source_col, *columns), state, many).withColumn("copies", copies())
    return rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "source", *columns)
