"""From documents to packed sequences: five stages, each of which takes what the one before it kept.

All stages but the last return the columns of documents. A text that is null, has no letter or is in no known language is rejected by the first, which sets lang; of each group of near
duplicates (0.8 of five-word shingles) exactly one row stays, that of the smallest id (rows without an id come last, ids need not be unique); passages
that repeat anywhere are cut out in whole characters and texts that nothing is left of go; mixing repeats or leaves out
documents; packing gives the pieces of what remains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import language, mixing, packing, shingles, suffix_dedup
from sieveline.llm.common import stash, table
from sieveline.sources.stored import settled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those too unlike all languages for their size; lang becomes the language told, `und` if none is trained."""
    prototypes = language.train(docs)
    least = language.thresholds(language.predict(docs, prototypes, keep=("lang",), with_size=True)) if prototypes else {}
    found = language.predict(docs, prototypes, keep=("lang", "source", "n_chars"), with_text=True, with_size=True)  # once more: no text is stored
    found = found.withColumn("bin", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int"))
    sure = F.lit(True)
    for size, score in least.items():
        sure = sure & ((F.col("bin") != size) | (F.col("score") >= score))
    return found.filter((F.col("size") > 0) & sure).select("doc_id", F.col("own_text").alias("text"), F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: rows, not ids, are grouped; a row's key is a 64-bit hash of all its columns and of which are null."""
    key = F.xxhash64(*(F.col(c).isNull() for c in COLUMNS), *COLUMNS)
    rows = docs.select(*COLUMNS, key.alias("row"))
    counted = stash(rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n")))  # equal rows are one key
    named = counted.join(shingles.groups(rows), "row")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "n")).alias("first"))
    chosen = stash(first.select("first.row", "first.n"))
    once = rows.join(chosen.filter("n = 1").select("row").hint("shuffle_hash"), "row", "left_semi")
    more = rows.join(chosen.filter("n > 1").select("row").hint("shuffle_hash"), "row", "left_semi").dropDuplicates(["row"])
    return once.unionByName(more).select(COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(docs, length=200, whole_characters=True, keep=("lang", "source"))
    kept = found.withColumn("text", F.decode("kept", "UTF-8")).withColumn("n_chars", F.length("text").cast("long"))
    return kept.filter(F.trim("text") != "").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Profiles, SimHash links, suffix arrays and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:  # what a stage stored on the way goes with its result
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
