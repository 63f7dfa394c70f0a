"""Frames that queries derive from the tables, with the SQL of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.splits import draw


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by their key to all cores, whatever files and row groups they lie in: for work that is much dearer than to move a row."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, key)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, text, label (0, 1), grp: short messages with amounts, phones, links, phrases and companies."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = spread(rows.select("o_orderkey", "c_custkey", "o_orderpriority", "o_totalprice"), "o_orderkey")
    return rows.selectExpr("o_orderkey AS doc", MESSAGE + " AS text", "cast(o_orderkey % 3 = 0 AS int) AS label", "c_custkey % 50 AS grp")


#: An expression that Spark and DuckDB share.
MESSAGE = """concat(
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'URGENT!! act now:  ' WHEN '2' THEN 'Congratulations, you won a priiiiize! ' WHEN '3' THEN 'Please send the code. ' WHEN '4' THEN 'your otp is ' ELSE 'Hello ' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'IQD ' ELSE '' END, cast(cast(floor(o_totalprice) AS bigint) AS varchar(20)), CASE WHEN o_orderkey % 5 = 1 THEN ' iqd' ELSE '' END,
  ' call 0750 ', lpad(cast(c_custkey % 1000 AS varchar(20)), 3, '0'), ' ', lpad(cast(o_orderkey % 10000 AS varchar(20)), 4, '0'), ' ',
  CASE o_orderkey % 4 WHEN 0 THEN 'http://zaincash-iq.top/verify' WHEN 1 THEN 'www.korek.com' WHEN 2 THEN 'see bit.ly/abc today' ELSE 'https://10.1.2.3:80/login' END,
  ' from ', CASE c_custkey % 3 WHEN 0 THEN 'Zain Cash' WHEN 1 THEN 'korek' ELSE 'nobody' END)"""
MESSAGES = f"SELECT o_orderkey AS doc, {MESSAGE} AS text, (o_orderkey % 3 = 0)::INT AS label, c_custkey % 50 AS grp FROM orders JOIN customer ON o_custkey = c_custkey"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, lang, source, label, score in thousandths, pred: labels as they are, scores from a hash and the label."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("toxic is not null"), "doc_id")
    score = (F.floor(draw("score", F.col("doc_id")) % 700) + 300 * F.col("toxic")) / 1000
    return rows.select(F.col("doc_id").alias("doc"), "lang", "source", F.col("toxic").alias("label"), score.alias("score")).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def draw_sql(*key: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(key) + "), 1, 8))::BIGINT"


PREDICTIONS = f"""SELECT *, (score >= 0.5)::INT AS pred FROM (SELECT d.doc_id AS doc, lang, source, toxic AS label,
  ({draw_sql("'score'", "d.doc_id::VARCHAR")} % 700 + 300 * toxic) / 1000 AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic IS NOT NULL)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, text of conversations."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


TURNS = "SELECT conv_id * 1000 + turn AS doc, coalesce(text, '') AS text FROM conversations"
