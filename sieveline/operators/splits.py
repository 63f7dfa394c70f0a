"""Hash randomness, group splits and leak checks. Hashes are MD5, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(*key: Column | str) -> Column:
    """A whole number below 2**32 from the key."""
    text = F.concat_ws("|", *(F.lit(k) if isinstance(k, str) else k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def chance(*key: Column | str) -> Column:
    return draw(*key) / F.lit(float(1 << 32))


def group_folds(df: DataFrame, group: str, strata: list[str], folds: int = 5, seed: str = "42") -> DataFrame:
    """group, fold: each group in one fold, groups of a stratum dealt evenly. A group in several strata counts for the least of them."""
    groups = df.groupBy(group).agg(F.min(F.concat_ws("_", *strata)).alias("stratum"))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(draw(seed, F.col(group)), group))
    return groups.select(group, (F.pmod(rank - 1, F.lit(folds))).cast("int").alias("fold"))


def group_split(df: DataFrame, group: str, strata: list[str], fold: int = 0, folds: int = 5, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """(train, test)."""
    rows = df.join(group_folds(df, group, strata, folds, seed), group)
    return rows.filter(F.col("fold") != fold).drop("fold"), rows.filter(F.col("fold") == fold).drop("fold")


def leaked(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """The groups that both hold: none, or the split is wrong."""
    return train.select(group).intersect(test.select(group))


def concept(seed_id: Column) -> Column:
    return F.regexp_replace(seed_id, "^(?:ckb|ar)-", "")


def sample(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows in a random order of the key that reruns keep."""
    return df.orderBy(draw(seed, F.col(key)), key).limit(n)
