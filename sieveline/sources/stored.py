"""Intermediate tables in the folder that the cluster shares: they cut the lineage, and a lost executor costs no recomputation."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: The tables of this process, by the scopes that own them; the first scope ends with the process.
_OWNED: list[list[tuple[SparkSession, str]]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Unset, only a local session gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{own_dir()}"


@lru_cache(1)
def own_dir() -> str:
    """A folder of this process, gone when it ends."""
    path = f"/tmp/checkpoints/sieveline-{os.getpid()}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def stash(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back. An empty frame keeps its schema."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    _OWNED[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, as a stored table; the tables that were stored on the way are removed."""
    _OWNED.append([])
    try:
        df = make()
        inner = _OWNED.pop()
        out = stash(df)
    except BaseException:
        inner = _OWNED.pop() if len(_OWNED) > 1 else []
        raise
    finally:
        remove(inner)
    return out


def remove(owned: list[tuple[SparkSession, str]]) -> None:
    for spark, path in owned:
        with contextlib.suppress(Exception):  # the JVM may be gone
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    owned.clear()


atexit.register(lambda: [remove(x) for x in _OWNED])
