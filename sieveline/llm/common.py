"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.sources.stored import shared_dir, stash  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8, nulls as empty ones."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def each_utf8(column):
    """The same one by one, so that a batch of texts is never there twice."""
    import pyarrow as pa

    for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield x.as_py() or b""


def text_runs(texts, size: int = 1 << 22):
    """Lists of texts of about `size` bytes."""
    own, total = [], 0
    for text in texts:
        own.append(text)
        total += len(text)
        if total >= size:
            yield own
            own, total = [], 0
    if own:
        yield own


def slices(rows: int, size: int) -> int:
    """How many parts of about `size` rows."""
    return max(1, -(-rows // size))


#: A key is hot if it holds more than this share of all rows, and more rows than the least.
HOT_SHARE, HOT_LEAST = 1024, 1024


def looked_up(rows: DataFrame, values: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `values`, one row per key, in a way that no hot key is one task.

    Keys with more than 1/1024 of all rows are 1023 at most, so their values are broadcast whatever the size of the data; the other
    rows are joined as usual. Both frames are read twice and should be stored. Keys are integers.
    """
    n = rows.count()
    hot = [r[0] for r in rows.groupBy(key).count().filter(F.col("count") > max(HOT_LEAST, n // HOT_SHARE)).filter(F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(values, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.filter(~is_hot).join(values, key, how).unionByName(rows.filter(is_hot).join(F.broadcast(values.filter(is_hot)), key, how))


def ship(spark: SparkSession) -> None:
    """Let the driver's file server give this package to all Python workers, once a session."""
    context = spark.sparkContext
    if getattr(context, "sieveline_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # the driver serves the file from there until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    context.sieveline_shipped = True


#: Bytes of rows that a worker gets at once: by default Spark counts rows alone, of which a few may be very long.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow, with this package at hand and batches bounded in bytes (a setting of the session)."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)
