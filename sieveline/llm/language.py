"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (`dims` long, made from a fixed seed). A trigram is bound from its letters' vectors,
rotated by two places, one place and none, by multiplication; a document is the bundle (sum) of its trigrams' vectors, and a language the
bundle of its training documents. The document's language is the prototype of the largest cosine.

Texts are lower-cased; what is no letter ends a word and counts as one blank; a-z have symbols of their own, other letters share the
rest of `SYMBOLS` by a hash of their code point. All characters of all texts count. Prototypes are sums of integers, so they don't
depend on partitions; a partition sends `dims` sums a language, which are added up before they reach the driver.

Defined cases: a null text or one without letters gets `und` and score 0; without training rows every text does; rows
that repeat are predicted each; an empty table gives no rows; equal cosines go to the first language by name; the score is the
cosine, 0 where negative. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import mapped, utf8

SYMBOLS, SEED, BATCH = 64, 20_240_607, 128
UND = "und"


@lru_cache(1)
def symbol_table() -> np.ndarray:
    points = np.arange(0x110000, dtype=np.uint64)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    out = np.where(letters, 27 + (points * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(SYMBOLS - 27), 0).astype(np.int64)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


@lru_cache(4)
def letter_vectors(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dims))


def trigrams(text: bytes) -> np.ndarray:
    """Numbers of the text's trigrams; none if it has no letter."""
    s = symbol_table()[np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)]
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    if len(s) < 3:
        return s[:0]
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def bound(numbers: np.ndarray, dims: int) -> np.ndarray:
    v = letter_vectors(dims)
    a, b, c = numbers // SYMBOLS**2, numbers // SYMBOLS % SYMBOLS, numbers % SYMBOLS
    return np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]


def bundles(texts: list[bytes], dims: int) -> np.ndarray:
    """The hypervector of each text; zeros if it has no letter."""
    return bundled([trigrams(x) for x in texts], dims)


def bundled(each: list[np.ndarray], dims: int) -> np.ndarray:
    """The same of the trigrams of each text."""
    numbers = np.concatenate(each)
    if not len(numbers):
        return np.zeros((len(each), dims), np.float32)
    seen = np.zeros(SYMBOLS**3, bool)
    seen[numbers] = True
    own = np.flatnonzero(seen)
    place = np.empty(SYMBOLS**3, np.int32)
    place[own] = np.arange(len(own))
    row = np.repeat(np.arange(len(each)), [len(x) for x in each])
    counts = np.bincount(row * len(own) + place[numbers], minlength=len(each) * len(own)).reshape(len(each), len(own))
    return counts.astype(np.float32) @ bound(own, dims).astype(np.float32)


def parts(texts: list[bytes]):
    """Runs of texts of at most BATCH and about 4 MB."""
    at = size = 0
    for i, x in enumerate(texts):
        if i > at and (i - at == BATCH or size + len(x) > 1 << 22):
            yield at, i
            at, size = i, 0
        size += len(x)
    if at < len(texts):
        yield at, len(texts)


def train(docs: DataFrame, dims: int = 512, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language; rows without one are left out."""

    def sums(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = np.asarray(batch.column(1).to_pylist(), object), utf8(batch.column(0))
            for a, b in parts(texts):
                h = bundles(texts[a:b], dims).astype(np.float64)
                for lang in set(langs[a:b].tolist()):
                    total[lang] = total.get(lang, 0) + h[langs[a:b] == lang].sum(0)
        for lang, h in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dims), pa.array(np.arange(dims), pa.int32()), pa.array(np.rint(h).astype(np.int64))], ["lang", "dim", "value"])

    rows = mapped(docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")), sums, "lang string, dim int, value long")
    out: dict[str, np.ndarray] = {}
    for lang, dim, value in rows.groupBy("lang", "dim").agg(F.sum("value")).collect():
        out.setdefault(lang, np.zeros(dims))[dim] = value
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False, with_size: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; `keep`: more columns to carry along unchanged; with_text: the text too, as `own_text`; with_size: `size`, its
    number of trigrams."""
    names = list(prototypes)
    dims = len(next(iter(prototypes.values()))) if names else 1
    rows = np.array([p / (np.linalg.norm(p) or 1) for p in prototypes.values()], np.float32).reshape(-1, dims)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("own_text"), *keep)
    schema = T.StructType([*(own if with_text else own.drop("own_text")).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("size", T.LongType())] if with_size else [])])

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            texts, langs, scores, sizes = utf8(batch.column(1)), [], [], []
            for a, b in parts(texts):
                each = [trigrams(x) for x in texts[a:b]] if names or with_size else []
                sizes += map(len, each)
                h = bundled(each, dims) if names else np.zeros((b - a, dims), np.float32)
                norm = np.linalg.norm(h, axis=1)
                cos = h @ rows.T / np.maximum(norm, 1e-9)[:, None] if names else np.zeros((b - a, 1))
                best = cos.argmax(1)
                for i in range(b - a):
                    known = names and norm[i] > 0
                    langs.append(names[best[i]] if known else UND)
                    scores.append(min(1.0, max(0.0, float(cos[i, best[i]]))) if known else 0.0)
            kept = [c for i, c in enumerate(batch.columns) if with_text or i != 1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *([pa.array(sizes, pa.int64())] if with_size else [])], schema.names)

    return mapped(own, of, schema)


def thresholds(found: DataFrame, lang_col: str = "lang", enough: int = 100) -> dict[int, float]:
    """The least score of a text in a known language, by the whole base-2 logarithm of its number of trigrams.

    Half the cosine that 99 in 100 of the training rows of that size reach; sizes of fewer rows than `enough` take those of shorter texts
    along, whose cosines are lower. Sizes that are not named have no threshold. `found`: predict's rows with size and lang_col.
    """
    known = found.filter(F.col(lang_col).isNotNull() & (F.col("size") > 0)).withColumn("bin", F.floor(F.log2("size")).cast("int"))
    steps = known.groupBy("bin", F.round("score", 3).alias("score")).agg(F.count("*").alias("n")).orderBy("bin", "score").collect()  # at most 1001 a size
    by_bin, out = {}, {}
    for r in steps:
        by_bin.setdefault(r["bin"], []).append((r["score"], r["n"]))
    for last in by_bin:
        pooled, first = [], last
        while first >= 0 and sum(n for _, n in pooled) < enough:
            pooled += by_bin.get(first, [])
            first -= 1
        total, upto = sum(n for _, n in pooled), 0
        if total >= enough:
            for score, n in sorted(pooled):
                upto += n
                if 100 * upto >= total:
                    out[last] = score / 2
                    break
    return out


def held_out(key: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, dims: int = 512, fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """Trains on the rows outside the fold (CRC-32 of the id as text, modulo the first, is the second) and predicts all."""
    out = held_out(F.col("doc_id"), *fold)
    return predict(docs, train(docs.filter(~out), dims)).select("doc_id", held_out(F.col("doc_id"), *fold).alias("held_out"), "lang_pred", "score")
