"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's features are itself and its character n-grams of 3 to 5 with the ends marked, hashed into `buckets`; its embedding is the mean
of theirs, a text's the mean of its words' (repeats included), and a linear softmax over it gives the two classes. So an unseen misspelling
shares most of its vectors with the word. Embeddings and softmax are trained together by AdaGrad on a bounded sample of labelled rows: at
most `per_class` of each class, the first by a hash of the id, as long as their features stay within `most` in all (8 bytes each). All buckets
learn, but those whose presence in a text tells little of the label (the G statistic of the 2 x 2 table is below `level`) by a `share` of the
learning rate, so that the many n-grams of a few texts don't learn these by heart. As everything is linear, a
trained word is one number, and a text's logit is the mean of its words' numbers plus a constant; all words of all texts count.

Defined cases: null and empty texts have no words and get the constant alone; labels that are null, or neither 0 nor 1, are left out; a
document with several labels counts as the largest; without labels of both classes every score is 0; rows that repeat are scored each; an
empty table gives no rows. Other columns are ignored, whatever their names. Memory: texts in runs of 4 MB, and one long text.
"""

from __future__ import annotations

import string
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.llm.common import each_utf8, mapped, stash, text_runs
from sieveline.llm.language import held_out

BUCKETS, DIMS, PER_CLASS, MOST, KNOWN = 1 << 17, 4, 2000, 1 << 24, 400_000
#: A G statistic of a chance of 0.001 by chi-square, and the share of the learning rate that buckets below it have.
LEVEL, SHARE, STEPS = 10.828, 0.03, 1500
SALT = 17


def bare(word: str) -> str:
    return word.strip(string.punctuation) or word


def features(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word and of its n-grams, of whole words of up to 64 characters and of the n-grams of all."""
    marked = f"<{bare(word)}>"
    if marked.isascii():  # its bytes are its characters
        raw = marked.encode()
        grams = [raw, *(raw[i : i + n] for n in (3, 4, 5) for i in range(len(raw) - n + 1))]
    else:
        grams = [g.encode() for g in (marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)))]
    return [crc32(g, SALT) % buckets for g in grams]


def coded(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words in lower case, the places of the texts' words among them, and where each text's places start and end."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([x.decode("utf-8", "replace").strip() for x in texts], pa.large_string())))
    own = split.values.dictionary_encode()
    return own.dictionary.to_pylist(), own.indices.to_numpy(), split.offsets.to_numpy()


def words(text: bytes) -> list[str]:
    """The words of a text."""
    names, at, _ = coded([text])
    return [w for i in at for w in [names[i]] if w]


class Remembered(dict):
    """What a function gives for short words, marks at their ends aside; emptied when it holds too many."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, word):
        own = bare(word)
        out = self[own] if own != word else self.function(word)
        if len(word) <= 64:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = out
        return out


def bag(at: np.ndarray, features_: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text whose words stand at these places: the mean over words of the means over features."""
    own, times = np.unique(at, return_counts=True)
    if not len(own):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found, n = np.concatenate([features_[i] for i in own]), np.fromiter((len(features_[i]) for i in own), np.int64, len(own))
    places, inverse = np.unique(found, return_inverse=True)
    return places.astype(np.int32), (np.bincount(inverse, np.repeat(times / n, n), len(places)) / times.sum()).astype(np.float32)


def bags(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, toxic, places, weights: each text's bag."""

    def of(batches):
        import pyarrow as pa

        known = Remembered(lambda w: np.asarray(features(w, buckets), np.int32))
        for batch in batches:
            out = []
            for own in text_runs(each_utf8(batch.column(2))):
                names, at, ends = coded(own)
                each = [known[w] if w else np.zeros(0, np.int32) for w in names]
                full = np.fromiter(map(bool, names), bool, len(names))
                out += [bag((x := at[a:b])[full[x]], each, buckets) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            places, weights = [p for p, _ in out], [w for _, w in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], ["doc_id", "toxic", "places", "weights"])

    return mapped(docs.select("doc_id", "toxic", "text"), of, "doc_id long, toxic int, places array<int>, weights array<float>")


def descend(rows: list, buckets: int, dims: int, steps: int, pace: np.ndarray, batch: int = 64, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Each bucket's number and the constant. rows: (toxic, places, weights); pace: of each bucket's rate. About `steps` batches are taken, in whole rounds."""
    rng = np.random.default_rng(7)
    e, w, b = np.zeros((buckets, dims), np.float32), rng.normal(0, 0.1, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)
    sums, number = [np.full_like(x, 1e-6) for x in (e, w, b)], np.zeros(buckets, np.int64)
    y = np.fromiter((r[0] for r in rows), np.int64, len(rows))
    weight = len(rows) / (2 * np.maximum(1, np.bincount(y, minlength=2)))
    for _ in range(-(-steps * batch // len(rows))):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            own = order[at : at + batch]
            places, x = np.concatenate([rows[i][1] for i in own]), np.concatenate([rows[i][2] for i in own])
            touched = np.zeros(buckets, bool)
            touched[places] = True
            touched = np.flatnonzero(touched)
            number[touched] = np.arange(len(touched))
            place, row = number[places], np.repeat(np.arange(len(own)), [len(rows[i][1]) for i in own])
            mine, apart = e[touched], w[:, 1] - w[:, 0]  # of two classes only the difference counts
            z = np.bincount(row, x * (mine @ apart)[place], len(own)) + float(b[1] - b[0])
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[own]) * weight[y[own]] / len(own)
            pull = np.bincount(place, g[row] * x, len(touched))
            of_e, of_w = pull[:, None] * apart, mine.T @ pull
            total = sums[0][touched] + (of_e * of_e).astype(np.float32)
            sums[0][touched] = total
            e[touched] = mine - (rate * pace[touched, None] * of_e / np.sqrt(total)).astype(np.float32)
            for v, total, own_g in zip((w, b), sums[1:], (np.stack([-of_w, of_w], 1), np.array([-g.sum(), g.sum()])), strict=True):
                total += (own_g * own_g).astype(np.float32)
                v -= (rate * own_g / np.sqrt(total)).astype(np.float32)
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float64), float(b[1] - b[0])


def significance(rows: list, buckets: int) -> np.ndarray:
    """The G statistic of each bucket: how far its presence in a text tells the label."""
    y = np.fromiter((r[0] for r in rows), np.int64, len(rows))
    with_, texts = (np.array([f(t) for t in (0, 1)], float) for f in (lambda t: np.bincount(np.concatenate([r[1] for r in rows if r[0] == t]), minlength=buckets), lambda t: (y == t).sum()))
    seen = np.stack([with_, texts[:, None] - with_], 1)  # class, present or not, bucket
    expected = texts[:, None, None] * seen.sum(0)[None] / len(rows)
    return 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0).sum((0, 1))


def fit(rows: list, buckets: int = BUCKETS, dims: int = DIMS, steps: int = STEPS, level: float = LEVEL, share: float = SHARE) -> tuple[np.ndarray, float]:
    return descend(rows, buckets, dims, steps, np.where(significance(rows, buckets) >= level, 1, share))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST) -> tuple[np.ndarray, float] | None:
    """docs and labels: those to learn from. Only the sampled ids and their bags come to the driver."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = [own.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    picked = F.broadcast(first[0].unionByName(first[1]))  # at most 2 * per_class rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = stash(bags(texts.join(picked, "doc_id")))  # so many rows at most
    upto = F.sum(F.size("places")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").rowsBetween(Window.unboundedPreceding, 0))
    within = made.select("doc_id", upto.alias("upto")).filter(F.col("upto") <= most).select("doc_id").distinct()
    found = made.join(F.broadcast(within), "doc_id").toArrow().combine_chunks().sort_by("doc_id")  # columns of numbers, not Python objects
    rows = [(y, p.values.to_numpy(), w.values.to_numpy()) for y, p, w in zip(found["toxic"].to_pylist(), found["places"], found["weights"], strict=True)]
    if len({r[0] for r in rows}) < 2:
        return None
    return fit(rows)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    numbers, constant = model if model else (np.zeros(BUCKETS), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # BUCKETS numbers

    def of(batches):
        import pyarrow as pa

        values = shared.value.tolist()
        number = values.__getitem__
        known = Remembered(lambda w: sum(map(number, own := features(w, len(values)))) / len(own))
        for batch in batches:
            scores = [np.zeros(0)]
            for own in text_runs(each_utf8(batch.column(1))):
                names, at, ends = coded(own)
                each = np.fromiter((known[w] if w else 0.0 for w in names), np.float64, len(names))
                full = np.fromiter(map(bool, names), bool, len(names))[at]
                total, n = (np.diff(np.concatenate(([0], np.cumsum(x)))[ends]) for x in (each[at], full))
                z = constant + np.where(n > 0, total / np.maximum(n, 1), 0.0)
                scores.append(1 / (1 + np.exp(-np.maximum(z, -700))) if model else np.zeros(len(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores), pa.float64())], ["doc_id", "score"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), of, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (5, 0), per_class: int = PER_CLASS) -> DataFrame:
    """Learns from the labels outside the fold (CRC-32 of the id as text, modulo the first, is the second) and scores all."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"), *fold)), per_class)
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), *fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
