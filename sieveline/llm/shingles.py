"""Groups of texts of a Jaccard similarity of 0.8 or more on the sets of their five-word shingles.

Words are A-Z lower-cased; a text of fewer words than five is one shingle; texts of equal sets are one item, the empty ones too. Candidates
are what SimHash links (3 of 64 bits, BK-trees) and what shares one of 40 bands of 7 minimum hashes: at a similarity of exactly 0.8 a pair
is missed with a probability of 0.00008, at 0.85 of under 0.000001. Candidates make coarse groups, and each group's texts are compared
exactly by an index of prefixes of the sorted sets, so what is linked is 0.8 similar. A coarse group above `most` shingles is
dealt into chunks and solved by pairs of chunks, so no task holds more than about twice that. Links are followed on: a group is a component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import simhash
from sieveline.llm.common import looked_up, mapped, ship, stash, utf8

WIDTH, BANDS, ROWS, PART = 5, 40, 7, 128


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes."""
    import xxhash

    words, of = text.lower().split(), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    joined, width = b" ".join(words), min(width, len(words))
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    return np.unique(np.fromiter((of(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1], ends[width - 1 :], strict=True)), np.uint64))


def least_hashes(own: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(11)
    times, plus = rng.integers(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)
    out, short = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32), (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), PART):
        each = short[at : at + PART, None] * times
        each += plus
        np.minimum(out, each.min(0), out=out)
    return out


def profiles(rows: DataFrame) -> DataFrame:
    """row, same (a hash of the set of shingles), n, bands."""

    def of(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            same, n, bands = [], [], []
            for text in utf8(batch.column(1)):
                own = shingles(text)
                same.append(xxh3_64_intdigest(own.tobytes()))
                n.append(len(own))
                least = least_hashes(own).reshape(BANDS, ROWS) if len(own) else ()
                bands.append(np.fromiter((xxh3_64_intdigest(x.tobytes(), b) for b, x in enumerate(least)), np.uint64, len(least)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["row", "same", "n", "bands"])

    return mapped(rows.select("row", "text"), of, "row long, same long, n long, bands array<long>")


def similar(sets: list[np.ndarray]) -> list[int]:
    """For each set the first of its component by links of a similarity of 0.8 or more."""
    label, holders = list(range(len(sets))), {}

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        own, tried = sets[i], set()
        for h in own[: len(own) - (4 * len(own) + 4) // 5 + 1].tolist():  # two similar sets share one of these
            held = holders.setdefault(h, [])
            for j in held:
                if j not in tried:
                    tried.add(j)
                    a, b = find(i), find(j)
                    if a != b and 5 * len(sets[j]) >= 4 * len(own) and 9 * len(np.intersect1d(own, sets[j], True)) >= 4 * (len(own) + len(sets[j])):
                        label[max(a, b)] = min(a, b)
            held.append(i)
    return [find(i) for i in range(len(sets))]


def groups(rows: DataFrame, most: int = 1 << 22) -> DataFrame:
    """row, component. `rows`: row (a key; rows that share it hold the same text) and text."""
    spark, own = rows.sparkSession, stash(profiles(rows))
    of_row = stash(own.select("row", "same").distinct())
    near = simhash.near_duplicates(rows, id_col="row").filter("doc_id != component_id").select(F.col("doc_id").alias("row"), F.col("component_id").alias("other")).distinct()
    near = stash(near.join(of_row, "row").select("other", F.col("same").alias("a")).distinct())  # copies are one, near copies may name one other
    edges = looked_up(near, of_row.select(F.col("row").alias("other"), F.col("same").alias("b")), "other").select("a", "b")
    held = stash(own.select("same", F.explode("bands").alias("key")).distinct())
    least = held.groupBy("key").agg(F.min("same").alias("b"), F.count("*").alias("n")).filter("n > 1").select("key", "b")
    edges = edges.unionByName(held.join(least, "key").select(F.col("same").alias("a"), "b"))
    coarse = simhash.components(edges)
    members = own.groupBy("same").agg(F.min("row").alias("row"), F.first("n").alias("n")).join(coarse.withColumnRenamed("node", "same"), "same")
    members = stash(members.withColumnRenamed("root", "coarse"))
    sizes = members.groupBy("coarse").agg(F.ceil(F.sum("n") / most).cast("int").alias("chunks"))
    texts = rows.select("row", "text").join(members.join(sizes, "coarse").hint("shuffle_hash"), "row")
    chunk, other = F.pmod(F.xxhash64("same"), F.col("chunks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    texts = texts.select("coarse", "same", "text", chunk.alias("chunk"), other.alias("other"))
    ship(spark)

    def solve(pdf):
        pdf = pdf.drop_duplicates("same").sort_values("same")
        found, same = similar([shingles(x.encode()) for x in pdf["text"]]), pdf["same"].to_numpy()
        return type(pdf)({"a": same, "b": same[found]})

    linked = texts.groupBy("coarse", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y")).applyInPandas(solve, "a long, b long")
    linked = stash(linked.filter("a != b"))
    if (sizes.agg(F.max("chunks")).first()[0] or 0) > 1:
        final = simhash.components(linked)
    else:  # each coarse group was solved at once
        final = linked.select(F.col("a").alias("node"), F.col("b").alias("root"))
    final = final.withColumnRenamed("node", "same")
    return looked_up(of_row, final, "same", "left").select("row", F.coalesce("root", "same").alias("component"))
