"""SimHash near-duplicates: components of fingerprints that differ in at most `radius` (3) of 64 bits.

Fingerprints: a shingle is three words (A-Z lower-cased) joined by spaces, its hash the XXH64 with seed 42; a bit is set if it
is set in over half of the text's shingles, repeats included.

Links are searched among distinct fingerprints, so exact copies are one item. Two fingerprints within 3 bits agree in one of four
bands of 16 bits at least, so each band value is a shard with a BK-tree of its own: the children of a node are keyed by
their integer Hamming distance to it, and a search follows only the edges from distance - 3 to distance + 3. A shard of more than
`crowd` fingerprints is dealt out again by the four bands of its other 48 bits, and again of the then other 36, which loses no
pair. A shard gives a link from each fingerprint to the first one of its component there, never all pairs.
Trees travel to the queries of their shard in the shuffle: a broadcast of all trees would grow with the corpus.
Components of the links are found by alternating large-star and small-star steps on stored tables.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a text of fewer words than three is one
shingle; rows that repeat get the same component; an empty table gives no rows; null ids do not count as the smallest. Other
columns are ignored. Memory: the hashes of one document by parts; a group of about `group_rows` fingerprints.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import looked_up, mapped, ship, slices, stash, utf8

PART = 1 << 16


def simhash(text: bytes, width: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans, of, total = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), PART):
        own = spans[at : at + PART]
        hashes = np.fromiter((of(joined[a:b], 42) for a, b in own), "<u8", len(own))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(spans), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, print: one row per document."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            prints = [simhash(x, width) for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), of, "doc_id long, print long")


class Forest:
    """BK-trees of the distinct fingerprints of each key; key is sorted."""

    def __init__(self, key: np.ndarray, prints: np.ndarray):
        n = len(prints)
        new = np.concatenate(([True], key[1:] != key[:-1]))
        self.prints, self.root = prints, np.flatnonzero(new)[np.cumsum(new) - 1]
        self.child = np.full(n * 65, -1, np.int32)
        at, moving = self.root.copy(), np.flatnonzero(~new)
        while len(moving):  # every print goes down one level; the first at a free edge stays there
            slot = at[moving] * 65 + np.bitwise_count(prints[moving] ^ prints[at[moving]])
            _, first = np.unique(slot, return_index=True)
            self.child[slot[first]] = moving[first]
            at[moving] = self.child[slot]
            moving = moving[at[moving] != moving]

    def pairs(self, queries: np.ndarray, radius: int):
        """Arrays (query, node) of the nodes within the radius, level by level."""
        node = self.root[queries]
        while len(queries):
            d = np.bitwise_count(self.prints[queries] ^ self.prints[node]).astype(np.int64)
            near = d <= radius
            yield queries[near], node[near]
            more = []
            for e in range(-radius, radius + 1):
                edge = d + e
                ok = (edge >= 1) & (edge <= 64)
                to = self.child[node[ok] * 65 + edge[ok]]
                more.append((queries[ok][to >= 0], to[to >= 0]))
            queries, node = (np.concatenate(x) for x in zip(*more, strict=True))


def roots(key: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its component among the rows of its key."""
    forest, label = Forest(key, prints), np.arange(len(prints))
    largest = int(np.bincount(np.unique(key, return_inverse=True)[1]).max())
    step = max(16, (1 << 20) // largest)
    for at in range(0, len(prints), step):
        for a, b in forest.pairs(np.arange(at, min(at + step, len(prints))), radius):
            while True:
                x, y = label[a], label[b]
                low, high = np.minimum(x, y), np.maximum(x, y)
                apart = low < high
                if not apart.any():
                    break
                np.minimum.at(label, high[apart], low[apart])
                while (label[label] != label).any():
                    label = label[label]
    return label


def band(rest: Column, number: Column, bits: int, width: int) -> tuple[Column, Column]:
    """The value of a band of `rest`, which has `width` bits, and the other bits moved together."""
    value = other = None
    for b in range(width // bits):
        low = F.shiftrightunsigned(rest, b * bits)
        own = low.bitwiseAND(F.lit((1 << bits) - 1))
        kept = rest.bitwiseAND(F.lit((1 << (b * bits)) - 1))
        high = F.lit(0).cast("long") if (b + 1) * bits >= width else F.shiftleft(F.shiftrightunsigned(rest, (b + 1) * bits), b * bits)
        value = F.when(number == b, own) if value is None else value.when(number == b, own)
        other = F.when(number == b, kept.bitwiseOR(high)) if other is None else other.when(number == b, kept.bitwiseOR(high))
    return value, other


def links(prints: DataFrame, radius: int = 3, crowd: int = 4096, group_rows: int = 32768) -> DataFrame:
    """a, b: links that connect what is within the radius. `prints`: distinct, in the column print."""
    if radius > 3:
        raise ValueError("four bands find up to three differing bits")
    ship(prints.sparkSession)
    rows, out = prints.select("print", F.lit(0).cast("long").alias("key"), F.col("print").alias("rest")), None

    def solve(pdf):
        pdf = pdf.sort_values(["key", "print"], kind="stable")
        key, own = pdf["key"].to_numpy(), pdf["print"].to_numpy().astype(np.int64)
        label = roots(key, own.view(np.uint64), radius)
        moved = label != np.arange(len(own))
        return type(pdf)({"a": own[moved], "b": own[label[moved]]})

    for width, bits in ((64, 16), (48, 12), (36, 9)):
        dealt = rows.withColumn("band", F.explode(F.array(*map(F.lit, range(4)))))
        value, other = band(F.col("rest"), F.col("band"), bits, width)
        dealt = dealt.select("print", F.xxhash64("key", "band", value).alias("key"), other.alias("rest"))
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        if bits == 9:
            ready, rows = dealt.join(sizes.select("key"), "key", "left_semi"), None
        else:
            ready = dealt.join(sizes.filter(F.col("n") <= crowd).select("key"), "key", "left_semi")
            rows = stash(dealt.join(sizes.filter(F.col("n") > crowd).select("key"), "key", "left_semi"))
            if rows.isEmpty():
                rows = None
        ready = stash(ready.select("print", "key"))
        n = ready.count()
        if n:
            found = ready.withColumn("part", F.pmod("key", F.lit(slices(n, group_rows)))).groupBy("part").applyInPandas(solve, "a long, b long")
            out = found if out is None else out.unionByName(found)
        if rows is None:
            break
    return prints.sparkSession.createDataFrame([], "a long, b long") if out is None else out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of the edges (a, b) with the smallest node that it is connected with."""
    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = stash(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = stash(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now


def near_duplicates(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", crowd: int = 4096) -> DataFrame:
    """doc_id, print, component_id (the smallest id of the component), one row per document."""
    own = stash(fingerprints(docs, id_col, text_col))
    distinct = stash(own.groupBy("print").agg(F.min("doc_id").alias("least")))
    groups = components(links(distinct.select("print"), radius, crowd))
    members = groups.join(distinct, groups["node"] == distinct["print"]).select("node", "root", "least")
    first = members.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = members.join(first, "root").select("node", "component_id")
    of_print = stash(distinct.join(moved, distinct["print"] == moved["node"], "left").select("print", F.coalesce("component_id", "least").alias("component_id")))
    return looked_up(own, of_print, "print").select("doc_id", "print", "component_id")


def as_text(prints: Column) -> Column:
    return F.lower(F.lpad(F.hex(prints), 16, "0"))
