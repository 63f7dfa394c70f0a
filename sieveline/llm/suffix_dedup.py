"""Removal of repeated passages: every byte that a `length`-byte string covers which also starts anywhere else.

Texts are UTF-8 bytes. Each start of a `length`-byte string has a key, the smallest hash of the `inner`-byte strings in it, so equal
strings have equal keys and a key's strings can be judged apart from all others. A run of starts with one key is a segment (its bytes
overlap the next segment's). Keys that occur once in the corpus have no repeats and are dropped by a grouped count. Equal segments of a key
are one segment with a count; a key with a single one needs no search, as all its strings repeat if it occurs twice. The other distinct
segments are dealt by key into shards of about `shard_bytes`; a shard's suffix array is made by induced sorting (suffix types, recursive
sorting of leftmost-smaller substrings, linear induction), and permuted common prefixes mark the starts that share `length` bytes with a
neighbour in the array. Only segments of repeated keys are sorted, so the work follows the repeats.
A key whose distinct segments have more than `crowd` bytes (a passage that a large share of documents hold, at whose ends each document goes on
differently) would burst its shard. Its segments are cut again by the smallest hash of longer inner strings, which sets most of them apart, and
so on by `finer` sizes up to `length`, where a key stands for one string and its count decides. Each round is exact and linear.

Segments are identified by 128 bits of hashes, strings of the last round by 64 within their key of the round before.

Defined cases: null and empty texts have no bytes; texts shorter than `length` lose nothing; rows that repeat make each other's strings repeats,
also if they share the id (texts of one id are told apart by a 64-bit hash); ids may be null; an empty table gives no rows. Other columns are
ignored, whatever their names. Memory: a text in blocks of 1 MB, segments in runs of 4 MB, and a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import each_utf8, mapped, ship, slices, stash
from sieveline.llm.suffix_array import repeats, suffix_array

#: Bytes of a text that are hashed at once; rows and bytes that a worker gives out at once.
BLOCK, ROWS, RUN = 1 << 20, 1 << 17, 1 << 22
NO_ID = -(1 << 63)


def hashes(data: np.ndarray, count: int, size: int) -> np.ndarray:
    """64-bit hashes of the `size`-byte strings (8 at least) at the first `count` starts; data is padded by 8 bytes."""
    words = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))
    x = np.full(count, 0x9E3779B97F4A7C15, np.uint64)
    for at in sorted({*range(0, size - 7, 8), size - 8}):
        x ^= words[at : at + count]
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    rows = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def segments(text: bytes, length: int, inner: int, block: int):
    """Arrays (key, start, starts, twice) of the runs of one key, block by block; twice: the key's string occurs in it again."""
    for at in range(0, len(text) - length + 1, block):
        part = text[at : at + block + length - 1]
        data = np.frombuffer(part + b"\0" * 8, np.uint8)
        each, width = hashes(data, len(part) - inner + 1, inner), length - inner + 1
        least = sliding_min(each, width)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        n, key = np.diff(np.append(first, len(least))), least[first]
        windows = np.lib.stride_tricks.sliding_window_view(each, width)
        leftmost = first + (windows[first] == key[:, None]).argmax(1)
        rightmost = first + n - 1 + width - 1 - (windows[first + n - 1][:, ::-1] == key[:, None]).argmax(1)
        yield key.view(np.int64), first + at, n, leftmost < rightmost


def cut(docs: DataFrame, length: int, inner: int) -> DataFrame:
    """id, mark, key, seg (the hash of its bytes), starts (how many strings), start, twice: one row per segment of each text."""
    names = ["id", "mark", "key", "seg", "starts", "start", "twice"]
    block = BLOCK

    def of(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        def made(batch, rows, out):
            place = pa.array(np.concatenate(rows))
            key, seg, n, first, twice = (np.concatenate(x) for x in out)
            return pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(key), pa.array(seg), pa.array(n.astype(np.int32)), pa.array(first), pa.array(twice)], names)

        for batch in batches:
            rows, out, size = [], ([], [], [], [], []), 0
            for i, text in enumerate(each_utf8(batch.column(2))):
                for key, first, n, twice in segments(text, length, inner, block):
                    own = np.fromiter((xxh3_64_intdigest(text[a : a + b]) for a, b in zip(first.tolist(), (n + length - 1).tolist(), strict=True)), np.uint64, len(first))
                    rows.append(np.full(len(key), i))
                    size += len(key)
                    for x, y in zip(out, (key, own.view(np.int64), n, first, twice), strict=True):
                        x.append(y)
                    if size >= ROWS:
                        yield made(batch, rows, out)
                        rows, out, size = [], ([], [], [], [], []), 0
            if rows:
                yield made(batch, rows, out)

    return mapped(docs, of, "id long, mark long, key long, seg long, starts int, start long, twice boolean")


def fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """key, seg, bytes, crowded of the wanted segments. `wanted`: id, mark, and those but bytes, each at a start, with starts; `docs`: distinct."""
    rows = wanted.groupBy("id", "mark").agg(F.collect_list(F.struct("key", "seg", "starts", "start", "crowded")).alias("wanted")).hint("shuffle_hash")

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            ends, fields = batch.column(1).offsets.to_numpy(), batch.column(1).values.flatten()
            starts, start = fields[2].to_numpy() + (length - 1), fields[3].to_numpy()
            out, size, since = [], 0, int(ends[0])

            def made(since, out, fields=fields):
                key, seg, _, _, crowded = (x.slice(since, len(out)) for x in fields)
                return pa.RecordBatch.from_arrays([key, seg, pa.array(out, pa.binary()), crowded], ["key", "seg", "bytes", "crowded"])

            for i, text in enumerate(each_utf8(batch.column(0))):
                for j in range(ends[i], ends[i + 1]):
                    out.append(text[start[j] : start[j] + starts[j]])
                    size += len(out[-1])
                    if size >= RUN:
                        yield made(since, out)
                        out, size, since = [], 0, j + 1
            yield made(since, out)

    return mapped(docs.join(rows, ["id", "mark"]).select("text", "wanted"), of, "key long, seg long, bytes binary, crowded boolean")


RESULT = "n_bytes long, n_removed long, n_spans long, spans array<struct<low:long,high:long>>, kept binary"
FOUND = "key long, seg long, low int, high int"


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def sorted_shards(texts: DataFrame, length: int, shards: int) -> DataFrame:
    """key, seg, low, high: the ranges of starts in a segment that repeat in another segment of the key, or further on in itself."""

    def solve(table):
        import pyarrow as pa

        keys, segs, texts = table["key"].to_numpy(), table["seg"].to_numpy(), table["bytes"].to_pylist()
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        t = np.frombuffer(b"\xff".join(texts), np.uint8)
        del texts
        again, at, out = repeats(t, suffix_array(t, 256), length), 0, []
        for key, seg, end in zip(keys, segs, ends.tolist(), strict=True):
            low, high = ranges(again[at : end - length])
            out.append((np.full(len(low), key), np.full(len(low), seg), low.astype(np.int32), high.astype(np.int32)))
            at = end
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "seg", "low", "high"])

    ship(texts.sparkSession)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    return texts.select("key", "seg", "bytes").withColumn("shard", shard).groupBy("shard").applyInArrow(lambda _, table: solve(table), FOUND)


def finer(inner: int, length: int) -> list[int]:
    """The sizes of the inner strings, round by round: two thirds of the way to length, and so on; the last is length."""
    out = [inner]
    while length - out[-1] > 16:
        out.append(out[-1] + 2 * (length - out[-1]) // 3)
    return [*out, length] if out[-1] < length else out


def repeated_ranges(docs: DataFrame, length: int, sizes: list[int], shard_bytes: int, crowd: int) -> DataFrame:
    """id, mark, low, high: byte ranges to remove, which may overlap. `docs`: id, mark, text; sizes: of the inner strings, this round's first."""
    cuts = stash(cut(docs, length, sizes[0]))
    keys = cuts.groupBy("key").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).filter("n > 1 or twice").select("key")
    kept = cuts.join(keys, "key")
    covered = lambda low, high: ("id", "mark", (F.col("start") + low).alias("low"), (F.col("start") + high + (length - 1)).alias("high"))
    if len(sizes) == 1:  # a key is one string
        return kept.select(*covered(0, F.col("starts")))
    kept = stash(kept)
    distinct = kept.groupBy("key", "seg", "starts").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "start")).alias("first"), F.max("twice").alias("twice"))
    by_key = distinct.groupBy("key").agg(F.count("*").alias("variants"), F.max("twice").alias("any_twice"), F.sum(F.col("starts").cast("long") + (length - 1)).alias("bytes"))
    search = (F.col("variants") > 1) | F.col("any_twice")
    judged = distinct.join(by_key, "key").select("key", "seg", "starts", "n", "first.*", search.alias("search"), (search & (F.col("bytes") > crowd)).alias("crowded"))
    judged = stash(judged.filter("search or n > 1"))
    spread = judged.agg(F.sum(F.when(F.expr("search and not crowded"), F.col("starts").cast("long") + (length - 1))), F.count_if("crowded")).first()
    found = judged.filter("n > 1").select("key", "seg", F.lit(0).alias("low"), F.col("starts").alias("high"))
    if spread[0] or spread[1]:
        again = not docs.groupBy("id", "mark").count().filter("count > 1").isEmpty()  # a row that repeats is read once
        texts = fetched(docs.dropDuplicates(["id", "mark"]) if again else docs, judged.filter("search").drop("n", "search"), length)
        if spread[1]:
            texts = stash(texts)
            inside = repeated_ranges(texts.filter("crowded").select(F.col("key").alias("id"), F.col("seg").alias("mark"), F.col("bytes").alias("text")), length, sizes[1:], shard_bytes, crowd)
            found = found.unionByName(inside.select(F.col("id").alias("key"), F.col("mark").alias("seg"), F.col("low").cast("int").alias("low"), (F.col("high") - (length - 1)).cast("int").alias("high")))
        if spread[0]:
            found = found.unionByName(sorted_shards(texts.filter("not crowded"), length, slices(spread[0], shard_bytes)))
    return kept.join(found, ["key", "seg"]).select(*covered(F.col("low"), F.col("high")))


def dedup(docs: DataFrame, length: int = 200, inner: int = 40, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 20, crowd: int = 1 << 21, whole_characters: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (merged byte ranges) and kept (the other bytes), one row per document.

    whole_characters: ranges are narrowed to whole characters, so that kept stays valid UTF-8. keep: columns to carry along.
    """
    if not 8 <= inner <= length:
        raise ValueError("inner must be 8 at least and length at most")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"), *keep)
    found = repeated_ranges(own.select("id", "mark", "text"), length, finer(inner, length), shard_bytes, crowd)
    spans = found.groupBy("id", "mark").agg(F.collect_set(F.struct("low", "high")).alias("spans")).hint("shuffle_hash")
    joined = own.join(spans, ["id", "mark"], "left").select("id", "text", "spans", *keep)
    schema = T.StructType([*joined.select(F.col("id").alias("doc_id"), *keep).schema, *T.StructType.fromDDL(RESULT)])

    def removed(batches):
        import pyarrow as pa

        for batch in batches:
            out, (all_low, all_high), ends = ([], [], [], [], []), (x.to_numpy() for x in batch.column(2).values.flatten()), batch.column(2).offsets.to_numpy()
            for i, text in enumerate(each_utf8(batch.column(1))):
                merged, (a, b) = [], ends[i : i + 2]
                for low, high in sorted(zip(all_low[a:b].tolist(), all_high[a:b].tolist(), strict=True)):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                if whole_characters:
                    for r in merged:
                        while r[0] < r[1] and text[r[0]] & 0xC0 == 0x80:
                            r[0] += 1
                        while r[1] > r[0] and r[1] < len(text) and text[r[1]] & 0xC0 == 0x80:
                            r[1] -= 1
                at, kept = 0, []
                for low, high in merged:
                    kept.append(text[at:low])
                    at = high
                kept = b"".join([*kept, text[at:]])
                for x, y in zip(out, (len(text), len(text) - len(kept), len(merged), [{"low": a, "high": b} for a, b in merged], kept), strict=True):
                    x.append(y)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.binary())
            carried = [batch.column(i) for i in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *carried, *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], schema.names)

    done = mapped(joined, removed, schema)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
