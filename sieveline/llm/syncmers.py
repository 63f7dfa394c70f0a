"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a sequence of symbols: words (cut after 24 characters) and single characters of scripts written without spaces.
A k-mer of `k` symbols is a closed syncmer if the smallest hash of its inner s-mers (`s` symbols) stands first or last. This depends
on the k-mer alone, so the same passage yields the same anchors in every document. All anchors are returned with their positions, by which
passages can be matched; the fingerprint is a SHA-256 of their distinct sorted hashes, and the likeness of two texts is the share of
the distinct anchors of either that both have, over all anchors.

Defined cases: a null or empty text, or one of white space, has the fingerprint ''; a text of fewer than k symbols is one anchor;
the likeness of two empty fingerprints is 1, of an empty one and another 0; equal texts have equal fingerprints; rows that
repeat follow each other in the order of ids; the last row's next is the first; a single row is its own next; an empty table
gives no rows. Nulls in the id come first. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SYMBOL = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[^\x20\x09-\x0D\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]{1,24}"


def anchors(text: Column, k: int = 4, s: int = 1, symbols: str = SYMBOL) -> Column:
    """array<struct<position, hash>>: the closed syncmers of the text, by symbol number from 0."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(symbols), F.lit(0)), lambda w: F.xxhash64(w))
    inner = k - s + 1  # s-mers in a k-mer

    def of(mers: Column, hashes: Column) -> Column:
        edge = lambda i: F.least(*(F.get(mers, i + j) for j in range(inner)))
        syncmer = lambda i: (F.get(mers, i) == edge(i)) | (F.get(mers, i + (inner - 1)) == edge(i))
        row = lambda i: F.struct(i.cast("int").alias("position"), F.xxhash64(*(F.get(hashes, i + j) for j in range(k))).alias("hash"))
        n = F.size(hashes)
        whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(hashes).alias("hash")))
        return F.when(n >= k, F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), syncmer), row)).when(n > 0, whole).otherwise(F.array().cast("array<struct<position:int,hash:bigint>>"))

    def mers(hashes: Column) -> Column:
        if s == 1:
            return hashes
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashes) - s, F.lit(0))), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(s))))

    bound = F.transform(F.array(found), lambda h: of(mers(h), h))  # binds the hashes, so that they are made once
    return F.element_at(bound, 1)


def hashes_of(found: Column) -> Column:
    """The distinct anchor hashes, ascending."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda a: a["hash"])))


def as_text(hashes: Column) -> Column:
    return F.when(F.size(hashes) == 0, F.lit("")).otherwise(F.sha2(F.array_join(hashes.cast("array<string>"), ",").cast("binary"), 256))


def likeness(a: Column, b: Column) -> Column:
    """The share of all distinct hashes that both hold."""
    shared = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))
    return F.element_at(shared, 1)


def zones(docs: DataFrame, zone_rows: int, most: int = 10_000) -> Column:
    """The number of the doc_id's range, from quantiles: about zone_rows rows each, at most `most` ranges."""
    parts = min(most, -(-docs.count() // zone_rows))
    if parts < 2:
        return F.lit(0)
    found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * max(parts, 1000))).first()[0]
    cuts = sorted(set(found or []))
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))  # first among every step-th cut, then among those up to the next
    below = lambda c: c < F.col("doc_id")
    coarse = F.size(F.filter(F.array(*map(F.lit, cuts[step - 1 :: step])), below))
    fine = F.size(F.filter(F.slice(F.array(*map(F.lit, cuts)), coarse * step + 1, step), below))
    return F.coalesce(coarse * step + fine, F.lit(0))


def with_next(docs: DataFrame, columns: list[str], zone_rows: int) -> DataFrame:
    """Adds `next`: the struct of `columns` of the next row by doc_id; the first row's after the last.

    Rows are dealt to ranges of doc_id, which are sorted apart. The first row of each range is read once more by its id and dealt to the range
    before as well, behind its rows, so texts are shuffled once and nothing is joined. No task holds more than some ranges.
    """
    zone, tie = zones(docs.select("doc_id"), zone_rows).alias("zone"), F.xxhash64(*columns).alias("tie")
    ids = docs.select(zone, "doc_id").groupBy("zone").agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).orderBy("zone").collect()
    if not ids:
        return docs.withColumn("next", F.struct(*columns))
    lows = [None if r["nulls"] else r["low"] for r in ids]
    before = {low: ids[i - 1]["zone"] for i, low in enumerate(lows)}
    known = [x for x in lows if x is not None]
    wanted = F.col("doc_id").isin(known) if known else F.lit(False)
    wanted = wanted | F.col("doc_id").isNull() if None in before else wanted
    heads = docs.filter(wanted).groupBy("doc_id").agg(F.min(F.struct(tie, *columns)).alias("first"))
    place = F.lit(before.get(None))
    if known:
        place = F.when(F.col("doc_id").isNull(), place).otherwise(F.element_at(F.create_map(*(F.lit(x) for low in known for x in (low, before[low]))), F.col("doc_id")))
    guests = heads.select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("doc_id", *columns) else F.col(f.name if f.name == "doc_id" else f"first.{f.name}") for f in docs.schema), place.cast("int").alias("zone"), "first.tie", F.lit(1).alias("guest"))
    rows = docs.select("*", zone.cast("int"), tie, F.lit(0).alias("guest")).unionByName(guests)
    in_zone = Window.partitionBy("zone").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    return rows.withColumn("next", F.lead(F.struct(*columns)).over(in_zone)).filter("guest = 0").drop("zone", "tie", "guest")


def fingerprints(docs: DataFrame, k: int = 4, s: int = 1, id_col: str = "doc_id", text_col: str = "text", zone_rows: int = 512) -> DataFrame:
    """Fingerprints and anchors of every text and of its edited text, in which the last half of the characters is taken from the next."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    n, half = F.length("text").cast("long"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = with_next(own, ["text"], zone_rows).select("doc_id", n.alias("n_chars"), "text", F.col("next.text").alias("next_text"), edited.alias("edited"))
    # anchors are made after the shuffle: texts are smaller
    rows = rows.select("doc_id", "n_chars", "edited", anchors(F.col("text"), k, s).alias("anchors"), anchors(F.col("edited"), k, s).alias("edited_anchors"), hashes_of(anchors(F.col("next_text"), k, s)).alias("next_hashes"))
    rows = rows.withColumns({"hashes": hashes_of(F.col("anchors")), "edited_hashes": hashes_of(F.col("edited_anchors"))})
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("hashes")).alias("fingerprint"), as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"), "anchors", "edited_anchors",
    )
