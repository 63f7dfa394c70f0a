"""The corpus operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sieveline.llm import common, knn, language, mixing, packing, quality, queries, shingles, simhash, suffix_dedup, syncmers, toxicity, url_rules
from sieveline.llm.suffix_array import repeats, suffix_array

DOCS = "doc_id long, text string, source string, lang string, key long, hash string"


def words(rng, n, stems="the of and ring lo mi ta sen"):
    stems = stems.split()
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = words(rng, 70)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[3]] * 3 + [texts[5] + " more", passage + " " + texts[6], texts[7] + " " + passage, "ab " * 900, "x" * 1200, None, "", " \n ", "Ünï cödé 漢字 " * 40, words(rng, 6000), "a", "UPPER lower"]
    sources = ["a", "b", None, "hot", "hot", "hot"]
    out = [(i, t, sources[i % 6], ["en", "de", None][i % 3], i, "clash") for i, t in enumerate(texts)]
    return out + [out[0], (None, "no id here", "a", "en", 1, "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def collected(df):
    return [tuple(r) for r in df.collect()]


# op1


def test_knn_is_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, (400, 8)).round(2)
    v[100:200] = v[100]  # copies: ties go to the smaller id
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, []), (404, [float("inf")]), (405, [0.5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("id", F.lit(2))
    got = {}
    for q, rank, i, s in collected(knn.top_k(df, lambda k: k % 10 == 0, 5, pivots=16, group_rows=8, chunk_rows=64)):
        got.setdefault(q, {})[rank] = (i, s)
    whole = np.zeros((406, 8), np.int64)
    whole[:400] = np.floor(v.astype(np.float32).astype(float) * 256)
    whole[405, 0] = 128
    alive = [*range(400), 403, 405]
    for q in range(0, 400, 10):
        s = whole @ whole[q]
        want = sorted((i for i in alive if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q][r] for r in range(1, 6)] == [(i, s[i]) for i in want]
    assert len(got) == 40


def test_knn_of_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert collected(knn.top_k(spark.createDataFrame([], kind), lambda k: k >= 0)) == []
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1.0, 1.0])], kind)
    assert sorted(collected(knn.top_k(few, lambda k: k == 0, 5))) == [(0, 1, 1, 131072), (0, 2, 2, 65536)]


# op2


def test_fingerprints(docs, rows, none):
    got = {r["doc_id"]: r for r in syncmers.fingerprints(docs, zone_rows=7).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, r in enumerate(order):
        if r[0] in (None, 0):  # its neighbours are ties
            continue
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[r[0]]["n_chars"] == len(text) and got[r[0]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[3]["fingerprint"] == got[40]["fingerprint"] and got[40]["near_next"] == got[41]["near_next"] == 1.0
    assert got[48]["fingerprint"] == "" == got[49]["fingerprint"] and got[48]["near_next"] == 1.0
    assert 0.2 < got[52]["near_edited"] < 0.8 and got[52]["near_next"] < 0.1
    assert syncmers.fingerprints(none).count() == 0


def test_closed_syncmers_stand_at_edges(spark):
    text = words(random.Random(1), 60)
    found = spark.createDataFrame([(text,)], "t string").select(syncmers.anchors(F.col("t"), 4, 1).alias("a"), F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("h")).first()
    h = found["h"]
    want = [i for i in range(len(h) - 3) if min(h[i : i + 4]) in (h[i], h[i + 3])]
    assert [a["position"] for a in found["a"]] == want


# op3


def test_mixing(docs, rows, none):
    got = collected(mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken"))
    assert len(got) == len(rows)
    by = {}
    for _, source, size, source_size, target, taken in got:
        by.setdefault(source, [source_size, target, 0, 0])
        by[source][2] += taken
        by[source][3] = max(by[source][3], size)
        assert taken <= 3 * size and (not size or taken % size == 0)
    total = sum(x[0] for x in by.values())
    assert sum(x[1] for x in by.values()) == pytest.approx(min(total, sum(3 * x[0] for x in by.values())))
    for source_size, target, taken, largest in by.values():
        assert target <= 3 * source_size + 1e-6 and abs(taken - target) <= largest
    assert sorted(got, key=str) == sorted(collected(mixing.mix(docs.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "taken")), key=str)
    assert mixing.mix(none).count() == 0
    copies = Counter(r["doc_id"] for r in mixing.mixture(docs, columns=("text",)).collect())
    assert all(copies[i] == sum(t // s for j, _, s, _, _, t in got if j == i and s) for i in {g[0] for g in got})


def test_mixing_caps_and_reshares(spark):
    rows = [(i, "w " * 10, "a" if i < 2 else "b" if i < 50 else "c") for i in range(100)]
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got["a"] == (20, 60.0) and got["b"] == (480, pytest.approx(940 * 2 / 3)) and got["c"][1] == pytest.approx(940 / 3)


# op4


def brute_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints, radius=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(docs, rows, none):
    got = [(i, t, c) for i, t, c in collected(simhash.near_duplicates(docs).select("doc_id", simhash.as_text(F.col("print")), "component_id"))]
    prints = [brute_print(r[1]) for r in rows]
    roots, least = brute_roots(prints), {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min((x for x in (least.get(root), r[0]) if x is not None), default=None)
    want = [(r[0], format(p, "016x"), least[root]) for r, p, root in zip(rows, prints, roots, strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("crowd", [4096, 3])
def test_links_in_crowds_and_chains(spark, crowd):
    rng, prints = random.Random(2), set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for _ in range(rng.choice([1, 2, 3, 3, 4])):
                p ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, crowd=crowd)).collect()}
    classes = {}
    for p, root in zip(signed, brute_roots(prints), strict=True):
        classes.setdefault(root, []).append(p)
    for own in classes.values():
        assert {found.get(p, p) for p in own} == {min(own)}


# op5


@pytest.mark.parametrize("small", [300, 0])
def test_suffix_arrays(small):
    rng = np.random.default_rng(1)
    for _ in range(150):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 50))
        sa = suffix_array(t, int(t.max()) + 1, small)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        raw = bytes(t.tolist())
        for n in (1, 3):
            starts = Counter(raw[i : i + n] for i in range(len(t) - n + 1))
            assert repeats(t.astype(np.uint8), sa, n, 4).tolist() == [i + n <= len(t) and starts[raw[i : i + n]] > 1 for i in range(len(t))]


def brute_dedup(texts, length):
    seen = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                gone[i : i + length] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("crowd, block", [(4096, 1 << 20), (0, 1 << 20), (4096, 300)])
def test_repeated_passages(docs, rows, none, monkeypatch, crowd, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    got = collected(suffix_dedup.dedup(docs, 64, 16, shard_bytes=2000, crowd=crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept"))
    want = brute_dedup([(r[1] or "").encode() for r in rows], 64)
    assert sorted(((a, b, c, d, bytes(e)) for a, b, c, d, e in got), key=str) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=str)
    if crowd:
        assert suffix_dedup.dedup(none, 64, 16).count() == 0


def test_repeated_passages_of_production_size(spark):
    rng = random.Random(23)
    passage, other = words(rng, 60), words(rng, 45)
    texts = [words(rng, rng.randint(1, 40)) + " " + passage + " " + words(rng, rng.randint(1, 40)) for _ in range(60)]  # keys at its ends have 60 variants
    texts += [other[i:] + words(rng, 30) for i in range(20)] + ["y" * n for n in (199, 200, 201, 700, 900)] + ["ab" * 300, "é" * 150]
    texts += [words(rng, 200_000), texts[0], words(rng, 10) + passage[3:-2] + words(rng, 10)]
    assert len(texts[-3]) > 1 << 20
    docs = spark.createDataFrame([*enumerate(texts), (5, texts[5]), (5, texts[5]), (None, texts[6])], "doc_id long, text string").withColumns({"key": F.lit(1), "mark": F.lit("x"), "n": F.lit(2)}).repartition(4)
    rows = [*enumerate(texts), (5, texts[5]), (5, texts[5]), (None, texts[6])]
    want = sorted(((i, *w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(rows, brute_dedup([t.encode() for _, t in rows], 200), strict=True)), key=str)
    for shard_bytes, crowd in ((1 << 20, 1 << 18), (3000, 600)):
        got = suffix_dedup.dedup(docs, 200, 40, shard_bytes=shard_bytes, crowd=crowd)
        assert sorted(collected(got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))), key=str) == want


def test_whole_characters_stay_valid(docs):
    for r in suffix_dedup.dedup(docs, 64, 16, whole_characters=True).collect():
        bytes(r["kept"]).decode()


# op6


def test_languages(spark, none):
    rng = random.Random(3)
    rows = [(i, words(rng, 40, "the of and ing" if i % 2 else "ung der sch ein"), "en" if i % 2 else "de") for i in range(80)] + [(90, None, "en"), (91, "12 34!", "de"), (92, "", None)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows[:80])
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (90, 91, 92))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert language.identify(none).count() == 0
    untrained = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify(untrained).first()["lang_pred"] == "und"


def test_trigrams_are_bound_letter_by_letter():
    v = language.letter_vectors(64)
    number = (1 * language.SYMBOLS + 2) * language.SYMBOLS + 3  # abc
    assert (language.bound(np.array([number]), 64)[0] == np.roll(v[1], 2) * np.roll(v[2], 1) * v[3]).all()
    assert language.trigrams(b"") .size == 0 == language.trigrams(b"!!").size and language.trigrams(b"ab").size == 2


# op7


def test_url_rules(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "com", "/en/7"), ("allow", "a.example.com", None), ("block", None, "/x")]
    urls = ["http://EXAMPLE.com/en/7", "https://b.example.com/en/8?q", "x://a.example.com", "x://com/en/", "x://ncom/en/", "x://example.com./en/", "x://b.a.example.com/fr#t", "nothing", "", None, "a://b://com/en/7", "x://commerce.org/en/"]
    df = spark.createDataFrame([(i % 9, u) for i, u in enumerate(urls * 40)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = Counter(collected(url_rules.judge(df, spark.createDataFrame(rules, "verdict string, host string, path string"), slice_rows=50)))
    want = Counter()
    for i, u in enumerate(urls * 40):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h) + len(p or ""), len(h), h, p or "", v == "allow", v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, default=None)
        want[(i % 9, host, path, best[2] + best[3] if best else None, best[5] if best else "allow")] += 1
    assert got == want
    assert url_rules.judge(df.limit(0), spark.createDataFrame(rules, "verdict string, host string, path string")).count() == 0


def test_url_rules_of_the_query(spark, tmp_path):
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://www.example.net/de/1", "http://example.net/de/8", "http://b.org/es/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.verdict, r.rule) for r in queries.op7_url_rules(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate([("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]))


# op8


def test_quality(spark, none):
    rng = random.Random(6)
    rows = [(i, words(rng, 40) if i % 4 else "*** | " * rng.randint(5, 30), ["a", "b", None][i % 3], None) for i in range(300)] + [(400, None, "new", "x"), (401, "", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(1, None), (5, 7), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 302 and all(got[i]["predicted"] == int(i % 4 > 0) for i in range(300) if got[i]["held_out"])
    assert got[400]["path_posterior"] == got[400]["host_posterior"]
    unlabelled = quality.classify(docs, labels.limit(0))
    assert {r["score"] for r in unlabelled.collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


def test_sites_shrink_toward_their_parents(spark):
    rows = [("h", "p", 1)] * 90 + [("h", "p", 0)] * 10 + [("h", "q", 0)] + [("i", "p", 0)] * 60 + [("i", "p", 1)] * 40
    hosts, paths, rate = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, good int"))
    host, path = dict(hosts.collect()), {(r[0], r[1]): r[2] for r in paths.collect()}
    assert rate == pytest.approx(130.5 / 202) and 0.4 < host["i"] < rate < host["h"] < 90 / 101
    assert 0 < path["h", "q"] < host["h"] and path["h", "q"] > 0.2


# op9


def test_toxicity(spark, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        own = words(rng, 40).split()
        if i % 3 == 0:
            own[7] = own[20] = rng.choice(["idiotic", "moronic"])
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(1000, words(rng, 40) + " idiotiic"), (1001, None), (1002, "")]
    schema = spark.createDataFrame(labels + [(3, None), (7, 5), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), schema).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == int(i % 3 == 0) for i in held) >= 0.9 * len(held)
    assert got[1000]["score"] > got[1]["score"]  # a misspelling that was never seen
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1001]["score"] == got[1002]["score"]
    assert toxicity.classify(none, schema).count() == 0


# op10


def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(docs, max_len=512, shard_rows=16).toPandas()
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            own = ids[at : at + 512]
            want[(-1 if r[0] is None else r[0], k, at, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes()))] += 1
    assert Counter(got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype("int64").itertuples(index=False, name=None)) == want
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= 512 and own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    assert packing.pack_documents(none).count() == 0


def test_odd_words_have_the_tokenizer_s_ids():
    import public_tokenizers

    words_ = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"), limit=20)
    texts = ["it's DON'T can't,", "a.b-c 12.5x <|endoftext|> <|EndOfText|>a", "Ångström… ÅB é. \xa0x\u2003y \x1c", "中文. İstanbul σΣ ΟΔΟΣ. 😀! don''t K", "", "x" * 500, "the the. the, THE"]
    for own in (texts, texts[::-1]):
        want = [np.asarray(words_.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in own]
        assert words_.encode([t.encode() for t in own]) == want


def test_long_texts_are_encoded_in_parts():
    import public_tokenizers

    rng = random.Random(31)
    texts = [words(rng, 400).encode(), b"", b"a" * 900, words(rng, 3).encode() + b" \n " + b"b" * 300 + b" c, d"]
    words_ = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    parts = [p for own in packing.runs(texts, 256) for p in own]
    assert len(parts) == 4 and len(parts[0]) > 5 and all(b"".join(p).split() for p in (parts[0], parts[2], parts[3]))
    for text, own in zip(texts, parts, strict=True):
        assert b" ".join(own).split() == text.split() and b"".join(words_.encode([p])[0] for p in own) == words_.encode([text])[0]


def test_other_tokenizers_are_refused():
    from pathlib import Path

    import public_tokenizers

    others = [p for p in Path(public_tokenizers.path("word_bpe_49k.json")).parent.glob("*.json") if p.name != "word_bpe_49k.json"]
    refused = 0
    for p in others:
        try:
            packing.WordTokens(str(p))
        except Exception:
            refused += 1
    assert refused == len(others)


def test_packing_is_within_a_sequence_of_the_bound():
    rng = np.random.default_rng(2)
    for _ in range(3):
        lengths = np.minimum(4096, rng.lognormal(6.3, 1.1, 6000).astype(int) + 1)
        bins, offsets = packing.best_two_fit(lengths, 4096)
        assert np.bincount(bins, lengths).max() <= 4096 and bins.max() + 1 <= -(-lengths.sum() // 4096) + 1


def test_two_documents_replace_the_smallest():
    bins, offsets = packing.best_two_fit(np.array([60, 25, 20, 19]), 100)
    assert bins.tolist() == [0, 1, 0, 0] and sorted(offsets.tolist()) == [0, 0, 60, 80]


# the pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    kept = docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, "").write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(kept.count())
        assert k == 4 or kept.columns == corpus_pipeline.COLUMNS, name
    assert docs.count() - 3 == seen[0] > seen[1] >= seen[2] > 0 and seen[4] >= seen[3]


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c, d, e = (words(rng, 80) for _ in range(5))
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (None, b, "en", "s"), (None, b, "en", "s"), (None, b, "en", "t"), (2, c, "en", "s"), (7, c, "en", "s"), (7, d, "en", "s"), (3, e, "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (None, b), (2, c), (7, d), (3, e)], key=str)
    cut = corpus_pipeline.cut_repeated_passages(spark, kept, "")
    assert sorted(r["text"] for r in cut.collect()) == sorted([a, b, c, d, e])  # each is over 200 bytes


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("most", [1 << 22, 300])
def test_groups_of_similar_shingles(spark, most):
    rng = random.Random(12)
    texts = []
    for k in range(40):
        own = words(rng, 150).split()
        texts.append(" ".join(own))
        for n in (1, 2, 3, 4):  # changed words, of similarities about 0.8 to 0.93 and less
            other = list(own)
            for i in range(n):
                other[10 + 30 * i] = f"changed{k}x{n}x{i}"
            texts.append(" ".join(other))
    texts += ["", "one two", "One  two", "one two three", texts[0].upper()]
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                a, b = max(root[i], root[j]), min(root[i], root[j])
                root = [b if r == a else r for r in root]
    found = {r["row"]: r["component"] for r in shingles.groups(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), most).collect()}
    assert len(found) == len(texts) and len(set(root)) == 83  # four changed words are too many
    assert len(set(zip(root, (found[i] for i in range(len(texts))), strict=True))) == len(set(root)) == len(set(found.values()))


def test_language_stage_decides(spark):
    import corpus_pipeline

    rng = random.Random(9)
    clean = [(i, words(rng, 60, "the of and ing" if i % 2 else "ung der sch ein"), "en" if i % 2 else "de") for i in range(300)]
    odd = [(300, words(rng, 60, "при вет как дел"), None), (301, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60)), None), (302, "12 34", "en"), (303, None, "en")]
    unnamed = [(400, words(rng, 60, "the of and ing"), None), (401, words(rng, 60, "ung der sch ein"), "en")]

    def kept(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
        return {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}

    assert kept(clean + odd + unnamed) == {i: lang for i, _, lang in clean} | {400: "en", 401: "de"}
    assert set(kept([(i, t, None) for i, t, _ in clean + odd])) == {i for i in range(302)}  # nothing is trained


def test_toxicity_learns_a_wide_vocabulary():
    rng = random.Random(15)
    bad = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(150)]

    def bag(text):
        each = [toxicity.features(w) for w in toxicity.words(text.encode())]
        total = np.zeros(toxicity.BUCKETS)
        for f in each:
            np.add.at(total, f, 1 / len(f) / len(each))
        own = np.flatnonzero(total)
        return own.astype(np.int32), total[own].astype(np.float32)

    rows = [(t, *bag(words(rng, 12) + (" " + rng.choice(bad[k % 150 : k % 150 + 1]) if t else ""))) for k in range(450) for t in (0, 1)]
    numbers, _ = toxicity.fit(rows)
    spelled = [w[:4] + "q" + w[4:] for w in bad]  # never seen
    assert sum(numbers[toxicity.features(w)].sum() > 0 for w in spelled) >= 0.95 * len(bad)
    assert np.count_nonzero(numbers) > 2000


def test_toxicity_bags_and_scores_by_hand(spark):
    rng = random.Random(17)
    texts = [words(rng, rng.randint(0, 30)) + " " + " ".join(rng.choices(["Straße", "foo,", "foo", "İx", "a\u00a0b", "\u2028"], k=4)) for _ in range(30)] + ["", " \n ", None, "foo " * 3000]
    names, at, ends = toxicity.coded([(t or "").encode() for t in texts])
    known = [np.asarray(toxicity.features(w)) for w in names]
    numbers = np.random.default_rng(1).normal(0, 30, toxicity.BUCKETS)
    docs = spark.createDataFrame([(i % 31, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"score": F.lit("x"), "toxic": F.lit(1)}).repartition(3)
    want, bags_ = [], []
    for i, t in enumerate(texts):
        own = [names[k] for k in at[ends[i] : ends[i + 1]] if names[k]]
        assert own == [w for w in (t or "").lower().split()] or "İ" in (t or "")
        total = np.zeros(toxicity.BUCKETS)
        for w in own:
            f = toxicity.features(w)
            np.add.at(total, f, 1 / len(f) / len(own))
        want.append((i % 31, 1 / (1 + np.exp(-(total @ numbers + 0.25)))))
        bags_.append((i % 31, total))
    got = sorted(collected(toxicity.score(docs, (numbers, 0.25))))
    assert [g[0] for g in got] == [w[0] for w in sorted(want)] and np.allclose([g[1] for g in got], [w[1] for w in sorted(want)])
    made = {(r["doc_id"], len(r["places"])): r for r in toxicity.bags(docs.withColumn("toxic", F.lit(1))).collect()}
    for i, total in bags_:
        r = made[i, np.count_nonzero(total)]
        assert np.allclose(total[list(r["places"])], list(r["weights"]), atol=1e-6)
    assert known and sum(r["places"] == [] for r in made.values()) >= 1


def test_significance_is_the_g_statistic():
    rows = [(1, np.array([0, 2]), None)] * 8 + [(1, np.array([2]), None)] * 2 + [(0, np.array([2]), None)] * 15 + [(0, np.array([0]), None)] * 5
    table = [[8, 5], [2, 15]]
    want = 2 * sum(o * np.log(o * 30 / (sum(table[i]) * sum(r[j] for r in table))) for i in (0, 1) for j in (0, 1) for o in [table[i][j]])
    assert toxicity.significance(rows, 4)[0] == pytest.approx(want) and toxicity.significance(rows, 4)[[1, 3]].tolist() == [0, 0]


def test_knn_with_copies_of_a_query(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (300, 6)).round(2)
    v[0] *= 4
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(0, v[0].tolist())] * 6
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    got = {r: (i, s) for _, r, i, s in collected(knn.top_k(df, lambda key: key == 0, 5, pivots=300, group_rows=1, chunk_rows=64))}
    whole = np.floor(v.astype(np.float32).astype(float) * 256).astype(np.int64)
    s = whole @ whole[0]
    want = sorted(range(1, 300), key=lambda i: (-s[i], i))[:5]
    assert [got.get(r) for r in range(1, 6)] == [(i, s[i]) for i in want]


def test_syncmers_keep_every_anchor(spark):
    rng = random.Random(21)
    make = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    passage = make(50)
    texts = [make(3000) + " " + passage, passage + " " + make(3000)]
    got = {r["doc_id"]: r for r in syncmers.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    a, b = ({x["hash"]: x["position"] for x in got[i]["anchors"]} for i in (0, 1))
    shared = a.keys() & b.keys()
    assert len(a) > 1000 and len(shared) > 10 and {a[h] - b[h] for h in shared} == {3000}
    assert got[0]["near_next"] == pytest.approx(len(shared) / len(a.keys() | b.keys())) and got[0]["near_next"] > 0
    own = {x["hash"] for x in got[0]["edited_anchors"]}
    assert got[0]["near_edited"] == pytest.approx(len(own & a.keys()) / len(own | a.keys()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_looked_up_apart(spark, monkeypatch, how):
    """Hot, rare, absent and null keys; the result is that of a plain join."""
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    rows = spark.createDataFrame([(7, i) for i in range(500)] + [(8, i) for i in range(40)] + [(9, 1), (11, 2), (None, 3)], "key long, n long")
    values = spark.createDataFrame([(7, "a"), (9, "b"), (10, "c")], "key long, v string")
    found = common.looked_up(rows, values, "key", how)
    assert found.columns == rows.join(values, "key", how).columns
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.join(values, "key", how).collect()))
    assert common.looked_up(rows.limit(0), values, "key", how).count() == 0


def test_copies_of_one_text_keep_one_component(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    text = "one and the same sentence of some words"
    rows = [(i, text) for i in range(100, 400)] + [(i, None) for i in range(50)] + [(None, text), (1000, "quite another text of other words here")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"] is None or 100 <= r["doc_id"] < 400, r["component_id"]) for r in found if r["doc_id"] != 1000} == {(True, 100), (False, 0)}


@pytest.mark.parametrize("clusters", [0, 40])
def test_reaches_lose_no_near_vector(clusters):
    """What a group does not need holds none of its queries' best; clustered vectors are mostly not needed."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (3000, 24))
    if clusters:
        x = rng.normal(0, 4, (clusters, 24))[rng.integers(0, clusters, 3000)] + x / 20
    x[:5] = 0
    x = np.floor(256 * x).astype(np.int64)
    known, k = knn.Cells(x[rng.choice(3000, 110, False)]), 5
    cell, d, angle, norm = known.place(x)
    known.least, known.longest = np.full((110, k + 1), np.inf), np.zeros(110)
    for c in range(110):
        own = np.sort(d[cell == c])[: k + 1]
        known.least[c, : len(own)], known.longest[c] = own, norm[cell == c].max(initial=0)
    shares = []
    for at in range(0, 3000, 100):
        group = np.argsort(np.argsort(known.order())[cell], kind="stable")[at : at + 8]
        least_d, least_angle = known.reach(x[group], k)
        needed = (d >= least_d[cell]) & (angle >= least_angle[cell])
        shares.append(needed.mean())
        s = knn.scores(x[group], x)
        s[np.arange(len(group)), group] = np.iinfo(np.int64).min
        kth = np.partition(s, -k, axis=1)[:, -k]
        assert needed[(s >= kth[:, None]).any(0)].all()
    assert np.mean(shares) < 0.3 or not clusters


def test_knn_by_salted_cells(spark):
    """Reaches too many to broadcast, cells in several tasks; rows that repeat count once each."""
    rng = np.random.default_rng(9)
    v = rng.normal(0, 1, (200, 6)).round(2)
    v[50:120] = v[50]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(60, v[60].tolist())] * 3
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for q, r, i, s in collected(knn.top_k(df, lambda key: key % 25 == 0, 5, pivots=10, group_rows=2, chunk_rows=32, most=0, salt_rows=20)):
        got.setdefault(q, {})[r] = (i, s)
    whole, ids = np.floor(np.array([x for _, x in data], np.float32).astype(float) * 256).astype(np.int64), [i for i, _ in data]
    for q in range(0, 200, 25):
        s = whole @ whole[q]
        want = sorted(((ids[j], s[j]) for j in range(len(ids)) if ids[j] != q), key=lambda x: (-x[1], x[0]))[:5]
        assert [got[q][r] for r in range(1, 6)] == want
