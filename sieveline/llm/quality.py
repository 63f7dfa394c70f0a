"""Quality by hierarchical empirical Bayes: a document's own evidence and what its site's labelled documents say.

Evidence: shape features of the whole text, each in 16 bins; the log-likelihood ratio of a bin comes from counts of the labelled documents, and a
document's evidence is the tempered sum of its bins'. Site: the posterior of a host is its labelled rate shrunk toward the global one, that
of a path shrunk toward its host's; how many documents a prior weighs is estimated from how much the rates vary beyond chance (method of
moments). The score is the posterior of the path updated by the evidence. All counts are grouped sums, added up before the shuffle,
so a hot host is no hot task; the table of bins has a fixed size.

Documents have no URL; the query takes the source for the host and the language for the path.

Defined cases: null and empty texts fall into the first bins; a null host or path is one of its own; sites without labels have their parent's
posterior; labels that are null, or neither 0 nor 1, are left out, and a document with several counts as the smallest; without labels every
score is 0.5; rows that repeat are scored each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import WORD, stash
from sieveline.llm.language import held_out

BINS, FEATURES, TEMPER, ABSENT = 16, 9, 0.7, "\u0000"
#: Up to so many sites, their table is broadcast.
MOST_SITES = 50_000
SALTS = 32


def bins(text: Column) -> Column:
    """The places of the text's features, 16 for each."""
    t = F.coalesce(text, F.lit(""))
    n, words = F.greatest(F.length(t), F.lit(1)), F.greatest(F.regexp_count(t, F.lit(WORD)), F.lit(1))
    lines = F.regexp_count(t, F.lit("\n")) + 1
    share = lambda pattern, by: F.regexp_count(t, F.lit(pattern)) / by
    features = [
        F.log2(words),
        n / words,
        40 * share(r"[^\p{L}\p{N}\s]", n),
        100 * share(r"[^\p{L}\p{N}\s]{3}", words) / 4,
        200 * share(r"\p{N}", n),
        50 * share(r"\p{Lu}", n),
        BINS * F.size(F.array_distinct(F.split(t, r"[\x20\x09-\x0D]+"))) / words,
        F.log2(words / lines + 1) * 2,
        100 * share(r"\s\|\s", words) / 4,
    ]
    place = lambda i, x: (i * BINS + F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(BINS - 1))).cast("int")
    return F.array(*(place(i, x) for i, x in enumerate(features)))


def ratios(labelled: DataFrame) -> dict[int, float]:
    """Log-likelihood ratio by bin. labelled: bins, good."""
    rows = labelled.select("good", F.explode("bins").alias("bin")).groupBy("bin").agg(F.sum("good").alias("g"), F.count("*").alias("n")).collect()  # at most 16 a feature
    total = {}
    for r in rows:
        g, n = total.get(r["bin"] // BINS, (0, 0))
        total[r["bin"] // BINS] = g + r["g"], n + r["n"]
    out = {}
    for r in rows:
        g, n = total[r["bin"] // BINS]
        out[r["bin"]] = math.log((r["g"] + 0.5) / (g + 0.5 * BINS)) - math.log((r["n"] - r["g"] + 0.5) / (n - g + 0.5 * BINS))
    return out


def concentration(sites: DataFrame, rate: Column) -> float:
    """How many documents the parent's rate weighs. sites: g, n; rate: that of the parent."""
    r = F.col("g") / F.col("n")
    row = sites.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (r - rate) ** 2).alias("spread"), F.sum(F.col("n") * rate * (1 - rate)).alias("chance")).first()
    if not row["n"] or row["k"] < 2 or row["n"] * row["n"] <= row["nn"]:
        return 1000.0
    p = row["chance"] / row["n"]
    between = (row["spread"] - (row["k"] - 1) * p) / (row["n"] - row["nn"] / row["n"])
    return min(1000.0, max(1.0, p / between - 1)) if between > 0 else 1000.0


def site_posteriors(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(host, posterior), (host, path, posterior) and the global rate. labelled: host, path, good."""
    paths = stash(labelled.groupBy("host", "path").agg(F.sum("good").alias("g"), F.count("*").alias("n")))
    g, n = paths.agg(F.sum("g"), F.sum("n")).first()
    rate = (g + 0.5) / (n + 1) if n else 0.5
    hosts = stash(paths.groupBy("host").agg(F.sum("g").alias("g"), F.sum("n").alias("n")))
    k = concentration(hosts, F.lit(rate))
    hosts = stash(hosts.withColumn("host_posterior", (F.col("g") + k * rate) / (F.col("n") + k)).select("host", "host_posterior"))
    inside = paths.join(hosts, "host")
    k = concentration(inside, F.col("host_posterior"))
    inside = inside.withColumn("path_posterior", (F.col("g") + k * F.col("host_posterior")) / (F.col("n") + k)).select("host", "path", "path_posterior")
    return hosts, stash(inside), rate


def attach(docs: DataFrame, sites: DataFrame, on: list[str]) -> DataFrame:
    if sites.count() <= MOST_SITES:
        return docs.join(F.broadcast(sites), on, "left")
    salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"], "left").drop("salt")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, fold: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, evidence, host_posterior, path_posterior, score, predicted. Learns from the labels outside the fold."""
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    name = lambda c: F.coalesce(c.cast("string"), F.lit(ABSENT))
    own = stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), name(host).alias("host"), name(path).alias("path"), bins(F.col(text_col).cast("string")).alias("bins")))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).filter("good in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"), *fold)).groupBy("doc_id").agg(F.min("good").alias("good"))
    labelled = stash(own.join(known, "doc_id"))
    table, (hosts, paths, rate) = ratios(labelled), site_posteriors(labelled)
    weights = F.array(*(F.lit(float(TEMPER * table.get(i, 0.0))) for i in range(BINS * FEATURES)))
    evidence = F.aggregate("bins", F.lit(0.0), lambda a, b: a + F.get(weights, b))
    rows = attach(attach(own, hosts, ["host"]), paths, ["host", "path"])
    upper = F.coalesce("host_posterior", F.lit(rate))
    rows = rows.select("doc_id", evidence.alias("evidence"), upper.alias("host_posterior"), F.coalesce("path_posterior", upper).alias("path_posterior"))
    score = 1 / (1 + F.exp(-(F.log(F.col("path_posterior") / (1 - F.col("path_posterior"))) + F.col("evidence"))))
    scored = rows.withColumn("score", score)
    return scored.select("doc_id", held_out(F.col("doc_id"), *fold).alias("held_out"), "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
