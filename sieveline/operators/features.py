"""n-grams, vocabularies, TF-IDF and scaling, in long form: one row per (document, term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import text as T


def char_grams(text: Column, low: int = 2, high: int = 5) -> Column:
    """n-grams of each word with a blank on both sides; a word no longer than n is given once, and not again for longer n."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), rf"(?U){T.SPACE}+", " "), " "), lambda w: w != "")

    def of_word(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(w)

        def of_size(n: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
            return F.transform(starts, lambda i: F.substring(w, i, n))

        # a size beyond the first that reaches the whole word adds nothing
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n == low) | (n - 1 < size))
        return F.flatten(F.transform(sizes, of_size))

    return F.flatten(F.transform(words, of_word))


def word_grams(text: Column, bigrams: bool = True) -> Column:
    """Runs of two or more word characters, and pairs of neighbours."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(T.WORD + "{2,}"), F.lit(0))
    if not bigrams:
        return tokens

    def with_pairs(own: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(own) - 1), lambda i: F.concat_ws(" ", F.get(own, i - 1), F.get(own, i)))
        return F.when(F.size(own) > 1, F.concat(own, pairs)).otherwise(own)

    return T.once(tokens, with_pairs)


def term_counts(docs: DataFrame, id_col: str, grams: Column) -> DataFrame:
    """doc, term, tf: a term once a document. Counted inside the row before rows are made, so that repeats never meet a shuffle.

    Only where rows share an id are their counts added up.
    """

    def counted(g: Column) -> Column:
        n = F.size(g)
        firsts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == 1) | (F.get(g, i - 1) != F.get(g, i - 2))))
        return T.once(firsts, lambda at: F.transform(at, lambda a, k: F.struct(F.get(g, a - 1).alias("term"), (F.coalesce(F.get(at, k + 1), n + 1) - a).alias("tf"))))

    rows = docs.select(F.col(id_col).alias("doc"), F.explode(T.once(F.sort_array(grams), counted)).alias("t")).select("doc", "t.term", "t.tf")
    shared = docs.groupBy(id_col).agg(F.count("*").alias("_n")).filter("_n > 1")
    return rows if shared.isEmpty() else rows.groupBy("doc", "term").agg(F.sum("tf").alias("tf"))


def vocabulary(counts: DataFrame, min_df: int = 2, most: int | None = None) -> DataFrame:
    """term, df, total of the terms in at least min_df documents; at most the `most` most frequent, ties by term."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    return terms.orderBy(F.desc("total"), "term").limit(most) if most else terms


def idf(vocabulary_: DataFrame, n_docs: int) -> DataFrame:
    return vocabulary_.withColumn("idf", F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)


def tfidf(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """doc, term, value: (1 + ln tf) * idf, each document scaled to length 1. The join is an inner one, as unknown terms drop out."""
    raw = counts.join(weights.select("term", "idf"), "term").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("raw") / norm).alias("value"))


def max_abs_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column by its largest absolute value; a column of zeros stays."""
    most = df.agg(*(F.max(F.abs(c)).alias(f"_{c}") for c in columns))
    wide = df.crossJoin(F.broadcast(most))  # one row
    return wide.withColumns({c: F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(df.columns)


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column centred and divided by its population deviation; a constant column becomes zeros."""
    stats = df.agg(*(F.avg(c).alias(f"_m{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s{c}") for c in columns))
    wide = df.crossJoin(F.broadcast(stats))  # one row
    return wide.withColumns({c: (F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") > 0, F.col(f"_s{c}")).otherwise(1.0) for c in columns}).select(df.columns)
