"""The registered queries, each with the SQL that it equals where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import resources as R
from sieveline.functions import signals, traced
from sieveline.functions import text as T
from sieveline.operators import explain as E
from sieveline.operators import features as X
from sieveline.operators import metrics as M
from sieveline.operators import model as L
from sieveline.operators import perturb as V
from sieveline.operators import splits as S
from sieveline.sources.stored import stash
from sieveline.plans.fixtures import MESSAGES, PREDICTIONS, TURNS, draw_sql, messages, predictions, spread, table, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def quoted(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def listed(*values: str) -> str:
    return f"[{quoted(*values)}]"


# Patterns as DuckDB takes them

_URL, _PHONE, _MONEY = R.URL_PATTERN.replace("'", "''"), R.PHONE_PATTERN, R.MONEY_PATTERN


def _normalised(t: str) -> str:
    """The steps on text of ASCII and Latin letters."""
    bare = f"regexp_replace(translate({t}, '{R.INVISIBLE}{R.TATWEEL}', ''), '{R.DIACRITICS}', '', 'g')"
    low = f"lower(translate({bare}, '{R.FOLD_FROM}{R.ARABIC_DIGITS}{R.EXTENDED_DIGITS}', '{R.FOLD_TO}{R.ASCII_DIGITS * 2}'))"
    return f"(SELECT trim(regexp_replace(coalesce(string_agg(c, '' ORDER BY i), ''), '\\s+', ' ', 'g')) FROM (SELECT c, i, lag(c, 1) OVER (ORDER BY i) AS p, lag(c, 2) OVER (ORDER BY i) AS q FROM (SELECT unnest(string_split({low}, '')) AS c, unnest(generate_series(1, length({low}))) AS i)) WHERE coalesce(NOT (c = p AND c = q), true) OR regexp_matches(c, '\\d'))"


def _domain(u: str) -> str:
    return f"regexp_replace(split_part(split_part(lower(regexp_replace({u}, '(?i)^https?://', '')), '/', 1), ':', 1), '^www\\.', '')"


# Text

INJECT = "(.{7})", R.TATWEEL + R.INVISIBLE[0]


@query(rf"""
WITH m AS ({MESSAGES}), x AS (SELECT doc, translate(regexp_replace(text, '(.{{7}})', '\1{INJECT[1]}', 'g'), '{R.ASCII_DIGITS}', '{R.ARABIC_DIGITS}') AS t FROM m)
SELECT doc, {_normalised("t")} AS norm FROM x""")
def normalise_injected(spark, sf_dir):
    raw = V.arabic_digits(F.regexp_replace("text", INJECT[0], "$1" + INJECT[1]))
    return messages(spark, sf_dir).select("doc", T.normalise(raw).alias("norm"))


@query(rf"""
WITH m AS ({MESSAGES}), n AS (SELECT doc, {_normalised("text")} AS t FROM m)
SELECT doc, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{_URL}', ' __url__ ', 'g'), '{_PHONE}', ' __phone__ ', 'g'), '{_MONEY}', ' __money__ ', 'g'), '\b\d{{4,}}\b', ' __num__ ', 'g'), '\s+', ' ', 'g')) AS folded FROM n""")
def fold_entities(spark, sf_dir):
    return messages(spark, sf_dir).select("doc", T.preprocess(F.col("text")).alias("folded"))


@query(f"SELECT host, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(url, '{_URL}'), lambda u: {_domain('u')})) AS host FROM pages) GROUP BY host")
def url_hosts(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.explode(T.domains(F.col("url"))).alias("host"))
    return hosts.groupBy("host").agg(F.count("*").alias("n"))


_LINKS = ["spam-farm.example.org"], [".org", ".net"], ["example.net"], ["cheap", "spam"]


@query(f"""
WITH h AS (SELECT page_id, regexp_extract_all(url, '{_URL}') AS urls, url FROM pages),
d AS (SELECT *, list_transform(urls, lambda u: {_domain("u")}) AS hosts FROM h),
f AS (SELECT page_id, (len(urls) > 0)::INT::DOUBLE AS url_present, len(urls)::DOUBLE AS url_count,
  (len(list_filter(hosts, lambda x: x IN ({quoted(*_LINKS[0])}))) > 0)::INT::DOUBLE AS url_shortener,
  (len(list_filter(hosts, lambda x: ends_with(x, '.org') OR ends_with(x, '.net'))) > 0)::INT::DOUBLE AS url_suspicious_tld,
  regexp_matches(url, 'https?://(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}')::INT::DOUBLE AS url_raw_ip,
  (len(list_filter(hosts, lambda x: NOT (x = 'example.net' OR ends_with(x, '.example.net')) AND regexp_matches(regexp_replace(x, '[^a-z]', '', 'g'), 'cheap|spam'))) > 0)::INT::DOUBLE AS url_brand_lookalike FROM d)
SELECT url_present, url_count, url_shortener, url_suspicious_tld, url_raw_ip, url_brand_lookalike, count(*) AS n FROM f GROUP BY ALL""")
def url_signals(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = signals.link_signals(F.coalesce("url", F.lit("")), *_LINKS)
    rows = table(spark, sf_dir, "pages").select(*(c.alias(k) for k, c in made.items()))
    return rows.groupBy(*made).agg(F.count("*").alias("n"))


def _signals_sql() -> str:
    words, brands = signals.lexicons()
    count = lambda own: " + ".join(f"(length(norm) - length(replace(norm, '{p}', ''))) // {len(p)}" for p in own)
    has = lambda own: "(" + " OR ".join(f"contains(norm, '{p}')" for p in own) + ")::INT"
    flag = lambda c: f"({c})::INT::DOUBLE"
    any_host = lambda c: flag(f"len(list_filter(hosts, lambda x: {c})) > 0")
    ends = lambda own: " OR ".join(f"ends_with(x, '{t}')" for t in own)
    return f"""
WITH m AS ({MESSAGES}), n AS (SELECT doc, text, {_normalised("text")} AS norm, regexp_extract_all(text, '{_URL}') AS urls FROM m),
b AS (SELECT *, list_transform(urls, lambda u: {_domain("u")}) AS hosts, regexp_extract_all(norm, '{_PHONE}') AS phones,
      list_max(list_transform(regexp_extract_all(norm, '{_MONEY}'), lambda s: length(regexp_replace(regexp_replace(s, '[^0-9]', '', 'g'), '^0+', '')))) AS digits, len(regexp_extract_all(norm, '{_MONEY}')) AS sums,
      length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS latin, length(regexp_replace(text, '[^؀-ۿݐ-ݿ]', '', 'g')) AS arabic FROM n),
w AS (SELECT *, {", ".join(f"({count(v)})::DOUBLE AS lex_{k}" for k, v in words.items())}, ({" + ".join(has(v) for v in brands.values())})::DOUBLE AS brand_mention,
      {any_host(f"NOT (x IN ({quoted(*R.LEGIT_DOMAINS)}) OR {ends(['.' + d for d in R.LEGIT_DOMAINS])}) AND regexp_matches(regexp_replace(x, '[^a-z]', '', 'g'), '{'|'.join(R.BRAND_TOKENS)}')")} AS url_brand_lookalike FROM b)
SELECT doc, {flag("len(urls) > 0")} AS url_present, len(urls)::DOUBLE AS url_count, {any_host(f"x IN ({quoted(*R.SHORTENERS)})")} AS url_shortener, {any_host(ends(R.SUSPICIOUS_TLDS))} AS url_suspicious_tld,
  {flag(r"regexp_matches(text, 'https?://(?:\d{1,3}\.){3}\d{1,3}')")} AS url_raw_ip, url_brand_lookalike, {flag("len(phones) > 0")} AS phone_present, len(phones)::DOUBLE AS phone_count,
  {flag("sums > 0")} AS money_present, CASE WHEN coalesce(digits, 0) < 4 THEN 0.0 ELSE least(digits - 3, 6) END::DOUBLE AS money_magnitude,
  {", ".join(f"lex_{k}" for k in words)}, {flag("lex_asks_for_code > 0 AND lex_provides_code = 0")} AS otp_asks_not_provides, brand_mention,
  {flag("brand_mention > 0 AND len(urls) > 0")} AS brand_and_link, {flag("brand_mention > 0 AND url_brand_lookalike > 0")} AS brand_and_lookalike, {flag("brand_mention > 0 AND lex_urgency > 0")} AS brand_and_urgency,
  length(text)::DOUBLE AS length, round(length(regexp_replace(norm, '[^0-9]', '', 'g')) / greatest(length(norm), 1), 9) AS digit_ratio, length(regexp_replace(text, '[^!]', '', 'g'))::DOUBLE AS exclaim_count,
  round(length(regexp_replace(text, '[^!?.,:*#]', '', 'g')) / greatest(length(text), 1), 9) AS punct_density, round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1), 9) AS upper_ratio,
  CASE WHEN latin + arabic > 0 THEN round(least(latin, arabic) / (latin + arabic), 9) ELSE 0.0 END::DOUBLE AS script_mix_ratio FROM w"""


@query(_signals_sql())
def message_signals(spark, sf_dir):
    made = signals.with_signals(messages(spark, sf_dir).select("doc", "text")).drop("text")
    return made.withColumns({c: F.round(c, 9) for c in ("digit_ratio", "punct_density", "upper_ratio", "script_mix_ratio")})


@query(f"SELECT doc, {'replace(' * sum(len(v) > 1 for v in R.romanisation().values())}translate(translate(text, '{''.join(k for k, v in R.romanisation().items() if not v)}', ''), '{''.join(k for k, v in R.romanisation().items() if len(v) == 1)}', '{''.join(v for v in R.romanisation().values() if len(v) == 1)}')" + "".join(f", '{k}', '{v}')" for k, v in R.romanisation().items() if len(v) > 1) + f" AS latin FROM (SELECT doc, translate(text, 'aeiounrslhgw', 'اەئۆوندشڕغخچ') AS text FROM ({MESSAGES}))")
def romanised(spark, sf_dir):
    return messages(spark, sf_dir).select("doc", T.romanise(F.translate("text", "aeiounrslhgw", "اەئۆوندشڕغخچ")).alias("latin"))


# n-grams and TF-IDF


def _by_character() -> Column:
    """The text for n-grams: SQL's lower() takes each character by itself, the JVM's makes two of İ and a final sigma of Σ at the end of a word."""
    return F.translate("text", "İΣ", "iσ")


_WORDS = rf"""WITH t AS ({TURNS}), k AS (SELECT doc, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM t),
g AS (SELECT doc, unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM k), c AS (SELECT doc, term, count(*) AS tf FROM g GROUP BY doc, term)"""
_IDF = ", v AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM t)"


@query(rf"""WITH t AS ({TURNS}), w AS (SELECT doc, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS word FROM t),
p AS (SELECT doc, ' ' || word || ' ' AS w, unnest(generate_series(2, 5)) AS n FROM w), s AS (SELECT doc, w, n, unnest(generate_series(1, greatest(length(w) - n + 1, 1))) AS i FROM p WHERE n = 2 OR n - 1 < length(w)),
c AS (SELECT doc, substr(w, i, n) AS term, count(*) AS tf FROM s GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 60000""")
def char_vocabulary(spark, sf_dir):
    return X.vocabulary(X.term_counts(turns(spark, sf_dir), "doc", X.char_grams(_by_character())), 2, 60_000).select("term", "df", F.col("total").cast("long").alias("total"))


@query(_WORDS + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM c GROUP BY term HAVING count(*) >= 2")
def word_vocabulary(spark, sf_dir):
    return X.vocabulary(X.term_counts(turns(spark, sf_dir), "doc", X.word_grams(_by_character()))).select("term", "df", F.col("total").cast("long").alias("total"))


@query(_WORDS + _IDF + """, r AS (SELECT doc, c.term, (1 + ln(tf)) * (ln((1 + n.n) / (1 + df)) + 1) AS raw FROM c JOIN v ON c.term = v.term, n)
SELECT doc, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)), 7) AS value FROM r""")
def word_tfidf(spark, sf_dir):
    docs = turns(spark, sf_dir)
    counts = stash(X.term_counts(docs, "doc", X.word_grams(_by_character())))
    return X.tfidf(counts, X.idf(X.vocabulary(counts), docs.count())).withColumn("value", F.round("value", 7))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / (SELECT max(abs(l_quantity)) FROM lineitem), 9) AS l_quantity, round(l_discount / (SELECT max(abs(l_discount)) FROM lineitem), 9) AS l_discount FROM lineitem")
def max_abs_scaled(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return X.max_abs_scale(rows, ["l_quantity", "l_discount"]).withColumns({c: F.round(c, 9) for c in ("l_quantity", "l_discount")})


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def standard_scaled(spark, sf_dir):
    return X.standard_scale(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


# Splits

_FOLDS = f"""WITH g AS (SELECT source, min(toxic::VARCHAR) AS stratum FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic IS NOT NULL GROUP BY source),
f AS (SELECT source, ((row_number() OVER (PARTITION BY stratum ORDER BY {draw_sql("'42'", "source")}, source) - 1) % 5)::INT AS fold FROM g)"""


@query(_FOLDS + " SELECT source, fold FROM f")
def group_folds(spark, sf_dir):
    return S.group_folds(predictions(spark, sf_dir), "source", ["label"])


@query(_FOLDS + ", a AS (SELECT fold, count(DISTINCT f.source) AS groups, count(*) AS n FROM f JOIN documents d ON d.source = f.source JOIN labels l ON l.doc_id = d.doc_id WHERE toxic IS NOT NULL GROUP BY fold) SELECT fold = 0 AS test, sum(groups)::BIGINT AS groups, sum(n)::BIGINT AS n, 0::BIGINT AS leaked FROM a GROUP BY ALL")
def split_sizes(spark, sf_dir):
    train, test = S.group_split(predictions(spark, sf_dir), "source", ["label"])
    sizes = lambda df, is_test: df.agg(F.count_distinct("source").alias("groups"), F.count("*").alias("n")).withColumn("test", F.lit(is_test))
    leaked = S.leaked(train, test, "source").agg(F.count("*").alias("leaked"))
    return sizes(train, False).unionByName(sizes(test, True)).crossJoin(F.broadcast(leaked)).select("test", "groups", "n", "leaked")


@query(f"SELECT doc_id, lang FROM documents ORDER BY {draw_sql(chr(39) + '0' + chr(39), 'doc_id::VARCHAR')}, doc_id LIMIT 100")
def random_sample(spark, sf_dir):
    return S.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


@query("SELECT DISTINCT regexp_replace(k, '^(?:ckb|ar)-', '') AS concept FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'ckb-' ELSE 'ar-' END || source || '-' || lang AS k FROM documents)")
def concepts(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "ckb-").otherwise("ar-"), "source", F.lit("-"), "lang").alias("k"))
    return keys.select(S.concept(F.col("k")).alias("concept")).distinct()


# Metrics

_COUNTS = "count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label <> 1 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred <> 1) AS fn, count(*) FILTER (label <> 1 AND pred <> 1) AS tn"


def _rates(source: str, *by: str) -> str:
    part = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} / ({b}), 9) ELSE 0.0 END::DOUBLE"
    return f"""SELECT {"".join(b + ", " for b in by)}tp, fp, fn, tn, {part("tp", "tp + fp")} AS precision, {part("tp", "tp + fn")} AS recall, {part("2 * tp", "2 * tp + fp + fn")} AS f1, {part("fp", "fp + tn")} AS fpr, {part("(tp + tn)", "tp + fp + fn + tn")} AS accuracy FROM ({source})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c, kind in df.dtypes if kind == "double"})


@query(f"SELECT l.label, count(p.doc) FILTER (pred = 0) AS pred_0, count(p.doc) FILTER (pred = 1) AS pred_1 FROM (VALUES (0), (1)) l(label) LEFT JOIN ({PREDICTIONS}) p ON p.label = l.label GROUP BY l.label")
def confusion_matrix(spark, sf_dir):
    return M.confusion(predictions(spark, sf_dir), [0, 1])


@query(_rates(f"SELECT lang, {_COUNTS} FROM ({PREDICTIONS}) GROUP BY lang", "lang"))
def metrics_by_language(spark, sf_dir):
    return _rounded(M.binary_report(predictions(spark, sf_dir), "lang"))


@query(f"SELECT source, round(avg(pred), 9) AS recall, count(*) AS n FROM ({PREDICTIONS}) WHERE label = 1 GROUP BY source")
def recall_by_category(spark, sf_dir):
    return predictions(spark, sf_dir).filter("label = 1").groupBy("source").agg(F.round(F.avg("pred"), 9).alias("recall"), F.count("*").alias("n"))


_ONE = lambda c: f"""SELECT '{c}' AS name, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, 2 * tp / greatest(2 * tp + fp + fn, 1) AS f1, tp + fn AS support
FROM (SELECT count(*) FILTER (label = {c} AND pred = {c}) AS tp, count(*) FILTER (label <> {c} AND pred = {c}) AS fp, count(*) FILTER (label = {c} AND pred <> {c}) AS fn FROM p)"""  # noqa: E731


@query(f"""WITH p AS ({PREDICTIONS}), c AS ({_ONE(0)} UNION ALL {_ONE(1)}), a AS (FROM c UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM c
UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM c)
SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM a""")
def class_report(spark, sf_dir):
    return _rounded(M.class_report(predictions(spark, sf_dir), [0, 1]))


@query(f"""WITH s AS (SELECT score, count(*) AS n, sum(label) AS hits FROM ({PREDICTIONS}) GROUP BY score),
r AS (SELECT hits, sum(n) OVER w AS seen, sum(hits) OVER w AS found FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(hits * found / seen) / sum(hits), 9) AS average_precision FROM r""")
def average_precision(spark, sf_dir):
    return _rounded(M.average_precision(predictions(spark, sf_dir)))


@query(_rates(f"SELECT t / 100 AS threshold, count(*) FILTER (label = 1 AND round(score * 100, 6) >= t) AS tp, count(*) FILTER (label = 0 AND round(score * 100, 6) >= t) AS fp, count(*) FILTER (label = 1 AND round(score * 100, 6) < t) AS fn, count(*) FILTER (label = 0 AND round(score * 100, 6) < t) AS tn FROM ({PREDICTIONS}), generate_series(20, 80, 5) g(t) GROUP BY t", "threshold"))
def threshold_sweep(spark, sf_dir):
    return _rounded(M.threshold_sweep(predictions(spark, sf_dir)))


@query(f"""WITH r AS ({_rates(f"SELECT source, {_COUNTS} FROM ({PREDICTIONS}) GROUP BY source", "source")}) SELECT round(avg(f1), 8) AS mean_f1, round(stddev_pop(f1), 8) AS std_f1, count(*) AS folds FROM r""")
def fold_mean_and_std(spark, sf_dir):
    by = _rounded(M.binary_report(predictions(spark, sf_dir), "source"))
    return by.agg(F.round(F.avg("f1"), 8).alias("mean_f1"), F.round(F.stddev_pop("f1"), 8).alias("std_f1"), F.count("*").alias("folds"))


@query(f"""WITH r AS ({_rates(f"SELECT lang, {_COUNTS} FROM ({PREDICTIONS}) GROUP BY lang", "lang")}) SELECT r.lang, r.recall, r.fpr, r.f1, round(b.f1 - r.f1, 9) AS f1_drop FROM r, r b WHERE b.lang = 'en'""")
def drop_against_baseline(spark, sf_dir):
    report = M.binary_report(predictions(spark, sf_dir), "lang").select("lang", "recall", "fpr", "f1")
    return _rounded(M.against_baseline(_rounded(report), "lang", "en"))


@query(f"SELECT lang, label, source, count(*) AS n FROM ({PREDICTIONS}) WHERE label <> pred GROUP BY ALL")
def error_concentration(spark, sf_dir):
    return predictions(spark, sf_dir).filter("label <> pred").groupBy("lang", "label", "source").agg(F.count("*").alias("n"))


@query(f"SELECT source, count(*) AS n FROM ({PREDICTIONS}) WHERE label <> pred GROUP BY source ORDER BY n DESC, source LIMIT 10")
def worst_groups(spark, sf_dir):
    return predictions(spark, sf_dir).filter("label <> pred").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


_WORST = lambda name, label, order: f"SELECT '{name}' AS kind, source, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score {order}, doc) AS rn FROM p WHERE label = {label} AND pred <> {label}) WHERE rn = 1"


@query(f"WITH p AS ({PREDICTIONS}) {_WORST('fn', 1, 'ASC')} UNION ALL {_WORST('fp', 0, 'DESC')}")
def confident_errors(spark, sf_dir):
    wrong = predictions(spark, sf_dir).filter("label <> pred")

    def first(name, label, order):
        own = wrong.filter(F.col("label") == label).withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(order, "doc")))
        return own.filter("rn = 1").select(F.lit(name).alias("kind"), "source", "doc", "score")

    return first("fn", 1, F.asc("score")).unionByName(first("fp", 0, F.desc("score")))


@query(f"""WITH p AS (SELECT doc, score AS a, CASE WHEN doc % 7 = 0 THEN score + 0.001 ELSE score END AS b FROM ({PREDICTIONS})), d AS (SELECT *, round(abs(a - b), 9) AS d FROM p)
SELECT count(*) AS rows, max(d) AS max_diff, round(avg(d), 9) AS mean_diff, count(*) FILTER ((a >= 0.5) <> (b >= 0.5)) AS label_mismatches, count(*) FILTER (d > 1e-6) AS beyond FROM d""")
def scorer_parity(spark, sf_dir):
    own = predictions(spark, sf_dir).select("doc", "score")
    other = own.withColumn("score", F.when(F.col("doc") % 7 == 0, F.col("score") + 0.001).otherwise(F.col("score")))
    return _rounded(M.parity(own, other, "doc").drop("worst"))


@query(f"SELECT label, round(all_n / (2 * n), 9) AS weight FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS all_n FROM ({PREDICTIONS}) GROUP BY label)")
def class_weights(spark, sf_dir):
    return _rounded(L.class_weights(predictions(spark, sf_dir)))


# Scoring and explanations

_MODEL = f"SELECT term, ({draw_sql(chr(39) + 'w' + chr(39), 'term')} % 2001 - 1000) / 1000 AS weight FROM (SELECT DISTINCT term FROM c)"
_PARTS = _WORDS + f", m AS ({_MODEL}), x AS (SELECT doc, c.term, tf::DOUBLE AS value, weight, tf * weight AS contribution FROM c JOIN m ON c.term = m.term), z AS (SELECT doc, round(1 / (1 + exp(-(sum(contribution) + 0.1))), 9) AS score FROM x GROUP BY doc), q AS (SELECT t.doc, coalesce(score, round(1 / (1 + exp(-0.1)), 9)) AS score FROM t LEFT JOIN z ON t.doc = z.doc), sc AS (SELECT *, CASE WHEN score >= 0.5 THEN 'scam' ELSE 'ham' END AS label FROM q)"


def _scored(spark, sf_dir):
    docs = turns(spark, sf_dir)
    counts = X.term_counts(docs, "doc", X.word_grams(_by_character())).select("doc", "term", F.col("tf").cast("double").alias("value"))
    counts = stash(counts)  # for the model, the scores and the reasons
    weights = counts.select("term").distinct().select("term", ((S.draw("w", F.col("term")) % 2001 - 1000) / 1000).alias("weight"))
    parts = stash(E.contributions(counts, weights))
    return parts, E.scores(docs, parts, 0.1, digits=9)


@query(_PARTS + " SELECT doc, score, label, CASE WHEN label = 'scam' THEN score ELSE round(1 - score, 9) END AS confidence, CASE WHEN label = 'scam' THEN 'Likely a SCAM' ELSE 'Looks legitimate' END AS verdict FROM sc")
def relational_scores(spark, sf_dir):
    scored = _scored(spark, sf_dir)[1]
    return scored.select("doc", "score", "label", F.round(E.confidence(F.col("score"), F.col("label")), 9).alias("confidence"), E.verdict(F.col("label")).alias("verdict"))


_TOP = lambda order: _PARTS + f""", ord AS (SELECT x.*, row_number() OVER (PARTITION BY x.doc ORDER BY {order} DESC, term) AS place FROM x JOIN sc ON x.doc = sc.doc),
top AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY place) AS rank FROM ord WHERE place <= 32 AND abs(contribution) >= 1e-9) SELECT doc, rank::INT AS rank, term, round(contribution, 9) AS contribution FROM top WHERE rank <= 8"""  # noqa: E731


@query(_TOP("CASE WHEN label = 'scam' THEN contribution ELSE -contribution END"))
def top_reasons(spark, sf_dir):
    return _rounded(E.top_reasons(*_scored(spark, sf_dir)).select("doc", "rank", "term", "contribution"))


@query(_TOP("abs(contribution)"))
def top_reasons_by_size(spark, sf_dir):
    return _rounded(E.top_reasons(*_scored(spark, sf_dir), by="absolute").select("doc", "rank", "term", "contribution"))


_REASON = ["url_present", "url_count", "phone_present", "phone_count", "length", "lex_prize", "exclaim_count", "brand_mention", "digit_ratio", "unknown"]
_GLOSS = "VALUES " + ", ".join(f"('{k}', {quoted(v[0])})" for k, v in R.GLOSSES.items())


@query(f"""WITH r AS (SELECT o_orderkey AS doc, i::INT AS rank, {listed(*_REASON)}[i] AS term, ({draw_sql("o_orderkey::VARCHAR", "i::VARCHAR")} % 2001 - 1000) / 1000 AS contribution FROM orders, generate_series(1, 10) g(i) WHERE (o_orderkey + i) % 4 > 0),
l AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.doc = r.doc AND b.term = CASE r.term WHEN 'url_count' THEN 'url_present' WHEN 'phone_count' THEN 'phone_present' END)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rank) AS place FROM l), q AS (SELECT *, max(abs(contribution)) OVER (PARTITION BY doc) AS peak FROM p WHERE place <= 7)
SELECT doc, place::INT AS place, q.term, coalesce(g.gloss, q.term) AS gloss, contribution, CASE WHEN peak > 0 THEN round(greatest(4, abs(contribution) / peak * 100), 6) ELSE 0.0 END::DOUBLE AS width FROM q LEFT JOIN ({_GLOSS}) g(term, gloss) ON g.term = q.term""")
def shown_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank")).filter((F.col("doc") + F.col("rank")) % 4 > 0)
    term = F.element_at(F.array(*map(F.lit, _REASON)), F.col("rank"))
    reasons = rows.select("doc", "rank", term.alias("term"), ((S.draw(F.col("doc"), F.col("rank")) % 2001 - 1000) / 1000).alias("contribution"))
    return E.described(E.shown_reasons(reasons)).select("doc", "place", "term", "gloss", "contribution", F.round("width", 6).alias("width"))


@query("""WITH s AS (SELECT l_orderkey AS doc, (l_partkey % 100)::INT AS lo, (l_partkey % 100 + 1 + l_suppkey % 30)::INT AS hi, l_returnflag || l_linenumber AS label FROM lineitem),
o AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY doc ORDER BY lo, hi DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS upto FROM s)
SELECT doc, greatest(lo, upto) AS lo, hi, label FROM o WHERE lo >= upto OR hi > upto""")
def merged_spans(spark, sf_dir):
    span = F.struct((F.col("l_partkey") % 100).cast("int").alias("lo"), (F.col("l_partkey") % 100 + 1 + F.col("l_suppkey") % 30).cast("int").alias("hi"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("label"))
    by_label = lambda a, b: F.when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(span), by_label).alias("spans"))
    return rows.select("doc", F.explode(traced.merge_spans(F.col("spans"))).alias("s")).select("doc", "s.lo", "s.hi", "s.label")


@query()
def traced_spans(spark, sf_dir):
    return messages(spark, sf_dir).select("doc", traced.marked(F.col("text")).alias("m")).select("doc", "m.spans", "m.fired", "m.n", "m.html")


# Evasions and augmentation

def _chance_sql(*key: str) -> str:
    return f"{draw_sql(*key)} / 4294967296.0"


def _each_sql(change: str) -> str:
    """A text from its characters c at the places i, from 0."""
    return f"array_to_string(list_transform(string_split(t, ''), lambda c, k: {change}), '')"


_I = "(k - 1)::VARCHAR"
_ZW = _each_sql(f"CASE WHEN trim(c) <> '' AND {_chance_sql(quoted('zw'), 'key', _I)} < 0.25 THEN c || {listed(*R.INVISIBLE[:3])}[{draw_sql(quoted('zw2'), 'key', _I)} % 3 + 1] ELSE c END")
_TW = _each_sql(f"CASE WHEN c > 'ؠ' AND c < 'ە' AND {_chance_sql(quoted('tw'), 'key', _I)} < 0.3 THEN c || repeat('{R.TATWEEL}', {draw_sql(quoted('tw2'), 'key', _I)} % 3 + 1) ELSE c END")
_ST = _each_sql(f"CASE WHEN regexp_matches(c, '\\p{{L}}') AND {_chance_sql(quoted('st'), 'key', _I)} < 0.15 THEN repeat(c, {draw_sql(quoted('st2'), 'key', _I)} % 3 + 3) ELSE c END")
_NAMES = "translate(c_name, 'Custome', 'کوستەمر')"
_MARKED = R.romanisation("marked")


def _marked_sql(t: str) -> str:
    longer = [(k, v) for k, v in _MARKED.items() if len(v) > 1]
    one = {k: v for k, v in _MARKED.items() if len(v) == 1}
    return "replace(" * len(longer) + f"translate(translate({t}, '{''.join(k for k, v in _MARKED.items() if not v)}', ''), '{''.join(one)}', '{''.join(one.values())}')" + "".join(f", '{k}', '{v}')" for k, v in longer)


@query(f"""WITH a AS (SELECT c_custkey AS doc, c_custkey::VARCHAR AS key, {_NAMES} AS t FROM customer),
z AS (SELECT doc, key, {_ZW} AS t FROM a), zt AS (SELECT doc, key, {_TW} AS t FROM z)
SELECT doc, 'none' AS variant, t AS evaded FROM a UNION ALL SELECT doc, 'zero-width insertion', t FROM z UNION ALL SELECT doc, 'tatweel padding', {_TW} FROM a UNION ALL SELECT doc, 'letter stretching', {_ST} FROM a
UNION ALL SELECT doc, 'digit-system swap', translate(t, '{R.ASCII_DIGITS}', '{R.ARABIC_DIGITS}') FROM a UNION ALL SELECT doc, 'Latin transliteration', {_marked_sql("t")} FROM a
UNION ALL SELECT doc, 'combined (zw+tatweel+stretch)', {_ST} FROM zt""")
def evasions(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select(F.col("c_custkey").alias("doc"), F.translate("c_name", "Custome", "کوستەمر").alias("text"))
    return V.evaded(rows, "doc").select("doc", "variant", "evaded")


def _pick_sql(values: list[str], *key: str) -> str:
    return f"{listed(*values)}[{draw_sql(*key)} % {len(values)} + 1]"


_KEY = "doc::VARCHAR"


@query(rf"""WITH m AS ({MESSAGES}) SELECT doc, regexp_replace(text, '(?:\+964\s?|00964\s?)?0?7[5789][\d\s\-]{{7,12}}\d', {_pick_sql(R.FAKE_PHONES, quoted("phone"), _KEY)}) AS phone,
  coalesce(regexp_replace(text, '\b\d{{4,}}\b', list_filter({listed(*R.AMOUNTS)}, lambda a: length(a) = length(regexp_extract(text, '\b\d{{4,}}\b')))[{draw_sql(quoted("amount"), _KEY)} % greatest(len(list_filter({listed(*R.AMOUNTS)}, lambda a: length(a) = length(regexp_extract(text, '\b\d{{4,}}\b')))), 1) + 1]), text) AS amount,
  {_pick_sql(R.GREETINGS["ckb"], quoted("greet"), _KEY)} || text AS greeted,
  CASE WHEN {_chance_sql(quoted("pu"), _KEY)} < 0.4 THEN regexp_replace(text, '\.+$', '') || {_pick_sql(R.ENDINGS, quoted("pu2"), _KEY)} ELSE text END AS ended FROM m""")
def augmentation_steps(spark, sf_dir):
    t, key = F.col("text"), F.col("doc")
    return messages(spark, sf_dir).select("doc", V.swap_phone(t, key).alias("phone"), V.swap_amount(t, key).alias("amount"), V.greet(t, key, F.lit("ckb")).alias("greeted"), V.punctuation(t, key).alias("ended"))


@query()
def augmented_corpus(spark, sf_dir):
    seeds = messages(spark, sf_dir).select(F.concat(F.when(F.col("doc") % 2 == 0, "ckb-").otherwise("ar-"), F.col("doc").cast("string")).alias("id"), "text", F.when(F.col("label") == 1, "scam").otherwise("ham").alias("label"), F.when(F.col("doc") % 2 == 0, "ckb").otherwise("ar").alias("lang"))
    return V.augment(seeds, 8)


# Relational operators in use

@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def group_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT text) AS texts FROM documents")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.count_distinct("text").alias("texts"))


@query("SELECT DISTINCT lang FROM documents ORDER BY lang")
def distinct_sorted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang")


@query("SELECT lang, avg((n_chars > 1000)::INT) AS long_share, count(*) FILTER (source = 'src1') AS src1 FROM documents GROUP BY lang")
def masked_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg((F.col("n_chars") > 1000).cast("int")).alias("long_share"), F.count_if(F.col("source") == "src1").alias("src1"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def first_per_key(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").withColumn("rn", rank).filter("rn = 1").drop("rn")


@query("SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def shared_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.filter("lang = 'en'").select("source").intersect(docs.filter("lang = 'fr'").select("source"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS hash FROM documents GROUP BY text")
def exact_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"))
