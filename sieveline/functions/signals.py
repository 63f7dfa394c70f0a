"""The 28 signals of a message as Column expressions: links are read from the raw text, the rest from the normalised one."""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import resources as R
from sieveline.functions import text as T

RAW_IP = r"(?U)https?://(?:\d{1,3}\.){3}\d{1,3}"
ARABIC_SCRIPT = "[\u0600-\u06ff\u0750-\u077f]"


@lru_cache(1)
def lexicons() -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Phrases normalised by the plain specification, without repeats, in order."""
    from sieveline.functions.traced import normalise_traced

    def own(words: list[str]) -> list[str]:
        return list(dict.fromkeys(n for w in words if (n := normalise_traced(w)[0])))

    return {k: own(v) for k, v in R.LEXICONS.items()}, {k: own(v) for k, v in R.BRANDS.items()}


def hits(text: Column, phrases: list[str]) -> Column:
    """Non-overlapping occurrences of each phrase, added up; phrases may overlap each other."""
    count = lambda p: F.when(F.contains(text, F.lit(p)), ((F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)).cast("int")).otherwise(0)
    ascii_, others = [p for p in phrases if p.isascii()], [p for p in phrases if not p.isascii()]
    wide = F.when(F.octet_length(text) > F.length(text), reduce(add, map(count, others), F.lit(0))).otherwise(0)  # in ASCII only phrases of ASCII fit
    return reduce(add, map(count, ascii_), wide)


def count_of(text: Column, characters: str) -> Column:
    """How many characters of the text fit the class; no array of them is made."""
    return F.length(text) - F.length(F.regexp_replace(text, f"(?U){characters}+", ""))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def lookalike(host: Column, legit: list[str], tokens: list[str]) -> Column:
    known = host.isin(legit) | F.rlike(host, F.lit(r"\.(?:" + "|".join(d.replace(".", r"\.") for d in legit) + ")$"))
    return ~known & F.rlike(F.regexp_replace(host, "[^a-z]", ""), F.lit("|".join(tokens)))


def link_signals(text: Column, shorteners=None, tlds=None, legit=None, tokens=None) -> dict[str, Column]:
    """The domain sets are parameters. `text` is the raw text, or the array of its URLs beside it: see with_signals."""
    return link_flags(T.urls(text), text, shorteners, tlds, legit, tokens)


def link_flags(urls: Column, text: Column, shorteners=None, tlds=None, legit=None, tokens=None) -> dict[str, Column]:
    hosts, n = T.hosts_of(urls), F.size(urls)
    ends = F.lit("(?:" + "|".join(t.replace(".", r"\.") for t in tlds or R.SUSPICIOUS_TLDS) + ")$")
    return {
        "url_present": flag(n > 0),
        "url_count": n.cast("double"),
        "url_shortener": flag(F.exists(hosts, lambda h: h.isin(shorteners or R.SHORTENERS))),
        "url_suspicious_tld": flag(F.exists(hosts, lambda h: F.rlike(h, ends))),
        "url_raw_ip": flag(F.rlike(text, F.lit(RAW_IP))),
        "url_brand_lookalike": flag(F.exists(hosts, lambda h: lookalike(h, legit or R.LEGIT_DOMAINS, tokens or R.BRAND_TOKENS))),
    }


def entity_signals(norm: Column) -> dict[str, Column]:
    return entity_flags(*entities(norm))


def entities(norm: Column) -> tuple[Column, Column]:
    """How many phones, and the digits of each amount without leading zeros. Without a currency none fits, which is cheaper to see."""
    phones = F.regexp_count(norm, F.lit(T.PHONE))
    sums = F.when(F.rlike(norm, F.lit(T.CURRENCY)), F.regexp_extract_all(norm, F.lit(T.MONEY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return phones, F.transform(sums, lambda m: F.length(F.regexp_replace(F.regexp_replace(m, r"(?U)[^\d]", ""), r"^0+", "")))


def entity_flags(phones: Column, sums: Column) -> dict[str, Column]:
    most = F.coalesce(F.array_max(sums), F.lit(0))
    return {
        "phone_present": flag(phones > 0),
        "phone_count": phones.cast("double"),
        "money_present": flag(F.size(sums) > 0),
        "money_magnitude": F.when(most < 4, 0.0).otherwise(F.least(most - 3, F.lit(6)).cast("double")),
    }


def wording_signals(norm: Column) -> dict[str, Column]:
    words, brands = lexicons()
    out = {f"lex_{k}": hits(norm, v).cast("double") for k, v in words.items()}
    out["brand_mention"] = reduce(add, (flag(reduce(or_, (F.contains(norm, F.lit(p)) for p in v))) for v in brands.values()))
    return out


def shape_signals(text: Column, norm: Column) -> dict[str, Column]:
    return shape_ratios(text, norm, *scripts(text))


def scripts(text: Column) -> tuple[Column, Column]:
    """Characters of Arabic script and Latin letters."""
    return count_of(text, ARABIC_SCRIPT), F.length(text) - F.length(F.regexp_replace(text, "(?iu)[a-z]+", ""))


def shape_ratios(text: Column, norm: Column, arabic: Column, latin: Column) -> dict[str, Column]:
    n = F.greatest(F.length(text), F.lit(1))
    return {
        "length": F.length(text).cast("double"),
        "digit_ratio": count_of(norm, r"\d") / F.greatest(F.length(norm), F.lit(1)),
        "exclaim_count": count_of(text, "[!]").cast("double"),
        "punct_density": count_of(text, "[!?.,:*#]") / n,
        "upper_ratio": count_of(text, r"\p{Upper}") / n,
        "script_mix_ratio": F.when(arabic + latin > 0, F.least(arabic, latin) / (arabic + latin)).otherwise(0.0),
    }


def with_signals(df: DataFrame, text_col: str = "text", signals_on: str = "raw") -> DataFrame:
    """Adds the signals as columns in their fixed order. A null text counts as empty.

    signals_on="normalised" reads links and shape from the normalised text too, which invisible characters can't lengthen.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    first = df.withColumn("_norm", T.normalise(raw))
    norm = F.col("_norm")
    source = raw if signals_on == "raw" else norm
    phones, sums = entities(norm)
    arabic, latin = scripts(source)
    first = first.withColumns({"_urls": T.urls(source), "_phones": phones, "_sums": sums, "_arabic": arabic, "_latin": latin})  # each used by several signals
    made = link_flags(F.col("_urls"), source) | entity_flags(F.col("_phones"), F.col("_sums")) | wording_signals(norm) | shape_ratios(source, norm, F.col("_arabic"), F.col("_latin"))
    plain = first.withColumns(made)
    brand = F.col("brand_mention") > 0
    joint = {"otp_asks_not_provides": flag((F.col("lex_asks_for_code") > 0) & (F.col("lex_provides_code") == 0)), "brand_and_link": flag(brand & (F.col("url_present") > 0)), "brand_and_lookalike": flag(brand & (F.col("url_brand_lookalike") > 0)), "brand_and_urgency": flag(brand & (F.col("lex_urgency") > 0))}
    return plain.withColumns(joint).select(*df.columns, *R.FEATURES)
