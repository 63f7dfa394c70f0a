"""Normalisation, entities and romanisation as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import resources as R

#: A character of a word and white space, as Python's patterns see them.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f]"
NO_WORD_BEFORE, NO_WORD_AFTER, WORD_BEFORE, WORD_AFTER = f"(?<!{WORD})", f"(?!{WORD})", f"(?<={WORD})", f"(?={WORD})"

_HOST = rf"{NO_WORD_BEFORE}(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:{R.TLDS})"
URL = rf"""(?iuU)(?:https?://|www\.)[^\s\x1c-\x1f<>"']+|{_HOST}(?:/[^\s\x1c-\x1f<>"']*)?"""
PHONE = rf"(?U)(?:(?:\+|00){SPACE}?964[\s\x1c-\x1f\-.]?|0){SPACE}?7[5789][\s\x1c-\x1f\-.]?\d[\s\x1c-\x1f\-.]?\d{{3}}[\s\x1c-\x1f\-.]?\d{{4}}"
_AMOUNT = r"\d[\d,،.\s\x1c-\x1f]{0,15}\d"
_AFTER = "|".join(c + (WORD_AFTER if c == r"\$" else NO_WORD_AFTER) for c in R.CURRENCIES)
_BEFORE = "|".join((WORD_BEFORE if c == r"\$" else NO_WORD_BEFORE) + c for c in R.CURRENCIES)
MONEY = rf"(?iuU){_AMOUNT}{SPACE}*(?:{_AFTER})|(?:{_BEFORE}){SPACE}*{_AMOUNT}"
CURRENCY = rf"(?iuU){'|'.join(R.CURRENCIES)}"  #: without which MONEY can't fit
LONG_NUMBER = rf"(?U){NO_WORD_BEFORE}\d{{4,}}{NO_WORD_AFTER}"


def once(value: Column, use) -> Column:
    """use(value), with the value made once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chars(text: Column) -> Column:
    """The characters of the text as an array; none for ''."""
    return F.array_remove(F.split(text, ""), "")  # text is named once, so chains of such changes stay short


def squeeze(text: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def strip_marks(text: Column) -> Column:
    """Drops invisible characters, tatweel and diacritics."""
    return F.regexp_replace(F.translate(text, R.INVISIBLE + R.TATWEEL, ""), R.DIACRITICS, "")


def compatible(text: Column) -> Column:
    """NFKC of each character by itself: a translation, and a look at each character only where one expands to several. ASCII stays."""
    source, target, longer = R.compatibility()
    table = F.expr("str_to_map('{}', '\\u0001', '\\u0002')".format("\\u0001".join(f"{_literal(k)}\\u0002{_literal(v)}" for k, v in longer.items())))
    single = lambda t: F.translate(t, source, target)
    spread = lambda t: F.array_join(F.transform(chars(t), lambda c: F.coalesce(F.element_at(table, c), single(c))), "")
    expands = lambda t: F.rlike(t, F.lit(R.character_class(longer)))
    return once(text, lambda t: F.when(F.octet_length(t) == F.length(t), t).when(expands(t), spread(t)).otherwise(single(t)))


def _literal(text: str) -> str:
    """For a literal in Spark SQL."""
    return "".join(f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}" for c in text)


def fold_letters(text: Column) -> Column:
    return F.translate(text, R.FOLD_FROM + R.ARABIC_DIGITS + R.EXTENDED_DIGITS, R.FOLD_TO + R.ASCII_DIGITS * 2)


def lower(text: Column) -> Column:
    """Lower case of each character by itself: a capital sigma is no final one."""
    return F.lower(F.translate(text, "Σ", "σ"))


def collapse_runs(text: Column) -> Column:
    """Three or more of the same character, digits excepted, to two."""
    return F.regexp_replace(text, r"(?Us)(\D)\1{2,}", "$1$1")


def normalise(text: Column) -> Column:
    return squeeze(collapse_runs(lower(fold_letters(compatible(strip_marks(text))))))


def fold_entities(text: Column) -> Column:
    """URLs, then phones, amounts and long numbers become placeholders."""
    for pattern, name in ((URL, "url"), (PHONE, "phone"), (MONEY, "money"), (LONG_NUMBER, "num")):
        text = F.regexp_replace(text, pattern, f" {R.PLACEHOLDERS[name]} ")
    return squeeze(text)


def preprocess(text: Column, normalised: bool = True, folded: bool = True) -> Column:
    text = normalise(text) if normalised else text
    return fold_entities(text) if folded else text


def romanise(text: Column, style: str = "ascii") -> Column:
    """Each letter by its Latin letters; others stay."""
    table = R.romanisation(style)
    one = {k: v for k, v in table.items() if len(v) == 1}
    text = F.translate(text, "".join(k for k, v in table.items() if not v), "")
    text = F.translate(text, "".join(one), "".join(one.values()))
    for k, v in table.items():
        if len(v) > 1:
            text = F.replace(text, F.lit(k), F.lit(v))
    return text


def urls(text: Column) -> Column:
    """The URLs of the text; the pattern is only tried on texts that hold a dot or a scheme, without which it can't fit."""
    return F.when(F.contains(text, F.lit(".")) | F.contains(text, F.lit("://")), F.regexp_extract_all(text, F.lit(URL), F.lit(0))).otherwise(F.array().cast("array<string>"))


def domains(text: Column) -> Column:
    """The hosts of the text's URLs: no scheme, path, port or leading www., lower case."""
    return hosts_of(urls(text))


def hosts_of(found: Column) -> Column:

    def host(url: Column) -> Column:
        bare = F.lower(F.regexp_replace(url, "(?i)^https?://", ""))
        return F.regexp_replace(F.substring_index(F.substring_index(bare, "/", 1), ":", 1), r"^www\.", "")

    return F.transform(found, host)
