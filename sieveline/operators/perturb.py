"""Evasions and augmentation as Columns; random choices are hashes of a key, so reruns and partitions agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import resources as R
from sieveline.functions import text as T
from sieveline.operators.splits import chance, draw

LETTER = r"\p{L}"


def _each(text: Column, change) -> Column:
    """Joins change(character, place) over the characters."""
    return F.array_join(F.transform(T.chars(text), change), "")


def zero_width(text: Column, key: Column) -> Column:
    """An invisible character after a quarter of the characters that are no blanks."""
    marks = F.array(*map(F.lit, R.INVISIBLE[:3]))
    mark = lambda i: F.get(marks, (draw("zw2", key, i) % 3).cast("int"))
    return _each(text, lambda c, i: F.when((F.trim(c) != "") & (chance("zw", key, i) < 0.25), F.concat(c, mark(i))).otherwise(c))


def tatweel(text: Column, key: Column) -> Column:
    """One to three tatweels after 30% of the characters strictly between U+0620 and U+06D5."""
    inside = lambda c: (c > "ؠ") & (c < "ە")
    return _each(text, lambda c, i: F.when(inside(c) & (chance("tw", key, i) < 0.3), F.concat(c, F.repeat(F.lit(R.TATWEEL), (draw("tw2", key, i) % 3 + 1).cast("int")))).otherwise(c))


def stretch(text: Column, key: Column) -> Column:
    """15% of the letters three to five times."""
    return _each(text, lambda c, i: F.when(F.rlike(c, F.lit(LETTER)) & (chance("st", key, i) < 0.15), F.repeat(c, (draw("st2", key, i) % 3 + 3).cast("int"))).otherwise(c))


def arabic_digits(text: Column, key: Column | None = None) -> Column:
    return F.translate(text, R.ASCII_DIGITS, R.ARABIC_DIGITS)


def marked_latin(text: Column, key: Column | None = None) -> Column:
    """The romanisation that training never sees."""
    return T.romanise(text, "marked")


def shifted(text: Column, key: Column) -> Column:
    return tatweel(zero_width(text, key), key)


def combined(text: Column, key: Column) -> Column:
    return stretch(shifted(text, key), key)


EVASIONS = {"zero-width insertion": zero_width, "tatweel padding": tatweel, "letter stretching": stretch, "digit-system swap": arabic_digits, "Latin transliteration": marked_latin, "combined (zw+tatweel+stretch)": combined}


def evaded(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Each row once as it is (variant none) and once for each evasion; one scan, rows made by explode."""
    text, id_ = F.col(text_col), F.col(key)
    rows = df.withColumn("_zw", zero_width(text, id_))  # of two variants
    own = {"zero-width insertion": F.col("_zw"), "combined (zw+tatweel+stretch)": stretch(tatweel(F.col("_zw"), id_), id_)}
    variants = {"none": text} | {n: own[n] if n in own else f(text, id_) for n, f in EVASIONS.items()}
    made = F.array(*(F.struct(F.lit(n).alias("variant"), c.alias("evaded")) for n, c in variants.items()))
    return rows.select("*", F.explode(made).alias("_v")).select(*df.columns, "_v.variant", "_v.evaded")


# Augmentation

PHONE_ANY = r"(?U)(?:\+964\s?|00964\s?)?0?7[5789][\d\s\-]{7,12}\d"
URL_ANY = r"(?iuU)(?:https?://)?(?:[\w-]+\.)+[a-z]{2,6}(?:/[\w\-/]*)?"
RUN = T.LONG_NUMBER


def pick(values: list[str], *key) -> Column:
    return F.get(F.array(*map(F.lit, values)), (draw(*key) % len(values)).cast("int"))


def replace_first(text: Column, pattern: str, new) -> Column:
    """new: from the match to its replacement. Without a match the text stays."""

    def changed(m: Column) -> Column:
        at = F.position(m, text)
        return F.when(F.coalesce(m, F.lit("")) == "", text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), new(m), F.substring(text, at + F.length(m), F.length(text))))

    return T.once(F.regexp_substr(text, F.lit(pattern)), changed)


def swap_phone(text: Column, key: Column) -> Column:
    return replace_first(text, PHONE_ANY, lambda m: pick(R.FAKE_PHONES, "phone", key))


def brand_in(text: Column) -> Column:
    """The first brand of which a marker is in the text."""
    out = None
    for brand, markers in R.BRAND_MARKERS.items():
        has = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))
        out = F.when(has, brand) if out is None else out.when(has, brand)
    return out


def swap_host(text: Column, key: Column, scam: Column) -> Column:
    """Scams get any host of the pool, others one of the same brand; links without a letter stay."""
    host = pick(R.SCAM_HOSTS, "host", key)
    scheme = F.when(chance("scheme", key) < 0.7, "http://").otherwise("")
    path = F.when(chance("path", key) < 0.6, F.concat(F.lit("/"), pick(R.SCAM_PATHS, "path2", key))).otherwise("")
    for_scam = F.when(F.startswith(host, F.lit("http")), host).otherwise(F.concat(scheme, host, path))

    def of_brand(brand: Column) -> Column:
        out = None
        for name, hosts in R.HOSTS_OF_BRAND.items():
            own = pick(hosts, "legit", key)
            out = F.when(brand == name, own) if out is None else out.when(brand == name, own)
        return out

    for_ham = T.once(brand_in(text), of_brand)
    return replace_first(text, URL_ANY, lambda m: F.when(~F.rlike(m, F.lit("(?i)[a-z]")), m).when(scam, for_scam).otherwise(F.coalesce(for_ham, m)))


def swap_amount(text: Column, key: Column) -> Column:
    """The first long number by another of equal width, if the pool has one."""

    def new(m: Column) -> Column:
        same = F.filter(F.array(*map(F.lit, R.AMOUNTS)), lambda a: F.length(a) == F.length(m))
        return F.coalesce(F.get(same, (draw("amount", key) % F.greatest(F.size(same), F.lit(1))).cast("int")), m)

    return replace_first(text, RUN, new)


def greet(text: Column, key: Column, lang: Column) -> Column:
    greeting = F.when(lang == "ckb", pick(R.GREETINGS["ckb"], "greet", key)).otherwise(pick(R.GREETINGS["ar"], "greet", key))
    greeted = F.exists(F.array(*map(F.lit, R.GREETED)), lambda g: F.startswith(text, g))
    return F.when(greeted, text).otherwise(F.concat(greeting, text))


def arabic_keyboard(text: Column, key: Column, lang: Column) -> Column:
    """70% of the Kurdish yeh and kaf in Arabic forms; in Arabic, 30% of word-final heh as teh marbuta."""

    def changed(all_: Column) -> Column:
        def change(c: Column, i: Column) -> Column:
            last = ~F.rlike(F.coalesce(F.get(all_, i + 1), F.lit(" ")), F.lit(LETTER))
            teh = (lang == "ar") & (c == "ه") & (i > 0) & last & (chance("teh", key, i) < 0.3)
            return F.when(c.isin("ی", "ک") & (chance("kb", key, i) < 0.7), F.translate(c, "یک", "يك")).when(teh, F.lit("ة")).otherwise(c)

        return F.array_join(F.transform(all_, change), "")

    # a text without any of these letters stays
    return F.when(F.rlike(text, F.lit("[یکه]")), T.once(T.chars(text), changed)).otherwise(text)


def swap_digits(text: Column, key: Column) -> Column:
    """Another digit system outside of URLs."""
    links = F.filter(F.regexp_extract_all(text, F.lit(URL_ANY), F.lit(0)), lambda u: F.rlike(u, F.lit("(?i)[a-z]")))
    between = F.split(F.regexp_replace(text, rf"(?=.*){URL_ANY}".replace("(?=.*)(?iuU)", "(?iuU)(?=[^\\s]*[a-z])"), "\u0001"), "\u0001")
    other = F.when(chance("digits", key) < 0.5, R.ARABIC_DIGITS).otherwise(R.EXTENDED_DIGITS)
    moved = F.transform(between, lambda p: F.when(other == R.ARABIC_DIGITS, F.translate(p, R.ASCII_DIGITS, R.ARABIC_DIGITS)).otherwise(F.translate(p, R.ASCII_DIGITS, R.EXTENDED_DIGITS)))
    joined = F.array_join(F.transform(moved, lambda p, i: F.concat(p, F.coalesce(F.get(links, i), F.lit("")))), "")
    return F.when(F.size(links) == F.size(between) - 1, joined).otherwise(text)


def partly_latin(text: Column, key: Column) -> Column:
    """The whole message in Latin letters (55%), or a run of its Arabic-script words."""
    arabic = lambda w: F.rlike(w, F.lit("[؀-ۿ]")) & ~F.startswith(w, F.lit("__"))

    def chosen(places: Column) -> Column:
        n = F.size(places)
        start = (draw("from", key) % F.greatest(n, F.lit(1))).cast("int")
        count = (draw("run", key) % F.greatest(F.floor(n / 2), F.lit(1)) + 1).cast("int")
        return F.when(chance("whole", key) < 0.55, places).when(n < 2, F.array().cast("array<int>")).otherwise(F.slice(places, start + 1, count))

    def changed(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: arabic(F.get(words, i)))
        own = lambda at: F.transform(words, lambda w, i: F.when(F.array_contains(at, i), T.romanise(w)).otherwise(w))
        return F.array_join(T.once(T.once(places, chosen), own), " ")

    return T.once(F.split(text, " "), changed)


def spacing(text: Column, key: Column) -> Column:
    first = lambda t, a, b: replace_first(t, a, lambda m: F.lit(b))
    text = F.when(chance("sp1", key) < 0.5, first(text, "، ", "،")).otherwise(text)
    text = F.when(chance("sp2", key) < 0.5, first(text, " ", "  ")).otherwise(text)
    return F.when(chance("sp3", key) < 0.3, first(text, r"\.", " .")).otherwise(text)


def punctuation(text: Column, key: Column) -> Column:
    return F.when(chance("pu", key) < 0.4, F.concat(F.regexp_replace(text, r"\.+$", ""), pick(R.ENDINGS, "pu2", key))).otherwise(text)


def _maybe(condition: Column, change):
    return lambda t: F.when(condition, change(t)).otherwise(t)


def attempt(text: Column, key: Column, lang: Column, scam: Column) -> Column:
    """The text after each step that the key's draws choose."""
    steps = [("a1", 0.7, lambda t: swap_phone(t, key)), ("a2", 0.7, lambda t: swap_host(t, key, scam)), ("a3", 0.6, lambda t: swap_amount(t, key)), ("a4", 0.5, lambda t: greet(t, key, lang)), ("a5", 0.45, lambda t: arabic_keyboard(t, key, lang)), ("a6", 0.35, lambda t: swap_digits(t, key)), ("a7", 0.22, lambda t: partly_latin(t, key)), ("a8", 0.5, lambda t: spacing(t, key)), ("a9", 0.4, lambda t: punctuation(t, key))]
    made = F.array(text)
    for name, p, change in steps:  # a lambda's argument is made once, however often the step names it
        made = F.transform(made, _maybe(chance(name, key) < p, change))
    return F.element_at(made, 1)


def augment(seeds: DataFrame, n: int = 16) -> DataFrame:
    """n rows per seed (id, text, label, lang): variant 0 as it is, then distinct variants from up to 12n attempts.

    A seed's attempts are made one after the other inside its row, up to the n-th distinct text, so nothing is made that isn't kept
    or a repeat, and nothing but the seeds is ever shuffled.
    """
    lang, scam = F.col("lang"), F.col("label") == "scam"

    def more(kept: Column, i: Column) -> Column:
        of = T.once(F.concat_ws("|", F.col("id"), i), lambda key: attempt(F.col("text"), key, lang, scam))
        added = lambda t: F.when(F.exists(kept, lambda x: x.eqNullSafe(t)), kept).otherwise(F.array_append(kept, t))
        return F.when(F.size(kept) >= n, kept).otherwise(T.once(of, added))

    texts = F.aggregate(F.sequence(F.lit(1), F.lit(12 * n)), F.array("text"), more)
    rows = seeds.filter("id is not null").select("*", F.posexplode(texts).alias("variant", "_text"))
    return rows.select(F.col("_text").alias("text"), "label", "lang", *(c for c in ("category", "source") if c in seeds.columns), F.col("id").alias("seed_id"), F.regexp_replace("id", "^(?:ckb|ar)-", "").alias("concept_id"), "variant")
