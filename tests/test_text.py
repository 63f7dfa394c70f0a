"""Column expressions against a plain specification of the same steps."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.functions import resources as R
from sieveline.functions import text as T
from sieveline.functions.traced import normalise_traced, spans_of

CASES = ["", "abc", "  a \t b ", "soooo goood 1000000", "ﻻ ﷺ ㎏", "ﹱx", "١٢٣ ۴۵۶", "كتاب ى ة أإآٱؤ ەئ", "ﬁ½ΣΑΣ", "a​b‍c‏d", "ســـلام", "مُحَمَّد", "😀😀😀😀", "\x1c\x1fa\x1d\x1db", "ŁÓDŹ", "x؀y", "１２３ＡＢ"]


def plain(text):
    drop, out = set(R.INVISIBLE + R.TATWEEL), []
    fold = dict(zip(R.FOLD_FROM + R.ARABIC_DIGITS + R.EXTENDED_DIGITS, R.FOLD_TO + R.ASCII_DIGITS * 2, strict=True))
    for ch in text:
        if ch in drop or re.match(R.DIACRITICS, ch):
            continue
        for c in "".join(fold.get(x, x) for x in unicodedata.normalize("NFKC", ch)).lower():
            if c.isdigit() or out[-2:] != [c, c]:
                out.append(c)
    return re.sub(r"\s+", " ", "".join(out)).strip()


def test_normalise_matches_the_specification(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string").select("i", T.normalise(T.F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: plain(t) for i, t in enumerate(CASES)}


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_traced_text_and_offsets(text):
    norm, at = normalise_traced(text)
    assert norm == plain(text) and len(at) == len(norm) and at == sorted(at) and all(0 <= i < len(text) for i in at)


def test_presentation_form_keeps_its_marks():
    assert normalise_traced("ﹱ")[0] == "ـً"


@pytest.mark.parametrize("raw, folded", [("see https://a.b/c now", "see __url__ now"), ("call 0750 123 4567", "call __phone__"), ("250,000 iqd", "__money__"), ("pin 12345", "pin __num__"), ("x.company", "__url__ pany"), ("500 $", "500 $")])
def test_fold_entities(spark, raw, folded):
    assert spark.createDataFrame([(raw,)], "t string").select(T.fold_entities(T.F.col("t"))).first()[0] == folded


def test_null_text_stays_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(T.normalise(T.F.col("t"))).first()[0] is None


def test_domains(spark):
    t = "HTTP://WWW.Zain.com:80/x and zaincash.iq?x, bit.ly/a"
    assert spark.createDataFrame([(t,)], "t string").select(T.domains(T.F.col("t"))).first()[0] == ["zain.com", "zaincash.iq"]  # ly is no top-level domain of the pattern


def test_spans_point_into_the_raw_text():
    text = "URG​ENT: call 0750 123 4567"
    found = {label: text[a:b] for a, b, label in spans_of(text)}
    assert found["urgency"] == "URG​ENT" and found["phone"] == "0750 123 4567"
