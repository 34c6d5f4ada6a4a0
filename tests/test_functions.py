from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st

from mergewright.functions import phonetic as P
from mergewright.functions import scoring as C
from mergewright.functions import similarity as S
from mergewright.functions import text as T


def one(spark, value, *cols):
    df = spark.createDataFrame([(value,)], "v string")
    return tuple(df.select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).head())


@pytest.mark.parametrize("value, expected", [(" İbrahim  çağrı-ÖZ ", "IBRAHIM CAGRI OZ"), (None, ""), ("", ""), ("ışıl", "ISIL"), ("a.b", "A B")])
def test_names(spark, value, expected):
    assert one(spark, value, T.tr_text("v"))[0] == expected


@pytest.mark.parametrize("value, phone", [("+90 543 038 59 77", "5430385977"), ("0543 038 59 77", "5430385977"), ("12-3", "123"), (None, "")])
def test_phone(spark, value, phone):
    assert one(spark, value, T.clean_phone("v"))[0] == phone


@pytest.mark.parametrize(
    "value, key, similar, base",
    [
        ("do.ga+bagis@gmail.com", "doga@gmail.com", "doga@gmail.com", "do.ga@gmail.com"),
        ("Do.ga+x@x.com", "doga@x.com", "do.ga@x.com", "do.ga@x.com"),
        ("none", "none", "none", ""),
        (None, "", "", ""),
    ],
)
def test_email(spark, value, key, similar, base):
    assert one(spark, value, T.email_key("v"), T.email_similarity_form("v"), T.golden_email("v")) == (key, similar, base)
    assert S.email_form(value) == similar


def test_phonetic(spark):
    assert one(spark, "Ashcraft", P.soundex_tr("v"))[0] == "A226"
    assert one(spark, "", P.soundex_tr("v"), P.metaphone_tr("v")) == ("", "")
    assert one(spark, "hassan wwwx", P.metaphone_tr("v"))[0] == "HSNVKS"
    assert one(spark, "Ayşe Kaya", P.consonant_key(T.tr_text("v")))[0] == "YSKY"


def test_jaro():
    assert round(S.jaro("martha", "marhta"), 4) == 0.9444 and S.jaro_winkler("martha", "marhta") == 0.9611
    assert round(S.jaro("abcxyzw", "bcaxyzw"), 4) == 0.9286
    assert S.jaro("", "a") == 0 and S.jaro("a", "a") == 1


@given(st.text("abcdeğ ", max_size=12), st.text("abcdeğ ", max_size=12))
def test_similarities_in_range(a, b):
    for f in (S.jaro_winkler, S.levenshtein, S.words, S.hybrid, S.word, S.phone, S.email, S.sequence):
        assert 0.0 <= f(a, b) <= 1.0
    assert S.jaro_winkler(a, b) == S.jaro_winkler(b, a)


def test_contacts():
    assert S.phone("054463982", "054362862") == 0.4667 and S.phone("05321112233", "5321112233") == 0.8
    assert S.phone("1234567890", "9999567890") == round(0.7 * SequenceMatcher(None, "1234567890", "9999567890").ratio(), 4) or S.phone("1234567890", "9999567890") == 0.65
    assert S.email("ali.test+k@gmail.com", "alitest@googlemail.com") < 1 and S.email("a.b+x@gmail.com", "ab@gmail.com") == 1.0
    assert S.email("zehra@gmail.com", "zehrabagis@gmail.com") == 0.7333


def test_name_words():
    assert S.words("ahmet m", "ahmet mustafa") == 0.96
    assert S.hybrid("ali veli", "veli ali") == 1.0
    assert S.surname_conflict("ali yilmaz", "veli yilmaz") and S.hybrid("ali yilmaz", "veli yilmaz") <= 0.74


def test_udfs_agree_with_native(spark):
    df = spark.createDataFrame([("Ayşe Kaya", "Ayse Kayah"), ("", "x"), ("abc", "abc")], "a string, b string")
    for r in df.select("a", "b", S.levenshtein_sim("a", "b").alias("l")).collect():
        assert r.l == S.levenshtein(r.a, r.b)


def features(spark, **values):
    df = spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))
    return df, C.Features.of(df)


@pytest.mark.parametrize(
    "values, expected",
    [
        (dict(name_present_both=1, tc_present_both=1, tc_exact_match=1, name_similarity=0), 53.85),
        (dict(name_present_both=1, name_similarity=0.62, first_name_similarity=0.28, surname_similarity=1.0), 64.0),
        (dict(name_present_both=1, tc_present_both=1, tc_exact_match=1, name_similarity=0.8), 90.77),
        (dict(name_present_both=0), 0.0),
    ],
)
def test_weighted_score(spark, values, expected):
    df, f = features(spark, **values)
    assert df.select(C.weighted_score(f)).head()[0] == expected
    assert df.select(C.weighted_breakdown(f).alias("b")).head().b.general_weighted_percent == expected


def test_logistic(spark):
    df, f = features(spark, other=1)
    assert df.select(C.logistic_score(f)).head()[0] == 0.018


def test_thresholds():
    assert C.Thresholds.of() == C.Thresholds(0.97, 0.75, 0.50)
    t = C.Thresholds.of(97, 40, 80)
    assert t.reject <= t.manual <= t.auto


def test_bands(spark):
    row = spark.range(1).select(C.contact_band(F_lit(0.28)), C.contact_band(F_lit(0.9)), C.percent(F_lit(0.28)), C.decision(F_lit(0.99))).head()
    assert tuple(row) == ("weak_match", "strong_match", 28, "pending")


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)
