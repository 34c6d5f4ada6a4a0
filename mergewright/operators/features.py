"""Features of candidate pairs. Flags and edit distance are column expressions over values cleaned once a record; what needs Python is one Arrow pass."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..functions import similarity as S
from ..functions.text import name_form, surname_or_only, text, tokens
from .blocking import with_records

#: The columns of normalized records that pairs need.
COLUMNS = ["clean_name", "clean_name_ordered", "clean_tc", "clean_phone", "clean_email", "email_normalized_key", "clean_city", "clean_address", "clean_muhatap_no", "name_phonetic_key", "name_metaphone_key", "first_name", "last_name"]

SCORES = ["first_name_similarity", "surname_similarity", "first_name_jaro_winkler", "surname_jaro_winkler", "name_token_similarity", "name_similarity", "name_levenshtein_similarity", "phone_similarity", "email_similarity", "email_username_similarity", "address_similarity"]


_KIND = StructType([*(StructField(n, DoubleType()) for n in SCORES), StructField("surname_conflict", BooleanType())])


@F.pandas_udf(_KIND)
def _rules_scores(v: pd.DataFrame) -> pd.DataFrame:
    out = []
    for lo, ro, ln, rn, lp, rp, le, re_, la, ra in v.itertuples(index=False):
        lt, rt = lo.split(), ro.split()
        lf, rf, ls, rs = *(x[0] if x else "" for x in (lt, rt)), *(x[-1] if x else "" for x in (lt, rt))
        out.append((S.best_of_three(lf, rf), S.best_of_three(ls, rs), S.jaro_winkler(lf, rf), S.jaro_winkler(ls, rs), S.words(lo, ro), S.hybrid(lo, ro), 0.0, S.phone(lp, rp), S.email(le, re_), S.email_user(le, re_), S.best_of_three(la, ra), S.surname_conflict(lo, ro)))
    return pd.DataFrame(out, columns=[*SCORES, "surname_conflict"])


@lru_cache(1 << 16)
def _name_scores(lo: str, ro: str, ln: str, rn: str, lf: str, rf: str, ls: str, rs: str) -> tuple:
    first, last, full = S.name_or_words(lf, rf), S.name_or_words(ls, rs), S.name_or_words(ln, rn)
    return (first, last, first, last, S.words(lo, ro), full, 0.0, 0.0, 0.0, 0.0, 0.0, S.surname_conflict(lo, ro))


@F.pandas_udf(_KIND)
def _linkage_scores(v: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([_name_scores(*x) for x in v.itertuples(index=False, name=None)], columns=[*SCORES, "surname_conflict"])


@F.pandas_udf(_KIND)
def _review_scores(v: pd.DataFrame) -> pd.DataFrame:
    out = []
    for lo, ro, ln, rn, lp, rp, le, re_, lf, rf, ls, rs in v.itertuples(index=False):
        out.append((S.jaro_winkler(lf, rf), S.jaro_winkler(ls, rs), 0.0, 0.0, S.words(lo, ro), S.hybrid(ln, rn), 0.0, S.phone(lp, rp), S.email(le, re_), 0.0, 0.0, S.surname_conflict(lo, ro)))
    return pd.DataFrame(out, columns=[*SCORES, "surname_conflict"])


def _v(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _ordered(side: str) -> Column:
    return F.coalesce(F.nullif(_v(f"{side}_clean_name_ordered"), F.lit("")), _v(f"{side}_clean_name"))


def _scored(pairs: DataFrame, values: dict[str, Column], udf) -> DataFrame:
    """Adds column s with the scores of the values. Whole combinations hardly repeat, so they aren't looked for; single values do, and a worker remembers them."""
    return pairs.withColumn("s", udf(F.struct(*(c.alias(f"v{i}") for i, c in enumerate(values.values())))))


def both(c: str) -> Column:
    """Values are without outer space: pair_frame() cleans them once a record, before records meet."""
    return (_v(f"left_{c}") != "") & (_v(f"right_{c}") != "")


def equal(c: str) -> Column:
    return both(c) & (F.col(f"left_{c}") == F.col(f"right_{c}"))


def conflict(c: str) -> Column:
    return both(c) & (F.col(f"left_{c}") != F.col(f"right_{c}"))


def _names(*cols: str) -> dict[str, Column]:
    return {f"{s}_{c}": _ordered(s) if c == "ordered" else _v(f"{s}_{c}") for c in cols for s in ("left", "right")}


def _int(**flags: Column) -> dict[str, Column]:
    return {k: F.coalesce(c, F.lit(False)).cast("int") for k, c in flags.items()}


def _contact_flags(first: Column, last: Column, phone: Column, email: Column) -> dict[str, Column]:
    shared = phone | email
    return _int(shared_contact_flag=shared, shared_contact_name_conflict=shared & (first < 0.55) & (last >= 0.80), household_risk_flag=shared & (last >= 0.80) & (first < 0.70))


def _common(*cols: str) -> Column:
    out = F.lit(0)
    for c in cols:
        out = out + both(c).cast("int")
    return out


def _phonetics() -> dict[str, Column]:
    p, m = equal("name_phonetic_key"), equal("name_metaphone_key")
    return _int(phonetic_exact_match=p, metaphone_exact_match=m, phonetic_close_match=p | m)


def _edit_distance() -> dict[str, Column]:
    return {"name_levenshtein_similarity": S.plain_levenshtein_sim("left_name_plain", "right_name_plain")}


def rules_features(pairs: DataFrame) -> DataFrame:
    """pairs with left_ and right_ COLUMNS -> the 38 features of the rule matcher as columns beside left_id and right_id."""
    p = _scored(pairs, _names("ordered", "clean_name", "clean_phone", "clean_email", "clean_address"), _rules_scores)
    lf, rf = (F.coalesce(F.get(tokens(_ordered(s)), F.lit(0)), F.lit("")) for s in ("left", "right"))
    ls, rs = surname_or_only(_ordered("left")), surname_or_only(_ordered("right"))
    domain = lambda s: F.substring_index(F.lower(_v(f"{s}_clean_email")), "@", -1)
    at = lambda s: F.instr(_v(f"{s}_clean_email"), "@") > 0
    first, last = F.col("s.first_name_similarity"), F.col("s.surname_similarity")
    phone, email, city = equal("clean_phone"), equal("clean_email"), equal("clean_city")
    out = _int(
        tc_exact_match=equal("clean_tc"), tc_conflict=conflict("clean_tc"), tc_present_both=both("clean_tc"), phone_exact_match=phone, phone_match=phone,
        phone_last7_match=both("clean_phone") & (F.right("left_clean_phone", F.lit(7)) == F.right("right_clean_phone", F.lit(7))), phone_present_both=both("clean_phone"),
        email_exact_match=email, email_domain_match=at("left") & at("right") & (domain("left") == domain("right")), email_present_both=both("clean_email"), city_exact_match=city, city_match=city,
        muhatap_no_exact_match=equal("clean_muhatap_no"), muhatap_no_conflict=conflict("clean_muhatap_no"), muhatap_present_both=both("clean_muhatap_no"), name_present_both=both("clean_name"),
        first_name_exact_match=(lf != "") & (lf == rf), surname_exact_match=(ls != "") & (ls == rs), same_surname_name_conflict=F.col("s.surname_conflict"),
    )
    out |= _phonetics() | _contact_flags(first, last, phone, email) | {n: F.col(f"s.{n}") for n in SCORES} | _edit_distance()
    out |= {"name_jaro_winkler": F.col("s.name_similarity"), "common_non_empty_fields": _common("clean_tc", "clean_phone", "clean_email", "clean_name", "clean_city", "clean_address", "clean_muhatap_no")}
    return p.select("left_id", "right_id", *(c.alias(n) for n, c in out.items()))


def linkage_features(pairs: DataFrame, keep=()) -> DataFrame:
    """The linkage model's 36 features: e-mails by key, names by words where either side has several. keep: columns that stay. Names, phones and e-mails
    are scored apart, so that what isn't asked for isn't worked out."""
    p = _scored(pairs, _names("ordered", "clean_name", "first_name", "last_name"), _linkage_scores)
    apart = {"phone_similarity": S.phone_sim(_v("left_clean_phone"), _v("right_clean_phone")), "email_similarity": F.greatest(*(S.email_sim(_v(f"left_{c}"), _v(f"right_{c}")) for c in ("email_normalized_key", "clean_email")))}
    first, last = F.col("s.first_name_similarity"), F.col("s.surname_similarity")
    phone, email, city = equal("clean_phone"), equal("email_normalized_key"), equal("clean_city")
    out = _int(
        tc_exact_match=equal("clean_tc"), tc_conflict=conflict("clean_tc"), tc_present_both=both("clean_tc"), muhatap_no_exact_match=equal("clean_muhatap_no"), muhatap_no_conflict=conflict("clean_muhatap_no"),
        muhatap_present_both=both("clean_muhatap_no"), phone_exact_match=phone, phone_match=phone, phone_present_both=both("clean_phone"),
        phone_last7_match=both("clean_phone") & (F.right("left_clean_phone", F.lit(7)) == F.right("right_clean_phone", F.lit(7))), email_exact_match=email,
        email_present_both=both("clean_email") | both("email_normalized_key"), city_exact_match=city, city_match=city, name_present_both=both("clean_name"),
        first_name_exact_match=equal("first_name"), surname_exact_match=equal("last_name"), same_surname_name_conflict=F.col("s.surname_conflict"),
    )
    out |= _phonetics() | _contact_flags(first, last, phone, email) | {n: F.col(f"s.{n}") for n in SCORES if n not in ("email_username_similarity",)} | apart | _edit_distance()
    out |= {"name_jaro_winkler": F.col("s.name_similarity"), "common_non_empty_fields": _common("clean_tc", "clean_phone", "email_normalized_key", "clean_name", "clean_city", "clean_address", "clean_muhatap_no")}
    return p.select("left_id", "right_id", *keep, *(c.alias(n) for n, c in out.items()))


def review_features(pairs: DataFrame) -> DataFrame:
    """The 23 features that review shows: no phonetics, household risk, addresses or edit distance."""
    p = _scored(pairs, _names("ordered", "clean_name", "clean_phone", "clean_email", "first_name", "last_name"), _review_scores)
    phone, email = equal("clean_phone"), equal("clean_email")
    out = _int(
        tc_exact_match=equal("clean_tc"), tc_conflict=conflict("clean_tc"), tc_present_both=both("clean_tc"), muhatap_no_exact_match=equal("clean_muhatap_no"), muhatap_no_conflict=conflict("clean_muhatap_no"),
        muhatap_present_both=both("clean_muhatap_no"), phone_exact_match=phone, phone_present_both=both("clean_phone"), email_exact_match=email, email_present_both=both("clean_email"), city_exact_match=equal("clean_city"),
        first_name_exact_match=equal("first_name"), surname_exact_match=equal("last_name"), name_present_both=both("clean_name"), shared_contact_flag=phone | email, same_surname_name_conflict=F.col("s.surname_conflict"),
    )
    out |= {n: F.col(f"s.{n}") for n in ("phone_similarity", "email_similarity", "name_similarity", "name_token_similarity", "first_name_similarity", "surname_similarity")}
    out |= {"common_non_empty_fields": _common("clean_name", "clean_tc", "clean_phone", "clean_email", "clean_city", "clean_muhatap_no")}
    return p.select("left_id", "right_id", *(c.alias(n) for n, c in out.items()))


#: The notes of a compared field.
NOTES = {
    "none": "{} her iki kayitta da bos.", "one": "{} alanlarindan biri bos.", "equal": "{} normalize edilmis degerlerle birebir eslesti.", "differ": "{} normalize edilmis degerleri farkli.",
    "exact_match": "{} birebir eslesti.", "strong_match": "{} guclu benzerlik gosteriyor.", "partial_match": "{} kismi benzerlik gosteriyor.", "weak_match": "{} zayif benzerlik gosteriyor.", "mismatch": "{} belirgin sekilde farkli.",
}
#: Field, column, label, kind of comparison.
FIELDS = (("fullName", "clean_name", "Ad soyad", "name"), ("firstName", "first_name", "Ad", "first"), ("surname", "last_name", "Soyad", "last"), ("tc", "clean_tc", "TC Kimlik No", "id"), ("phone", "clean_phone", "Telefon", "phone"), ("email", "clean_email", "E-posta", "email"), ("city", "clean_city", "Sehir", "exact"), ("muhatapNo", "clean_muhatap_no", "Muhatap Kodu", "id"))


def field_comparisons(pairs: DataFrame, source: str = "admin_review") -> DataFrame:
    """left_id, right_id, fields: of each field a struct of values, method, result, score and note. Raw values are in left_raw_ and right_raw_
    columns where there are such."""
    from ..functions.scoring import contact_band, percent, review_name_band

    p = _scored(pairs, _names("ordered", "clean_name", "clean_phone", "clean_email", "first_name", "last_name"), _review_scores)
    similar = {"name": "name_similarity", "first": "first_name_similarity", "last": "surname_similarity", "phone": "phone_similarity", "email": "email_similarity"}

    def one(field: str, c: str, label: str, kind: str) -> Column:
        note = lambda k: F.lit(NOTES[k].format(label))
        left, right = text(f"left_{c}"), text(f"right_{c}")
        same = left == right
        if kind in similar:
            score = F.col(f"s.{similar[kind]}")
            result = review_name_band(score) if kind in ("name", "first", "last") else contact_band(score, same)
            points = percent(score) if kind in ("name", "first", "last") else F.when(same, 100).otherwise(percent(score))
            said = note("mismatch")
            for k in ("exact_match", "strong_match", "partial_match", "weak_match"):
                said = F.when(result == k, note(k)).otherwise(said)
        else:
            result = F.when(same, "exact_match").otherwise("conflict" if kind == "id" else "mismatch")
            points, said = F.when(same, 100).otherwise(0), F.when(same, note("equal")).otherwise(note("differ"))
        here = both(c)
        raw = lambda s: F.nullif(text(f"{s}_raw_{c}"), F.lit("")) if f"{s}_raw_{c}" in pairs.columns else F.nullif(text(f"{s}_{c}"), F.lit(""))
        return F.struct(
            raw("left").alias("rawLeftValue"), raw("right").alias("rawRightValue"), F.nullif(left, F.lit("")).alias("normalizedLeftValue"), F.nullif(right, F.lit("")).alias("normalizedRightValue"),
            F.lit(f"{source}_{kind}({c})").alias("comparisonMethod"), F.when(here, result).otherwise("missing").alias("comparisonResult"), F.when(here, points).otherwise(0).alias("score0To100"),
            (here & same).alias("exactMatch"), F.when(here, said).when((left == "") & (right == ""), note("none")).otherwise(note("one")).alias("notes"),
        )

    return p.select("left_id", "right_id", F.struct(*(one(*f).alias(f[0]) for f in FIELDS)).alias("fields"))


def pair_frame(found: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with their records' COLUMNS. clean_name_ordered, the name in its own order, is clean_name where records have no such column."""
    return with_records(found, paired(records), [*COLUMNS, "name_plain"])


def paired(records: DataFrame, *more: str) -> DataFrame:
    """What pairs have of a record: record_id, COLUMNS and name_plain, cleaned, and more of its columns under _name as they are."""
    r = records if "clean_name_ordered" in records.columns else records.withColumn("clean_name_ordered", F.col("clean_name"))
    return r.select("record_id", *(text(c).alias(c) for c in COLUMNS), *(F.col(c).alias(f"_{c}") for c in more)).withColumn("name_plain", name_form("clean_name"))


def exact_flags(pairs: DataFrame) -> DataFrame:
    """The native flags only, for pairs that a first filter goes over."""
    last7 = both("clean_phone") & (F.right("left_clean_phone", F.lit(7)) == F.right("right_clean_phone", F.lit(7)))
    flags = _int(tc_exact_match=equal("clean_tc"), tc_conflict=conflict("clean_tc"), phone_exact_match=equal("clean_phone"), phone_last7_match=last7, email_exact_match=equal("clean_email"), city_exact_match=equal("clean_city"), muhatap_no_exact_match=equal("clean_muhatap_no"), muhatap_no_conflict=conflict("clean_muhatap_no"), phonetic_exact_match=equal("name_phonetic_key"), metaphone_exact_match=equal("name_metaphone_key"))
    more = {"name_levenshtein_similarity": S.plain_levenshtein_sim("left_name_plain", "right_name_plain"), "common_non_empty_fields": _common("clean_tc", "clean_phone", "clean_email", "clean_name", "clean_city", "clean_address", "clean_muhatap_no")}
    return pairs.select("left_id", "right_id", *(c.alias(n) for n, c in (flags | more).items()))
