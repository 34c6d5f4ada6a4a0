"""Scores, bands, thresholds, flags and reasons over pair features, as column expressions. A feature that isn't there counts 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The coefficients of the logistic score.
LOGISTIC = {
    "tc_exact_match": 4.0, "tc_conflict": -4.5, "phone_exact_match": 1.5, "phone_last7_match": 0.8, "email_exact_match": 1.2, "city_exact_match": 0.7,
    "muhatap_no_exact_match": 1.5, "muhatap_no_conflict": -1.5, "phonetic_exact_match": 1.0, "metaphone_exact_match": 0.7, "phonetic_close_match": 0.6,
    "name_similarity": 2.5, "name_jaro_winkler": 1.0, "name_levenshtein_similarity": 0.8, "email_similarity": 1.2, "first_name_similarity": 1.8,
    "surname_similarity": 1.2, "first_name_jaro_winkler": 0.5, "surname_jaro_winkler": 0.4, "first_name_exact_match": 0.7, "surname_exact_match": 0.6,
    "common_non_empty_fields": 0.2, "shared_contact_name_conflict": -2.5, "household_risk_flag": -3.0,
}
LOGISTIC_BIAS = -4.0
#: The default weights of the score's parts.
WEIGHTS = {"adSoyad": 30.0, "tcKimlikNo": 35.0, "telefon": 15.0, "email": 10.0, "muhatapNo": 10.0}


class Features:
    """The features of a frame: own columns, or the fields of a struct or map column."""

    def __init__(self, names, get=F.col):
        self.names, self.get = set(names), get

    @classmethod
    def of(cls, df: DataFrame) -> Features:
        return cls(df.columns)

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def num(self, name: str) -> Column:
        return F.coalesce(self.get(name).cast("double"), F.lit(0.0)) if name in self.names else F.lit(0.0)

    def on(self, name: str) -> Column:
        return self.num(name) != 0


def logistic_score(f: Features) -> Column:
    z = F.lit(LOGISTIC_BIAS)
    for name, w in LOGISTIC.items():
        if name in f:
            z = z + w * f.num(name)
    return F.round(1.0 / (1.0 + F.exp(-z)), 4)


def _parts(f: Features) -> dict[str, tuple[Column, Column]]:
    """Of each part whether both sides have it, and its value from 0 to 1."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    both = lambda flag, otherwise: f.on(flag) if flag in f else otherwise
    exact = lambda n: F.when(f.on(n), 1.0).otherwise(0.0)
    any_name = f.on("first_name_exact_match") | f.on("surname_exact_match")
    for n in ("name_similarity", "first_name_similarity", "surname_similarity"):
        any_name = any_name | (f.num(n) > 0)
    return {
        "adSoyad": (both("name_present_both", any_name), clamp(F.greatest(f.num("name_similarity"), f.num("first_name_similarity") * 0.5 + f.num("surname_similarity") * 0.5))),
        "tcKimlikNo": (both("tc_present_both", f.on("tc_exact_match") | f.on("tc_conflict")), exact("tc_exact_match")),
        "telefon": (both("phone_present_both", f.on("phone_exact_match") | f.on("phone_last7_match") | (f.num("phone_similarity") > 0)), clamp(F.greatest(f.num("phone_similarity"), exact("phone_exact_match")))),
        "email": (both("email_present_both", f.on("email_exact_match") | (f.num("email_similarity") > 0)), clamp(F.greatest(f.num("email_similarity"), exact("email_exact_match")))),
        "muhatapNo": (both("muhatap_present_both", f.on("muhatap_no_exact_match") | f.on("muhatap_no_conflict")), exact("muhatap_no_exact_match")),
    }


def weighted_score(f: Features, weights: dict[str, float] | None = None) -> Column:
    """0 to 100: the weighted mean of the parts that both sides have."""
    w = WEIGHTS | (weights or {})
    top, bottom = F.lit(0.0), F.lit(0.0)
    for k, (has, value) in _parts(f).items():
        weight = max(0.0, float(w[k] or 0.0))
        if weight > 0:
            top = top + F.when(has, value * weight).otherwise(0.0)
            bottom = bottom + F.when(has, F.lit(weight)).otherwise(0.0)
    return F.when(bottom > 0, F.round(100.0 * top / bottom, 2)).otherwise(0.0)


def weighted_breakdown(f: Features, weights: dict[str, float] | None = None) -> Column:
    """weighted_score with the parts it comes from."""
    w, parts = WEIGHTS | (weights or {}), _parts(f)
    return F.struct(
        F.struct(*(F.when(has, F.round(100.0 * v, 2)).otherwise(0.0).alias(k) for k, (has, v) in parts.items())).alias("components_percent"),
        F.array_compact(F.array(*(F.when(has, F.lit(k)) for k, (has, _) in parts.items()))).alias("active_component_keys"),
        F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(float(w[k]))) for k in WEIGHTS))).alias("weights_used"),
        weighted_score(f, weights).alias("general_weighted_percent"),
    )


@dataclass(frozen=True)
class Thresholds:
    """Auto-approve, manual and reject, as probabilities in that order."""

    auto: float = 0.97
    manual: float = 0.75
    reject: float = 0.50

    @classmethod
    def of(cls, auto: float | None = None, manual: float | None = None, reject: float | None = None) -> Thresholds:
        """From settings: over 1 they are percent; they are clamped and put in order."""
        low, mid, high = sorted(max(0.0, min(1.0, x / 100 if x > 1 else x)) for x in (97 if auto is None else auto, 75 if manual is None else manual, 50 if reject is None else reject))
        return cls(high, mid, low)


def decision(probability: Column, thresholds: Thresholds | None = None) -> Column:
    """Every pair waits for review; neither probability nor thresholds decide."""
    return F.when(probability.isNull() | probability.isNotNull(), "pending")


def decision_trace(f: Features) -> Column:
    return F.struct(*(f.on(n).cast("int").alias(n) for n in ("tc_conflict", "household_risk_flag", "muhatap_no_conflict")))


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in pairs)))


def risk_flags(f: Features, kind: str = "rules") -> Column:
    """kind: rules, linkage or review."""
    no_id = ~f.on("tc_exact_match") & ~f.on("tc_conflict") & ~f.on("phone_exact_match") & ~f.on("email_exact_match")
    first = [(f.on("tc_conflict"), "tc_conflict"), (f.on("muhatap_no_conflict"), "muhatap_no_conflict"), (f.on("shared_contact_flag"), "shared_contact")]
    household = [(f.on("shared_contact_name_conflict"), "shared_contact_name_conflict"), (f.on("household_risk_flag"), "household_risk")]
    surname = [(f.on("same_surname_name_conflict"), "same_surname_name_conflict")]
    weak = [
        ((f.num("email_similarity") >= 0.85) & ~f.on("tc_exact_match") & ~f.on("phone_exact_match") & (f.num("name_similarity") < 0.80), "email_high_identity_weak"),
        (no_id & (f.num("name_similarity") >= 0.80), "weak_identity_evidence"),
    ]
    cross = [(no_id & ~f.on("city_exact_match"), "cross_city_contact_mismatch")]
    sparse = [(f.num("common_non_empty_fields") <= 2, "sparse_data")]
    return _flags(*{"rules": first + household + surname + sparse, "linkage": first + household + surname + weak + cross + sparse, "review": first + surname + weak + sparse}[kind])


def name_band(score: Column, exact: Column) -> Column:
    return F.when(exact, "exact_match").when(score >= 0.9, "strong_match").when(score >= 0.7, "partial_match").when(score > 0, "mismatch").otherwise("missing")


def review_name_band(score: Column) -> Column:
    return F.when(score >= 1.0, "exact_match").when(score >= 0.92, "strong_match").when(score >= 0.80, "partial_match").otherwise("mismatch")


def contact_band(score: Column, exact: Column | None = None) -> Column:
    exact = F.lit(False) if exact is None else exact
    return F.when(exact, "exact_match").when(score >= 0.85, "strong_match").when(score >= 0.60, "partial_match").when(score >= 0.20, "weak_match").otherwise("mismatch")


def level_band(level: Column, score: Column, strong: float, partial: float) -> Column:
    """For a compared field of the linkage model: by its similarity, or by its level (3 exact, 2, 1) where that says more."""
    return F.when(level == 3, "exact_match").when((score >= strong) | (level == 2), "strong_match").when((score >= partial) | (level == 1), "partial_match").otherwise("mismatch")


def percent(score: Column) -> Column:
    return F.bround(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).cast("int")


def match_type(features: Features, source: Column) -> Column:
    """splink, or by what the rules found: exact, phonetic, fuzzy, ml."""
    return F.when(F.startswith(F.lower(source), F.lit("splink")), "splink").when(features.on("tc_exact_match") | features.on("phone_exact_match") | features.on("email_exact_match"), "exact").when(features.on("phonetic_exact_match") | features.on("metaphone_exact_match"), "phonetic").when(features.num("name_similarity") > 0, "fuzzy").otherwise("ml")


def confidence(splink: Column, ml: Column) -> Column:
    return F.coalesce(splink, ml, F.lit(0.0))


def weak_label(f: Features) -> Column:
    """1 or 0 by rules, -1 if none applies; a negative rule wins."""
    name = f.num("name_similarity")
    yes = f.on("tc_exact_match") | (f.on("email_exact_match") & (name >= 0.85)) | (f.on("phone_exact_match") & (name >= 0.88)) | ((name >= 0.97) & (f.on("phonetic_exact_match") | f.on("metaphone_exact_match")))
    no = f.on("tc_conflict") | (f.on("household_risk_flag") & f.on("shared_contact_name_conflict") & ~f.on("tc_exact_match")) | ((name < 0.55) & f.on("shared_contact_flag"))
    return F.when(no, 0).when(yes, 1).otherwise(-1)


#: The texts of the reasons, by kind of matcher where they differ.
REASONS = {
    "tc_conflict": "TC Kimlik No catisiyor; otomatik birlestirme engellendi.",
    "tc": "TC Kimlik No tam eslesti.",
    "name": "Ad soyad karsilastirmasi {} olarak degerlendirildi.",
    "phone": {"rules": "Telefon eslesti.", "linkage": "Telefon numarasi normalize edilmis sekilde eslesti."},
    "email": {"rules": "E-posta eslesti.", "linkage": "E-posta normalize edilmis anahtara gore eslesti."},
    "city": {"rules": "Sehir eslesti.", "linkage": "Sehir bilgisi eslesti."},
    "muhatap": "Muhatap Kodu tam eslesti; guclu eslesme sinyali.",
    "muhatap_conflict": "Muhatap Kodu catisiyor; farkli kisi olabilir.",
    "contact_conflict": {"rules": "Ortak iletisim var ancak isim sinyali catismali.", "linkage": "Ortak iletisim bilgisi var ancak isim sinyali catismali."},
    "household": {"rules": "Household riski tespit edildi.", "linkage": "Ortak iletisim household riski olusturuyor."},
    "surname": "Soyad ayni ancak ad sinyali belirgin sekilde farkli.",
    "sparse": "Bos alanlar nedeniyle guven dusuruldu.",
    "probability": {"rules": "Eslesme olasiligi: ", "linkage": "Splink eslesme olasiligi: "},
    "fallback": "Splink kullanilamadi; legacy fallback devrede.",
    "pending": "Nihai karar manuel inceleme olarak birakildi.",
    "rejected": "Nihai karar farkli kisi yonunde.",
    "approved": "Nihai karar ayni kisi yonunde.",
}


def rule_reasons(f: Features, name_result: Column, probability: Column, final: Column, kind: str = "rules", fallback: bool = False) -> Column:
    """Why a pair is one, in words, in a fixed order."""
    say = lambda k: REASONS[k] if isinstance(REASONS[k], str) else REASONS[k][kind]
    before, after = REASONS["name"].split("{}")
    plain = [("phone_exact_match", "phone"), ("email_exact_match", "email"), ("city_exact_match", "city"), ("muhatap_no_exact_match", "muhatap"), ("muhatap_no_conflict", "muhatap_conflict"), ("shared_contact_name_conflict", "contact_conflict"), ("household_risk_flag", "household"), ("same_surname_name_conflict", "surname")]
    return F.array_compact(F.array(
        F.when(f.on("tc_conflict"), say("tc_conflict")).when(f.on("tc_exact_match"), say("tc")),
        F.when(name_result.isin("exact_match", "strong_match"), F.concat(F.lit(before), name_result, F.lit(after))),
        *(F.when(f.on(n), say(k)) for n, k in plain),
        F.when(f.num("common_non_empty_fields") <= 2, say("sparse")),
        F.concat(F.lit(say("probability")), F.format_string("%.4f", probability)),
        F.lit(say("fallback")) if fallback else F.lit(None).cast("string"),
        *(F.when(final == d, say(d)) for d in ("pending", "rejected", "approved")),
    ))


#: The texts of the reasons shown in review.
REVIEW_REASONS = {
    "type": "Eslesme tipi: ", "confidence": "Guven skoru: ", "tc_conflict": "TC Kimlik No catisiyor.", "tc": "TC Kimlik No eslesti.", "phone": "Telefon eslesti.", "email": "E-posta eslesti.", "city": "Sehir eslesti.",
    "muhatap": "Muhatap Kodu tam eslesti; guclu eslesme sinyali.", "muhatap_conflict": "Muhatap Kodu catisiyor; farkli kisi olabilir.", "surname": "Soyad ayni ancak ad sinyali belirgin sekilde farkli.", "name": "Ad soyad sonucu: {}.",
    "approved": "Nihai karar otomatik veya manuel onayla ayni kisi yonunde.", "rejected": "Nihai karar reddedildi; farkli kisi olasiligi daha yuksek.", "pending": "Nihai durum manuel inceleme icin beklemede.",
    "blocked": "Benzerlik skoru yuksek ancak TC Kimlik No cakismasi nedeniyle otomatik birlestirme engellendi.",
}


def review_reasons(f: Features, kind: Column, sure: Column, name_result: Column, final: Column) -> Column:
    say = REVIEW_REASONS
    before, after = say["name"].split("{}")
    kind = F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown"))
    return F.array_compact(F.array(
        F.concat(F.lit(say["type"]), kind), F.concat(F.lit(say["confidence"]), F.format_string("%.4f", sure)),
        F.when(f.on("tc_conflict"), say["tc_conflict"]).when(f.on("tc_exact_match"), say["tc"]),
        *(F.when(f.on(n), say[k]) for n, k in (("phone_exact_match", "phone"), ("email_exact_match", "email"), ("city_exact_match", "city"), ("muhatap_no_exact_match", "muhatap"), ("muhatap_no_conflict", "muhatap_conflict"), ("same_surname_name_conflict", "surname"))),
        F.when(name_result.isin("exact_match", "strong_match", "partial_match"), F.concat(F.lit(before), name_result, F.lit(after))),
        F.when(final == "approved", say["approved"]).when((final == "rejected") & f.on("tc_conflict") & (sure >= 0.80), say["blocked"]).when(final == "rejected", say["rejected"]).otherwise(say["pending"]),
    ))
