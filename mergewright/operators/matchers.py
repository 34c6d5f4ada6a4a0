"""Rule matchers: the first engine's two-of-four, and the feature matcher with its logistic or forest score."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Features, decision, decision_trace, logistic_score, match_type, name_band, risk_flags, rule_reasons, weighted_breakdown
from ..functions.similarity import jaro_winkler
from .blocking import PASSES, bare_pairs, city_key_pairs, city_pairs
from .features import equal, exact_flags, pair_frame, rules_features

NAME_THRESHOLD = 0.85
PREDICTION_THRESHOLD = 0.30


def city_rules(records: DataFrame, min_rules: int = 2, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Pairs of one city with at least min_rules of: similar name, equal tc, phone, e-mail. The exact rules come first: a name is compared only
    where it can decide, and from two rules on a pair must share an id, so that such pairs only are made."""
    flat = pair_frame(city_pairs(records) if min_rules < 2 else city_key_pairs(records), records)
    flags = flat.select("left_id", "right_id", "left_clean_name", "right_clean_name", *(equal(c).cast("int").alias(n) for n, c in (("tc_exact", "clean_tc"), ("phone_exact", "clean_phone"), ("email_exact", "clean_email"))))
    flags = flags.withColumn("exact", F.col("tc_exact") + F.col("phone_exact") + F.col("email_exact")).where(F.col("exact") >= min_rules - 1)
    return _with_name(flags, "left_clean_name", "right_clean_name", jaro_winkler, "name_jw", threshold).withColumn("rules_matched", F.col("exact") + F.col("name_jw")).where(F.col("rules_matched") >= min_rules).select("left_id", "right_id", "name_jw", "tc_exact", "phone_exact", "email_exact", "rules_matched")


def _with_name(df: DataFrame, a: str, b: str, score, name: str, threshold: float) -> DataFrame:
    @F.pandas_udf("int")
    def over(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([int(score(p or "", q or "") >= threshold) for p, q in zip(x, y)], dtype="int32")

    told = df.select(a, b).distinct().withColumn(name, over(a, b))
    return df.join(told, [a, b])


def side_by_side(found: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with L_ and R_ columns of their records, the surest first."""
    side = lambda s, k: records.select(F.col("record_id").alias(k), *(F.col(c).alias(f"{s}_{c}") for c in columns))
    return found.join(side("L", "left_id"), "left_id").join(side("R", "right_id"), "right_id").orderBy(F.desc("rules_matched"), "left_id", "right_id")


def feature_rules(records: DataFrame, min_rules: int = 2, passes=PASSES, score=None, weights=None, fallback: bool = False) -> DataFrame:
    """Candidates by blocking whose rules (similar name, equal tc, phone, e-mail) reach min_rules or whose score reaches the threshold, with
    score, parts, flags, reasons and decision. score: a column over the features, else the logistic one."""
    if not 1 <= min_rules <= 4:
        raise ValueError("min_rules goes from 1 to 4")
    f = rules_features(pair_frame(bare_pairs(records, passes), records))
    feats = Features.of(f)
    f = f.withColumn("ml_probability", logistic_score(feats) if score is None else score)
    f = f.withColumn("rules_matched", (F.col("name_similarity") >= NAME_THRESHOLD).cast("int") + F.col("tc_exact_match") + F.col("phone_exact_match") + F.col("email_exact_match"))
    f = f.where((F.col("rules_matched") >= min_rules) | (F.col("ml_probability") >= PREDICTION_THRESHOLD))
    band = name_band(F.col("name_similarity"), F.col("name_similarity") >= 1.0)
    source = F.lit("fallback_legacy_v1" if fallback else "rules_v1")
    out = f.withColumns({"decision": decision(F.col("ml_probability")), "risk_flags": risk_flags(feats), "score": weighted_breakdown(feats, weights), "decision_trace": decision_trace(feats), "match_type": match_type(feats, source), "decision_source": source})
    return out.withColumn("reasons", rule_reasons(feats, band, F.col("ml_probability"), F.col("decision"), "rules", fallback))


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc_nulls_last("ml_probability"), F.desc_nulls_last("name_similarity"), "left_id", "right_id")


def fast_pairs(records: DataFrame, passes=PASSES, least: float = PREDICTION_THRESHOLD) -> DataFrame:
    """Candidates scored by the native flags and edit distance alone: no Python."""
    flags = exact_flags(pair_frame(bare_pairs(records, passes), records))
    return flags.withColumn("score", logistic_score(Features.of(flags))).where(F.col("score") >= least)


