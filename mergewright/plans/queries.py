"""Queries over the driver's tables, by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phonetic as P
from ..functions import scoring as C
from ..functions import similarity as S
from ..functions import text as T
from ..operators import blocking as B
from ..operators import features as X
from ..operators import golden as G
from ..operators import groups as R
from ..operators import linkage, matchers, review, training
from ..operators import normalize as N
from ..sources import sinks
from . import donors as D
from . import reports as Q
from .tables import cut
from .oracle import LOGIT, low, metaphone, soundex, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_(sql)
        return f

    return add


IDS = ["left_id", "right_id"]


def _flat(spark, sf) -> DataFrame:
    r = D.records(spark, sf)
    return X.pair_frame(B.bare_pairs(r), r)


def _flags(spark, sf) -> DataFrame:
    return X.exact_flags(_flat(spark, sf))


@query("SELECT record_id, clean_name, clean_city, clean_address FROM norm")
def norm_text(spark, sf):
    return D.records(spark, sf).select("record_id", "clean_name", "clean_city", "clean_address")


@query("SELECT record_id, clean_phone, phone_last7, clean_tc FROM norm")
def norm_phone(spark, sf):
    return D.records(spark, sf).select("record_id", "clean_phone", "phone_last7", "clean_tc")


@query("SELECT record_id, clean_email, email_normalized_key, CASE WHEN contains(clean_email, '@') THEN (CASE WHEN split_part(clean_email, '@', 2) IN ('gmail.com', 'googlemail.com') THEN replace(split_part(split_part(clean_email, '@', 1), '+', 1), '.', '') ELSE split_part(split_part(clean_email, '@', 1), '+', 1) END) || '@' || split_part(clean_email, '@', 2) ELSE clean_email END AS similarity_form FROM norm")
def norm_email_keys(spark, sf):
    return D.records(spark, sf).select("record_id", "clean_email", "email_normalized_key", T.email_similarity_form("clean_email").alias("similarity_form"))


@query("SELECT record_id, clean_muhatap_no FROM norm")
def norm_muhatap(spark, sf):
    return D.records(spark, sf).select("record_id", "clean_muhatap_no")


@query("SELECT record_id, ordered_name FROM norm")
def canonical_name(spark, sf):
    return D.records(spark, sf).select("record_id", "ordered_name")


@query("SELECT record_id, first_name, last_name, CASE WHEN clean_name = '' THEN '' ELSE list_filter(string_split(clean_name, ' '), lambda x: x <> '')[-1] END AS surname_or_only FROM norm")
def name_parts(spark, sf):
    return D.records(spark, sf).select("record_id", "first_name", "last_name", F.col("clean_surname").alias("surname_or_only"))


@query(f"SELECT record_id, {soundex(low('name'))} AS code FROM donors")
def soundex_tr(spark, sf):
    return D.donors(spark, sf).select("record_id", P.soundex_tr("name").alias("code"))


@query(f"SELECT record_id, {metaphone(low('name'))} AS code FROM donors")
def metaphone_tr(spark, sf):
    return D.donors(spark, sf).select("record_id", P.metaphone_tr("name").alias("code"))


@query("SELECT record_id, blocking_key FROM norm")
def blocking_key(spark, sf):
    return D.records(spark, sf).select("record_id", "blocking_key")


@query("SELECT is_valid, count(*) AS n FROM norm GROUP BY is_valid")
def validity(spark, sf):
    return D.records(spark, sf).groupBy("is_valid").agg(F.count("*").alias("n"))


_codes = "SELECT record_id, CASE WHEN clean_name = '' THEN 'missing_required_name' END AS e, CASE WHEN clean_tc = '' AND clean_phone = '' AND clean_email = '' THEN 'missing_all_primary_identifiers' END AS w FROM norm"


@query(f"SELECT record_id, coalesce(e, '') AS errors, coalesce(w, '') AS warnings, CASE WHEN e IS NULL THEN 'valid' ELSE 'invalid' END AS row_status FROM ({_codes})")
def validation_codes(spark, sf):
    return N.validation(D.records(spark, sf)).select("record_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "row_status")


@query(f"SELECT code, count(*) AS n FROM (SELECT e AS code FROM ({_codes}) UNION ALL SELECT w FROM ({_codes})) WHERE code IS NOT NULL GROUP BY code")
def warning_summary(spark, sf):
    return N.warning_summary(N.validation(D.records(spark, sf)))


@query("SELECT coalesce(nullif(blocking_key, ''), '__EMPTY__') AS blocking_key, count(*) AS n FROM norm GROUP BY 1")
def block_histogram(spark, sf):
    return B.histogram(D.records(spark, sf))


@query("SELECT 'clean_tc' AS field, clean_tc AS block_key, count(*) AS block_size FROM norm WHERE clean_tc <> '' GROUP BY 2 HAVING count(*) > 20 UNION ALL SELECT 'clean_phone', clean_phone, count(*) FROM norm WHERE clean_phone <> '' GROUP BY 2 HAVING count(*) > 100 UNION ALL SELECT 'email_normalized_key', email_normalized_key, count(*) FROM norm WHERE email_normalized_key <> '' GROUP BY 2 HAVING count(*) > 100 UNION ALL SELECT 'clean_muhatap_no', clean_muhatap_no, count(*) FROM norm WHERE clean_muhatap_no <> '' GROUP BY 2 HAVING count(*) > 50 UNION ALL SELECT 'name_phonetic_key', name_phonetic_key, count(*) FROM norm WHERE name_phonetic_key <> '' GROUP BY 2 HAVING count(*) > 200")
def skipped_blocks(spark, sf):
    return B.skipped_blocks(D.records(spark, sf))


@query("SELECT a.record_id AS left_id, b.record_id AS right_id FROM norm a JOIN norm b ON a.clean_tc = b.clean_tc AND a.record_id < b.record_id WHERE a.clean_tc <> ''")
def pairs_tc(spark, sf):
    return B.column_pairs(D.records(spark, sf), "clean_tc").select(*IDS)


@query("SELECT left_id, right_id FROM allpairs WHERE pass = 1")
def pairs_phone(spark, sf):
    return B.column_pairs(D.records(spark, sf), "clean_phone", 100).select(*IDS)


@query("SELECT left_id, right_id FROM allpairs WHERE pass = 2")
def pairs_email(spark, sf):
    return B.column_pairs(D.records(spark, sf), "email_normalized_key", 100).select(*IDS)


@query("SELECT left_id, right_id, pass FROM pairs")
def pairs_multi_pass(spark, sf):
    return B.bare_pairs(D.records(spark, sf)).select(*IDS, "pass")


@query("SELECT left_id, right_id, pass, key FROM pairs ORDER BY pass, key, left_id, right_id LIMIT 500")
def pairs_capped(spark, sf):
    return B.limited(B.pairs(D.records(spark, sf)), 500)


@query("SELECT a.record_id AS left_id, b.record_id AS right_id FROM norm a JOIN norm b ON a.record_id < b.record_id AND ((a.clean_tc <> '' AND a.clean_tc = b.clean_tc) OR (a.clean_phone <> '' AND a.clean_phone = b.clean_phone) OR (a.email_normalized_key <> '' AND a.email_normalized_key = b.email_normalized_key) OR (a.name_phonetic_key <> '' AND a.name_phonetic_key = b.name_phonetic_key))")
def pairs_linkage(spark, sf):
    return B.uncapped_pairs(D.records(spark, sf), B.LINKAGE_PASSES)


@query("SELECT left_id, right_id FROM (SELECT left_id, right_id FROM allpairs WHERE pass = 0 EXCEPT SELECT left_id, right_id FROM allpairs WHERE pass = 1) UNION SELECT left_id, right_id FROM (SELECT left_id, right_id FROM allpairs WHERE pass = 1 INTERSECT SELECT left_id, right_id FROM allpairs WHERE pass = 2)")
def setops_pairs(spark, sf):
    r = D.records(spark, sf)
    tc, phone, mail = (B.column_pairs(r, k, c).select(*IDS) for k, c in B.PASSES[:3])
    return tc.subtract(phone).union(phone.intersect(mail)).distinct()


@query("SELECT left_id, right_id, tc_exact_match, tc_conflict, phone_exact_match, phone_last7_match, email_exact_match, city_exact_match, muhatap_no_exact_match, muhatap_no_conflict, phonetic_exact_match, metaphone_exact_match, common_non_empty_fields FROM flags")
def pair_exact_flags(spark, sf):
    return _flags(spark, sf).drop("name_levenshtein_similarity")


@query("SELECT left_id, right_id, name_levenshtein_similarity FROM flags")
def pair_levenshtein(spark, sf):
    return _flags(spark, sf).select(*IDS, "name_levenshtein_similarity")


@query("SELECT left_id, right_id, CASE WHEN lp = '' OR rp = '' THEN 0.0 WHEN lp = rp THEN 1.0 WHEN length(lp) >= 7 AND length(rp) >= 7 AND right(lp, 7) = right(rp, 7) THEN 0.8 WHEN length(lp) >= 6 AND length(rp) >= 6 AND right(lp, 6) = right(rp, 6) THEN 0.65 END::DOUBLE AS tier FROM flags")
def pair_phone_tier(spark, sf):
    return _flat(spark, sf).select(*IDS, S.phone_tier("left_clean_phone", "right_clean_phone").alias("tier"))


@query("SELECT left_id, right_id, CASE WHEN ln = rn AND ln <> '' THEN 'exact_match' WHEN s >= 0.9 THEN 'strong_match' WHEN s >= 0.7 THEN 'partial_match' WHEN s > 0 THEN 'mismatch' ELSE 'missing' END AS name_band, CASE WHEN s >= 1 THEN 'exact_match' WHEN s >= 0.92 THEN 'strong_match' WHEN s >= 0.8 THEN 'partial_match' ELSE 'mismatch' END AS review_band, CASE WHEN phone_exact_match = 1 THEN 'exact_match' WHEN s >= 0.85 THEN 'strong_match' WHEN s >= 0.6 THEN 'partial_match' WHEN s >= 0.2 THEN 'weak_match' ELSE 'mismatch' END AS contact_band FROM (SELECT *, name_levenshtein_similarity AS s FROM flags)")
def contact_bands(spark, sf):
    s = F.col("s")
    f = _flat(spark, sf).withColumn("s", S.levenshtein_sim("left_clean_name", "right_clean_name"))
    return f.select(*IDS, C.name_band(s, X.equal("clean_name")).alias("name_band"), C.review_name_band(s).alias("review_band"), C.contact_band(s, X.equal("clean_phone")).alias("contact_band"))


@query(f"SELECT left_id, right_id, {LOGIT} AS score FROM flags WHERE {LOGIT} >= 0.3")
def logistic_score(spark, sf):
    return matchers.fast_pairs(D.records(spark, sf)).select(*IDS, "score")


@query("SELECT left_id, right_id, CASE WHEN w > 0 THEN CAST(round(CAST(1e2 * v / w AS VARCHAR)::DECIMAL(38, 20), 2) AS DOUBLE) ELSE 0.0 END AS general FROM (SELECT left_id, right_id, CASE WHEN s > 0 THEN 3e1 ELSE 0e0 END + CASE WHEN tc_exact_match + tc_conflict > 0 THEN 35e0 ELSE 0e0 END + CASE WHEN phone_exact_match + phone_last7_match > 0 THEN 15e0 ELSE 0e0 END + CASE WHEN email_exact_match > 0 THEN 1e1 ELSE 0e0 END + CASE WHEN muhatap_no_exact_match + muhatap_no_conflict > 0 THEN 1e1 ELSE 0e0 END AS w, CASE WHEN s > 0 THEN s * 3e1 ELSE 0e0 END + 35e0 * tc_exact_match + 15e0 * phone_exact_match + 1e1 * email_exact_match + 1e1 * muhatap_no_exact_match AS v FROM (SELECT *, CAST(name_levenshtein_similarity AS DOUBLE) AS s FROM flags))")
def weighted_score(spark, sf):
    f = _flags(spark, sf).withColumnRenamed("name_levenshtein_similarity", "name_similarity")
    return f.select(*IDS, C.weighted_score(C.Features.of(f)).alias("general"))


@query("SELECT left_id, right_id, array_to_string(list_filter([CASE WHEN tc_conflict = 1 THEN 'tc_conflict' END, CASE WHEN muhatap_no_conflict = 1 THEN 'muhatap_no_conflict' END, CASE WHEN phone_exact_match + email_exact_match > 0 THEN 'shared_contact' END, CASE WHEN tc_exact_match + tc_conflict + phone_exact_match + email_exact_match = 0 AND name_levenshtein_similarity >= 0.8 THEN 'weak_identity_evidence' END, CASE WHEN tc_exact_match + tc_conflict + phone_exact_match + email_exact_match + city_exact_match = 0 THEN 'cross_city_contact_mismatch' END, CASE WHEN common_non_empty_fields <= 2 THEN 'sparse_data' END], lambda x: x IS NOT NULL), ',') AS flags FROM flags")
def risk_flags(spark, sf):
    f = _flags(spark, sf).withColumnRenamed("name_levenshtein_similarity", "name_similarity").withColumn("shared_contact_flag", F.greatest("phone_exact_match", "email_exact_match"))
    return f.select(*IDS, F.array_join(C.risk_flags(C.Features.of(f), "linkage"), ",").alias("flags"))


@query("SELECT left_id, right_id, 'pending' AS decision, tc_conflict, 0 AS household_risk_flag, muhatap_no_conflict FROM flags")
def decision_trace(spark, sf):
    f = _flags(spark, sf)
    return f.select(*IDS, C.decision(F.lit(0.99)).alias("decision"), C.decision_trace(C.Features.of(f)).alias("t")).select(*IDS, "decision", "t.*")


@query("SELECT left_id, right_id, CASE WHEN tc_conflict = 1 OR (s < 0.55 AND phone_exact_match + email_exact_match > 0) THEN 0 WHEN tc_exact_match = 1 OR (email_exact_match = 1 AND s >= 0.85) OR (phone_exact_match = 1 AND s >= 0.88) OR (s >= 0.97 AND phonetic_exact_match + metaphone_exact_match > 0) THEN 1 ELSE -1 END AS label FROM (SELECT *, name_levenshtein_similarity AS s FROM flags)")
def weak_labels(spark, sf):
    f = _flags(spark, sf).withColumnRenamed("name_levenshtein_similarity", "name_similarity").withColumn("shared_contact_flag", F.greatest("phone_exact_match", "email_exact_match"))
    return f.select(*IDS, C.weak_label(C.Features.of(f)).alias("label"))


@query("SELECT left_id, right_id, CASE WHEN tc_exact_match + phone_exact_match + email_exact_match > 0 THEN 'exact' WHEN phonetic_exact_match + metaphone_exact_match > 0 THEN 'phonetic' WHEN name_levenshtein_similarity > 0 THEN 'fuzzy' ELSE 'ml' END AS match_type FROM flags")
def match_type(spark, sf):
    f = _flags(spark, sf).withColumnRenamed("name_levenshtein_similarity", "name_similarity")
    return f.select(*IDS, C.match_type(C.Features.of(f), F.lit("rules")).alias("match_type"))


_city = "SELECT l.record_id AS left_id, r.record_id AS right_id, CAST(l.clean_tc <> '' AND l.clean_tc = r.clean_tc AS INT) AS tc_exact, CAST(l.clean_phone <> '' AND l.clean_phone = r.clean_phone AS INT) AS phone_exact, CAST(l.clean_email <> '' AND l.clean_email = r.clean_email AS INT) AS email_exact FROM norm l JOIN norm r ON l.clean_city = r.clean_city AND l.record_id < r.record_id"


@query(f"SELECT left_id, right_id, tc_exact, phone_exact, email_exact FROM ({_city}) WHERE tc_exact + phone_exact + email_exact >= 2")
def rules_city_exact(spark, sf):
    return matchers.city_rules(D.records(spark, sf), 2).where("tc_exact + phone_exact + email_exact >= 2").select(*IDS, "tc_exact", "phone_exact", "email_exact")


@query()
def rules_g0(spark, sf):
    return matchers.city_rules(D.records(spark, sf))


@query()
def rules_g2(spark, sf):
    return matchers.feature_rules(D.records(spark, sf)).select(*IDS, "rules_matched", "ml_probability", "decision", F.array_join("risk_flags", ",").alias("flags"), "score.general_weighted_percent", F.array_join("reasons", "|").alias("reasons"))


@query()
def pair_features(spark, sf):
    return X.rules_features(_flat(spark, sf))


@query()
def linkage_features(spark, sf):
    return X.linkage_features(_flat(spark, sf))


@query()
def review_features(spark, sf):
    return X.review_features(_flat(spark, sf))


@query()
def field_comparisons(spark, sf):
    return X.field_comparisons(_flat(spark, sf)).select(*IDS, F.to_json("fields").alias("fields"))


_g = lambda c: f"CASE WHEN l.{c} = '' OR r.{c} = '' THEN -1 WHEN l.{c} = r.{c} THEN 1 ELSE 0 END"


@query(f"SELECT g_tc, g_phone, g_city, g_phonetic, count(*) AS n FROM (SELECT {_g('clean_tc')} AS g_tc, {_g('clean_phone')} AS g_phone, {_g('clean_city')} AS g_city, {_g('name_phonetic_key')} AS g_phonetic FROM pairs p JOIN norm l ON l.record_id = p.left_id JOIN norm r ON r.record_id = p.right_id) GROUP BY ALL")
def gamma_patterns(spark, sf):
    exact = linkage.COMPARISONS[:4]
    return linkage.patterns(linkage.levels(_flat(spark, sf), exact), exact)


@query("SELECT least(0.5, greatest(1e-9, (SELECT count(*) FROM (SELECT left_id, right_id FROM (SELECT a.record_id AS left_id, b.record_id AS right_id FROM norm a JOIN norm b ON a.clean_tc = b.clean_tc AND a.record_id < b.record_id AND a.clean_tc <> '') UNION SELECT a.record_id, b.record_id FROM norm a JOIN norm b ON a.name_phonetic_key = b.name_phonetic_key AND a.record_id < b.record_id AND a.name_phonetic_key <> '')) / 0.85 / (count(*) * (count(*) - 1) / 2))) AS prior FROM norm")
def prior_lambda(spark, sf):
    return spark.createDataFrame([(linkage.prior(D.records(spark, sf)),)], "prior double")


@query()
def linkage_predictions(spark, sf):
    return linkage.brief(D.records(spark, sf, dealt=True), digits=6)


@query("SELECT record_id, group_id FROM comp")
def components(spark, sf):
    return D.approved_groups(spark, sf)


_m = "SELECT c.group_id, count(*) AS record_count FROM comp c GROUP BY c.group_id"
_gsum = f"SELECT m.group_id, m.record_count, e.match_count, e.avg_score, e.max_score, d.codes AS muhatap_codes, d.n > 1 AS different_muhatap_code FROM ({_m}) m JOIN (SELECT group_id, count(*) AS match_count, round(avg(score), 4) AS avg_score, round(max(score), 4) AS max_score FROM cand JOIN comp ON comp.record_id = cand.left_id WHERE decision = 'approved' GROUP BY group_id) e USING (group_id) JOIN (SELECT group_id, array_to_string(list_sort(list_distinct(list(nullif(clean_muhatap_no, '')))), ',') AS codes, count(DISTINCT nullif(clean_muhatap_no, '')) AS n FROM comp JOIN norm USING (record_id) GROUP BY group_id) d USING (group_id)"


def _approved(spark, sf):
    return D.approved_groups(spark, sf).withColumn("decision", F.lit("approved"))


@query(_gsum)
def group_metrics(spark, sf):
    out = R.summary(_approved(spark, sf), D.candidates(spark, sf), D.records(spark, sf))
    return out.select("group_id", "record_count", "match_count", "avg_score", "max_score", F.array_join("muhatap_codes", ",").alias("muhatap_codes"), "different_muhatap_code")


@query(f"SELECT group_id, record_count, match_count, max_score FROM ({_gsum}) WHERE different_muhatap_code AND record_count >= 2 ORDER BY avg_score DESC, match_count DESC, group_id LIMIT 50")
def different_muhatap(spark, sf):
    c = D.candidates(spark, sf)
    scored = c.select("left_id", "decision", (F.col("score") * 100).alias("general_weighted_percent"))
    return R.page(R.listing(_approved(spark, sf), c, D.records(spark, sf), scored=scored), 1, 50).select("group_id", "record_count", "match_count", "max_score")


@query("SELECT count(DISTINCT group_id) AS duplicate_group_count, count(*) AS affected_record_count FROM comp")
def group_totals(spark, sf):
    return R.metrics(_approved(spark, sf))


def _golden(spark, sf):
    members = D.approved_groups(spark, sf).join(D.records(spark, sf), "record_id")
    return G.golden(members)


def _pick(f: str) -> str:
    return f"coalesce(max(CASE WHEN field = '{f}' AND i = 1 THEN val END), '') AS {f}"


@query(f"SELECT group_id, {_pick('clean_name')}, {_pick('clean_city')}, {_pick('clean_muhatap_no')} FROM comp LEFT JOIN gbest USING (group_id) GROUP BY group_id")
def golden_mode(spark, sf):
    return _golden(spark, sf).select("group_id", "clean_name", "clean_city", "clean_muhatap_no")


@query(f"SELECT group_id, {_pick('clean_address')} FROM comp LEFT JOIN gbest USING (group_id) GROUP BY group_id")
def golden_address(spark, sf):
    return _golden(spark, sf).select("group_id", "clean_address")


@query(f"SELECT group_id, {_pick('clean_tc')}, {_pick('clean_phone')}, {_pick('clean_email')}, (SELECT record_id FROM gval v WHERE v.group_id = c.group_id AND ord = 1) AS golden_record_id, (SELECT string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY ord) FROM gval v WHERE v.group_id = c.group_id) AS source_record_ids, (SELECT coalesce(string_agg(DISTINCT clean_email, ',' ORDER BY clean_email), '') FROM gval v WHERE v.group_id = c.group_id AND contains(clean_email, '+')) AS secondary_emails, CASE WHEN count(DISTINCT CASE WHEN field = 'clean_tc' THEN val END) > 1 THEN 'tc_conflict' ELSE '' END AS warnings FROM comp c LEFT JOIN gbest USING (group_id) GROUP BY group_id")
def golden_full(spark, sf):
    join = lambda c: F.array_join(c, ",").alias(c)
    return _golden(spark, sf).select("group_id", "clean_tc", "clean_phone", "clean_email", "golden_record_id", join("source_record_ids"), join("secondary_emails"), F.array_join(F.filter("warnings", lambda x: x == "tc_conflict"), ",").alias("warnings"))


@query(f"SELECT group_id, coalesce(CASE WHEN ok THEN nullif(e.canonical_name, '') END, clean_name) AS clean_name, coalesce(CASE WHEN ok THEN nullif(e.canonical_city, '') END, clean_city) AS clean_city FROM (SELECT group_id, {_pick('clean_name')}, {_pick('clean_city')} FROM comp LEFT JOIN gbest USING (group_id) GROUP BY group_id) g JOIN (SELECT entity_id AS group_id, bool_and(status = 'confirmed') AS ok FROM members GROUP BY 1) USING (group_id) JOIN entities e ON e.id = group_id")
def overlay(spark, sf):
    m = D.memberships(spark, sf)
    return G.overlay(_golden(spark, sf), D.approved_groups(spark, sf), m, D.entities(m)).select("group_id", "clean_name", "clean_city")


@query("SELECT match_id, arg_max(decision, (decided_at, id)) AS decision, max(id) FILTER (i = 1) AS id FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY decided_at DESC, id DESC) AS i FROM acts) GROUP BY match_id")
def latest_review(spark, sf):
    return review.latest_reviews(D.actions(spark, sf)).select("match_id", "decision", "id")


@query("SELECT upload_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY created_at DESC, id DESC) AS i FROM runs) WHERE i = 1")
def latest_run(spark, sf):
    return review.latest_by(D.runs(spark, sf), "upload_id", "created_at", "id").select("upload_id", "id", "status")




def _split_ids(spark, sf):
    return D.candidates(spark, sf).select("id", (F.col("left_id") % 7).alias("l"), (F.col("right_id") % 7).alias("r"))


_lr = "(SELECT id, left_id % 7 AS l, right_id % 7 AS r FROM cand)"


@query(f"SELECT id, CASE WHEN l IN (1, 2, 3) AND r IN (1, 2, 3) THEN 'approved' WHEN l IN (4) OR r IN (4) OR (l IN (1, 2, 3)) <> (r IN (1, 2, 3)) THEN 'rejected' ELSE 'pending' END AS decision FROM {_lr}")
def partial_decision(spark, sf):
    s = _split_ids(spark, sf)
    return s.select("id", review.partial_decision(F.col("l"), F.col("r"), review._array([1, 2, 3]), review._array([4])).alias("decision"))


@query(f"SELECT id, CASE WHEN l IN (1, 2) AND r IN (1, 2) THEN 'approved' WHEN (l IN (1, 2) AND r IN (3, 4)) OR (l IN (3, 4) AND r IN (1, 2)) THEN 'rejected' ELSE 'pending' END AS decision FROM {_lr}")
def merge_decision(spark, sf):
    s = _split_ids(spark, sf)
    return s.select("id", review.merge_decision(F.col("l"), F.col("r"), review._array([1, 2]), review._array([3, 4])).alias("decision"))


@query(f"SELECT id, CASE WHEN l = 5 OR r = 5 THEN CASE WHEN (CASE WHEN l = 5 THEN r ELSE l END) IN (1, 2) THEN 'rejected' ELSE 'pending' END END AS decision FROM {_lr}")
def remove_decision(spark, sf):
    s = _split_ids(spark, sf)
    return s.select("id", review.remove_decision(F.col("l"), F.col("r"), F.lit(5), review._array([1, 2])).alias("decision"))


@query("SELECT DISTINCT m.entity_id, n.upload_id FROM members m JOIN norm n ON n.record_id = m.normalized_record_id WHERE m.status = 'confirmed' AND lower(n.clean_muhatap_no) = 'm24' AND n.record_id NOT IN (40) AND n.upload_id IN (SELECT upload_id FROM norm WHERE record_id IN (40))")
def muhatap_conflict(spark, sf):
    return review.muhatap_conflicts(D.memberships(spark, sf), D.records(spark, sf), [40], "M24")


_clean = "SELECT 0 AS source_rank, 'entity' AS source, e.id, f.record_id, f.upload_id, coalesce(e.canonical_name, '') AS clean_name, coalesce(e.canonical_city, '') AS clean_city, coalesce(e.canonical_muhatap_no, '') AS clean_muhatap_no, coalesce((SELECT is_valid FROM norm WHERE norm.record_id = e.golden_record_id), true) AS is_valid FROM entities e JOIN (SELECT entity_id, min(record_id) AS record_id, arg_min(upload_id, record_id) AS upload_id FROM members JOIN norm ON record_id = normalized_record_id WHERE status = 'confirmed' GROUP BY entity_id) f ON f.entity_id = e.id UNION ALL SELECT 1, 'normalized_record', record_id, record_id, upload_id, clean_name, clean_city, clean_muhatap_no, is_valid FROM norm WHERE record_id NOT IN (SELECT normalized_record_id FROM members WHERE status = 'confirmed')"
_shown = ["source_rank", "source", "id", "record_id", "upload_id", "clean_name", "clean_city", "clean_muhatap_no", "is_valid"]


def _clean_data(spark, sf):
    m = D.memberships(spark, sf)
    return Q.clean_dataset(D.records(spark, sf), m, D.entities(m))


@query(_clean)
def clean_dataset(spark, sf):
    return _clean_data(spark, sf).select(*_shown)


@query(f"SELECT * FROM ({_clean}) ORDER BY source_rank, id LIMIT 100 OFFSET 200")
def clean_dataset_page(spark, sf):
    return Q.clean_page(_clean_data(spark, sf), 3, 100).select(*_shown)


@query("SELECT record_id FROM norm WHERE contains(lower(clean_name), 'met') OR contains(lower(clean_tc), 'met') OR contains(lower(clean_phone), 'met') OR contains(lower(clean_email), 'met') OR contains(lower(clean_city), 'met') OR contains(lower(clean_muhatap_no), 'met')")
def search_filter(spark, sf):
    return Q.filters(D.records(spark, sf), search=" MET ").select("record_id")


@query("SELECT record_id FROM norm WHERE contains(lower(concat_ws(' ', clean_name, clean_tc, clean_phone, clean_email, clean_city, clean_muhatap_no)), 'yilmaz 1')")
def search_across(spark, sf):
    return Q.filters(D.records(spark, sf), search="yilmaz 1", across=True).select("record_id")


@query("SELECT record_id FROM norm WHERE clean_tc = '' AND clean_phone <> '' AND is_valid")
def missing_filter(spark, sf):
    return Q.filters(D.records(spark, sf), is_valid=True, missing={"clean_tc": True, "clean_phone": False}).select("record_id")


_dec = "count(*) FILTER (decision = 'approved') AS approved, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision = 'pending') AS pending"


@query(f"SELECT (SELECT count(*) FROM runs) AS total_uploads, (SELECT count(*) FROM norm) AS total_normalized_records, count(*) AS total_match_candidates, {_dec} FROM cand")
def report_overview(spark, sf):
    return Q.overview(D.runs(spark, sf), D.records(spark, sf), D.candidates(spark, sf))


@query("SELECT count(*) AS total_normalized_records, count(*) FILTER (is_valid) AS valid_records, count(*) FILTER (NOT is_valid) AS invalid_records, round(count(*) FILTER (is_valid) / count(*) * 100, 2) AS validity_rate, round(count(*) FILTER (clean_tc <> '') / count(*) * 100, 2) AS tc_fill_rate, round(count(*) FILTER (clean_phone <> '') / count(*) * 100, 2) AS phone_fill_rate, round(count(*) FILTER (clean_email <> '') / count(*) * 100, 2) AS email_fill_rate, (SELECT count(*) FROM runs) AS normalization_runs, (SELECT CAST(sum(total_processed) AS BIGINT) FROM runs) AS total_processed, (SELECT CAST(sum(success_count) AS BIGINT) FROM runs) AS total_success, (SELECT CAST(sum(failed_count) AS BIGINT) FROM runs) AS total_failed FROM norm")
def report_quality(spark, sf):
    return Q.data_quality(D.records(spark, sf), D.runs(spark, sf))


@query("SELECT (SELECT count(*) FROM runs WHERE created_at >= TIMESTAMP '1995-01-01' AND created_at <= TIMESTAMP '1996-06-30') AS n")
def date_range(spark, sf):
    return Q.between(D.runs(spark, sf), "created_at", "1995-01-01", "1996-06-30T00:00:00Z").agg(F.count("*").alias("n"))


@query(f"SELECT (SELECT count(*) FROM runs) AS total_detection_runs, (SELECT CAST(sum(duplicate_group_count) AS BIGINT) FROM runs) AS total_duplicate_groups, (SELECT CAST(sum(affected_record_count) AS BIGINT) FROM runs) AS total_affected_records, count(*) AS total_match_candidates, {_dec}, round(avg(score) * 100, 2) AS avg_score_pct FROM cand")
def report_detection(spark, sf):
    return Q.detection_summary(D.runs(spark, sf), D.candidates(spark, sf))


@query("SELECT count(*) AS total_reviews, count(*) FILTER (decision = 'approved') AS approvals, count(*) FILTER (decision = 'rejected') AS rejections FROM acts")
def report_review(spark, sf):
    return Q.review_summary(D.actions(spark, sf))


@query("SELECT id, match_id, decision FROM acts ORDER BY decided_at DESC, id DESC LIMIT 5")
def recent_reviews(spark, sf):
    return D.actions(spark, sf).orderBy(F.desc("decided_at"), F.desc("id")).limit(5).select("id", "match_id", "decision")


@query("SELECT id, status FROM runs ORDER BY created_at DESC, id DESC LIMIT 30")
def upload_history(spark, sf):
    runs = D.runs(spark, sf).withColumns({"file_name": F.lit("f"), "source_type": F.lit(None).cast("string"), "total_records": F.col("total_processed")})
    return Q.upload_history(runs).select("id", "status")


@query(f"SELECT upload_id, count(*) AS total, {_dec}, round(coalesce(avg(coalesce(confidence, score)), 0), 4) AS avg_confidence FROM cand GROUP BY upload_id")
def match_stats(spark, sf):
    return Q.match_stats(D.candidates(spark, sf))


@query("SELECT e.id, e.canonical_name, count(m.normalized_record_id) AS total_donors, count(CASE WHEN m.status = 'confirmed' THEN 1 END) AS active_donors FROM entities e LEFT JOIN members m ON m.entity_id = e.id GROUP BY e.id, e.canonical_name")
def entity_summary(spark, sf):
    m = D.memberships(spark, sf)
    return Q.entity_summary(D.entities(m), m.select("entity_id", F.col("normalized_record_id").alias("donor_id"), (F.col("status") == "confirmed").alias("is_active")))


@query("SELECT c.left_id, c.right_id, l.clean_name AS left_clean_name, r.clean_name AS right_clean_name, l.clean_phone AS left_clean_phone, r.clean_phone AS right_clean_phone, c.score FROM cand c JOIN norm l ON l.record_id = c.left_id JOIN norm r ON r.record_id = c.right_id WHERE c.decision = 'pending'")
def pending_matches_view(spark, sf):
    return Q.pending_matches(D.candidates(spark, sf), D.records(spark, sf)).select(*IDS, "left_clean_name", "right_clean_name", "left_clean_phone", "right_clean_phone", "score")


@query("SELECT id, left_id, right_id FROM cand ORDER BY coalesce(confidence, score) DESC, created_at DESC, id LIMIT 100 OFFSET 100")
def candidate_page(spark, sf):
    return Q.candidate_list(D.candidates(spark, sf), 2, 100).select("id", *IDS)


@query("SELECT upload_id, normalized_records, latest_run_id, coalesce(match_candidates, 0) AS match_candidates FROM (SELECT upload_id, count(*) AS normalized_records FROM norm GROUP BY 1) LEFT JOIN (SELECT upload_id, arg_max(id, (created_at, id)) AS latest_run_id FROM runs GROUP BY 1) USING (upload_id) LEFT JOIN (SELECT upload_id, count(*) AS match_candidates FROM cand GROUP BY 1) USING (upload_id)")
def pipeline_status(spark, sf):
    return Q.pipeline_status(D.records(spark, sf), D.runs(spark, sf), D.candidates(spark, sf))


@query("SELECT m.job_id AS id, m.run_id AS latest_run_id, m.run_status, e.stage FROM (SELECT job_id, arg_max(id, (created_at, id)) AS run_id, arg_max(status, (created_at, id)) AS run_status FROM runs GROUP BY job_id) m LEFT JOIN (SELECT event_id % 1000 AS run_id, arg_max(event_type, (ts, event_id)) AS stage FROM events GROUP BY 1) e ON e.run_id = m.run_id")
def job_state(spark, sf):
    runs = D.runs(spark, sf)
    jobs = runs.select(F.col("job_id").alias("id"), F.lit("done").alias("status")).distinct()
    events = D.table(spark, sf, "events").select((F.col("event_id") % 1000).alias("run_id"), F.col("event_type").alias("stage"), F.col("props").alias("message"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return Q.job_state(jobs, runs, events).select("id", "latest_run_id", "run_status", "stage")


@query("SELECT n.upload_id, count(*) AS merge_group_count, count(DISTINCT entity_id) AS entity_count FROM members m JOIN norm n ON n.record_id = m.normalized_record_id WHERE m.status = 'confirmed' GROUP BY n.upload_id")
def merged_uploads(spark, sf):
    uploads = spark.createDataFrame([(i, f"f{i}.csv") for i in range(1, 4)], "id long, file_name string")
    return Q.merged_uploads(D.memberships(spark, sf), D.records(spark, sf), uploads).select("upload_id", "merge_group_count", "entity_count")


@query(f"SELECT g.group_id, 'GOLDEN_RECORD' AS row_type, NULL::BIGINT AS prior_record_id, g.clean_name AS golden_clean_name, '' AS prior_clean_name FROM (SELECT group_id, {_pick('clean_name')} FROM comp LEFT JOIN gbest USING (group_id) GROUP BY group_id) g UNION ALL SELECT g.group_id, CASE WHEN record_id % 5 = 0 THEN 'EXCLUDED_MEMBER' ELSE 'PRIOR_MATCHED_MEMBER' END, record_id, g.clean_name, n.clean_name FROM (SELECT group_id, {_pick('clean_name')} FROM comp LEFT JOIN gbest USING (group_id) GROUP BY group_id) g JOIN comp USING (group_id) JOIN norm n USING (record_id)")
def merge_detail_long(spark, sf):
    members = D.approved_groups(spark, sf)
    out = Q.merge_detail(_golden(spark, sf), members.where("record_id % 5 <> 0"), members.where("record_id % 5 = 0"), D.records(spark, sf))
    return out.select("group_id", "row_type", "prior_record_id", "golden_clean_name", "prior_clean_name")


@query("SELECT upload_id, row_index, n FROM (SELECT upload_id, count(*) AS n FROM donors GROUP BY 1) JOIN (SELECT DISTINCT unnest(range(1, 1 + (SELECT max(n) FROM (SELECT count(*) AS n FROM donors GROUP BY upload_id)))) AS row_index) ON row_index <= n")
def ingest_row_index(spark, sf):
    """Raw records keep a 1-based index without gaps in each upload."""
    d, out = D.donors(spark, sf), None
    for u in (1, 2, 3):
        own = sinks.raw_rows(d.where(F.col("upload_id") == u), u, ["record_id"]).select("upload_id", "row_index")
        out = own if out is None else out.unionByName(own)
    n = d.groupBy("upload_id").agg(F.count("*").alias("n"))
    return out.join(n, "upload_id")


@query("SELECT count(*) FILTER (clean_name <> '') AS name, count(*) FILTER (clean_tc <> '') AS tc, count(*) FILTER (clean_phone <> '') AS phone, count(*) FILTER (clean_email <> '') AS email, count(*) FILTER (clean_address <> '') AS address FROM norm")
def ingestion_fill_rates(spark, sf):
    return D.records(spark, sf).agg(*(Q.filled(f"clean_{c}").alias(c) for c in ("name", "tc", "phone", "email", "address")))


@query("SELECT count(*) AS n, count(DISTINCT (left_id, right_id)) AS different FROM cand")
def insert_new_pairs(spark, sf):
    c = D.candidates(spark, sf).select("detection_run_id", "left_id", "right_id")
    both = c.unionByName(c.select("detection_run_id", F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))).withColumn("position", F.lit(1))
    return sinks.new_pairs(both).agg(F.count("*").alias("n"), F.count_distinct("left_id", "right_id").alias("different"))


@query("SELECT round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM (SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 0 AND predicted = 0) AS tn FROM (SELECT CAST(decision = 'approved' AS INT) AS label, CAST(score >= 0.5 AS INT) AS predicted FROM cand WHERE decision <> 'pending'))")
def classification_metrics(spark, sf):
    c = D.candidates(spark, sf).where("decision <> 'pending'")
    return training.classification_metrics(c.select((F.col("decision") == "approved").cast("int").alias("label"), (F.col("score") >= 0.5).cast("int").alias("predicted")))


@query()
def training_pairs(spark, sf):
    return training.training_pairs(D.records(spark, sf))


@query()
def forest_scores(spark, sf):
    """Weak labels, a forest on the offline features, and its probabilities."""
    f = cut(X.rules_features(_flat(spark, sf)), "features")
    model, _ = training.train_forest(training.weakly_labelled(f), training.OFFLINE)
    return training.predict(model, f).select(*IDS, "ml_probability")


@query()
def similarity_functions(spark, sf):
    S.register(spark)
    f = _flat(spark, sf).select(*IDS, F.col("left_clean_name").alias("a"), F.col("right_clean_name").alias("b"))
    return spark.sql("SELECT left_id, right_id, jaro_winkler_tr(a, b) AS jw, hybrid_name_sim(a, b) AS hybrid, token_name_sim(a, b) AS words, difflib_ratio(a, b) AS ratio, soundex_tr(a) AS soundex FROM {f}", f=f)


@query("SELECT record_id, clean_name, clean_tc FROM norm WHERE upload_id = 2")
def upload_scope(spark, sf):
    from ..sources.readers import scope

    return scope(D.records(spark, sf), upload_id=2).select("record_id", "clean_name", "clean_tc")


#: Feature rows made up from the customers' keys, alike on both engines, so that every branch of the scores, flags and bands is met.
_k = "c_custkey"
_sim = lambda p: f"({_k} * {p} % 101) / 1e2"
_on = lambda c: f"CAST({c} AS INT)"
FEATURE_ROWS = "SELECT *, " + ", ".join((
    f"{_on('shared_contact_flag = 1 AND first_name_similarity < 0.55 AND surname_similarity >= 0.80')} AS shared_contact_name_conflict",
    f"{_on('shared_contact_flag = 1 AND surname_similarity >= 0.80 AND first_name_similarity < 0.70')} AS household_risk_flag",
    f"{_on('phonetic_exact_match = 1 OR metaphone_exact_match = 1')} AS phonetic_close_match",
)) + " FROM (SELECT " + ", ".join((
    f"{_k} AS id", f"{_on(f'{_k} % 5 = 0')} AS tc_exact_match", f"{_on(f'{_k} % 5 = 1')} AS tc_conflict", f"{_on(f'{_k} % 5 < 2')} AS tc_present_both", f"{_on(f'{_k} % 7 = 0')} AS phone_exact_match", f"{_on(f'{_k} % 7 < 2')} AS phone_last7_match",
    f"{_on(f'{_k} % 7 < 5')} AS phone_present_both", f"{_on(f'{_k} % 11 = 0')} AS email_exact_match", f"{_on(f'{_k} % 11 < 6')} AS email_present_both", f"{_on(f'{_k} % 7 = 0 OR {_k} % 11 = 0')} AS shared_contact_flag",
    f"{_on(f'{_k} % 13 = 0')} AS muhatap_no_exact_match", f"{_on(f'{_k} % 13 IN (1, 2, 3)')} AS muhatap_no_conflict", f"{_on(f'{_k} % 13 < 4')} AS muhatap_present_both", f"{_on(f'{_k} % 3 = 0')} AS city_exact_match",
    f"{_on(f'{_k} % 17 < 5')} AS phonetic_exact_match", f"{_on(f'{_k} % 19 < 6')} AS metaphone_exact_match", f"{_on(f'{_k} % 23 < 4')} AS first_name_exact_match", f"{_on(f'{_k} % 29 < 9')} AS surname_exact_match", f"{_on(f'{_k} % 31 < 6')} AS same_surname_name_conflict",
    f"{_on(f'{_k} % 6 > 0')} AS name_present_both", f"{_k} % 8 AS common_non_empty_fields", f"{_k} % 5 - 1 AS level", f"CASE WHEN {_k} % 4 = 0 THEN 'Splink_v4' ELSE 'rules_v1' END AS source",
    *(f"{_sim(p)} AS {n}" for n, p in (("name_similarity", 37), ("name_jaro_winkler", 41), ("name_levenshtein_similarity", 43), ("email_similarity", 53), ("phone_similarity", 59), ("first_name_similarity", 61), ("surname_similarity", 67), ("first_name_jaro_winkler", 71), ("surname_jaro_winkler", 73))),
)) + " FROM customer)"


def _feature_rows(spark, sf) -> DataFrame:
    return spark.sql(FEATURE_ROWS.replace("FROM customer", "FROM {customer}"), customer=D.table(spark, sf, "customer").select("c_custkey"))


_z = f"{C.LOGISTIC_BIAS}" + "".join(f" + {w} * {n}" for n, w in C.LOGISTIC.items())


@query(f"SELECT id, round(1.0 / (1.0 + exp(-({_z}))), 4) AS score FROM ({FEATURE_ROWS})")
def scoring_logistic(spark, sf):
    """All 24 terms."""
    f = _feature_rows(spark, sf)
    return f.select("id", C.logistic_score(C.Features.of(f)).alias("score"))


_top = "30e0 * name_present_both * greatest(name_similarity, first_name_similarity * 0.5e0 + surname_similarity * 0.5e0) + 35e0 * tc_present_both * tc_exact_match + 15e0 * phone_present_both * greatest(phone_similarity, phone_exact_match) + 1e1 * email_present_both * greatest(email_similarity, email_exact_match) + 1e1 * muhatap_present_both * muhatap_no_exact_match"
_bottom = "30e0 * name_present_both + 35e0 * tc_present_both + 15e0 * phone_present_both + 1e1 * email_present_both + 1e1 * muhatap_present_both"


@query(f"SELECT id, CASE WHEN b > 0 THEN CAST(round(CAST(1e2 * t / b AS VARCHAR)::DECIMAL(38, 20), 2) AS DOUBLE) ELSE 0.0 END AS general FROM (SELECT id, {_top} AS t, {_bottom} AS b FROM ({FEATURE_ROWS}))")
def scoring_weighted(spark, sf):
    """All five parts, each with and without."""
    f = _feature_rows(spark, sf)
    return f.select("id", C.weighted_score(C.Features.of(f)).alias("general"))


_noid = "tc_exact_match + tc_conflict + phone_exact_match + email_exact_match = 0"
_flag_sql = {
    "tc_conflict": "tc_conflict = 1", "muhatap_no_conflict": "muhatap_no_conflict = 1", "shared_contact": "shared_contact_flag = 1", "shared_contact_name_conflict": "shared_contact_name_conflict = 1", "household_risk": "household_risk_flag = 1",
    "same_surname_name_conflict": "same_surname_name_conflict = 1", "email_high_identity_weak": "email_similarity >= 0.85 AND tc_exact_match + phone_exact_match = 0 AND name_similarity < 0.8",
    "weak_identity_evidence": f"{_noid} AND name_similarity >= 0.8", "cross_city_contact_mismatch": f"{_noid} AND city_exact_match = 0", "sparse_data": "common_non_empty_fields <= 2",
}
_all = list(_flag_sql)
_kinds = {"rules": [*_all[:6], _all[9]], "linkage": _all, "review": [*_all[:3], _all[5], *_all[6:8], _all[9]]}
_flags_of = lambda kind: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_flag_sql[n]} THEN '{n}' END" for n in _kinds[kind]) + f"], lambda x: x IS NOT NULL), ',') AS {kind}"


@query(f"SELECT id, {', '.join(map(_flags_of, _kinds))} FROM ({FEATURE_ROWS})")
def scoring_flags(spark, sf):
    """All ten risk flags in the three variants."""
    f = _feature_rows(spark, sf)
    return f.select("id", *(F.array_join(C.risk_flags(C.Features.of(f), k), ",").alias(k) for k in _kinds))


@query(f"SELECT id, CASE WHEN tc_conflict = 1 OR (household_risk_flag = 1 AND shared_contact_name_conflict = 1 AND tc_exact_match = 0) OR (name_similarity < 0.55 AND shared_contact_flag = 1) THEN 0 WHEN tc_exact_match = 1 OR (email_exact_match = 1 AND name_similarity >= 0.85) OR (phone_exact_match = 1 AND name_similarity >= 0.88) OR (name_similarity >= 0.97 AND phonetic_exact_match + metaphone_exact_match > 0) THEN 1 ELSE -1 END AS label, 'pending' AS decision, tc_conflict, household_risk_flag, muhatap_no_conflict, CASE WHEN source LIKE 'Splink%' THEN 'splink' WHEN tc_exact_match + phone_exact_match + email_exact_match > 0 THEN 'exact' WHEN phonetic_exact_match + metaphone_exact_match > 0 THEN 'phonetic' WHEN name_similarity > 0 THEN 'fuzzy' ELSE 'ml' END AS match_type FROM ({FEATURE_ROWS})")
def scoring_labels(spark, sf):
    """Weak labels, the decision with its trace, and the type of a match."""
    f = _feature_rows(spark, sf)
    x = C.Features.of(f)
    return f.select("id", C.weak_label(x).alias("label"), C.decision(F.col("name_similarity")).alias("decision"), C.decision_trace(x).alias("t"), C.match_type(x, F.col("source")).alias("match_type")).select("id", "label", "decision", "t.*", "match_type")


_b = lambda c, exact, *steps: "CASE " + (f"WHEN {exact} THEN 'exact_match' " if exact else "") + " ".join(f"WHEN {c} >= {x} THEN '{n}_match'" for x, n in steps)


@query(f"SELECT id, {_b('name_similarity', 'first_name_exact_match = 1', (0.9, 'strong'), (0.7, 'partial'))} WHEN name_similarity > 0 THEN 'mismatch' ELSE 'missing' END AS rules_name, {_b('name_similarity', 'name_similarity >= 1', (0.92, 'strong'), (0.8, 'partial'))} ELSE 'mismatch' END AS review_name, {_b('phone_similarity', 'phone_exact_match = 1', (0.85, 'strong'), (0.6, 'partial'), (0.2, 'weak'))} ELSE 'mismatch' END AS contact, CASE WHEN level = 3 THEN 'exact_match' WHEN first_name_similarity >= 0.95 OR level = 2 THEN 'strong_match' WHEN first_name_similarity >= 0.85 OR level = 1 THEN 'partial_match' ELSE 'mismatch' END AS by_level, CAST(round(100 * name_similarity) AS INT) AS percent FROM ({FEATURE_ROWS})")
def scoring_bands(spark, sf):
    """The four tables of bands, and percent."""
    f = _feature_rows(spark, sf)
    c = F.col
    return f.select("id", C.name_band(c("name_similarity"), c("first_name_exact_match") == 1).alias("rules_name"), C.review_name_band(c("name_similarity")).alias("review_name"), C.contact_band(c("phone_similarity"), c("phone_exact_match") == 1).alias("contact"), C.level_band(c("level"), c("first_name_similarity"), 0.95, 0.85).alias("by_level"), C.percent(c("name_similarity")).alias("percent"))


@query("SELECT left_id, right_id, jw, phone, mail FROM (VALUES (1, 2, 0.9611, 0.4667, 0.7333)) t(left_id, right_id, jw, phone, mail)")
def similarity_vectors(spark, sf):
    """Values worked out by hand: MARTHA and MARHTA, two phones, two e-mails."""
    S.register(spark)
    return spark.sql("SELECT 1 AS left_id, 2 AS right_id, jaro_winkler_tr('MARTHA', 'MARHTA') AS jw, phone_sim('054463982', '054362862') AS phone, email_sim('zehra@gmail.com', 'zehrabagis@gmail.com') AS mail")
