"""DuckDB statements for the queries: common table expressions by name, put before a statement as it needs them."""

from __future__ import annotations

import re

from ..functions.scoring import LOGISTIC, LOGISTIC_BIAS
from ..functions.text import LOWER_ASCII, TURKISH, UPPER_ASCII
from .donors import DONORS

ALL = "[^A-Z0-9]"


def tr(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(upper(translate({c}, '{TURKISH}', '{UPPER_ASCII}')), '{ALL}', ' ', 'g'), ' +', ' ', 'g'))"


def low(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(translate({c}, '{TURKISH}', '{LOWER_ASCII}')), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"


def _collapse(c: str, letters: str) -> str:
    for x in letters:
        c = f"regexp_replace({c}, '{x}+', '{x}', 'g')"
    return c


def soundex(c: str) -> str:
    """c: a lower-case plain name."""
    t = f"replace({c}, ' ', '')"
    code = _collapse(f"translate({t}, 'abcdefghijklmnopqrstuvwxyz0123456789', '012301200224550126230102020000000000')", "0123456")
    return f"CASE WHEN {t} = '' THEN '' ELSE substr(upper(substr({t}, 1, 1)) || replace(substr({code}, 2), '0', '') || '000', 1, 4) END"


def metaphone(c: str) -> str:
    t = f"regexp_replace(replace(replace(replace(replace({c}, 'ph', 'f'), 'w', 'v'), 'x', 'ks'), 'q', 'k'), '[aeiou]', '', 'g')"
    return f"upper(substr(replace({_collapse(t, 'bcdfghjklmnpqrstvwxyz0123456789 ')}, ' ', ''), 1, 12))"


def words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda x: x <> '')"


def email_key(c: str) -> str:
    return f"CASE WHEN contains({c}, '@') THEN replace(split_part(split_part({c}, '@', 1), '+', 1), '.', '') || '@' || substr({c}, position('@' IN {c}) + 1) ELSE {c} END"


def lev(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE round(1.0 - levenshtein({low(a)}, {low(b)}) / greatest(length({low(a)}), length({low(b)}))::DOUBLE, 4) END"


def pass_sql(i: int, key: str, cap: int | None) -> str:
    """Pairs by one key of n, with the number of the pass."""
    limit = f" AND count(*) <= {cap}" if cap else ""
    return f"SELECT a.record_id AS left_id, b.record_id AS right_id, {i} AS pass, a.{key} AS key FROM norm a JOIN norm b ON a.{key} = b.{key} AND a.record_id < b.record_id WHERE a.{key} IN (SELECT {key} FROM norm WHERE {key} <> '' GROUP BY {key} HAVING count(*) > 1{limit})"


PASSES = (("clean_tc", 20), ("clean_phone", 100), ("email_normalized_key", 100), ("clean_muhatap_no", 50), ("name_phonetic_key", 200))
_both = lambda c: f"(l.{c} <> '' AND r.{c} <> '')"
_eq = lambda c: f"CAST({_both(c)} AND l.{c} = r.{c} AS INT)"
_ne = lambda c: f"CAST({_both(c)} AND l.{c} <> r.{c} AS INT)"
_common = " + ".join(f"CAST({_both(c)} AS INT)" for c in ("clean_tc", "clean_phone", "clean_email", "clean_name", "clean_city", "clean_address", "clean_muhatap_no"))
_used = ("tc_exact_match", "tc_conflict", "phone_exact_match", "phone_last7_match", "email_exact_match", "city_exact_match", "muhatap_no_exact_match", "muhatap_no_conflict", "phonetic_exact_match", "metaphone_exact_match", "name_levenshtein_similarity", "common_non_empty_fields")
LOGIT = "round(1.0 / (1.0 + exp(-(" + f"{LOGISTIC_BIAS}" + "".join(f" + {w} * {n}" for n, w in LOGISTIC.items() if n in _used) + "))), 4)"


def components(edges: str) -> str:
    """Names reach (x, y) and comp (record_id, group_id) over a query of edges a, b."""
    return f"reach(x, y) AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges}) UNION SELECT r.x, e.b FROM reach r JOIN (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})) e ON r.y = e.a), comp AS (SELECT x AS record_id, least(x, min(y)) AS group_id FROM reach GROUP BY x)"


CTES: dict[str, str] = {
    "donors": f"donors AS ({DONORS})",
    "n0": f"n0 AS (SELECT *, {tr('name')} AS clean_name, {tr('city')} AS clean_city, {tr('address')} AS clean_address, regexp_replace(tc, '\\D', '', 'g') AS clean_tc, right(regexp_replace(phone, '\\D', '', 'g'), 10) AS clean_phone, lower(regexp_replace(email, '\\s', '', 'g')) AS clean_email, upper(regexp_replace(muhatap_no, '\\s', '', 'g')) AS clean_muhatap_no FROM donors)",
    "n1": f"n1 AS (SELECT *, coalesce({words('clean_name')}[1], '') AS first_name, CASE WHEN len({words('clean_name')}) > 1 THEN {words('clean_name')}[-1] ELSE '' END AS last_name, array_to_string(list_sort(list_distinct({words('clean_name')})), ' ') AS ordered_name, right(clean_phone, 7) AS phone_last7, {email_key('clean_email')} AS email_normalized_key, clean_name <> '' AS is_valid FROM n0)",
    "n2": f"n2 AS (SELECT *, {soundex('lower(ordered_name)')} AS name_phonetic_key, {metaphone('lower(ordered_name)')} AS name_metaphone_key FROM n1)",
    "norm": "norm AS (SELECT *, CASE WHEN clean_tc <> '' THEN 'tc:' || clean_tc WHEN phone_last7 <> '' THEN 'phone:' || phone_last7 WHEN email_normalized_key <> '' THEN 'email:' || email_normalized_key WHEN name_phonetic_key <> '' AND clean_city <> '' THEN 'phonetic_city:' || name_phonetic_key || ':' || clean_city WHEN ordered_name <> '' THEN 'name:' || ordered_name ELSE '' END AS blocking_key FROM n2)",
    "allpairs": "allpairs AS (" + " UNION ALL ".join(pass_sql(i, k, c) for i, (k, c) in enumerate(PASSES)) + ")",
    "pairs": "pairs AS (SELECT left_id, right_id, min(pass) AS pass, arg_min(key, (pass, key)) AS key FROM allpairs GROUP BY left_id, right_id)",
    "flags": f"flags AS (SELECT p.left_id, p.right_id, {_eq('clean_tc')} AS tc_exact_match, {_ne('clean_tc')} AS tc_conflict, {_eq('clean_phone')} AS phone_exact_match, CAST({_both('clean_phone')} AND right(l.clean_phone, 7) = right(r.clean_phone, 7) AS INT) AS phone_last7_match, {_eq('clean_email')} AS email_exact_match, {_eq('clean_city')} AS city_exact_match, {_eq('clean_muhatap_no')} AS muhatap_no_exact_match, {_ne('clean_muhatap_no')} AS muhatap_no_conflict, {_eq('name_phonetic_key')} AS phonetic_exact_match, {_eq('name_metaphone_key')} AS metaphone_exact_match, {lev('l.clean_name', 'r.clean_name')} AS name_levenshtein_similarity, {_common} AS common_non_empty_fields, l.clean_phone AS lp, r.clean_phone AS rp, l.clean_name AS ln, r.clean_name AS rn FROM pairs p JOIN norm l ON l.record_id = p.left_id JOIN norm r ON r.record_id = p.right_id)",
    "cand": "cand AS (SELECT left_id * 1000000 + right_id AS id, 1 AS detection_run_id, left_id, right_id, (left_id * 7 + right_id * 13) % 101 / 100.0 AS score, CASE WHEN (left_id + right_id) % 4 <> 0 THEN (left_id * 3 + right_id) % 97 / 96.0 END AS confidence, CASE (left_id + right_id) % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS decision, left_id % 1000 AS created_at, 1 + left_id % 3 AS upload_id FROM pairs)",
    "reach": components("SELECT left_id AS a, right_id AS b FROM cand WHERE decision = 'approved'"),
    "members": "members AS (SELECT group_id AS entity_id, record_id AS normalized_record_id, CASE WHEN record_id % 5 = 0 THEN 'pending' ELSE 'confirmed' END AS status FROM comp)",
    "entities": "entities AS (SELECT DISTINCT entity_id AS id, CASE WHEN entity_id % 2 = 0 THEN 'ENTITY ' || entity_id ELSE '' END AS canonical_name, CASE WHEN entity_id % 3 = 0 THEN 'ISTANBUL' END AS canonical_city, 'E' || entity_id AS canonical_muhatap_no, entity_id AS golden_record_id FROM members)",
    "acts": "acts AS (SELECT event_id AS id, event_id % 50 AS match_id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'click' THEN 'rejected' ELSE 'pending' END AS decision, ts AS decided_at FROM events)",
    "runs": "runs AS (SELECT o_orderkey AS id, o_custkey % 20 AS upload_id, o_orderkey % 7 AS job_id, o_orderdate AS created_at, o_orderstatus AS status, o_orderkey % 100 AS total_processed, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 90 END AS success_count, o_orderkey % 10 AS failed_count, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 30 END AS duplicate_group_count, o_orderkey % 60 AS affected_record_count FROM orders)",
    "gval": "gval AS (SELECT g.group_id, n.*, row_number() OVER (PARTITION BY g.group_id ORDER BY CAST(clean_name <> '' AS INT) + CAST(clean_tc <> '' AS INT) + CAST(clean_phone <> '' AS INT) + CAST(clean_email <> '' AS INT) + CAST(clean_city <> '' AS INT) + CAST(clean_address <> '' AS INT) + CAST(clean_muhatap_no <> '' AS INT) DESC, n.record_id) AS ord FROM comp g JOIN norm n USING (record_id))",
    "glong": "glong AS (" + " UNION ALL ".join(f"SELECT group_id, record_id, ord, '{f}' AS field, {v} AS val, {p} AS pref, {x} AS longest FROM gval" for f, v, p, x in (("clean_name", "clean_name", 0, "false"), ("clean_tc", "CASE WHEN length(clean_tc) = 11 THEN clean_tc ELSE '' END", 11, "false"), ("clean_phone", "clean_phone", 10, "false"), ("clean_email", "CASE WHEN contains(clean_email, '@') THEN split_part(split_part(clean_email, '@', 1), '+', 1) || '@' || split_part(clean_email, '@', 2) ELSE '' END", 0, "false"), ("clean_city", "clean_city", 0, "false"), ("clean_address", "clean_address", 0, "true"), ("clean_muhatap_no", "clean_muhatap_no", 0, "false"))) + ")",
    "gbest": "gbest AS (SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY cnt DESC, (length(val) = pref) DESC, length(val) DESC, ord) AS i FROM (SELECT *, CASE WHEN longest THEN 0 ELSE count(*) OVER (PARTITION BY group_id, field, val) END AS cnt FROM glong WHERE val <> ''))",
}
_names = {"reach": ("reach", "comp")}


def with_(statement: str) -> str:
    """The statement with the expressions it names, directly or not, before it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for key in CTES:
            if key not in need and any(re.search(rf"\b(FROM|JOIN)\s+{n}\b", text) for n in _names.get(key, (key,))):
                need.append(key)
                visit(CTES[key])

    visit(statement)
    order = [k for k in CTES if k in need]
    return ("WITH RECURSIVE " + ", ".join(CTES[k] for k in order) + " " if order else "") + statement
