"""Queries of the workflow tables, the reads by scope and the exports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import services as V
from ..sources import sinks
from . import donors as D
from . import reports as Q
from .queries import query

_run = "(1 + (left_id + right_id) % 12)"


def _by_run(spark, sf):
    """Candidates of twelve detection runs, and the runs, of five uploads."""
    c = D.candidates(spark, sf).withColumn("detection_run_id", 1 + (F.col("left_id") + F.col("right_id")) % 12)
    return c, spark.range(1, 13).select("id", (F.col("id") % 5).alias("upload_id"))


@query(f"SELECT id, {_run} AS detection_run_id, decision FROM cand WHERE {_run} IN (SELECT max(i) FROM range(1, 13) t(i) GROUP BY i % 5)")
def candidates_latest_runs(spark, sf):
    c, r = _by_run(spark, sf)
    return V.in_scope(c, r).select("id", "detection_run_id", "decision")


@query(f"SELECT id, {_run} AS detection_run_id, decision FROM cand WHERE {_run} % 5 = 2 AND decision = 'approved'")
def candidates_of_upload(spark, sf):
    c, r = _by_run(spark, sf)
    return V.in_scope(c, r, upload_id=2, latest=False, decision=" Approved ").select("id", "detection_run_id", "decision")


@query("SELECT u.id, r.id AS latest_run_id, r.status AS run_status FROM (SELECT DISTINCT upload_id AS id FROM runs WHERE upload_id IN (SELECT upload_id FROM norm)) u JOIN (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY created_at DESC, id DESC) AS n FROM runs) r ON r.upload_id = u.id AND r.n = 1")
def uploads_with_records(spark, sf):
    r = D.runs(spark, sf)
    uploads = r.groupBy(F.col("upload_id").alias("id")).agg(F.min("created_at").alias("created_at"))
    return V.uploads_with_records(uploads, D.records(spark, sf), r).select("id", "latest_run_id", "run_status")


def _matches(spark, sf):
    return D.candidates(spark, sf).select("id", "upload_id", F.col("score").alias("ml_score"), F.lit("pending").alias("status"))


def _said(spark, sf):
    m, k = D.candidates(spark, sf), F.col("left_id") % 4
    return m.where(k < 2).select("id", F.when(k == 0, "confirmed").otherwise("rejected").alias("status"), F.when(k == 0, F.lit("ayse")).alias("by"), F.lit("other person").alias("reason"), F.col("right_id").alias("at"))


@query("SELECT id, CASE left_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, CASE left_id % 4 WHEN 0 THEN 'ayse' WHEN 1 THEN 'system' END AS approved_by, CASE left_id % 4 WHEN 0 THEN right_id END AS approved_at, CASE left_id % 4 WHEN 1 THEN 'other person' END AS rejected_reason, CASE left_id % 4 WHEN 1 THEN right_id END AS rejected_at FROM cand")
def match_decisions(spark, sf):
    return V.decide_matches(_matches(spark, sf), _said(spark, sf)).select("id", "status", "approved_by", "approved_at", "rejected_reason", "rejected_at")


@query("SELECT id, score AS ml_score FROM cand WHERE left_id % 4 >= 2 ORDER BY score DESC, id LIMIT 100")
def pending_top(spark, sf):
    """The limit is the report's own."""
    return V.pending_top(V.decide_matches(_matches(spark, sf), _said(spark, sf))).select("id", "ml_score")


@query("SELECT record_id, clean_city FROM norm WHERE clean_city = 'ISTANBUL'")
def donors_by_key(spark, sf):
    return V.by_key(D.records(spark, sf), "clean_city", "ISTANBUL").select("record_id", "clean_city")


def _legacy(spark, sf):
    m = D.memberships(spark, sf)
    maps = m.select(F.col("normalized_record_id").alias("id"), "entity_id", F.col("normalized_record_id").alias("donor_id"), F.lit(True).alias("is_active"))
    ents = D.entities(m).select("id", "canonical_name", "canonical_city", F.lit(0).cast("long").alias("donor_count"))
    return V.map_donors(ents, maps.where("false"), maps)


@query("SELECT entity_id AS id, count(*) FILTER (normalized_record_id % 3 <> 0) AS donor_count FROM members GROUP BY entity_id")
def entity_donor_counts(spark, sf):
    """Maps made, then every third switched off."""
    e, m = _legacy(spark, sf)
    return V.deactivate(e, m, m.where("id % 3 = 0").select("id"))[0].select("id", "donor_count")


@query("SELECT m.entity_id, n.record_id, n.clean_name FROM members m JOIN norm n ON n.record_id = m.normalized_record_id WHERE n.record_id % 3 <> 0")
def entity_donors(spark, sf):
    e, m = _legacy(spark, sf)
    m = V.deactivate(e, m, m.where("id % 3 = 0").select("id"))[1]
    return V.donors_of(m, D.records(spark, sf)).select("entity_id", "record_id", "clean_name")


@query("SELECT id, canonical_name, CASE WHEN id % 2 = 0 THEN 'ANKARA' ELSE canonical_city END AS canonical_city FROM entities")
def entity_update(spark, sf):
    e, _ = _legacy(spark, sf)
    return V.update_entities(e, e.select("id", F.when(F.col("id") % 2 == 0, "ANKARA").otherwise("").alias("canonical_city"))).select("id", "canonical_name", "canonical_city")


@query("SELECT -id AS id, 'MERGED ' || id AS canonical_name, 2 AS donor_count, 'merged' AS status FROM cand WHERE decision = 'approved'")
def merge_donors(spark, sf):
    e, m = _legacy(spark, sf)
    c = D.candidates(spark, sf).where("decision = 'approved'")
    merges = c.select((-F.col("id")).alias("entity_id"), F.concat(F.lit("MERGED "), "id").alias("canonical_name"), F.col("id").alias("match_id"), F.array("left_id", "right_id").alias("donor_ids"))
    e, _, done = V.merge_donors(e, m, _matches(spark, sf), merges)
    return e.join(done.select((-F.col("id")).alias("id"), "status"), "id").select("id", "canonical_name", "donor_count", "status")


@query("SELECT job_id AS id, CASE WHEN job_id % 2 = 0 THEN 'completed' ELSE 'running' END AS status, least(100.0, greatest(0.0, max_by(total_processed * 1.5 - 20, id))) AS progress FROM runs GROUP BY job_id")
def job_progress(spark, sf):
    r = D.runs(spark, sf)
    jobs = r.select(F.col("job_id").alias("id")).distinct().select("id", F.lit("running").alias("status"), F.lit(0.0).alias("progress"))
    said = r.select(F.col("job_id").alias("id"), F.col("id").alias("at"), F.when(F.col("job_id") % 2 == 0, "completed").alias("status"), (F.col("total_processed") * F.lit(1.5) - 20).alias("progress"))
    return V.job_progress(jobs, said).select("id", "status", "progress")


@query("SELECT id, 'done' AS status, (id % 1000) * 1000 AS duration_ms, 'b' || id AS kept, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'old' END AS patched FROM runs")
def run_finalize(spark, sf):
    r = D.runs(spark, sf)
    at = lambda n: F.timestamp_millis(F.lit(1700000000000) + n)
    runs = r.select("id", F.lit("running").alias("status"), at(F.lit(0)).alias("started_at"), F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.concat(F.lit("b"), "id")).alias("meta"))
    ends = r.select("id", F.lit("done").alias("status"), at(F.col("id") % 1000 * 1000).alias("completed_at"), F.when(F.col("id") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"))).alias("meta"))
    return V.finalize_runs(runs, ends).select("id", "status", "duration_ms", F.col("meta")["b"].alias("kept"), F.col("meta")["a"].alias("patched"))


@query("SELECT 1 AS detection_run_id, 'approved' AS decision, group_id, record_id FROM comp UNION ALL SELECT 2, 'pending', 7, 7")
def groups_refresh(spark, sf):
    """Groups of run 1, stored wrongly, are made anew; those of run 2 stay."""
    stored = spark.sql("SELECT 1L AS detection_run_id, 'approved' AS decision, 5L AS group_id, 9L AS record_id UNION ALL SELECT 2L, 'pending', 7L, 7L")
    c = D.candidates(spark, sf).where("decision = 'approved'")
    return V.refresh_groups(stored, c, spark.sql("SELECT 1L AS detection_run_id"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'later' WHEN c_custkey % 3 = 1 THEN trim(c_name) ELSE 'alt' END AS v FROM customer")
def key_picker(spark, sf):
    """Keys in broken letters and other cases; a later map goes over an earlier one; empty values fall through to the next name."""
    k = F.col("c_custkey") % 3
    c = D.table(spark, sf, "customer").select("c_custkey", F.create_map(F.lit("Ad Soyadı".encode().decode("cp1252")), F.when(k == 2, "").otherwise(F.col("c_name")), F.lit("unvan"), F.lit(" alt ")).alias("m1"), F.when(k == 0, F.create_map(F.lit("AD-SOYADI"), F.lit("later"))).alias("m2"))
    return c.select(F.col("c_custkey").alias("id"), V.pick_value(["m1", "m2"], ["ad_soyadi", "Unvan"]).alias("v"))


@query("SELECT CAST(id AS VARCHAR) AS match_id, '1' AS detection_run_id, CAST(left_id AS VARCHAR) AS left_id, CAST(right_id AS VARCHAR) AS right_id, '' AS match_type, decision FROM cand WHERE decision = 'approved'")
def export_approved(spark, sf):
    rows = Q.approved_matches(D.candidates(spark, sf))
    return sinks.csv_view(rows, Q.APPROVED_FIELDS).select("match_id", "detection_run_id", "left_id", "right_id", "match_type", "decision")


@query("SELECT 'rec_' || group_id AS group_id, string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY record_id) AS record_ids, count(*) AS record_count FROM comp GROUP BY group_id")
def export_groups(spark, sf):
    m = D.approved_groups(spark, sf).withColumn("decision", F.lit("approved"))
    return Q.group_rows(m).select("group_id", "record_ids", "record_count")
