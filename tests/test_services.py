"""Tables of the workflow: changes that meet nothing, repeat, or go too far."""

from __future__ import annotations

from mergewright.operators import services as V
from mergewright.plans import reports


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_decisions_last_word_counts(spark):
    m = spark.sql("SELECT * FROM VALUES (1L, 'pending', 0.5), (2L, 'pending', null), (3L, 'pending', 0.9) t(id, status, ml_score)")
    said = spark.sql("SELECT * FROM VALUES (1L, 'confirmed', 'a', null, 1), (1L, 'rejected', null, 'no', 2), (9L, 'confirmed', 'a', null, 1), (2L, 'odd', 'a', null, 3) t(id, status, by, reason, at)")
    out = V.decide_matches(m, said)
    assert rows(out.select("id", "status")) == [(1, "rejected"), (2, "pending"), (3, "pending")]
    assert out.where("id = 1").first().approved_by == "system"
    assert [r.id for r in V.pending_top(out, n=5).collect()] == [3, 2]


def test_lookup_only_by_allowed_columns(spark):
    r = spark.sql("SELECT 1 AS record_id, 'A' AS clean_city, 'x' AS clean_name")
    assert V.by_key(r, "clean_city", "A").count() == 1
    assert V.by_key(r, "clean_name", "x").count() == 0


def test_switching_off_twice_lowers_once_and_never_below_zero(spark):
    e = spark.sql("SELECT 1L AS id, 0L AS donor_count UNION ALL SELECT 2L, 2L")
    m = spark.sql("SELECT * FROM VALUES (1L, 1L, 5L, true), (2L, 2L, 6L, true), (3L, 2L, 7L, false) t(id, entity_id, donor_id, is_active)")
    e2, m2 = V.deactivate(e, m, spark.sql("SELECT * FROM VALUES (1L), (2L), (2L), (3L), (9L) t(id)"))
    assert rows(e2) == [(1, 0), (2, 1)] and not m2.where("is_active").count()
    assert rows(V.deactivate(e2, m2, m.select("id"))[0]) == [(1, 0), (2, 1)]


def test_merge_makes_entity_maps_and_marks_match(spark):
    e = spark.sql("SELECT 1L AS id, 'A' AS canonical_name, 1L AS donor_count")
    maps = spark.sql("SELECT 1L AS id, 1L AS entity_id, 5L AS donor_id, true AS is_active")
    m = spark.sql("SELECT 4L AS id, 'pending' AS status")
    e2, maps2, m2 = V.merge_donors(e, maps, m, spark.sql("SELECT 2L AS entity_id, 'B' AS canonical_name, 4L AS match_id, array(5L, 6L) AS donor_ids"))
    assert rows(e2) == [(1, "A", 1), (2, "B", 2)] and m2.first().status == "merged"
    assert rows(V.maps_of(maps2, 5).select("entity_id")) == [(1,), (2,)]


def test_progress_is_kept_between_0_and_100(spark):
    jobs = spark.sql("SELECT 1L AS id, 'running' AS status, 0.0D AS progress")
    said = spark.sql("SELECT * FROM VALUES (1L, 1, 250.0D, null), (1L, 2, null, 'failed') t(id, at, progress, status)")
    out = V.job_progress(jobs, said).first()
    assert (out.status, out.progress, out.updated_at) == ("failed", 100.0, 2)


def test_meta_of_a_run_is_merged(spark):
    runs = spark.sql("SELECT 1L AS id, 'running' AS status, timestamp_millis(0) AS started_at, map('a', '1', 'b', '2') AS meta UNION ALL SELECT 2L, 'running', null, null")
    ends = spark.sql("SELECT 1L AS id, 'done' AS status, timestamp_millis(1500) AS completed_at, map('b', '3') AS meta UNION ALL SELECT 2L, 'done', timestamp_millis(5), null")
    out = {r.id: r for r in V.finalize_runs(runs, ends).collect()}
    assert out[1].meta == {"a": "1", "b": "3"} and out[1].duration_ms == 1500
    assert out[2].meta == {} and out[2].duration_ms is None


def test_groups_of_other_runs_stay(spark):
    stored = spark.sql("SELECT * FROM VALUES (1L, 'approved', 1L, 1L), (2L, 'approved', 1L, 1L) t(detection_run_id, decision, group_id, record_id)")
    c = spark.sql("SELECT * FROM VALUES (1L, 'approved', 3L, 4L), (1L, 'pending', 4L, 5L), (2L, 'approved', 8L, 9L) t(detection_run_id, decision, left_id, right_id)")
    out = rows(V.refresh_groups(stored, c, spark.sql("SELECT 1L AS detection_run_id")))
    assert out == [(1, "approved", 3, 3), (1, "approved", 3, 4), (1, "pending", 4, 4), (1, "pending", 4, 5), (2, "approved", 1, 1)]


def test_scope_and_empty_tables(spark):
    c = spark.sql("SELECT * FROM VALUES (1L, 1L, 'pending'), (2L, 2L, 'approved'), (3L, 3L, 'pending') t(id, detection_run_id, decision)")
    r = spark.sql("SELECT * FROM VALUES (1L, 7L), (2L, 7L), (3L, 8L) t(id, upload_id)")
    assert rows(V.in_scope(c, r).select("id")) == [(2,), (3,)]
    assert rows(V.in_scope(c, r, 7, latest=False).select("id")) == [(1,), (2,)]
    assert V.in_scope(c, r.where("false")).count() == 0
    up = spark.sql("SELECT 7L AS id, 1 AS created_at")
    assert V.uploads_with_records(up, r.where("false"), r.selectExpr("id", "upload_id", "'x' AS status", "1 AS created_at")).count() == 0


def test_group_rows_count_a_record_once(spark):
    m = spark.sql("SELECT * FROM VALUES ('approved', 1L, 2L), ('approved', 1L, 1L), ('approved', 1L, 2L) t(decision, group_id, record_id)")
    assert rows(reports.group_rows(m).select("group_id", "record_ids", "record_count")) == [("rec_1", "1,2", 2)]
