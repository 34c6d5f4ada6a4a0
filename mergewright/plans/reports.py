"""Reports, the clean dataset and its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_time


def between(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a period, both ends in it; an end that is no date in one of three forms doesn't limit."""
    for text, keep in ((start, lambda c, t: c >= t), (end, lambda c, t: c <= t)):
        if text:
            t = parse_time(F.lit(text))
            df = df.where(t.isNull() | keep(F.col(column), t))
    return df


def _rate(part: Column, whole: Column, places: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100, places)


def _decisions() -> list[Column]:
    return [F.count_if(F.col("decision") == d).alias(d) for d in ("approved", "rejected", "pending")]


def _one(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = frames[0].withColumn("_one", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def overview(uploads: DataFrame, records: DataFrame, candidates: DataFrame) -> DataFrame:
    return _one(uploads.agg(F.count("*").alias("total_uploads")), records.agg(F.count("*").alias("total_normalized_records")), candidates.agg(F.count("*").alias("total_match_candidates"), *_decisions()))


def filled(c: str) -> Column:
    return F.count_if(F.coalesce(F.col(c), F.lit("")) != "")


def data_quality(records: DataFrame, runs: DataFrame) -> DataFrame:
    total = F.count("*")
    fills = [_rate(filled(f"clean_{c}"), total).alias(f"{c}_fill_rate") for c in ("tc", "phone", "email")]
    valid = F.count_if(F.coalesce("is_valid", F.lit(False)))
    r = records.agg(total.alias("total_normalized_records"), valid.alias("valid_records"), (total - valid).alias("invalid_records"), _rate(valid, total).alias("validity_rate"), *fills)
    sums = [F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("long").alias(n) for c, n in (("total_processed", "total_processed"), ("success_count", "total_success"), ("failed_count", "total_failed"))]
    return _one(r, runs.agg(F.count("*").alias("normalization_runs"), *sums))


def detection_summary(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("long").alias(n) for c, n in (("duplicate_group_count", "total_duplicate_groups"), ("affected_record_count", "total_affected_records"))]
    c = candidates.agg(F.count("*").alias("total_match_candidates"), *_decisions(), F.round(F.coalesce(F.avg("score"), F.lit(0.0)) * 100, 2).alias("avg_score_pct"))
    return _one(runs.agg(F.count("*").alias("total_detection_runs"), *sums), c)


def review_summary(actions: DataFrame) -> DataFrame:
    return actions.agg(F.count("*").alias("total_reviews"), F.count_if(F.col("decision") == "approved").alias("approvals"), F.count_if(F.col("decision") == "rejected").alias("rejections"))


def recent_reviews(actions: DataFrame, candidates: DataFrame, n: int = 5) -> DataFrame:
    """The last reviews with the pairs they were of."""
    last = actions.orderBy(F.desc("decided_at"), F.desc("id")).limit(n)
    pair = candidates.select(F.col("id").alias("match_id"), "left_id", "right_id")
    return last.join(pair, "match_id", "left").select("id", F.coalesce("decided_by", F.lit("system")).alias("user"), "decision", F.col("decided_at").alias("date"), F.concat(F.lit("match_"), "match_id").alias("group_id"), "match_id", "left_id", "right_id")


def upload_history(uploads: DataFrame, n: int = 30) -> DataFrame:
    return uploads.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select("id", "file_name", F.coalesce("source_type", F.lit("unknown")).alias("source_type"), F.coalesce("total_records", F.lit(0)).alias("total_records"), "status", "created_at")


def match_stats(candidates: DataFrame) -> DataFrame:
    """By upload: how many pairs, by decision, and the mean confidence."""
    sure = F.round(F.coalesce(F.avg(F.coalesce("confidence", "score")), F.lit(0.0)), 4)
    return candidates.groupBy("upload_id").agg(F.count("*").alias("total"), *_decisions(), sure.alias("avg_confidence"))


def entity_summary(entities: DataFrame, entity_map: DataFrame) -> DataFrame:
    """Legacy view: of each entity its donors, and those active."""
    m = entity_map.select(F.col("entity_id").alias("id"), "donor_id", "is_active")
    return entities.join(m, "id", "left").groupBy("id", "canonical_name").agg(F.count("donor_id").alias("total_donors"), F.count(F.when(F.col("is_active"), 1)).alias("active_donors"))


def pending_matches(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Pending pairs with both records' names and contacts, the surest first."""
    side = lambda s: records.select(F.col("record_id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in ("clean_name", "clean_phone", "clean_email", "clean_city")))
    return candidates.where("decision = 'pending'").join(side("left"), "left_id").join(side("right"), "right_id").orderBy(F.desc_nulls_last("score"), "left_id", "right_id")


def candidate_list(candidates: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """A page of candidates by confidence, else score; then the newest."""
    from ..operators.groups import page

    return page(candidates.orderBy(F.desc_nulls_last(F.coalesce("confidence", "score")), F.desc("created_at"), "id"), number, size)


def pipeline_status(records: DataFrame, runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """By upload: normalized records, the latest run and the candidates."""
    last = runs.groupBy("upload_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("latest_run_id"))
    n = records.groupBy("upload_id").agg(F.count("*").alias("normalized_records"))
    c = candidates.groupBy("upload_id").agg(F.count("*").alias("match_candidates"))
    return n.join(last, "upload_id", "left").join(c, "upload_id", "left").fillna(0, ["match_candidates"])


def job_state(jobs: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """Each job with its latest pipeline run and that run's latest event."""
    r = runs.groupBy("job_id").agg(F.max_by(F.struct(F.col("id").alias("run_id"), F.col("status").alias("run_status")), F.struct("created_at", "id")).alias("r"))
    e = events.groupBy("run_id").agg(F.max_by(F.struct("stage", "message"), F.struct("created_at", "id")).alias("e"))
    return jobs.join(r, jobs.id == r.job_id, "left").join(e, F.col("r.run_id") == F.col("run_id"), "left").select(jobs.id, jobs.status, F.col("r.run_id").alias("latest_run_id"), F.col("r.run_status").alias("run_status"), F.col("e.stage").alias("stage"), F.col("e.message").alias("message"))


def finished(runs: DataFrame) -> DataFrame:
    """Adds duration_ms."""
    return runs.withColumn("duration_ms", (F.unix_millis("completed_at") - F.unix_millis("started_at")).cast("int"))


def merged_uploads(memberships: DataFrame, records: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploads with confirmed members: rows of memberships as the report counts them, and entities."""
    m = memberships.where("status = 'confirmed'").join(records.select(F.col("record_id").alias("normalized_record_id"), "upload_id"), "normalized_record_id")
    n = m.groupBy("upload_id").agg(F.count("entity_id").alias("merge_group_count"), F.count_distinct("entity_id").alias("entity_count"))
    return n.join(uploads.select(F.col("id").alias("upload_id"), "file_name"), "upload_id", "left")


GOLDEN = ["clean_name", "clean_tc", "clean_phone", "clean_email", "clean_city", "clean_address", "clean_muhatap_no"]


def merge_detail(golden_: DataFrame, members: DataFrame, excluded: DataFrame, records: DataFrame, group: str = "group_id") -> DataFrame:
    """Of each group one GOLDEN_RECORD row, then a PRIOR_MATCHED_MEMBER row for each member and an EXCLUDED_MEMBER row for each record left out, all with
    the golden values and a line that says what was merged."""
    codes = members.join(records.select("record_id", "clean_muhatap_no"), "record_id").groupBy(group).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.nullif("clean_muhatap_no", F.lit("")))), ", ").alias("codes"))
    line = F.concat(F.col("n").cast("string"), F.lit(" kayit birlestirildi: "), F.col("codes"))
    head = golden_.join(codes, group).select(group, *(F.col(c).alias(f"golden_{c}") for c in GOLDEN), line.alias("merge_report_line"))
    prior = records.select("record_id", *(F.col(c).alias(f"prior_{c}") for c in GOLDEN))
    rows = head.select("*", F.lit("GOLDEN_RECORD").alias("row_type"), F.lit(None).cast("long").alias("prior_record_id"), *(F.lit("").alias(f"prior_{c}") for c in GOLDEN))
    for m, kind in ((members, "PRIOR_MATCHED_MEMBER"), (excluded, "EXCLUDED_MEMBER")):
        own = head.join(m.select(group, "record_id"), group).join(prior, "record_id").withColumn("row_type", F.lit(kind)).withColumnRenamed("record_id", "prior_record_id")
        rows = rows.unionByName(own)
    return rows


def clean_dataset(records: DataFrame, memberships: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each entity with a confirmed member, and every record that is confirmed nowhere. Entities come first (source_rank), then ids."""
    m = memberships.where("status = 'confirmed'").select("entity_id", F.col("normalized_record_id").alias("record_id"))
    first = m.join(records.select("record_id", "upload_id"), "record_id").groupBy("entity_id").agg(F.min(F.struct("record_id", "upload_id")).alias("f"))
    e = entities.join(first, entities.id == first.entity_id)
    valid = records.select(F.col("record_id").alias("golden_record_id"), F.col("is_valid").alias("_valid"))
    e = e.join(valid, "golden_record_id", "left")
    names = {c: c.replace("clean_", "canonical_") for c in GOLDEN}
    own = e.select(F.lit(0).alias("source_rank"), F.lit("entity").alias("source"), F.col("id").cast("long").alias("id"), F.col("entity_id"), F.col("f.record_id").alias("record_id"), F.col("f.upload_id").alias("upload_id"), *((F.coalesce(F.col(v), F.lit("")) if v in entities.columns else F.lit("")).alias(c) for c, v in names.items()), F.coalesce("_valid", F.lit(True)).alias("is_valid"))
    rest = records.join(m.select("record_id"), "record_id", "left_anti")
    rest = rest.select(F.lit(1).alias("source_rank"), F.lit("normalized_record").alias("source"), F.col("record_id").alias("id"), F.lit(None).cast("long").alias("entity_id"), "record_id", "upload_id", *GOLDEN, "is_valid")
    return own.unionByName(rest)


def clean_page(clean: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    from ..operators.groups import page

    return page(clean.orderBy("source_rank", "id"), number, size, 500)


SEARCHED = ["clean_name", "clean_tc", "clean_phone", "clean_email", "clean_city", "clean_muhatap_no"]


def filters(df: DataFrame, is_valid: bool | None = None, search: str | None = None, missing: dict[str, bool] | None = None, across: bool = False) -> DataFrame:
    """Validity, a search term in one of six columns (across: in the columns joined by spaces, so that it may lie over two), and columns that must (not) be missing."""
    if is_valid is not None:
        df = df.where(F.col("is_valid") == is_valid)
    if search and search.strip():
        term = search.strip().lower()
        if across:
            df = df.where(F.contains(F.lower(F.concat_ws(" ", *SEARCHED)), F.lit(term)))
        else:
            hit = F.lit(False)
            for c in SEARCHED:
                hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term))
            df = df.where(hit)
    for c, gone in (missing or {}).items():
        empty = F.coalesce(F.col(c), F.lit("")) == ""
        df = df.where(empty if gone else ~empty)
    return df


#: The columns of exported approved matches.
APPROVED_FIELDS = ["match_id", "detection_run_id", "left_id", "right_id", "score", "confidence", "match_type", "decision", "created_at"]


def approved_matches(candidates: DataFrame) -> DataFrame:
    """Approved pairs for export, the newest first; columns that the table lacks are left to the writer, which leaves them empty."""
    return candidates.where("decision = 'approved'").withColumnRenamed("id", "match_id").orderBy(F.desc("created_at"), "match_id")


def group_rows(members: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Groups for export: key, ids joined in order, their number; listed: the groups' listing, whose scores and counts are added."""
    out = members.groupBy("decision", F.col("group_id").alias("_g")).agg(F.array_join(F.array_sort(F.collect_set("record_id")), ",").alias("record_ids"), F.count_distinct("record_id").alias("record_count"))
    if listed is not None:
        out = out.join(listed.select("decision", F.col("group_id").alias("_g"), "group_score", F.col("max_group_score").alias("group_score_max"), "match_count"), ["decision", "_g"], "left")
    return out.withColumn("group_id", F.concat(F.lit("rec_"), "_g")).drop("_g")
