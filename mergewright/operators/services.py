"""Tables of the older workflow (matches, entities, maps), of jobs and runs, and reads by scope: every write is a table in, a table out.

Rows are changed by joins on their ids, so a batch of changes costs the same plan as one. Of several changes to one id the largest by `at` counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import groups
from .review import latest_by

#: The columns that may be looked up by.
LOOKUPS = ("clean_tc", "clean_phone", "email_normalized_key", "name_phonetic_key", "clean_city")


def patch(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with the non-null values of changes, one row of them a key. Columns that only changes have are added. Unknown keys change nothing."""
    both = [c for c in changes.columns if c != key and c in table.columns]
    more = [c for c in changes.columns if c != key and c not in table.columns]
    own = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in both + more))
    out = table.join(own, F.col(key) == F.col("_key"), "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in both else F.col(c) for c in table.columns), *(F.col(f"_new_{c}").alias(c) for c in more))


def by_key(records: DataFrame, column: str, value: str) -> DataFrame:
    """Records with that value in one of the five columns; none for any other column."""
    return records.where(F.col(column) == value) if column in LOOKUPS else records.where(F.lit(False))


def pending_top(matches: DataFrame, upload_id: int | None = None, n: int = 100) -> DataFrame:
    """The n surest pending matches, ties to the lower id."""
    m = matches.where("status = 'pending'")
    m = m if upload_id is None else m.where(F.col("upload_id") == upload_id)
    return m.orderBy(F.desc_nulls_last("ml_score"), "id").limit(n)


def decide_matches(matches: DataFrame, said: DataFrame) -> DataFrame:
    """said: id, status (confirmed or rejected), by, reason, at. A rejection's reason and time, and an approval's time, go to columns of their own."""
    last = latest_by(said.where(F.col("status").isin("confirmed", "rejected")), "id", "at", "status")
    no = F.col("status") == "rejected"
    return patch(matches, last.select("id", "status", F.coalesce("by", F.lit("system")).alias("approved_by"), F.when(~no, F.col("at")).alias("approved_at"), F.when(no, F.col("reason")).alias("rejected_reason"), F.when(no, F.col("at")).alias("rejected_at")))


def entity_by_name(entities: DataFrame, name: str) -> DataFrame:
    """The entity of exactly that name, the lowest id where several bear it."""
    return entities.where(F.col("canonical_name") == name).orderBy("id").limit(1)


def update_entities(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id and any of canonical_email, canonical_phone, canonical_city; empty values change nothing."""
    return patch(entities, changes.select("id", *(F.nullif(c, F.lit("")).alias(c) for c in changes.columns if c in ("canonical_email", "canonical_phone", "canonical_city"))))


def _recount(entities: DataFrame, delta: DataFrame) -> DataFrame:
    d = delta.withColumnsRenamed({"entity_id": "_e", "n": "_n"})
    out = entities.join(d, F.col("id") == F.col("_e"), "left")
    return out.withColumn("donor_count", F.greatest(F.lit(0), F.coalesce("donor_count", F.lit(0)) + F.coalesce("_n", F.lit(0)))).drop("_e", "_n")


def map_donors(entities: DataFrame, maps: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """new: id, entity_id, donor_id -> the entities with their donor_count raised, and the maps with the new rows, active."""
    rows = new.select(*(F.col(c) if c in new.columns else F.lit(True).alias(c) if c == "is_active" else F.lit(None).cast(maps.schema[c].dataType).alias(c) for c in maps.columns))
    return _recount(entities, new.groupBy("entity_id").agg(F.count("*").alias("n"))), maps.unionByName(rows)


def deactivate(entities: DataFrame, maps: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids: id of maps to switch off -> entities with their donor_count lowered, not below zero, and the maps. A map that is off already lowers nothing."""
    off = ids.select(F.col("id").alias("_off")).distinct()
    marked = maps.join(off, F.col("id") == F.col("_off"), "left")
    lost = marked.where("_off IS NOT NULL AND is_active").groupBy("entity_id").agg((-F.count("*")).alias("n"))
    return _recount(entities, lost), marked.withColumn("is_active", F.col("is_active") & F.col("_off").isNull()).drop("_off")


def donors_of(maps: DataFrame, records: DataFrame, entity_id: int | None = None, active: bool = True) -> DataFrame:
    """entity_id and the records mapped to it; of all entities if none is given."""
    m = maps if entity_id is None else maps.where(F.col("entity_id") == entity_id)
    m = m.where("is_active") if active else m
    return m.select("entity_id", F.col("donor_id").alias("record_id")).join(records, "record_id")


def maps_of(maps: DataFrame, donor_id: int) -> DataFrame:
    return maps.where((F.col("donor_id") == donor_id) & F.col("is_active"))


def merge_donors(entities: DataFrame, maps: DataFrame, matches: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """merges: entity_id (new), canonical_name, match_id, donor_ids -> entities with the new ones, maps of all their donors, and the matches as merged.
    A map's id is derived from entity and donor."""
    fresh = merges.select(*(F.col("entity_id").alias("id") if c == "id" else F.lit(0).cast(entities.schema[c].dataType).alias(c) if c == "donor_count" else F.col(c) if c in merges.columns else F.lit(None).cast(entities.schema[c].dataType).alias(c) for c in entities.columns))
    rows = merges.select("entity_id", F.explode("donor_ids").alias("donor_id"), "match_id").withColumn("id", F.xxhash64("entity_id", "donor_id"))
    e, m = map_donors(entities.unionByName(fresh), maps, rows)
    done = merges.where("match_id IS NOT NULL").select(F.col("match_id").alias("id"), F.lit("merged").alias("status")).distinct()
    return e, m, patch(matches, done)


def job_progress(jobs: DataFrame, said: DataFrame) -> DataFrame:
    """said: id, at and any of status, progress, total_rows, processed_rows, error_message. The last word on each column counts; progress stays from 0 to 100."""
    cols = [c for c in said.columns if c not in ("id", "at")]
    last = said.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col("at"), F.col(c)))).alias(c) for c in cols), F.max("at").alias("updated_at"))
    if "progress" in cols:
        last = last.withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("progress"))))
    return patch(jobs, last)


def finalize_runs(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """ends: id, status, completed_at and any counts, error_message and meta (a map whose entries go over the run's own). Adds duration_ms."""
    out = patch(runs, ends.drop("meta"))
    if "meta" in ends.columns:
        out = out.join(ends.select(F.col("id").alias("_id"), F.col("meta").alias("_meta")), F.col("id") == F.col("_id"), "left")
        own, new = (F.coalesce(F.col(c), F.create_map().cast("map<string,string>")) for c in ("meta", "_meta"))
        kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(new, k))
        out = out.withColumn("meta", F.map_concat(kept, new)).drop("_id", "_meta")
    return out.withColumn("duration_ms", F.unix_millis("completed_at") - F.unix_millis("started_at"))


def in_scope(candidates: DataFrame, runs: DataFrame, upload_id: int | None = None, latest: bool = True, decision: str | None = None) -> DataFrame:
    """Candidates of an upload's detection runs, the last only if latest is set; without an upload, of every upload's last run."""
    r = runs if upload_id is None else runs.where(F.col("upload_id") == upload_id)
    r = r.groupBy("upload_id").agg(F.max("id").alias("detection_run_id")) if latest or upload_id is None else r.select(F.col("id").alias("detection_run_id"))
    c = candidates.where(F.col("decision") == decision.strip().lower()) if (decision or "").strip().lower() in ("pending", "approved", "rejected") else candidates
    return c.join(r.select("detection_run_id").distinct(), "detection_run_id", "left_semi")


def uploads_with_records(uploads: DataFrame, records: DataFrame, runs: DataFrame, n: int | None = None) -> DataFrame:
    """Uploads that have normalized records, the newest first, each with its latest run; n: as many at most."""
    u = uploads.join(records.select(F.col("upload_id").alias("id")).distinct(), "id", "left_semi")
    last = runs.groupBy("upload_id").agg(F.max_by(F.struct(F.col("id").alias("latest_run_id"), F.col("status").alias("run_status")), F.struct("created_at", "id")).alias("r"))
    u = u.orderBy(F.desc("created_at"), F.desc("id"))
    u = u if n is None else u.limit(n)
    return u.join(last.select(F.col("upload_id").alias("id"), "r.*"), "id", "left")


def refresh_groups(stored: DataFrame, candidates: DataFrame, run_ids: DataFrame) -> DataFrame:
    """stored: detection_run_id, decision, group_id, record_id; those of the given runs are made anew from the candidates, each run and decision by itself."""
    ids = run_ids.select("detection_run_id").distinct()
    node = lambda c: F.struct("detection_run_id", F.col(c).alias("id")).alias(c)
    found = groups(candidates.join(ids, "detection_run_id", "left_semi").select("decision", node("left_id"), node("right_id")))
    new = found.select(F.col("record_id.detection_run_id").alias("detection_run_id"), "decision", F.col("group_id.id").alias("group_id"), F.col("record_id.id").alias("record_id"))
    return stored.select(*new.columns).join(ids, "detection_run_id", "left_anti").unionByName(new)


def _broken() -> dict[str, str]:
    """Turkish letters as they look when their UTF-8 is read as one byte a letter, once or twice, with what they stand for."""
    out = {}
    for letter, plain in zip("ŞşĞğÜüÖöÇçİı", "SsGgUuOoCcIi", strict=True):
        for page in ("cp1252", "latin-1"):
            once = letter.encode().decode(page, "ignore")
            twice = once.encode().decode(page, "ignore")
            out.update({x: plain for x in (twice, once) if len(x) > 1})
    return dict(sorted(out.items(), key=lambda x: (-len(x[0]), x[0])))


#: Broken letters, the longest first.
BROKEN = _broken()


def key_form(c: Column) -> Column:
    """A key's letters and digits in lower case, broken letters mended."""
    for bad, plain in BROKEN.items():
        c = F.replace(c, F.lit(bad), F.lit(plain))
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def pick_value(maps: list[str], names: list[str]) -> Column:
    """The first non-empty value, trimmed, under one of the names, in their order; of several keys of one form the last map's last one counts. Empty if there is none."""
    entry = "array<struct<key:string,value:string>>"
    entries = F.transform(F.concat(*(F.coalesce(F.map_entries(m).cast(entry), F.array().cast(entry)) for m in maps)), lambda e: F.struct(key_form(e["key"]).alias("k"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("v")))
    one = lambda n: F.nullif(F.try_element_at(F.filter(entries, lambda e: e["k"] == key_form(F.lit(n))), F.lit(-1))["v"], F.lit(""))
    return F.coalesce(*(one(n) for n in names), F.lit(""))
