"""Golden records: of a group's records one value for each field, by fixed rules; all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

COUNTED = ["clean_name", "clean_tc", "clean_phone", "clean_email", "clean_city", "clean_address", "clean_muhatap_no"]


def _fields() -> list[tuple[str, Column, int, bool]]:
    """Field, its value in a record, preferred length (0: none), whether the longest value counts and not the most frequent."""
    return [
        ("clean_name", T.text("clean_name"), 0, False), ("clean_tc", T.golden_tc("clean_tc"), 11, False), ("clean_phone", T.clean_phone("clean_phone"), 10, False), ("clean_email", T.golden_email("clean_email"), 0, False),
        ("clean_city", T.text("clean_city"), 0, False), ("clean_address", T.text("clean_address"), 0, True), ("clean_muhatap_no", T.text("clean_muhatap_no"), 0, False),
    ]


def golden(members: DataFrame, group: str = "group_id", row_id: str = "record_id") -> DataFrame:
    """members: group, record id and the clean columns -> one row a group: the fields, source_record_ids in order, field_sources, secondary_emails, warnings.

    Records stand by completeness, most first, then id. A field takes the value with the highest (frequency, preferred length hit, length), the
    first in that order; an address the longest. Values are counted by (group, field, value) before any of a group's rows meet."""
    key = F.struct((-T.completeness(*COUNTED)).alias("c"), F.col(row_id).alias("id"))
    rows = members.withColumn("_at", key)
    long = rows.select(F.col(group).alias("g"), "_at", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), v.alias("val"), F.lit(p).alias("pref"), F.lit(x).alias("longest")) for n, v, p, x in _fields()))).alias("f")).select("g", "_at", "f.*").where("val <> ''")
    counts = long.groupBy("g", "field", "val", "pref", "longest").agg(F.count("*").alias("n"), F.min("_at").alias("at"))
    rank = F.struct(F.when(F.col("longest"), 0).otherwise(-F.col("n")).alias("a"), F.when(F.length("val") == F.col("pref"), 0).otherwise(1).alias("b"), (-F.length("val")).alias("c"), F.col("at"))
    best = counts.groupBy("g", "field").agg(F.min(F.struct(rank.alias("r"), "val")).alias("b"), F.count("*").alias("different"))
    wide = best.groupBy("g").agg(
        *(F.max(F.when(F.col("field") == n, F.col("b.val"))).alias(n) for n, *_ in _fields()),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.col("b.r.at.id").alias("id"))))).alias("field_sources"),
        F.max(F.when(F.col("field") == "clean_tc", F.col("different"))).alias("_tcs"),
    )
    alias = F.when(T.is_email_alias("clean_email"), F.lower(T.text("clean_email")))
    base = rows.groupBy(F.col(group).alias("g")).agg(F.transform(F.array_sort(F.collect_list("_at")), lambda x: x.id).alias("source_record_ids"), F.array_sort(F.collect_set(alias)).alias("secondary_emails"))
    out = base.join(wide, "g", "left")
    filled = {n: F.coalesce(F.col(n), F.lit("")) for n, *_ in _fields()}
    weak = (filled["clean_tc"] == "") & (filled["clean_phone"] == "") & (filled["clean_email"] == "")
    warnings = F.array_compact(F.array(F.when(F.col("_tcs") > 1, "tc_conflict"), F.when(weak, "weak_identity_evidence")))
    return out.select(F.col("g").alias(group), *(c.alias(n) for n, c in filled.items()), "source_record_ids", "field_sources", "secondary_emails", warnings.alias("warnings"), F.col("source_record_ids")[0].alias("golden_record_id"))


def overlay(golden_: DataFrame, members: DataFrame, memberships: DataFrame, entities: DataFrame, group: str = "group_id") -> DataFrame:
    """Golden fields overridden by an entity's own non-empty values, where all of the group's records are confirmed members of that one entity."""
    m = memberships.select(F.col("normalized_record_id").alias("record_id"), "entity_id", (F.col("status") == "confirmed").alias("ok"))
    state = members.select(group, "record_id").join(m, "record_id", "left").groupBy(group).agg(F.count_distinct("entity_id").alias("n"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_ok"), F.min("entity_id").alias("entity_id"))
    own = state.where("n = 1 and all_ok").select(group, "entity_id").join(entities.withColumnRenamed("id", "entity_id"), "entity_id")
    names = {f.replace("clean_", "canonical_"): f for f in COUNTED}
    own = own.select(group, "entity_id", *(F.col(c).alias(f"_{c}") for c in names if c in entities.columns))
    out = golden_.join(own, group, "left")
    over = {f: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(f)) for c, f in names.items() if c in entities.columns}
    return out.withColumns(over).drop(*(f"_{c}" for c in names))


def first_members(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("entity_id").agg(F.min("normalized_record_id").alias("record_id"))


