"""Review: every transition is a function from the state's tables and a request to the changed tables, and appends to actions and audit.

The tables: candidates (id, detection_run_id, left_id, right_id, score, confidence, match_type, decision), memberships (entity_id,
normalized_record_id, confidence_at_merge, status), entities, records (record_id, upload_id and the clean columns), actions, audit."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .golden import COUNTED, golden

EDITABLE = ("clean_name", "clean_tc", "clean_phone", "clean_email", "clean_city", "clean_address", "clean_muhatap_no")
ACTIONS = "match_id long, decision string, decided_by string, reason string"
AUDIT = "action_type string, entity_type string, entity_id long, payload string, created_by string"
MEMBERSHIPS = "entity_id long, normalized_record_id long, confidence_at_merge double, status string"
ENTITIES = "id long, canonical_name string, canonical_tc string, canonical_phone string, canonical_email string, canonical_city string, canonical_address string, canonical_muhatap_no string, golden_record_id long, donor_count int, merged_by string"


class Refused(ValueError):
    """A transition that the state doesn't allow."""


@dataclass(frozen=True)
class State:
    records: DataFrame
    candidates: DataFrame
    memberships: DataFrame
    entities: DataFrame
    actions: DataFrame
    audit: DataFrame

    def log(self, matches: DataFrame | None, decision: str, by: str, reason: str, kind: str, entity: int | None) -> State:
        spark = self.records.sparkSession
        rows = spark.createDataFrame([], ACTIONS) if matches is None else matches.select(F.col("id").alias("match_id"), F.lit(decision).alias("decision") if decision else F.col("decision"), F.lit(by).alias("decided_by"), F.lit(reason).alias("reason"))
        note = spark.createDataFrame([(kind, "entity" if entity is not None else "match", entity, reason, by)], AUDIT)
        return replace(self, actions=self.actions.unionByName(rows), audit=self.audit.unionByName(note))


def normal_decision(c: Column) -> Column:
    d = F.lower(F.trim(c))
    return F.when(d.isin("approved", "confirmed"), "approved").when(d == "rejected", "rejected").otherwise("pending")


def partial_decision(left: Column, right: Column, approved: Column, rejected: Column) -> Column:
    """Columns: ids and arrays of approved and rejected ids. Two approved ones: approved; a rejected one, or one approved: rejected; else pending."""
    inside = lambda x, xs: F.array_contains(xs, x)
    la, ra = inside(left, approved), inside(right, approved)
    return F.when(la & ra, "approved").when(inside(left, rejected) | inside(right, rejected) | (la != ra), "rejected").otherwise("pending")


def merge_decision(left: Column, right: Column, union: Column, unselected: Column) -> Column:
    """Both in the union (and none unselected): approved; a pair across union and unselected: rejected; else pending."""
    lu, ru = F.array_contains(union, left), F.array_contains(union, right)
    ln, rn = F.array_contains(unselected, left), F.array_contains(unselected, right)
    return F.when(lu & ru, "approved").when((lu & rn) | (ln & ru), "rejected").otherwise("pending")


def remove_decision(left: Column, right: Column, gone: Column, remaining: Column) -> Column:
    """Null where a pair doesn't hold the removed record; to a remaining one rejected, else pending."""
    mine = (left == gone) | (right == gone)
    other = F.when(left == gone, right).otherwise(left)
    return F.when(mine, F.when(F.array_contains(remaining, other), "rejected").otherwise("pending"))


def latest_reviews(actions: DataFrame) -> DataFrame:
    """Of each match its last review."""
    last = F.row_number().over(W.partitionBy("match_id").orderBy(F.desc("decided_at"), F.desc("id")))
    return actions.withColumn("_n", last).where("_n = 1").drop("_n")


def latest_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the columns given: one aggregation, no window."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def muhatap_conflicts(memberships: DataFrame, records: DataFrame, ids: list[int], code: str, except_entity: int | None = None) -> DataFrame:
    """Other confirmed entities with that code (case ignored) in the uploads of the given records."""
    uploads = records.where(F.col("record_id").isin(ids)).select("upload_id").distinct()
    rows = memberships.where("status = 'confirmed'").join(records.select(F.col("record_id").alias("normalized_record_id"), "upload_id", "clean_muhatap_no"), "normalized_record_id")
    rows = rows.where((F.lower("clean_muhatap_no") == code.lower()) & ~F.col("normalized_record_id").isin(ids)).join(uploads, "upload_id", "left_semi")
    return (rows if except_entity is None else rows.where(F.col("entity_id") != except_entity)).select("entity_id", "upload_id").distinct()


def co_review(acknowledged: bool, required: int) -> None:
    """If the setting (1 to 20) asks for several reviewers, a merge must say that the others have seen it."""
    if max(1, min(20, required)) > 1 and not acknowledged:
        raise Refused("more reviewers must confirm this")


def _changed(before: State, after: State) -> DataFrame:
    """The candidates whose decision is another than before."""
    old = before.candidates.select("id", F.col("decision").alias("old"))
    return after.candidates.join(old, "id").where("decision <> old").drop("old")


def _match(state: State, match_id: int, *allowed: str):
    row = state.candidates.where(F.col("id") == match_id).head()
    if row is None or row.decision not in allowed:
        raise Refused(f"match {match_id} is not {' or '.join(allowed)}")
    return row


def _decide(state: State, cond: Column, decision: Column) -> DataFrame:
    return state.candidates.withColumn("decision", F.when(cond, decision).otherwise(F.col("decision")))


def _next_entity(state: State) -> int:
    return (state.entities.agg(F.max("id")).first()[0] or 0) + 1


def _entity(state: State, entity_id: int, ids: list[int], by: str, fields: dict[str, str] | None = None) -> State:
    """The entity with its members confirmed and its fields from their golden record, or as given."""
    spark = state.records.sparkSession
    members = state.records.where(F.col("record_id").isin(ids)).withColumn("group_id", F.lit(entity_id))
    row = golden(members).head()
    if row is None:
        raise Refused("no such records")
    values = {c: (fields or {}).get(c) or row[c] for c in COUNTED}
    order = ("clean_name", "clean_tc", "clean_phone", "clean_email", "clean_city", "clean_address", "clean_muhatap_no")
    own = spark.createDataFrame([(entity_id, *(values[c] for c in order), int(row.golden_record_id), len(ids), by)], ENTITIES)
    joined = spark.createDataFrame([(entity_id, i, 1.0, "confirmed") for i in ids], MEMBERSHIPS)
    left = state.memberships.where(~((F.col("entity_id") == entity_id) & F.col("normalized_record_id").isin(ids)))
    return replace(state, entities=state.entities.where(F.col("id") != entity_id).unionByName(own), memberships=left.unionByName(joined))


def approve(state: State, match_id: int, by: str, reason: str = "") -> tuple[State, int]:
    """A pending pair becomes an entity of its two records: non-empty values, the left's first."""
    m = _match(state, match_id, "pending")
    pair = {r.record_id: r for r in state.records.where(F.col("record_id").isin(m.left_id, m.right_id)).collect()}
    if len(pair) < 2:
        raise Refused("a record of the pair is missing")
    values = {c: pair[m.left_id][c] or pair[m.right_id][c] or "" for c in COUNTED}
    entity = _next_entity(state)
    state = _entity(state, entity, sorted(pair), by, values)
    state = replace(state, candidates=_decide(state, F.col("id") == match_id, F.lit("approved")))
    return state.log(state.candidates.where(F.col("id") == match_id), "approved", by, reason, "approve", entity), entity


def reject(state: State, match_id: int, by: str, reason: str = "") -> State:
    _match(state, match_id, "pending")
    state = replace(state, candidates=_decide(state, F.col("id") == match_id, F.lit("rejected")))
    return state.log(state.candidates.where(F.col("id") == match_id), "rejected", by, reason, "reject", None)


def reset(state: State, match_id: int, by: str, reason: str = "") -> State:
    """Back to pending; the memberships of its two records in a common entity too, whose count follows."""
    m = _match(state, match_id, "approved", "rejected")
    pair = [m.left_id, m.right_id]
    common = state.memberships.where(F.col("normalized_record_id").isin(pair) & (F.col("status") == "confirmed")).groupBy("entity_id").agg(F.count_distinct("normalized_record_id").alias("n")).where("n = 2")
    common = [r.entity_id for r in common.collect()]
    back = F.col("entity_id").isin(common) & F.col("normalized_record_id").isin(pair)
    members = state.memberships.withColumn("status", F.when(back, "pending").otherwise(F.col("status")))
    counts = members.where("status = 'confirmed'").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").cast("int").alias("_n"))
    entities = state.entities.join(counts, "id", "left").withColumn("donor_count", F.when(F.col("id").isin(common), F.coalesce("_n", F.lit(0))).otherwise(F.col("donor_count"))).drop("_n").select(state.entities.columns)
    state = replace(state, candidates=_decide(state, F.col("id") == match_id, F.lit("pending")), memberships=members, entities=entities)
    return state.log(state.candidates.where(F.col("id") == match_id), "pending", by, reason, "reset", None)


def _array(ids: list[int]) -> Column:
    return F.array(*map(F.lit, ids)).cast("array<bigint>")


def partial_approve(state: State, group: list[int], approved: list[int], rejected: list[int], by: str, reason: str = "", entity_id: int | None = None, acknowledged: bool = False, required: int = 1) -> tuple[State, int | None]:
    """Some of a group's records become an entity, some are turned down, the others wait."""
    co_review(acknowledged, required)
    before = state
    if set(approved) & set(rejected):
        raise Refused("a record can't be approved and rejected")
    if (set(approved) | set(rejected)) - set(group) or len(approved) == 1:
        raise Refused("the records must be of the group, and two at least approved")
    entity = entity_id
    if approved:
        entity = entity or _next_entity(state)
        state = _entity(state, entity, sorted(approved), by)
    inside = F.col("left_id").isin(group) & F.col("right_id").isin(group)
    state = replace(state, candidates=_decide(state, inside, partial_decision(F.col("left_id"), F.col("right_id"), _array(approved), _array(rejected))))
    return state.log(_changed(before, state), "", by, reason, "partial_approve", entity), entity


def merge_into(state: State, entity_id: int, group: list[int], selected: list[int], by: str, reason: str = "", acknowledged: bool = False, required: int = 1) -> State:
    """Selected records of a group join an entity; pairs between it and the group's others are rejected."""
    co_review(acknowledged, required)
    if set(selected) - set(group):
        raise Refused("the selected records must be of the group")
    before = state
    now = [r.normalized_record_id for r in state.memberships.where((F.col("entity_id") == entity_id) & (F.col("status") == "confirmed")).collect()]
    if not now or not selected:
        raise Refused("no such entity, or nothing selected")
    union, others = sorted({*now, *selected}), sorted(set(group) - set(selected) - set(now))
    if len(union) < 2:
        raise Refused("an entity needs two records")
    state = _entity(state, entity_id, union, by)
    touched = sorted({*union, *others})
    inside = F.col("left_id").isin(touched) & F.col("right_id").isin(touched)
    state = replace(state, candidates=_decide(state, inside, merge_decision(F.col("left_id"), F.col("right_id"), _array(union), _array(others))))
    return state.log(_changed(before, state), "", by, reason, "merge_into_entity", entity_id)


def remove_member(state: State, entity_id: int, record_id: int, by: str, reason: str = "", runs: list[int] | None = None) -> State:
    """A record leaves an entity; its pairs with those that stay are rejected, its others wait again. runs: the detection runs of the upload at hand; other
    runs' pairs stay as they are (none given: all are of it). Only pairs whose decision changes are logged."""
    before = state
    now = [r.normalized_record_id for r in state.memberships.where((F.col("entity_id") == entity_id) & (F.col("status") == "confirmed")).collect()]
    rest = sorted(set(now) - {record_id})
    if record_id not in now or not rest:
        raise Refused("not a member, or the only one")
    members = state.memberships.where(~((F.col("entity_id") == entity_id) & (F.col("normalized_record_id") == record_id)))
    state = _entity(replace(state, memberships=members), entity_id, rest, by)
    new = remove_decision(F.col("left_id"), F.col("right_id"), F.lit(record_id), _array(rest))
    mine = F.lit(True) if runs is None else F.col("detection_run_id").isin(runs)
    state = replace(state, candidates=state.candidates.withColumn("decision", F.when(mine, F.coalesce(new, F.col("decision"))).otherwise(F.col("decision"))))
    return state.log(_changed(before, state), "", by, reason, "remove_member", entity_id)


def edit_golden(state: State, entity_id: int, changes: dict[str, str], by: str) -> State:
    """Sets some of the seven fields of an entity; a code that another entity of the upload has is refused."""
    if not changes or set(changes) - set(EDITABLE):
        raise Refused("only the fields of a golden record can be edited")
    ids = [r.normalized_record_id for r in state.memberships.where((F.col("entity_id") == entity_id) & (F.col("status") == "confirmed")).collect()]
    code = changes.get("clean_muhatap_no", "")
    if code and muhatap_conflicts(state.memberships, state.records, ids, code, entity_id).head() is not None:
        raise Refused("another entity of this upload has that code")
    mine = F.col("id") == entity_id
    sets = {c.replace("clean_", "canonical_"): F.when(mine, F.lit(v)).otherwise(F.col(c.replace("clean_", "canonical_"))) for c, v in changes.items()}
    return replace(state, entities=state.entities.withColumns(sets)).log(None, "", by, str(sorted(changes)), "edit_golden", entity_id)
