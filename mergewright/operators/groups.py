"""Duplicate groups: components of candidate pairs, their figures, their listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components


def page(df: DataFrame, number: int = 1, size: int = 50, most: int = 200) -> DataFrame:
    """A page of an ordered frame; page 1 at least, size from 1 to most."""
    size = max(1, min(most, size))
    return df.offset((max(1, number) - 1) * size).limit(size)


def total_pages(total: int, size: int) -> int:
    return max(1, -(-total // max(1, size)))


def groups(candidates: DataFrame, by_decision: bool = True) -> DataFrame:
    """record_id, group_id (the component's smallest id), decision: components of two records or more, of each decision separately."""
    if not by_decision:
        return connected_components(candidates, "left_id", "right_id").select(F.col("node").alias("record_id"), F.col("root").alias("group_id"), F.lit(None).cast("string").alias("decision"))
    node = lambda c: F.struct("decision", F.col(c).alias("id")).alias(c)
    known = candidates.where(F.col("decision").isin("pending", "approved", "rejected")).select(node("left_id"), node("right_id"))
    return connected_components(known, "left_id", "right_id").select(F.col("node.id").alias("record_id"), F.col("root.id").alias("group_id"), F.col("node.decision").alias("decision"))


def metrics(members: DataFrame) -> DataFrame:
    """duplicate_group_count, affected_record_count."""
    return members.agg(F.count_distinct("decision", "group_id").alias("duplicate_group_count"), F.count("*").alias("affected_record_count"))


def summary(members: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """One row a group: key, sizes, scores, codes, and whether there are several codes."""
    m = members.select("decision", "group_id", "record_id")
    edges = candidates.select(F.col("left_id").alias("record_id"), "decision", "score").join(m, ["record_id", "decision"]).groupBy("decision", "group_id").agg(F.count("*").alias("match_count"), F.round(F.avg("score"), 4).alias("avg_score"), F.round(F.max("score"), 4).alias("max_score"))
    codes = m.join(records.select("record_id", F.nullif(F.col("clean_muhatap_no"), F.lit("")).alias("code")), "record_id").groupBy("decision", "group_id").agg(F.count("*").alias("record_count"), F.array_sort(F.collect_set("code")).alias("muhatap_codes"))
    out = codes.join(edges, ["decision", "group_id"], "left").withColumn("different_muhatap_code", F.size("muhatap_codes") > 1)
    return out.withColumn("group_key", F.concat(F.lit("rec_"), F.col("group_id")))


def listing(members: DataFrame, candidates: DataFrame, records: DataFrame, memberships: DataFrame | None = None, several_codes: bool = True, decision: str | None = None, scored: DataFrame | None = None) -> DataFrame:
    """The groups to review, by (group_score, match_count), the mean display score first. scored: left_id, decision and general_weighted_percent of pairs; without it
    the pairs' review features are scored. Confirmed members leave pending groups, groups under two records go, all of this before any paging."""
    m = members if decision is None else members.where(F.col("decision") == decision)
    if memberships is not None:
        done = memberships.where("status = 'confirmed'").select(F.col("normalized_record_id").alias("record_id"), F.lit("pending").alias("decision")).distinct()
        m = m.join(done, ["record_id", "decision"], "left_anti")
    out = summary(m, candidates, records).where("record_count >= 2")
    out = out.where("different_muhatap_code") if several_codes else out
    if scored is None:
        from ..functions.scoring import Features, weighted_score
        from .features import pair_frame, review_features

        f = review_features(pair_frame(candidates.select("left_id", "right_id").distinct(), records))
        f = f.select("left_id", "right_id", weighted_score(Features.of(f)).alias("general_weighted_percent"))
        scored = candidates.select("left_id", "right_id", "decision").join(f, ["left_id", "right_id"])
    out = out.join(display_scores(scored, m), ["decision", "group_id"], "left")
    return out.orderBy(F.desc_nulls_last("group_score"), F.desc_nulls_last("match_count"), "decision", "group_id")


def different_codes(pairs: DataFrame) -> DataFrame:
    """Pairs of two different non-empty codes."""
    from .features import conflict

    return pairs.where(conflict("clean_muhatap_no"))


def search(members: DataFrame, records: DataFrame, term: str) -> DataFrame:
    """The groups one of whose records has the term in its name, tc, phone or e-mail."""
    hit = F.lit(False)
    for c in ("clean_name", "clean_tc", "clean_phone", "clean_email"):
        hit = hit | F.contains(F.lower(c), F.lit(term.lower()))
    found = records.where(hit | (F.col("record_id").cast("string") == term)).select("record_id")
    return members.join(found, "record_id", "left_semi").select("decision", "group_id").distinct()


def display_scores(scored: DataFrame, members: DataFrame) -> DataFrame:
    """scored: left_id, decision and general_weighted_percent -> the mean and best of a group's pairs as shares."""
    p = scored.select(F.col("left_id").alias("record_id"), "decision", (F.col("general_weighted_percent") / 100).alias("s")).join(members, ["record_id", "decision"])
    return p.groupBy("decision", "group_id").agg(F.round(F.avg("s"), 4).alias("group_score"), F.round(F.max("s"), 4).alias("max_group_score"))


def merge_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two group lists with record_ids arrays as one; for the same set of records the second's row counts."""
    both = first.withColumn("_p", F.lit(1)).unionByName(second.withColumn("_p", F.lit(0)))
    key = F.array_sort("record_ids")
    cols = [c for c in first.columns]
    return both.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*cols), "_p").alias("r")).select("r.*")
