"""Mixing sources to target weights on a time-varying curriculum (DataFrame operations only).

Every source has a weight and a schedule, a piecewise linear multiplier over training time 0..1. A source's demand
for words up to time t is its target times the share of its schedule's integral up to t. A document that lies at word
offset u of its source (documents in the order of a hash of their ids) is used at the time where the demand reaches u,
so that inverting the integral gives its training position; the mix is range-sorted by position.

Prefix sums never put a source into one task: equal rows are counted first, sums are taken over (source, leading digits of the hash) in two levels
of at most 16**3 rows each, and inside the finer bins. Only tables with one row for each source are ordered in one task.

Defined results: null text or a text without words has size 0, takes 0 words and has a null position; null sources form
one source, the last; null ids hash as the empty string; repeated rows each count; very long texts count whole; an empty table gives no rows;
other columns are ignored by mix() and kept by materialise(), whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words, read, whole_row

WEIGHTS = (3, 1, 2)
#: Knots (time, multiplier) by class of weight: the first fade out, the second are steady, the third fade in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))


def segments(knots) -> list[tuple[float, float, float, float]]:
    """Of each linear piece: start time, multiplier there, slope, integral up to there as a share of the whole."""
    if len(knots) < 2 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or any(m < 0 for _, m in knots):
        raise ValueError("a schedule needs two or more knots with rising times and multipliers of 0 or more")
    parts = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole = sum(parts)
    if whole <= 0:
        raise ValueError("a schedule's integral must be positive")
    return [(a[0], a[1] / whole, (b[1] - a[1]) / (b[0] - a[0]) / whole, sum(parts[:i]) / whole) for i, (a, b) in enumerate(zip(knots, knots[1:]))]


def invert(share, schedules=SCHEDULES, which=None):
    """The time at which a schedule's integral reaches a share (columns)."""
    out = F.lit(None).cast("double")
    for k, knots in reversed(list(enumerate(schedules))):
        t = None
        for t0, m, slope, before in segments(knots):
            y = F.greatest(share - F.lit(before), F.lit(0.0))
            root = F.lit(m) + F.sqrt(F.greatest(F.lit(m * m) + F.lit(2 * slope) * y, F.lit(0.0)))
            own = F.lit(t0) + F.when(root > 0, 2 * y / root).otherwise(0.0)
            t = own if t is None else F.when(share < F.lit(before), t).otherwise(own)
        out = F.when(which == k, t).otherwise(out)
    return out


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """sizes (source, source_size), one row per source -> and class, weight, target: weights dealt in the order of the sources,
    share times all words dealt by weight, at most `most` times a source's size, the excess going to the others by weight.
    That fixed point is a water level: sources in the order of the level that fills them, the first that the level of the rest doesn't fill sets it."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("class", (rank % len(weights)).cast("int")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1).cast("double"))
    every = W.partitionBy()
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    s = s.withColumn("left", F.lit(share) * F.sum("source_size").over(every) - (F.sum("cap").over(order) - F.col("cap")))
    s = s.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.sum("weight").over(order) + F.col("weight")))
    s = s.withColumn("level", F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level"))).over(every)["level"])
    return s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).select("source", "source_size", "class", "weight", "target")


COPIES = 10_000


def each_copy(rows: DataFrame, most: int) -> DataFrame:
    """A row for each of a row's `copies`, numbered from 0 in `copy`. What is there very often is dealt out in runs of COPIES before it is spelt out."""
    if most <= COPIES:
        return rows.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    runs = rows.withColumn("run", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)"))).repartition("h", "run")
    return runs.withColumn("copy", F.explode(F.expr(f"sequence(run, least(run + {COPIES}L, copies) - 1)"))).drop("run")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, schedules=SCHEDULES, seed: str = "") -> DataFrame:
    """docs (doc_id, text, source; others ignored) -> doc_id, source, size, source_size, target, taken, position, last_position.

    A source's documents stand in the order of md5(seed + id + " " + md5(text)), so that rows that share an id are apart too; equal rows follow one another. Its target takes whole passes over all of them, then
    documents in that order until the target is met; the last of them may be taken in part. position and last_position are the
    times in training, 0 to 1, of the first and the last use of a document; null if it isn't used."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.md5(text)))
    one = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest.alias("h")).groupBy("h", "doc_id", "source", "size").agg(F.count("*").alias("copies")), "mix")
    n, most_copies = one.agg(F.count("*"), F.max("copies")).first()
    digits = min(6, max(1, math.ceil(math.log(max(1, n / 20_000), 16))))
    coarse = (digits + 1) // 2
    one = one.withColumns({"bin": F.substring("h", 1, digits), "all": F.col("size") * F.col("copies")})
    bins = one.groupBy("source", "bin").agg(F.sum("all").alias("bin_size")).withColumn("top", F.substring("bin", 1, coarse))
    tops = bins.groupBy("source", "top").agg(F.sum("bin_size").alias("top_size"))
    plan = targets(tops.groupBy("source").agg(F.sum("top_size").alias("source_size")), share, most, weights)
    before = lambda c, by, *parts: F.sum(c).over(W.partitionBy(*parts).orderBy(by)) - F.col(c)
    tops = tops.withColumn("top_start", before("top_size", "top", "source")).select(F.col("source").alias("s"), F.col("top").alias("t"), "top_start")
    bins = bins.withColumn("in_top", before("bin_size", "bin", "source", "top")).withColumnRenamed("source", "bs")
    bins = bins.join(tops, F.col("bs").eqNullSafe(F.col("s")) & (F.col("top") == F.col("t"))).select("bs", F.col("bin").alias("b"), (F.col("top_start") + F.col("in_top")).alias("bin_start"))
    plan = bins.join(plan.withColumnRenamed("source", "s"), F.col("bs").eqNullSafe(F.col("s"))).select("s", "b", "bin_start", "source_size", "class", "target")
    inside = W.partitionBy("source", "bin").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    own = one.withColumn("inner", F.sum("all").over(inside) - F.col("all"))
    own = each_copy(own, most_copies or 1).withColumn("inner", F.col("inner") + F.col("copy") * F.col("size"))
    own = own.join(plan, (F.col("bin") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")), "left")
    whole = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    own = own.withColumn("start", F.col("bin_start") + F.col("inner")).withColumn("passes", passes)
    rest = whole - F.col("passes") * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    own = own.withColumn("extra", extra.cast("long")).withColumn("taken", (F.col("passes") * F.col("size") + F.col("extra")).cast("long"))
    last = F.when(F.col("extra") > 0, F.col("passes")).otherwise(F.col("passes") - 1)
    at = lambda k: F.when(F.col("taken") > 0, F.round(invert((k * F.col("source_size") + F.col("start")) / F.col("target"), schedules, F.col("class")), 9))
    return own.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", at(F.lit(0)).alias("position"), at(last).alias("last_position"))


def materialise(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: the documents with all their columns, one row per use, range-sorted by position. A use in part keeps the text's first words.
    plan: what mix() made of these docs. Where ids repeat or are null, the rows of one id, source and size, which mix() takes as they come, are numbered on
    both sides, so that each row has a plan of its own."""
    d = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"))
    p = plan.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "taken", "position", "last_position")
    same = F.col("id").eqNullSafe(F.col("p_id"))
    if not plan.groupBy("doc_id").count().where("count > 1").isEmpty():
        d = d.withColumns({"d_source": F.col("row.source"), "d_size": n_words(F.col("row.text"))})
        d = d.withColumn("d_no", F.row_number().over(W.partitionBy("id", "d_source", "d_size").orderBy("row.text", F.to_json("row"))))
        p = p.withColumn("p_no", F.row_number().over(W.partitionBy("p_id", "p_source", "p_size").orderBy("position", "last_position", "taken")))
        same = same & F.col("d_source").eqNullSafe(F.col("p_source")) & (F.col("d_size") == F.col("p_size")) & (F.col("d_no") == F.col("p_no"))
    used = d.join(p.where("taken > 0"), same)
    uses = F.transform(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("p_size")).cast("int") - 1), lambda k: F.struct(F.when(k == 0, F.col("position")).otherwise(F.col("last_position")).alias("at"), F.least(F.col("p_size"), F.col("taken") - k * F.col("p_size")).alias("words")))
    used = used.withColumn("use", F.explode(uses))
    pieces = F.split("row.text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    leads = F.col("row.text").rlike(r"^[\x20\x09-\x0D]").cast("int")
    cutting = F.concat_ws("", F.slice(pieces, F.lit(1), F.col("use.words").cast("int") + leads))
    used = used.withColumn("shown", F.when(F.col("use.words") < F.col("p_size"), cutting).otherwise(F.col("row.text")))
    new = {"text": F.col("shown")} | ({"n_chars": F.length("shown").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return used.orderBy("use.at", "id").select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


def _time_sql() -> str:
    cases = ""
    for k, knots in enumerate(SCHEDULES):
        inner = ""
        for t0, m, slope, before in reversed(segments(knots)):
            y = f"greatest(u - {before!r}::DOUBLE, 0.0::DOUBLE)"
            root = f"({m!r}::DOUBLE + sqrt(greatest({m * m!r}::DOUBLE + {2 * slope!r}::DOUBLE * {y}, 0.0::DOUBLE)))"
            inner += f" WHEN u >= {before!r}::DOUBLE THEN {t0!r}::DOUBLE + CASE WHEN {root} > 0 THEN 2 * {y} / {root} ELSE 0 END"
        cases += f" WHEN class = {k} THEN CASE{inner} END"
    return f"CASE{cases} END"


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) AS class FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE class WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap, 2 * source_size / CAST(CASE class WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS full_at FROM s),
v AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level FROM w WINDOW o AS (ORDER BY full_at, source NULLS LAST)),
l AS (SELECT level FROM v WHERE full_at >= level ORDER BY full_at, level LIMIT 1),
t AS (SELECT source, source_size, class, least(cap, coalesce((SELECT level FROM l) * weight, cap)) AS target FROM w),
c AS (SELECT d.*, t.source_size, t.class, t.target, floor(t.target) AS whole, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(whole / source_size) AS BIGINT) ELSE 0 END AS passes FROM c),
k AS (SELECT *, CAST(passes * size + greatest(0, least(size, whole - passes * source_size - start)) AS BIGINT) AS taken, start / target AS u FROM p)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round({_time_sql()}, 9) END AS position FROM k
"""
