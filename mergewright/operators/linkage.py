"""A Fellegi and Sunter model: levels of agreement by field, expectation and maximisation over patterns of levels, match probabilities.

u comes from random pairs, the share of matches from deterministic rules, m from passes of EM, each on the pairs of one blocking key with that key's
own field left out; a field's m is the mean of what the passes say. EM runs on the table of level patterns and their counts, whose size is bounded by the levels, not on pairs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Features, confidence, decision, risk_flags, rule_reasons, review_name_band, weighted_breakdown
from ..functions.similarity import jaro
from ..plans.tables import cut
from .blocking import LINKAGE_PASSES, bare_pairs, blocks, dealt, meet
from .features import COLUMNS, both, linkage_features, pair_frame, paired
from .flags import BRIEF, FLAGS, briefs
from .levels import counter, finder

#: Field, column, thresholds of its similarity levels (none: equal or not).
COMPARISONS = (("tc", "clean_tc", ()), ("phone", "clean_phone", ()), ("city", "clean_city", ()), ("phonetic", "name_phonetic_key", ()), ("name", "clean_name", (0.92, 0.80)), ("first", "first_name", (0.95, 0.85)), ("surname", "last_name", (0.95, 0.85)), ("email", "email_normalized_key", (0.90, 0.70)))
THRESHOLD = 0.30
RECALL = 0.85
U_PAIRS = 20_000
EM_STEPS = 5
#: Post-caps: no conflict of ids may look certain.
TC_CAP, MUHATAP_CAP = 0.75, 0.85
#: Rows of a block's part: parts meet two by two, so that a row goes out once for each part of its block.
PART = 2048


def _winkler(a: str, b: str) -> float:
    """The textbook form: the prefix counts only beyond a similarity of 0.7."""
    j = jaro(a, b)
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return j + same * 0.1 * (1.0 - j) if j > 0.7 else j


def _level_udf(cuts: tuple[float, ...]):
    @F.pandas_udf("int")
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sum(_winkler(x, y) >= t for t in cuts) for x, y in zip(a, b)], dtype="int32")

    return over


def levels(pairs_: DataFrame, comparisons=COMPARISONS) -> DataFrame:
    """Adds g_<field>: -1 a side is missing, 0 different, up to the highest for equal."""
    fuzzy = [(f, c, t) for f, c, t in comparisons if t]
    out = pairs_
    for f, c, cuts in fuzzy:
        over = _level_udf(cuts)
        told = out.where(both(c) & (F.col(f"left_{c}") != F.col(f"right_{c}"))).select(f"left_{c}", f"right_{c}").distinct().withColumn(f"_l_{f}", over(f"left_{c}", f"right_{c}"))
        out = out.join(told, [f"left_{c}", f"right_{c}"], "left")
    done = {}
    for f, c, cuts in comparisons:
        low = F.coalesce(F.col(f"_l_{f}"), F.lit(0)) if cuts else F.lit(0)
        done[f"g_{f}"] = F.when(~both(c), -1).when(F.col(f"left_{c}") == F.col(f"right_{c}"), len(cuts) + 1).otherwise(low).cast("int")
    return out.withColumns(done).drop(*(f"_l_{f}" for f, _, _ in fuzzy))


def patterns(leveled: DataFrame, comparisons=COMPARISONS) -> DataFrame:
    """The combinations of levels and how many pairs have each."""
    return leveled.groupBy(*(f"g_{f}" for f, _, _ in comparisons)).agg(F.count("*").alias("n"))


@dataclass
class Model:
    prior: float = 1e-4
    m: dict[str, list[float]] = field(default_factory=dict)
    u: dict[str, list[float]] = field(default_factory=dict)

    @classmethod
    def default(cls, comparisons=COMPARISONS) -> Model:
        """Before training: the highest level carries most of a match's probability."""
        out = cls()
        for f, _, cuts in comparisons:
            k = len(cuts) + 2
            out.m[f] = [0.05 / (k - 1)] * (k - 1) + [0.95]
            out.u[f] = [0.95] + [0.05 / (k - 1)] * (k - 1)
        return out

    def weight(self, f: str) -> Column:
        out = F.lit(0.0)
        for g, (m, u) in enumerate(zip(self.m[f], self.u[f])):
            out = F.when(F.col(f"g_{f}") == g, math.log2(max(m, 1e-9) / max(u, 1e-9))).otherwise(out)
        return out

    def match_weight(self) -> Column:
        out = F.lit(math.log2(self.prior / (1 - self.prior)))
        for f in self.m:
            out = out + self.weight(f)
        return out

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.pow(F.lit(2.0), -F.greatest(F.lit(-500.0), F.least(F.lit(500.0), self.match_weight()))))


def _shares(counts: pd.DataFrame, f: str, weight, k: int) -> list[float]:
    known = counts[f"g_{f}"] >= 0
    total = weight[known].sum()
    return [(weight[known & (counts[f"g_{f}"] == g)].sum() + 1e-6) / (total + 1e-6 * k) for g in range(k)]


def em(counts: pd.DataFrame, model: Model, free: list[str], closed: list[str], steps: int = EM_STEPS) -> dict[str, list[float]]:
    """counts: g_ columns and n, of pairs that agree on the closed fields. m of the free fields as this block has it; the block's share of matches starts
    from the prior and what agreement on the closed fields is worth."""
    m = {f: list(model.m[f]) for f in free}
    odds = model.prior / (1 - model.prior)
    for f in closed:
        odds *= model.m[f][-1] / max(model.u[f][-1], 1e-9)
    share = min(0.99, max(1e-4, odds / (1 + odds)))
    for _ in range(steps):
        w = pd.Series(math.log(share / (1 - share)), index=counts.index)
        for f in free:
            ratio = [math.log(max(x, 1e-9) / max(y, 1e-9)) for x, y in zip(m[f], model.u[f])]
            w += counts[f"g_{f}"].map(lambda g, r=ratio: r[g] if g >= 0 else 0.0)
        p = 1 / (1 + (-w.clip(-50, 50)).map(math.exp))
        share = min(1 - 1e-6, max(1e-6, float((p * counts.n).sum() / counts.n.sum())))
        m = {f: _shares(counts, f, p * counts.n, len(m[f])) for f in free}
    return m


def random_pairs(records: DataFrame, n: int = U_PAIRS, seed: int = 42) -> DataFrame:
    """About n pairs of rows picked by a seeded hash of their ids: each row of a sample meets its neighbours in another order of the sample."""
    total = max(1, records.count())
    share = min(1.0, n / total)
    some = records.select("record_id").where(F.pmod(F.xxhash64("record_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    near = max(1, math.ceil(n / max(1, total * share)))
    from ..sources.sinks import number

    a = number(some.withColumn("h", F.xxhash64("record_id", F.lit(seed + 1))), ["h", "record_id"], "a")
    size = max(1, min(near, total - 1)) if total > 1 else 0
    offsets = F.explode(F.sequence(F.lit(1), F.lit(max(1, size))))
    left = a.select(F.col("record_id").alias("x"), "a", offsets.alias("o")).withColumn("to", F.col("a") + F.col("o"))
    right = a.select(F.col("record_id").alias("y"), F.col("a").alias("to"))
    return left.join(right, "to").select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).limit(n)


def prior(records: DataFrame, recall: float = RECALL) -> float:
    """The share of matches among all pairs, from the pairs that one id or one phonetic name gives, at an assumed recall."""
    n = records.count()
    own = records.select(F.trim("clean_tc").alias("tc"), F.trim("name_phonetic_key").alias("ph"))
    two = F.sum(F.col("count") * (F.col("count") - 1) / 2)
    by = lambda *keys: own.where(" and ".join(f"{k} <> ''" for k in keys)).groupBy(*keys).count().agg(F.coalesce(two, F.lit(0.0))).first()[0]
    hit = by("tc") + by("ph") - by("tc", "ph")  # pairs are counted from block sizes, not made
    return min(0.5, max(1e-9, hit / recall / max(1.0, n * (n - 1) / 2)))


def _cells(rows: DataFrame, key: str, columns, most: int = PART, alike: str = "email_normalized_key") -> DataFrame:
    """lefts, rights, alone: a block's parts as they meet, in about as many tasks as two million pairs or 50 000 rows each ask for. Rows of one value of
    `alike` come into one part, so that its similarities are told once there, unless the block has many of them."""
    size, by = F.col("block_size"), None
    pairs, held, largest = blocks(rows, key).agg(F.coalesce(F.sum(size * size), F.lit(0)), F.coalesce(F.sum(size), F.lit(0)), F.max(size)).first()
    tasks = 10 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if largest and largest > most:
        common = rows.where(F.col(alike) != "").groupBy(key, alike).count().where(F.col("count") > most // 32).select(key, alike, F.lit(True).alias("_common"))
        own = F.when(F.col("_common") | (F.col(alike) == ""), F.col("record_id").cast("string")).otherwise(F.col(alike))
        rows, by = rows.join(common, [key, alike], "left").withColumn("_by", own).drop("_common"), "_by"
    lists = dealt(rows, key, columns, most=most, by=by)[1]
    met = meet(lists.withColumnRenamed("rows", "lefts"), lists.withColumnRenamed("rows", "rights"), min(tasks, 1 + max(pairs // 4_000_000, held // 50_000)))
    return met.select("lefts", "rights", (F.col("lo") == F.col("hi")).alias("alone"))


def block_patterns(records: DataFrame, key: str, comparisons=COMPARISONS) -> pd.DataFrame:
    """patterns() of all pairs of rows with one value of a column, without a table of pairs. records may have been through paired() with the column."""
    columns = list(dict.fromkeys(c for _, c, _ in comparisons))
    fields = [f"g_{f}" for f, _, _ in comparisons]
    rows = records if f"_{key}" in records.columns else cut(paired(records, key), "paired")
    counted = _cells(rows, f"_{key}", columns).mapInArrow(counter(comparisons, _winkler), ", ".join(f"{f} int" for f in fields) + ", n long")
    return counted.groupBy(*fields).agg(F.sum("n").alias("n")).orderBy(*fields).toPandas()


def _own(records: DataFrame) -> DataFrame:
    """records as a table of our own, made once."""
    return records if hasattr(records, "_cut_path") else cut(records, "records")


def _patterns(spark) -> DataFrame:
    """id and g_ columns of all patterns of COMPARISONS."""
    size = math.prod(len(cuts) + 3 for _, _, cuts in COMPARISONS)
    at, step = {}, size
    for f, _, cuts in COMPARISONS:
        step //= len(cuts) + 3
        at[f"g_{f}"] = (F.floor(F.col("id") / step) % (len(cuts) + 3) - 1).cast("int")
    return spark.range(size).withColumns(at)


def _kept(spark, model: Model, threshold: float) -> bytes:
    """A byte for each pattern of COMPARISONS: whether its pairs are kept."""
    found = _patterns(spark)
    out = bytearray(found.count())
    for i in found.where((model.probability() >= threshold) | _same()).select("id").toPandas().id:
        out[i] = 1
    return bytes(out)


def _same() -> Column:
    return (F.col("g_tc") == 1) | (F.col("g_phone") == 1) | (F.col("g_email") == 3)


def _met(records: DataFrame, passes, columns, find, kind: str, most: int) -> DataFrame:
    """What find(later keys) gives for the cells of each pass; a pass leaves out what a later one finds."""
    keys = [key for key, _ in passes if key in records.columns]
    rows, out = cut(paired(records, *keys), "paired"), None
    for i, key in enumerate(keys):
        later = [f"_{k}" for k in keys[i + 1 :]]
        cells = _cells(rows, f"_{key}", [*columns, *(F.when(F.trim(k) != "", F.col(k)).alias(k) for k in later)], most)
        own = cells.mapInArrow(find(later), kind)
        out = own if out is None else out.unionByName(own)
    return out


def kept_pairs(records: DataFrame, model: Model, threshold: float, passes=LINKAGE_PASSES, most: int = PART) -> DataFrame:
    """The candidates that predict() keeps, with their levels and both sides' columns. Passes without caps make no table of all candidates: each leaves out
    what a later one finds. Rows that share an id are then rows of their own."""
    if any(cap is not None for _, cap in passes):
        flat = levels(pair_frame(bare_pairs(records, passes), records))
        return flat.where((model.probability() >= threshold) | _same())
    columns, kind = [*COLUMNS, "name_plain"], records.schema["record_id"].dataType.simpleString()
    sides = ", ".join(f"{s}_id {kind}, " + ", ".join(f"{s}_{c} string" for c in columns) for s in ("left", "right"))
    kept = _kept(records.sparkSession, model, threshold)
    return _met(records, passes, columns, lambda later: finder(later, COMPARISONS, _winkler, kept, columns), sides + "".join(f", g_{f} int" for f, _, _ in COMPARISONS), most)


def brief(records: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, passes=LINKAGE_PASSES, digits: int | None = None, most: int = PART) -> DataFrame:
    """left_id, right_id, match_probability (rounded to so many digits), surfaced, decision and flags (risk_flags, joined by commas) of predict(). Without caps,
    no pair's other columns are made: the probability goes by its pattern, the flags by pattern, by names that meet and by what both sides have."""
    rounded = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    if any(cap is not None for _, cap in passes):
        out = predict(records, model, threshold, passes)
        return out.select("left_id", "right_id", rounded(F.col("match_probability")).alias("match_probability"), "surfaced", "decision", F.array_join("risk_flags", ",").alias("flags"))
    records = _own(records)
    model = train(records) if model is None else model
    table = _patterns(records.sparkSession).withColumns({"p": model.probability(), "k": model.probability() >= threshold}).select(
        (F.col("k") | _same()).alias("kept"), (~F.col("k")).alias("surfaced"), *(rounded(c).alias(f"p{i}") for i, c in enumerate((F.col("p"), F.least("p", F.lit(TC_CAP)), F.least("p", F.lit(MUHATAP_CAP))))),
        *((F.col(f"g_{f}") == g).alias(f"{f}_{n}") for f, g, n in (("tc", 1, "same"), ("tc", 0, "differs"), ("phone", 1, "same"), ("email", 3, "same"), ("city", 1, "same"))), "id",
    ).orderBy("id").toPandas()
    kind = records.schema["record_id"].dataType.simpleString()
    find = lambda later: briefs(later, COMPARISONS, _winkler, table)
    found = _met(records, passes, BRIEF, find, f"left_id {kind}, right_id {kind}, match_probability double, surfaced boolean, flags int", most)
    texts = F.array(*(F.lit(",".join(n for i, n in enumerate(FLAGS) if x >> i & 1)) for x in range(1 << len(FLAGS))))
    return found.select("left_id", "right_id", "match_probability", "surfaced", decision(F.col("match_probability")).alias("decision"), F.get(texts, F.col("flags")).alias("flags"))


def train(records: DataFrame, comparisons=COMPARISONS, seed: int = 42) -> Model:
    model = Model.default(comparisons)
    records = _own(records)
    model.prior = prior(records)
    by = lambda found: patterns(levels(pair_frame(found, records), comparisons), comparisons).toPandas()
    counts = by(random_pairs(records, U_PAIRS, seed))
    if len(counts):
        for f, _, _ in comparisons:
            model.u[f] = _shares(counts, f, counts.n.astype(float), len(model.u[f]))
    told: dict[str, list[list[float]]] = {}
    passes = (("clean_tc", ["tc"]), ("name_phonetic_key", ["phonetic", "name"]))
    rows = cut(paired(records, *(key for key, _ in passes)), "paired")
    for key, closed in passes:
        counts = block_patterns(rows, key, comparisons)
        if len(counts):
            for f, m in em(counts, model, [f for f, _, _ in comparisons if f not in closed], closed[:1]).items():
                told.setdefault(f, []).append(m)
    for f, found in told.items():
        model.m[f] = [sum(x) / len(found) for x in zip(*found)]
    return model


def predict(records: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, passes=LINKAGE_PASSES, weights=None) -> DataFrame:
    """Candidates at or above the threshold, and those below that share tc, phone or e-mail key; conflicts are capped. Surest first where it matters: see ordered."""
    records = _own(records)
    model = train(records) if model is None else model
    scored = kept_pairs(records, model, threshold, passes).withColumns({"match_weight": model.match_weight(), "match_probability": model.probability()})
    scored = scored.withColumn("surfaced", F.col("match_probability") < threshold)
    f = linkage_features(scored, ["match_weight", "match_probability", "surfaced", *(f"g_{f}" for f, _, _ in COMPARISONS)])
    feats = Features.of(f)
    p = F.when(F.col("tc_conflict") == 1, F.least("match_probability", F.lit(TC_CAP))).when(F.col("muhatap_no_conflict") == 1, F.least("match_probability", F.lit(MUHATAP_CAP))).otherwise(F.col("match_probability"))
    f = f.withColumn("match_probability", p).withColumns({"decision": decision(F.col("match_probability")), "risk_flags": risk_flags(feats, "linkage"), "score": weighted_breakdown(feats, weights), "match_type": F.lit("splink"), "confidence": confidence(F.col("match_probability"), F.lit(None).cast("double"))})
    return f.withColumn("reasons", rule_reasons(feats, review_name_band(F.col("name_similarity")), F.col("match_probability"), F.col("decision"), "linkage"))


def ordered(found: DataFrame, most: int | None = None) -> DataFrame:
    out = found.orderBy(F.desc_nulls_last("match_probability"), F.desc_nulls_last("match_weight"), "left_id", "right_id")
    return out if most is None else out.limit(most)


def detect(records: DataFrame, min_rules: int = 2, weights=None) -> DataFrame:
    """The linkage model; should it fail, the feature rules, which say so in decision_source."""
    from .matchers import feature_rules

    if len(records.take(2)) < 2:
        return predict(records.limit(0), Model.default(), weights=weights)
    try:
        return cut(predict(records, weights=weights), "detected")
    except (ValueError, ArithmeticError):
        return feature_rules(records, min_rules, weights=weights, fallback=True)
