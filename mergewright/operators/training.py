"""Training pairs, labels and the forest that scores pairs."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import Features, weak_label
from ..plans.tables import cut
from ..sources.sinks import number
from .features import pair_frame, rules_features
from .review import latest_reviews

#: The features of the model that learns from reviews, in order.
CANONICAL = ["name_similarity", "email_similarity", "phone_exact_match", "tc_exact_match", "city_exact_match", "address_similarity"]
#: Those of the model trained offline.
OFFLINE = ["tc_exact_match", "tc_conflict", "phone_exact_match", "phone_last7_match", "email_exact_match", "email_domain_match", "email_username_similarity", "city_exact_match", "phonetic_exact_match", "metaphone_exact_match", "phonetic_close_match", "name_jaro_winkler", "name_levenshtein_similarity", "name_similarity", "first_name_similarity", "surname_similarity", "first_name_jaro_winkler", "surname_jaro_winkler", "first_name_exact_match", "surname_exact_match", "shared_contact_flag", "shared_contact_name_conflict", "household_risk_flag"]
MIN_ROWS = 10
#: The most that Spark's trees allow; the model has no limit of its own.
MAX_DEPTH = 30


def _f(n: str) -> Column:
    return F.col(n)


def good_candidate() -> Column:
    """Pairs worth labelling: a shared id, or names alike with something that supports them."""
    some = _f("common_non_empty_fields") >= 2
    by_id = (_f("tc_exact_match") == 1) | (_f("email_exact_match") == 1) | (_f("phone_exact_match") == 1)
    by_name = (_f("phone_last7_match") == 1) & (_f("name_similarity") >= 0.82)
    alike = (_f("name_similarity") >= 0.93) & ((_f("phone_last7_match") == 1) | (_f("email_similarity") >= 0.95) | (_f("phonetic_exact_match") == 1) | some)
    parts = (_f("first_name_similarity") >= 0.90) & (_f("surname_similarity") >= 0.93) & ((_f("shared_contact_flag") == 1) | (_f("phonetic_exact_match") == 1) | some)
    return by_id | by_name | alike | parts | ((_f("first_name_exact_match") == 1) & (_f("surname_exact_match") == 1) & some)


def _no_id() -> Column:
    return (_f("tc_exact_match") == 0) & (_f("phone_exact_match") == 0) & (_f("email_exact_match") == 0)


def same_surname() -> Column:
    return (_f("surname_exact_match") == 1) & _no_id() & (_f("first_name_exact_match") == 0) & ((_f("shared_contact_flag") == 1) | (_f("household_risk_flag") == 1) | _f("name_similarity").between(0.45, 0.85))


def aggressive() -> Column:
    name = _f("name_similarity")
    rules = ((_f("surname_exact_match") == 1) & (_f("first_name_similarity") < 0.70) & (name < 0.85)) | ((_f("shared_contact_flag") == 1) & (name < 0.80)) | ((_f("household_risk_flag") == 1) & (_f("shared_contact_name_conflict") == 1))
    return _no_id() & (rules | ((name > 0.60) & (name < 0.88)) | ((_f("city_exact_match") == 1) & (_f("phonetic_exact_match") == 1) & (name < 0.88)))


def cross_name() -> Column:
    return _no_id() & (_f("phonetic_exact_match") == 1) & _f("name_similarity").between(0.65, 0.90) & ((_f("first_name_similarity") < 0.95) | (_f("surname_similarity") < 0.95))


def family() -> Column:
    free = (_f("tc_exact_match") == 0) & ~((_f("first_name_exact_match") == 1) & (_f("name_similarity") >= 0.93))
    signal = F.greatest("phone_exact_match", "phone_last7_match", "email_exact_match", "city_exact_match", "shared_contact_flag", "household_risk_flag") == 1
    return free & (_f("surname_exact_match") == 1) & (((_f("first_name_similarity") < 0.75) & signal) | ((_f("shared_contact_name_conflict") == 1) & (_f("first_name_similarity") < 0.85)))


#: Generator, blocking keys, rows of a block that take part, its predicate, most pairs.
GENERATORS = (
    ("strong", ("clean_tc", "clean_phone", "email_normalized_key"), 200, None, None), ("name", ("name_phonetic_key",), 40, good_candidate, None), ("same_surname", ("clean_surname",), 60, same_surname, 300),
    ("aggressive", ("clean_surname",), 80, aggressive, 500), ("cross_name", ("name_phonetic_key",), 50, cross_name, 300), ("family", ("clean_surname",), 100, family, 500),
)


def block_pairs(records: DataFrame, key: str, most: int) -> DataFrame:
    """Pairs among the first `most` records by id of each block. Each task first keeps its own first rows of a block, so a hot block never meets whole."""
    rows = records.where(F.trim(key) != "").select(F.col("record_id").alias("id"), F.col(key).alias("k"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("id"))).where(F.col("n") <= most).select("id", "k")
    other = rows.select(F.col("id").alias("right_id"), "k")
    return rows.join(other, "k").where(F.col("id") < F.col("right_id")).select(F.col("id").alias("left_id"), "right_id", F.col("k").alias("key"))


def training_pairs(records: DataFrame, generators=GENERATORS) -> DataFrame:
    """generator, left_id, right_id; limits count in the order of blocks and ids."""
    out = None
    for name, keys, most, rule, limit in generators:
        found = None
        for k in keys:
            own = block_pairs(records, k, most)
            found = own if found is None else found.unionByName(own)
        found = found.groupBy("left_id", "right_id").agg(F.min("key").alias("key"))
        if rule is not None:
            ok = rules_features(pair_frame(found.select("left_id", "right_id"), records)).where(rule()).select("left_id", "right_id")
            found = found.join(ok, ["left_id", "right_id"], "left_semi")
        if limit is not None:
            found = found.orderBy("key", "left_id", "right_id").limit(limit)
        found = found.select(F.lit(name).alias("generator"), "left_id", "right_id")
        out = found if out is None else out.unionByName(found)
    return out


def candidate_table(records: DataFrame, generators=GENERATORS) -> DataFrame:
    """The union of all generators' pairs with their features and an empty label, in order."""
    found = training_pairs(records, generators).select("left_id", "right_id").distinct()
    return rules_features(pair_frame(found, records)).withColumn("label", F.lit(None).cast("int")).orderBy("left_id", "right_id")


def weakly_labelled(features: DataFrame) -> DataFrame:
    return features.withColumn("label", weak_label(Features.of(features))).where("label >= 0")


def labels(candidates: DataFrame, actions: DataFrame) -> DataFrame:
    """match id, label: the last review, else the candidate's decision; pending ones don't count."""
    last = latest_reviews(actions).select(F.col("match_id").alias("id"), F.col("decision").alias("said"))
    d = F.lower(F.trim(F.coalesce("said", "decision")))
    out = candidates.select("id", "left_id", "right_id", "decision").join(last, "id", "left")
    return out.withColumn("label", F.when(d == "approved", 1).when(d == "rejected", 0)).where("label is not null").select("id", "left_id", "right_id", "label")


def ground_truth(candidates: DataFrame, actions: DataFrame, features: DataFrame) -> DataFrame:
    """Labels with the canonical features."""
    own = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in features.columns else F.lit(0.0).alias(c) for c in CANONICAL]
    return labels(candidates, actions).join(features.select("left_id", "right_id", *own), ["left_id", "right_id"]).select("id", "left_id", "right_id", "label", *CANONICAL)


def split(df: DataFrame, share: float = 0.2) -> DataFrame:
    """Adds is_test: of each class the share, to the nearest row, whose pairs hash lowest, the same at every run; a class of two rows or more has one at least on
    each side. Rows are numbered through range partitions, so no class has to fit a task."""
    counts = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    rows, before, edge = number(df.withColumn("_h", F.xxhash64("left_id", "right_id")), ["label", "_h", "left_id", "right_id"], "_no"), 0, F.lit(0)
    for label, n in sorted(counts.items()):
        take = min(n - 1, max(1, round(share * n))) if n > 1 else 0
        edge = F.when(F.col("label") == label, before + take).otherwise(edge)
        before += n
    return rows.withColumn("is_test", F.col("_no") <= edge).drop("_no", "_h")


def train_forest(df: DataFrame, columns: list[str] | None = None, trees: int = 200, seed: int = 42) -> tuple[PipelineModel, dict]:
    """df: label and features, and pair ids -> the model and its figures. Classes weigh alike."""
    columns = columns or CANONICAL
    counts = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    total = sum(counts.values())
    if total < MIN_ROWS or len(counts) < 2:
        raise ValueError("training needs ten labelled pairs or more, of both labels")
    own = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns]
    rows = split(df.select("left_id", "right_id", F.col("label").cast("int").alias("label"), *own))
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, total / (2.0 * counts[1])).otherwise(total / (2.0 * counts[0])))
    rows = cut(rows, "training")
    forest = RandomForestClassifier(numTrees=trees, seed=seed, weightCol="weight", labelCol="label", featuresCol="v", maxDepth=MAX_DEPTH)
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="v"), forest]).fit(rows.where("not is_test"))
    told = classification_metrics(predict(model, rows.where("is_test")).withColumn("predicted", (F.col("ml_probability") >= 0.5).cast("int"))).head().asDict()
    return model, told | {"train_size": rows.where("not is_test").count(), "test_size": rows.where("is_test").count(), "total_labeled_samples": total, "feature_columns": columns}


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ml_probability."""
    columns = model.stages[0].getInputCols()
    missing = {c: F.lit(0.0) for c in columns if c not in df.columns}
    out = model.transform(df.withColumns(missing).fillna(0.0, columns) if missing else df.fillna(0.0, columns))
    return out.withColumn("ml_probability", F.round(vector_to_array("probability")[1], 4)).drop("v", "rawPrediction", "probability", "prediction", *missing)


def classification_metrics(df: DataFrame) -> DataFrame:
    """label, predicted -> accuracy, precision, recall, f1, rounded to four places; 0 where undefined."""
    hit = lambda a, b: F.count_if((F.col("label") == a) & (F.col("predicted") == b))
    c = df.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(F.round(share(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"), F.round(share(tp, tp + fp), 4).alias("precision"), F.round(share(tp, tp + fn), 4).alias("recall"), F.round(share(2 * tp, 2 * tp + fp + fn), 4).alias("f1"))


def flatten_features(raw: dict) -> dict:
    """A payload whose features may lie one level down; the outer values win."""
    inner = raw.get("features")
    return (dict(inner) if isinstance(inner, dict) else {}) | {k: v for k, v in raw.items() if k != "features"}
