import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergewright.operators import blocking as B
from mergewright.operators import golden as G
from mergewright.operators import levels, linkage, matchers, review, training
from mergewright.operators import normalize as N
from mergewright.operators.features import pair_frame, review_features, rules_features
from mergewright.operators.graph import connected_components
from mergewright.plans import donors as D
from mergewright.plans import reports as Q
from mergewright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
KEYS = ["clean_tc", "clean_phone", "email_normalized_key", "clean_muhatap_no", "name_phonetic_key"]


def rows(spark, **cols):
    n = len(next(iter(cols.values())))
    return spark.createDataFrame([(i, *((cols[k][i] if k in cols else "") for k in KEYS)) for i in range(n)], "record_id long, " + ", ".join(f"{k} string" for k in KEYS))


def test_block_over_cap_gives_nothing(spark):
    df = rows(spark, name_phonetic_key=["A123"] * 1000)
    assert B.pairs(df).count() == 0 and B.skipped_blocks(df).collect()[0].block_size == 1000


def test_pair_limit(spark):
    p = B.pairs(rows(spark, clean_phone=["5"] * 50))
    assert p.count() == 1225 and B.limited(p, 100).count() == 100 and B.is_limited(p, 100) and not B.is_limited(p, 1225)


def test_blocks_of_different_size(spark):
    df = rows(spark, clean_phone=["1"] * 300 + ["2"] * 10)
    assert B.pairs(df).count() == 45 and [r.block_size for r in B.skipped_blocks(df).collect()] == [300]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1120)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame([*edges, (None, 1)], "left_id long, right_id long"))
    assert {(x.node, x.root) for x in got.collect()} == {(x, top(x)) for x in up}
    assert connected_components(spark.createDataFrame([], "left_id long, right_id long")).count() == 0


def donors(spark, *records):
    names = ("name", "tc", "phone", "email", "city", "address", "muhatap_no")
    return N.normalize(spark.createDataFrame([(i, 1, *(r.get(n, "") for n in names)) for i, r in enumerate(records, 1)], "record_id long, upload_id long, " + ", ".join(f"{n} string" for n in names)))


def test_features_of_a_pair(spark):
    d = donors(spark, dict(name="Ali Yilmaz", tc="12345678901", phone="0543 038 59 77"), dict(name="Veli Yilmaz", tc="99999999999", phone="+90 543 038 59 77"))
    f = rules_features(pair_frame(B.pairs(d), d)).head()
    assert (f.phone_exact_match, f.tc_conflict, f.same_surname_name_conflict, f.shared_contact_flag) == (1, 1, 1, 1)
    assert len(f) == 40 and len(review_features(pair_frame(B.pairs(d), d)).columns) == 25
    m = matchers.feature_rules(d).head()
    assert m is None or m.decision == "pending"


def test_golden_record(spark):
    d = donors(spark, dict(name="Ayşe Kaya", tc="1" * 11, email="a.b+x@gmail.com", address="Uzun Sokak 12"), dict(name="Ayşe Kaya", tc="123", email="a.b@gmail.com", city="Izmir"), dict(name="A Kaya", tc="2" * 11, phone="05321112233", address="Kisa"))
    g = [G.golden(d.orderBy(F.rand(s)).withColumn("group_id", F.lit(1))).head() for s in (1, 2)]
    assert g[0] == g[1]
    x = g[0]
    assert (x.clean_name, x.clean_email, x.clean_address, x.secondary_emails) == ("AYSE KAYA", "a.b@gmail.com", "UZUN SOKAK 12", ["a.b+x@gmail.com"])
    assert x.warnings == ["tc_conflict"] and x.source_record_ids[0] == 1 and x.field_sources["clean_phone"] == 3


def state(spark):
    d = donors(spark, *(dict(name=f"Kisi {i}", phone="5321112233", muhatap_no=f"M{i}") for i in range(1, 5)))
    pairs = [(10 * a + b, 1, a, b, 0.9, 0.9, "exact", "pending") for a in range(1, 5) for b in range(a + 1, 5)]
    c = spark.createDataFrame(pairs, "id long, detection_run_id long, left_id long, right_id long, score double, confidence double, match_type string, decision string")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    return review.State(d, c, empty(review.MEMBERSHIPS), empty(review.ENTITIES), empty(review.ACTIONS), empty(review.AUDIT))


def decisions(s):
    return {(r.left_id, r.right_id): r.decision for r in s.candidates.collect()}


def test_partial_approval_merge_and_removal(spark):
    s, e = review.partial_approve(state(spark), [1, 2, 3, 4], [1, 2], [3], "me")
    assert decisions(s) == {(1, 2): "approved", (1, 3): "rejected", (1, 4): "rejected", (2, 3): "rejected", (2, 4): "rejected", (3, 4): "rejected"}
    s = review.merge_into(s, e, [1, 2, 3, 4], [4], "me")
    assert decisions(s)[(1, 4)] == "approved" and decisions(s)[(3, 4)] == "rejected"
    s = review.remove_member(s, e, 1, "me")
    assert decisions(s)[(1, 2)] == "rejected" and decisions(s)[(1, 3)] == "pending"
    assert sorted(r.normalized_record_id for r in s.memberships.collect()) == [2, 4]
    assert s.audit.count() == 3
    with pytest.raises(review.Refused):
        review.partial_approve(s, [1, 2], [1, 2], [2], "me")


def test_approve_reject_reset(spark):
    s, e = review.approve(state(spark), 12, "me")
    assert s.entities.head().donor_count == 2 and decisions(s)[(1, 2)] == "approved"
    with pytest.raises(review.Refused):
        review.reject(s, 12, "me")
    s = review.reset(s, 12, "me")
    assert decisions(s)[(1, 2)] == "pending" and s.entities.head().donor_count == 0
    s = review.reject(s, 13, "me")
    assert decisions(s)[(1, 3)] == "rejected" and s.actions.count() == 3
    with pytest.raises(review.Refused):
        review.edit_golden(s, e, {"id": "1"}, "me")


def test_linkage_keeps_conflicts_uncertain(spark):
    p = linkage.predict(D.records(spark, SF))
    assert p.where("tc_conflict = 1 and match_probability > 0.75 or muhatap_no_conflict = 1 and match_probability > 0.85").count() == 0
    assert p.where("decision <> 'pending'").count() == 0
    assert linkage.predict(D.records(spark, SF).limit(0), linkage.Model.default()).count() == 0


def test_uncapped_pairs_are_not_shuffled(spark, capsys):
    rows = [(i, f"t{i % 4}" if i % 3 else " ", None if i % 5 == 0 else f"p{i % 7}", "", "S" if i < 40 else f"s{i % 9}") for i in [*range(60), 7, 7]]
    r = spark.createDataFrame(rows, "record_id long, clean_tc string, clean_phone string, email_normalized_key string, name_phonetic_key string")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and any((x or "").strip() and x == y for x, y in zip(a[1:], b[1:])))
    for most in (3, 1000):
        assert sorted(map(tuple, B.uncapped_pairs(r, most=most).collect())) == want
    QUERIES["pairs_linkage"](spark, SF).explain()
    assert not re.search(r"hashpartitioning\((left|right)_id", capsys.readouterr().out)


def test_linkage_levels_by_block_are_those_of_pairs(spark, capsys):
    r = D.records(spark, SF)
    model = linkage.Model.default()
    flat = linkage.levels(pair_frame(B.bare_pairs(r, B.LINKAGE_PASSES), r))
    cols = ["left_id", "right_id", "left_clean_email", "right_last_name", *(f"g_{f}" for f, _, _ in linkage.COMPARISONS)]
    want = flat.where((model.probability() >= 0.3) | linkage._same()).select(cols)
    found = linkage.kept_pairs(r, model, 0.3)
    assert sorted(map(tuple, found.select(cols).collect())) == sorted(map(tuple, want.collect()))
    own = linkage.levels(pair_frame(B.column_pairs(r, "name_phonetic_key").select("left_id", "right_id"), r))
    fields = [f"g_{f}" for f, _, _ in linkage.COMPARISONS]
    counted = linkage.block_patterns(r, "name_phonetic_key")
    assert sorted(map(tuple, linkage.patterns(own).select(*fields, "n").collect())) == sorted(counted[[*fields, "n"]].itertuples(index=False, name=None))
    linkage.predict(r, model).explain()
    assert not re.search(r"hashpartitioning\((left|right)_id", capsys.readouterr().out)
    values = ["martha", "marhta", "u12@gmail.com", "u.21@example.com", "ü", "a" * 64, "ab" * 40]
    x, y = zip(*((i, j) for i in range(7) for j in range(7)))
    told = levels.reached(values, np.array(x), np.array(y), (0.9, 0.7), linkage._winkler)
    assert told.tolist() == [sum(linkage._winkler(values[i], values[j]) >= t for t in (0.9, 0.7)) for i, j in zip(x, y)]


def test_linkage_brief_is_predict(spark):
    """By grids of a block's parts, against the pairs one by one: a cap that nothing reaches takes that way."""
    pick, columns = random.Random(5).choice, linkage.COLUMNS
    rows = []
    for i in range(230):
        first, last = pick(["AHMET", "AHMED", "A", "AYSE"]), pick(["YILMAZ", "YILMAS", "KAYA"])
        mail = pick(["", "ü", f"{pick('abc')}{i % 40}@gmail.com", f"{pick('abc')}.{i % 90}@example.com", pick("ab") * 70])
        values = {"clean_name": f"{first} {last}" if i % 9 else "", "clean_name_ordered": "", "clean_tc": pick(["", str(i % 50)]), "clean_phone": pick(["", str(i % 60)]), "clean_email": mail, "email_normalized_key": mail.replace(".", ""), "clean_city": pick(["", "IZMIR", "BURSA"])}
        values |= {"clean_address": pick(["", "X"]), "clean_muhatap_no": pick(["", f"M{i % 3}"]), "name_phonetic_key": "A545" if i % 20 else "K", "name_metaphone_key": "", "first_name": first if i % 9 else "", "last_name": last if i % 9 else ""}
        rows.append((i, *(values[c] for c in columns)))
    r = spark.createDataFrame(rows, "record_id long, " + ", ".join(f"{c} string" for c in columns)).localCheckpoint()
    model = linkage.Model.default()
    model.prior = 0.05
    want = sorted(map(tuple, linkage.brief(r, model, passes=[(k, 10**6) for k, _ in B.LINKAGE_PASSES], digits=6).collect()))
    assert {f for x in want for f in x[5].split(",")} >= {"email_high_identity_weak", "household_risk", "same_surname_name_conflict", "cross_city_contact_mismatch", "sparse_data", "weak_identity_evidence"}
    for most in (150, 1000):
        assert sorted(map(tuple, linkage.brief(r, model, digits=6, most=most).collect())) == want
    a, b = ["ab", "ü", "a" * 65, "martha", "abcabd"], ["ü", "marhta", "a" * 66, "bacdba", "ab"]
    assert levels.grid(a, b, (0.9, 0.7), linkage._winkler).tolist() == [[sum(linkage._winkler(x, y) >= t for t in (0.9, 0.7)) for y in b] for x in a]


def test_forest(spark):
    r = D.records(spark, SF)
    f = rules_features(pair_frame(B.pairs(r), r))
    model, figures = training.train_forest(training.weakly_labelled(f), training.OFFLINE, trees=5)
    assert figures["accuracy"] > 0.9 and training.predict(model, f).where("ml_probability between 0 and 1").count() == f.count()
    with pytest.raises(ValueError):
        training.train_forest(training.weakly_labelled(f).limit(3))


def test_clean_dataset_has_each_record_once(spark):
    m = D.memberships(spark, SF)
    clean = Q.clean_dataset(D.records(spark, SF), m, D.entities(m))
    rest = clean.where("source_rank = 1").count()
    assert rest + m.where("status = 'confirmed'").count() == D.records(spark, SF).count()
    assert Q.clean_page(clean, 1, 10).count() == 10


def test_forest_scores_are_of_the_whole_forest(spark, monkeypatch):
    from mergewright.plans.queries import QUERIES

    made, train = [], training.train_forest

    def seen(*a, **b):
        made.append(train(*a, **b))
        return made[-1]

    monkeypatch.setattr(training, "train_forest", seen)
    assert QUERIES["forest_scores"](spark, "/root/testdata/sf0.001").count() > 0
    forest = made[0][0].stages[1]
    assert forest.getNumTrees == 200 and forest.getMaxDepth() == 30


@pytest.mark.parametrize("n", [10, 20, 200])
def test_forest_split_is_stratified(spark, n):
    df = spark.createDataFrame([(i, i + 1000, int(i % 4 == 0), i % 7 / 7, 0.5) for i in range(n)], "left_id long, right_id long, label int, name_similarity double, email_similarity double")
    rows = training.split(df).groupBy("label", "is_test").count().collect()
    for label in (0, 1):
        own = {r.is_test: r["count"] for r in rows if r.label == label}
        assert abs(own[True] - 0.2 * sum(own.values())) <= 1 and own[False] > own[True]
    model, figures = training.train_forest(df, trees=3)
    assert figures["train_size"] + figures["test_size"] == n and abs(figures["test_size"] - 0.2 * n) <= 1
    assert training.predict(model, df).count() == n


def test_review_gates(spark):
    s = state(spark)
    with pytest.raises(review.Refused):
        review.partial_approve(s, [1, 2, 3, 4], [1, 2], [], "me", required=2)
    s, e = review.partial_approve(s, [1, 2, 3, 4], [1, 2], [], "me", acknowledged=True, required=2)
    for group, selected in (([3, 4], [3, 9]), ([3, 4], [])):
        with pytest.raises(review.Refused):
            review.merge_into(s, e, group, selected, "me")
    with pytest.raises(review.Refused):
        review.merge_into(s, e, [3, 4], [3], "me", required=3)
    logged = s.actions.count()
    other = review.remove_member(s, e, 1, "me", runs=[99])
    assert decisions(other) == decisions(s) and other.actions.count() == logged
    s = review.remove_member(s, e, 1, "me", runs=[1])
    assert decisions(s)[(1, 2)] == "rejected" and decisions(s)[(1, 3)] == "pending"
    assert s.actions.count() == logged + 3


def test_groups_of_all_decisions_at_once(spark):
    from mergewright.operators import groups as R

    rows = [(1, 2, "pending"), (2, 3, "pending"), (2, 3, "approved"), (7, 8, "rejected"), (8, 9, "other")]
    got = R.groups(spark.createDataFrame(rows, "left_id long, right_id long, decision string")).collect()
    assert {(r.record_id, r.group_id, r.decision) for r in got} == {(1, 1, "pending"), (2, 1, "pending"), (3, 1, "pending"), (2, 2, "approved"), (3, 2, "approved"), (7, 7, "rejected"), (8, 7, "rejected")}


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace as N

    from mergewright.plans import tables

    none = N(isDefined=lambda: False)
    context = N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        tables.shared_dir(N(conf=N(get=lambda *a: None), sparkContext=context))
