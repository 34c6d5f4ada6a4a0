"""The pipeline's stages and the whole of it, with columns whose names are those that operators like to use."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from mergewright.llm import bpe, mixing, quality, secrets

NAMES = ("_id", "_p", "_use", "_gone", "_r", "_no", "_size", "id", "row", "at", "taken", "size", "position", "copies", "least", "digest", "copy", "h", "bin", "gone", "k_id", "p_id", "d_no")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES) + ", more map<string,int>, `a.b` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *(f"{n}{i}" for n in NAMES), {"x": 1}, 7) for i, t, s in rows], DOCS)


def texts(n, seed=1, words=200):
    r = random.Random(seed)
    known = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)]
    return [" ".join(r.choices(known, k=r.randint(20, 60))) for _ in range(n)]


ODD = [(None, "alone without an id", "a"), (None, "alone without an id", "a"), (900, None, "a"), (901, "", None), (902, " \t", "b"), (903, "x" * 200_000, "b"), (904, "very long " * 30_000, None)]
CASES = {"unique": [(i, t, "abc"[i % 3]) for i, t in enumerate(texts(40))] + ODD[2:], "shared": [(i % 9, t, "abc"[i % 3]) for i, t in enumerate(texts(40))] + ODD * 2, "null": [(None, None, None)] * 4, "empty": []}


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    """A folder with labels: texts with junk signs are of low quality."""
    where = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_the_columns(spark, labels, case, stage):
    docs = frame(spark, CASES[case])
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, labels)
    if stage != "tokens":
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = out.collect()
    if stage in ("secrets", "tokens"):
        assert len(got) == len(CASES[case])
    if stage not in ("tokens", "mixing") and case != "empty":
        assert all(r._id == f"_id{r.doc_id}" and r["a.b"] == 7 and r.more == {"x": 1} for r in got)


def test_near_duplicates_stage_is_brute_force(spark, labels):
    r = random.Random(5)
    rows = [(i, t, "a") for i, t in enumerate(texts(30))]
    for i in range(30):
        w = rows[i][1].split()
        w[r.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w), "b"))
    rows += [(200, rows[0][1], "a"), (201, None, "a"), (202, "", "a")]

    def shingles(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = {i: shingles(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}
    top = lambda x: x if up[x] == x else top(up[x])
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), labels).collect()
    assert sorted(x.doc_id for x in got) == sorted(i for i in up if top(i) == i)


def test_redaction_is_brute_force(spark, labels, monkeypatch):
    key = "AKIA" + "B2" * 9
    rows = [(1, f"see {key} and password: abcdefghijkl9 end", "a"), (2, f"token={key}", "a"), (3, "deadbeefdeadbeef00\nplain", "a"), (4, "plain", None)]
    monkeypatch.setattr(secrets, "default_samples", lambda *a: __import__("pandas").DataFrame({"token": ["zzzz"], "label": [0]}))
    got = {x.doc_id: x for x in corpus_pipeline.redact_secrets(spark, frame(spark, rows), labels).collect()}
    want = {1: "see <secret:access> and <secret:assign> end", 2: "<secret:assign>", 3: "<secret:hex>\nplain", 4: "plain"}
    assert {i: x.text for i, x in got.items()} == want and all(x.n_chars == len(x.text) for x in got.values())


@pytest.mark.parametrize("case", ["unique", "shared"])
def test_mix_in_order_with_parts(spark, case):
    rows = CASES[case] if case == "unique" else CASES[case] + [(3, f"shares its id {i}", "a") for i in range(20)]
    docs = frame(spark, rows)
    plan = mixing.mix(docs)
    got = mixing.materialise(docs, plan).collect()
    uses = []
    for x in plan.where("taken > 0").collect():
        for k in range(-(-x.taken // x.size)):
            uses.append((x.position if k == 0 else x.last_position, x.doc_id, x.source, min(x.size, x.taken - k * x.size)))
    uses.sort(key=lambda u: (u[0], u[1] is not None, u[1] or 0))
    size = lambda t: len(WORD.findall(t))
    assert Counter((x.doc_id, x.source, size(x.text)) for x in got) == Counter(u[1:] for u in uses)
    assert [x.doc_id for x in got] == [u[1] for u in uses]
    whole = {}
    for i, t, _ in rows:
        whole.setdefault(i, []).append(t or "")
    for x in got:
        assert any(t.startswith(x.text) and (len(t) == len(x.text) or WORD.findall(t)[: size(x.text)] == WORD.findall(x.text)) for t in whole[x.doc_id]) and x.n_chars == len(x.text)
    double = [x for x in plan.collect() if x.taken > x.size]
    assert not double or max(Counter((x.doc_id, x.text) for x in got).values()) >= 2


def test_many_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 3)
    rows = [(None, "one two three", "a")] * 11 + [(i, t, "b") for i, t in enumerate(texts(10))]
    plan = mixing.mix(frame(spark, rows)).collect()
    assert len(plan) == len(rows) and all(0 <= x.taken <= 2 * x.size for x in plan)
    for s in "ab":
        own = [x for x in plan if x.source == s]
        assert sum(x.taken for x in own) == int(own[0].target)


def test_whole_pipeline(spark, tmp_path):
    """Every stage's work is seen in the result: junk gone, near copies gone, the rest encoded as the mix has it; nothing is left of the tables between."""
    import tiktoken

    from mergewright.plans import tables

    good = texts(330, seed=2, words=600)
    rows, labels = [], []
    for i, t in enumerate(good):
        junk = i % 5 == 0
        rows.append((i, " ".join(w + "###" for w in t.split()) if junk else t, "abc"[i % 3]))
        labels.append((i, int(not junk), 0))
    rows += [(1000 + i, rows[i][1], "a") for i in range(1, 5)] + [(2000, None, "a")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = tables.tables()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(tables.tables() - before) == 1
    docs = frame(spark, rows)
    kept = [x.doc_id for x in quality.score(docs, *quality.fitted(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect() if x.score >= 0.7]
    assert sum(i % 5 == 0 for i in kept if i < 1000) <= 3 and len(kept) > 250
    want = sorted(i for i in set(kept) if i < 1000)
    ids = Counter(x.doc_id for x in got)
    assert set(ids) <= set(want) and max(ids.values()) <= 2 and len(ids) > 0.6 * len(want)
    path, pattern = bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    text, whole = dict((i, t) for i, t, _ in rows), 0
    for x in got:
        said = own.encode_ordinary(text[x.doc_id])
        whole += (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(said), hashlib.sha256(",".join(map(str, said)).encode()).hexdigest(), hashlib.sha256(text[x.doc_id].encode()).hexdigest())
    assert whole >= len(got) - 3  # a source's last use may be in part
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [tuple(x) for x in again] == [tuple(x) for x in got]
