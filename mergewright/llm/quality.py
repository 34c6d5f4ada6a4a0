"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Words (runs of letters and digits, and runs of signs, by case) fall into BUCKETS by hash. Each bucket has a sparse random index
vector; its word vector is the sum of the index vectors of its neighbours (WINDOW each way) over the whole corpus, brought to unit length, plus
its own index vector. A document is the mean and the deviation of its words' vectors, short ones drawn towards the average. Every partition adds up its own neighbours; the sums by
bucket are a plain aggregation, and what the driver gets is the table of vectors, whose size is fixed.

The network is fitted on a bounded sample of labelled rows (ROWS of each class), and its temperature on a fifth of them kept aside.

Defined results: null and wordless texts have a zero vector and get its score; without labels every score is 0.5, with one class only it is 1 or 0 (as that class says);
very long texts are read whole; repeated rows and rows that share an id or have none are scored each; ids that are null or have labels of both kinds teach
nothing; an empty table gives no rows; other columns are ignored (keep() keeps them, whatever their names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read, small_batches
from .labelled import fold, sample
from .shingles import BASE, _power_tables, mix

PARTS, HELD = 4, 2
CUT = 0.7
ROWS = 6000
BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 48, 2, 2
HIDDEN = 24
PRIOR = 10

#: 0: white space, 1: letter, digit or part of a longer character, 2: sign.
KIND = np.array([0 if i <= 32 else 1 if i >= 128 or chr(i).isalnum() else 2 for i in range(256)], np.uint8)
_random = np.random.default_rng(11)
PLACE = _random.integers(0, DIM, (BUCKETS, NONZERO))
SIGN = _random.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def index_vectors() -> np.ndarray:
    out = np.zeros((BUCKETS, DIM))
    for k in range(NONZERO):
        np.add.at(out, (np.arange(BUCKETS), PLACE[:, k]), SIGN[:, k])
    return out


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word, and the number of the text it stands in."""
    parts = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    kind = KIND[raw]
    change = np.flatnonzero(np.diff(kind, prepend=0))
    ends = np.append(change[1:], len(raw))
    inside = kind[change] > 0
    starts, ends = change[inside], ends[inside]
    power, inverse = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts] + np.uint64(BASE))
    firsts = np.cumsum([0, *(len(t) + 1 for t in parts)])
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(firsts, starts, side="right") - 1


def neighbours(b: np.ndarray, of: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS * DIM)
    for o in range(1, WINDOW + 1):
        same = of[o:] == of[:-o]
        x, y = b[:-o][same], b[o:][same]
        for to, frm in ((x, y), (y, x)):
            for k in range(NONZERO):
                out += np.bincount(to * DIM + PLACE[frm, k], SIGN[frm, k], BUCKETS * DIM)
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM, from all documents."""
    names = [f"v{i}" for i in range(DIM)]

    def run(batches):
        total, any_ = np.zeros(BUCKETS * DIM), False
        for b in small_batches(batches, 0):
            total += neighbours(*tokens(b.column(0).to_pylist()))
            any_ = True
        if any_:
            table = total.reshape(BUCKETS, DIM).astype(np.int64)
            rows = np.flatnonzero(table.any(1))
            for lo in range(0, len(rows), 4096):
                part = rows[lo : lo + 4096]
                yield pa.record_batch([pa.array(part.astype(np.int32)), *(pa.array(np.ascontiguousarray(table[part, i])) for i in range(DIM))], names=["bucket", *names])

    sums = docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"{n} long" for n in names))
    got = sums.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    table = np.zeros((BUCKETS, DIM))
    table[got.bucket.to_numpy()] = got[names].to_numpy(float)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    own = index_vectors()
    return (table / np.where(norm > 0, norm, 1) + own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Mean and variance of the word vectors of each text, and its number of words."""
    b, of = tokens(texts)
    out = np.zeros((len(texts), 2 * DIM + 1))
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        if hi > lo:
            v = vectors[b[lo:hi]]
            out[i, :DIM], out[i, DIM:-1], out[i, -1] = v.mean(0), v.var(0), hi - lo
    return out


class Network:
    """Pooled vectors, drawn towards the sample's mean as if PRIOR average words stood in every text, and standardised; one hidden layer of
    rectified units; one output over a temperature."""

    def __init__(self, n: int = 2 * DIM, seed: int = 3):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, (2 / n) ** 0.5, (n, HIDDEN)), np.zeros(HIDDEN), r.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        self.mean, self.scale, self.temperature, self.constant, self.prior = np.zeros(n), np.ones(n), 1.0, None, np.zeros(n)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        n = x[:, -1:]
        drawn = (x[:, :-1] * n + PRIOR * self.prior) / (n + PRIOR)
        return np.concatenate([drawn[:, :DIM], np.sqrt(drawn[:, DIM:])], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = self.inputs(x)
        h = np.maximum(((x - self.mean) / self.scale) @ self.w[0] + self.w[1], 0)
        return h @ self.w[2] + self.w[3]

    def proba(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 1500, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> Network:
        self.prior = x[:, :-1].mean(0)
        x = self.inputs(x)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        r, m, v = np.random.default_rng(seed), [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        for t in range(1, steps + 1):
            i = r.integers(0, len(x), min(256, len(x)))
            a, z = x[i], x[i] @ self.w[0] + self.w[1]
            h = np.maximum(z, 0)
            d = weight[i] * (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - y[i]) / len(i)
            dz = np.outer(d, self.w[2]) * (z > 0)
            grads = [a.T @ dz + decay * self.w[0], dz.sum(0), h.T @ d + decay * self.w[2], np.array([d.sum()])]
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                self.w[k] -= rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
        """The temperature with the least loss on rows that the fit hasn't seen."""
        z = self.logits(x)
        loss = lambda t: (weight * (np.logaddexp(0, -np.abs(z / t)) + np.maximum(z / t, 0) - y * z / t)).sum()
        self.temperature = float(min(np.geomspace(0.25, 10, 60), key=loss))
        return self


def train(rows: DataFrame, vectors: np.ndarray, shares: dict[int, float] | None = None) -> Network:
    """rows: doc_id, text, y, a bounded number. shares: of each class among all labelled rows, to undo the sampling by class."""
    known = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for b in small_batches(batches, 1):
            x = pooled(b.column(1).to_pylist(), known.value)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = rows.selectExpr("cast(doc_id as bigint) doc_id", "text", "cast(y as int) y").mapInArrow(run, "doc_id long, y int, x array<double>").toPandas()
    net = Network()
    if got.y.nunique() < 2:
        net.constant = 0.5 if got.empty else float(got.y.iloc[0])
        return net
    got = got.sort_values(["doc_id", "y"], kind="stable")
    x, y = np.stack(got.x), got.y.to_numpy(float)
    weight = np.ones(len(y))
    for k, share in (shares or {}).items():
        weight[y == k] = share / max(1e-9, (y == k).mean())
    aside = np.arange(len(y)) % 5 == 4
    net.fit(x[~aside], y[~aside], weight[~aside])
    return net.calibrate(x[aside], y[aside], weight[aside])


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    vectors = word_vectors(docs)
    counts = {r.y: r.n for r in labels.where("quality in (0, 1)").where(fold(PARTS) != HELD).groupBy(F.col("quality").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    rows = sample(docs, labels, "quality", PARTS, HELD, {0: ROWS, 1: ROWS})
    return vectors, train(rows, vectors, {k: n / sum(counts.values()) for k, n in counts.items()})


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    known = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches):
        for b in small_batches(batches, 2):
            s = known.value[1].proba(pooled(b.column(2).to_pylist(), known.value[0]))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(PARTS) == HELD).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, vectors: np.ndarray, net: Network, least: float = CUT) -> DataFrame:
    """The documents whose score is at least `least`, with all columns."""
    known = docs.sparkSession.sparkContext.broadcast((vectors, net))
    at = docs.columns.index("text")

    def run(batches):
        for b in small_batches(batches, at):
            yield b.filter(pa.array(known.value[1].proba(pooled(b.column(at).to_pylist(), known.value[0])) >= least))

    return map_rows(docs, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, *fitted(docs, read(spark, sf_dir, "labels")))
