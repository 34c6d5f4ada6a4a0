"""Exact top-k search by inner product, a block of documents at a time.

Components become integers floor(SCALE * x). Documents are put in an order that keeps alike ones together (nearest of CENTROIDS
centroids, fitted on SAMPLE rows whose ids hash lowest; then id) and range-partitioned; BLOCK consecutive documents form a block, and consecutive blocks
a group, one row each: the group's ids, its forward index (the vectors by block), and each block's maxima and minima by component. Queries
in the same order form chunks.

A query's bound for a block is the sum over components of the larger of query * maximum and query * minimum. Bounds alone are read first, from the maxima and
minima of all groups, dealt into tiles: in a first round every query takes the LEAD blocks of each tile with the highest bounds and scores them through the
forward index, which gives its k-th (score, id) so far; in a second round it takes all other blocks whose bound reaches that. Only groups and queries with such a
pair meet; there a query takes its blocks in the order of their bounds until they fall below its k-th score, and only what beats its k-th (score, id)
comes out.

All arithmetic is exact: floating-point products are used only where every partial sum is an integer that the type holds.

Defined results: rows with a null id, or with a vector that is null or has null or non-finite components, take no part; missing components of
shorter vectors count as 0; rows that share an id are rows of their own, each a query and a candidate of all others; ties go to the smaller id; a query without
candidates gives no rows; scores are taken modulo 2**64 if they exceed a long; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop, read

K, EVERY, SCALE = 20, 20, 64.0
BLOCK, LEAD = 256, 4
#: Most blocks in a group, groups in a tile and queries in a chunk; wide vectors make smaller groups and chunks.
GROUP, TILE, CHUNK = 32, 256, 2048
CENTROIDS, SAMPLE = 64, 4096
LOW, NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def matrix(lists, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def centroids(x: np.ndarray, n: int = CENTROIDS, rounds: int = 8) -> np.ndarray:
    """Lloyd's method from evenly spaced rows."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = x[np.linspace(0, len(x) - 1, min(n, max(1, len(x) // 16))).astype(int)].astype(float)
    for _ in range(rounds):
        near = nearest(x, c)
        for k in range(len(c)):
            if (near == k).any():
                c[k] = x[near == k].mean(0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far, all of them better than its floor."""

    def __init__(self, n: int, k: int, floor: tuple[np.ndarray, np.ndarray] | None = None):
        self.k = k
        score, id_ = (np.full(n, LOW), np.full(n, NONE)) if floor is None else floor
        self.score, self.id = np.repeat(score[:, None], k, 1), np.repeat(id_[:, None], k, 1)
        self.real = np.zeros((n, k), bool)

    def least(self, rows=slice(None)) -> np.ndarray:
        """What a score must reach to matter."""
        return self.score[rows, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, nos: np.ndarray, own: np.ndarray) -> None:
        """scores: of the queries `rows` by document; nos: the documents' row numbers; own: the queries'."""
        last, last_id = self.score[rows, -1][:, None], self.id[rows, -1][:, None]
        ok = ((scores > last) | ((scores == last) & (ids[None, :] < last_id))) & (nos[None, :] != own[:, None])
        hit = ok.any(1)
        rows, scores, ok = rows[hit], scores[hit], ok[hit]
        if not len(rows):
            return
        s = np.concatenate([self.score[rows], np.where(ok, scores, LOW)], 1)
        i = np.concatenate([self.id[rows], np.where(ok, ids[None, :], NONE)], 1)
        r = np.concatenate([self.real[rows], ok], 1)
        by_id = np.argsort(i, axis=1, kind="stable")
        top = np.take_along_axis(by_id, np.argsort(np.invert(np.take_along_axis(s, by_id, 1)), axis=1, kind="stable")[:, : self.k], 1)
        self.score[rows], self.id[rows], self.real[rows] = (np.take_along_axis(x, top, 1) for x in (s, i, r))


def bounds(q: np.ndarray, highs: np.ndarray, lows: np.ndarray) -> np.ndarray:
    return product(np.maximum(q, 0), highs) + product(np.minimum(q, 0), lows)


def search(best: Best, own: np.ndarray, q: np.ndarray, ids: np.ndarray, nos: np.ndarray, docs: np.ndarray, highs: np.ndarray, lows: np.ndarray, live: np.ndarray | None = None, block: int = BLOCK) -> int:
    """Adds to best what the queries (own: their row numbers) find in the live blocks (query, block) of one group; how many (query, block) were scored."""
    bound = bounds(q, highs, lows)
    live = np.ones(bound.shape, bool) if live is None else live
    order = np.argsort(np.where(live, np.invert(bound), NONE), axis=1, kind="stable")
    scored, all_ = 0, np.arange(len(q))
    for turn in range(order.shape[1]):
        at = order[:, turn]
        here = np.flatnonzero(live[all_, at] & (bound[all_, at] >= best.least()))
        if not len(here):
            break
        scored += len(here)
        for b in np.unique(at[here]):
            rows = here[at[here] == b]
            part = slice(b * block, (b + 1) * block)
            best.add(rows, product(q[rows], docs[part]), ids[part], nos[part], own[rows])
    return scored


def leading(bound: np.ndarray, first_id: np.ndarray, lead: int) -> np.ndarray:
    """Of each query the `lead` blocks with the highest bounds, those with smaller ids first: a mask."""
    n = bound.shape[1]
    out = np.zeros(bound.shape, bool)
    if n <= lead:
        out[:] = True
        return out
    by = np.argsort(first_id, kind="stable")
    order = np.argsort(np.invert(bound[:, by]), axis=1, kind="stable")[:, :lead]
    np.put_along_axis(out, by[order], True, 1)
    return out


def _ranges(docs: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    parts = [docs[i : i + block] for i in range(0, len(docs), block)]
    return np.stack([p.max(0) for p in parts]), np.stack([p.min(0) for p in parts])


def _pack(x: np.ndarray) -> bytes:
    """Integers as 16 bits where they fit; the first byte says which."""
    small = len(x) == 0 or (x.min() >= -32768 and x.max() <= 32767)
    return (b"s" + x.astype(np.int16).tobytes()) if small else (b"l" + x.astype(np.int64).tobytes())


def _unpack(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if raw[:1] == b"s" else np.int64, offset=1).reshape(-1, dim).astype(np.int64)


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """id, v (array of long): the rows that take part."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), v.alias("e")).where(F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    return rows.select("id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


GROUPS = pa.schema([("g", pa.int64()), *((n, pa.binary()) for n in ("ids", "nos", "docs", "highs", "lows", "first_ids"))])
GROUPS_DDL = "g long, ids binary, nos binary, docs binary, highs binary, lows binary, first_ids binary"
CHUNKS = pa.schema([("c", pa.int64()), ("ids", pa.binary()), ("nos", pa.binary()), ("q", pa.binary())])
CHUNKS_DDL = "c long, ids binary, nos binary, q binary"
PAIRS = pa.schema([("g", pa.int64()), ("c", pa.int64()), *((n, pa.binary()) for n in ("at", "q_ids", "q_nos", "q", "score", "id", "live"))])
PAIRS_DDL = "g long, c long, at binary, q_ids binary, q_nos binary, q binary, score binary, id binary, live binary"
HITS = pa.schema([(n, pa.int64()) for n in ("c", "at", "query_id", "vec_id", "score")])
HITS_DDL = "c long, at long, query_id long, vec_id long, score long"


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _packed(rows: DataFrame, size: int, dim: int, make, schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows (no, id, v, c) in order of (c, id, no), `size` of them at a time as one row that make(number, ids, nos, vectors) gives."""

    def run(batches):
        part, turn, ids, nos, vs = TaskContext.get().partitionId(), 0, [], [], []
        done = lambda: pa.record_batch([pa.array([x], f.type) for x, f in zip(make(part << 32 | turn, np.array(ids, np.int64), np.array(nos, np.int64), matrix(vs, dim)), schema)], schema=schema)
        for b in batches:
            for no, i, v in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(i)
                nos.append(no)
                vs.append(v)
                if len(ids) == size:
                    yield done()
                    ids, nos, vs, turn = [], [], [], turn + 1
        if ids:
            yield done()

    n = rows.count()
    parts = max(1, -(-n // (4 * size)))
    return rows.repartitionByRange(parts, "c", "id", "no").sortWithinPartitions("c", "id", "no").select("no", "id", "v").mapInArrow(run, ddl)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query, the rows whose id is divisible by `every`, against all other rows. told gets how many pairs of a chunk of
    queries and a group met in each round (shipped), and how many there are."""
    rows = cut(integers(vectors, vec_id, embedding, scale).withColumn("no", F.monotonically_increasing_id()), "vectors")
    dim = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas().v
    c = centroids(matrix(list(some), dim).astype(float))
    block, most_lead = BLOCK, LEAD
    blocks = max(1, min(GROUP, (1 << 20) // (2 * block * dim)))
    chunk = max(64, min(CHUNK, (1 << 18) // (2 * dim)))

    def place(batches):
        for b in batches:
            x = matrix(b.column(2).to_pylist(), dim)
            yield pa.record_batch([*b.columns, pa.array(nearest(x.astype(float), c).astype(np.int32))], names=["no", "id", "v", "c"])

    def group(number, ids, nos, docs):
        highs, lows = _ranges(docs, block)
        first = np.minimum.reduceat(ids, np.arange(0, len(ids), block))
        return number, ids.tobytes(), nos.tobytes(), _pack(docs), _pack(highs), _pack(lows), first.tobytes()

    placed = cut(rows.select("no", "id", "v").mapInArrow(place, "no long, id long, v array<long>, c int"), "placed")
    groups = cut(_packed(placed, blocks * block, dim, group, GROUPS, GROUPS_DDL), "groups")
    chunks = cut(_packed(placed.where(F.col("id") % every == 0), chunk, dim, lambda number, ids, nos, q: (number, ids.tobytes(), nos.tobytes(), _pack(q)), CHUNKS, CHUNKS_DDL), "chunks")
    n_groups = groups.count()
    drop(rows, placed)
    tiles = max(1, -(-n_groups // TILE))
    tile = groups.select("g", "highs", "lows", "first_ids").groupBy(F.pmod(F.xxhash64("g"), F.lit(tiles)).cast("int").alias("tile")).agg(F.array_sort(F.collect_list(F.struct("g", "highs", "lows", "first_ids"))).alias("bounds"))

    def choose(first_round: bool):
        def run(batches):
            for b in batches:
                for one in b.to_pylist():
                    q, q_ids, q_nos, at = _unpack(one["q"], dim), _longs(one["ids"]), _longs(one["nos"]), np.arange(len(one["ids"]) // 8)
                    score, id_ = np.full(len(at), LOW), np.full(len(at), NONE)
                    for f in one["floors"] or ():
                        score[f["at"]], id_[f["at"]] = f["score"], f["vec_id"]
                    known = [(x["g"], _unpack(x["highs"], dim), _unpack(x["lows"], dim), _longs(x["first_ids"])) for x in one["bounds"]]
                    edges = np.cumsum([0, *(len(x[1]) for x in known)])
                    highs, lows, firsts = (np.concatenate([x[i] for x in known]) for i in (1, 2, 3))
                    live = np.empty((len(q), len(highs)), bool)
                    for lo in range(0, len(q), 256):
                        bound = bounds(q[lo : lo + 256], highs, lows)
                        lead = leading(bound, firsts, most_lead)
                        live[lo : lo + 256] = lead if first_round else ~lead & (bound >= score[lo : lo + 256, None])
                    for (g, *_), x, y in zip(known, edges, edges[1:]):
                        some = np.flatnonzero(live[:, x:y].any(1))
                        if len(some):
                            values = (g, one["c"], at[some].tobytes(), q_ids[some].tobytes(), q_nos[some].tobytes(), _pack(q[some]), score[some].tobytes(), id_[some].tobytes(), np.packbits(live[some, x:y], axis=1).tobytes())
                            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(values, PAIRS)], schema=PAIRS)

        return run

    def meet(batches):
        for b in batches:
            for one in b.to_pylist():
                at, q_ids, q_nos, ids, nos = (_longs(one[n]) for n in ("at", "q_ids", "q_nos", "ids", "nos"))
                highs = _unpack(one["highs"], dim)
                live = np.unpackbits(np.frombuffer(one["live"], np.uint8).reshape(len(at), -1), axis=1, count=len(highs)).astype(bool)
                best = Best(len(at), k, (_longs(one["score"]), _longs(one["id"])))
                search(best, q_nos, _unpack(one["q"], dim), ids, nos, _unpack(one["docs"], dim), highs, _unpack(one["lows"], dim), live, block)
                i, r = np.nonzero(best.real)
                if len(i):
                    yield pa.record_batch([pa.array(x) for x in (np.full(len(i), one["c"]), at[i], q_ids[i], best.id[i, r], best.score[i, r])], schema=HITS)

    def round_(asks: DataFrame, first_round: bool) -> DataFrame:
        dealt = asks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).join(tile, "tile").select("c", "ids", "nos", "q", "floors", "bounds")
        pairs = dealt.mapInArrow(choose(first_round), PAIRS_DDL)
        if told is not None:
            told.setdefault("shipped", []).append(pairs.count())
        met = pairs.join(groups.select("g", "ids", "nos", "docs", "highs", "lows"), "g")
        return met.mapInArrow(meet, HITS_DDL)

    best = F.row_number().over(W.partitionBy("c", "at").orderBy(F.col("score").desc(), "vec_id"))
    top = lambda hits: hits.withColumn("rank", best).where(F.col("rank") <= k)
    first = cut(top(round_(chunks.withColumn("floors", F.lit(None).cast("array<struct<at:long,vec_id:long,score:long>>")), True)), "first")
    floors = first.where(F.col("rank") == k).groupBy("c").agg(F.collect_list(F.struct("at", "vec_id", "score")).alias("floors"))
    second = round_(chunks.join(floors, "c", "left"), False)
    if told is not None:
        told["pairs"] = n_groups * chunks.count()
    return top(first.drop("rank").unionByName(second)).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.no, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.no <> c.no),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
