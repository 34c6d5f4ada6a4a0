"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

PERMUTATIONS hash functions give twice as many signature values: of each, the minimum and the maximum over the set; both are unbiased
samples of the similarity. Values are banded, rows per band as many as leave a pair at the threshold a chance under MISS of sharing
no band. Documents with the same set are one class from the start, found by a digest of the set.

Inside a bucket no pairs are emitted at large. First every member is paired with the bucket's smallest and largest member (two aggregates and a join);
confirmed pairs give components. Then only members of different components are compared, block by block of a bucket, on sizes and on a 128-bit
sketch of their signatures (a bound 6 standard deviations wide, so it loses nothing), each pair in the first bucket it shares, and what passes is confirmed
on its sets; out come edges that join components. A link that isn't checked is one inside a component.

Defined results: null, empty and wordless texts have 0 shingles and are linked with nothing; rows with a null id are linked with nothing
and have a null component; rows that share an id are documents of their own, and components may then share their number, the smallest id; equal
texts are linked, and one of equal rows with words is kept; very long texts are read whole; an empty table gives no rows; other columns are ignored
(deduplicate() keeps them, whatever their names).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import cut, fields, partitions, read, small_batches, whole_row
from .shingles import mix, shingle_sets

PERMUTATIONS = 64
MISS = 1e-6


def rows_per_band(threshold: float) -> int:
    n = 2 * PERMUTATIONS
    return max([r for r in range(1, 17) if (1 - threshold**r) ** (n // r) < MISS], default=1)


_random = np.random.default_rng(20240229)
_A = _random.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each hash function, as 32-bit values: first all minima, then all maxima."""
    low = np.full(PERMUTATIONS, (1 << 32) - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(hashes), 4096):
        values = (hashes[i : i + 4096, None] * _A + _B) >> np.uint64(32)
        np.minimum(low, values.min(0), out=low)
        np.maximum(high, values.max(0), out=high)
    return np.concatenate([low, high])


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    n = len(sig) // rows
    out = np.arange(n, dtype=np.uint64)
    for i in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[i * n : (i + 1) * n])
    return out.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """One bit of each value, as two longs."""
    return np.packbits((mix(sig) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def signed(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, set_key (null without shingles), bands, s1, s2."""
    rows = rows_per_band(threshold)

    def run(batches):
        for b in small_batches(batches, 1):
            keys, all_bands, sketches, sizes = [], [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), k):
                sizes.append(len(s))
                if len(s):
                    sig = signature(s)
                    keys.append(hashlib.md5(s.tobytes()).digest())
                    all_bands.append(bands(sig, rows))
                    sketches.append(sketch(sig))
                else:
                    keys.append(None)
                    all_bands.append(None)
                    sketches.append((None, None))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(all_bands, pa.list_(pa.int64())), pa.array([x[0] for x in sketches], pa.int64()), pa.array([x[1] for x in sketches], pa.int64())], names=["doc_id", "n_shingles", "set_key", "bands", "s1", "s2"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, s1 long, s2 long")


def sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for b in small_batches(batches, 1):
            yield pa.record_batch([b.column(0), pa.array([s.view(np.int64) for s in shingle_sets(b.column(1).to_pylist(), k)], pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "id long, shingles array<long>")


SALT, HUBS = 64, 10_000


def attach(pairs: DataFrame, own: DataFrame, side: str, n_pairs: int) -> DataFrame:
    """Pairs with the shingles of one side. An id in very many pairs is a hub; there are HUBS of them at most, so their table can be broadcast. A hub's
    pairs are dealt out by the hash of their other side, and its shingles are sent to each part."""
    much = max(1024, -(-n_pairs // HUBS))
    other = "b" if side == "a" else "a"
    hubs = pairs.groupBy(side).count().where(F.col("count") > much).select(F.col(side).alias("hub"), F.ceil(F.col("count") / much).cast("int").alias("parts"))
    dealt = pairs.join(F.broadcast(hubs), F.col(side) == F.col("hub"), "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("hub", "parts")
    sent = own.join(F.broadcast(hubs), F.col("id") == F.col("hub"), "left")
    sent = sent.select(F.col("id").alias(side), F.col("shingles").alias(f"s{side}"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return dealt.join(sent, [side, "part"]).drop("part")


def confirm(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a table that cut() returned) whose full sets are alike enough; own: id, shingles of every document in a pair."""
    n = pairs.count()
    both = attach(attach(pairs, own, "b", n), own, "a", n)
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    return both.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


MEMBERS, SHINGLES = 1024, 200_000
SIGN = ["doc_id", "n_shingles", "bands", "s1", "s2", "root"]


def blocked(rows: DataFrame) -> DataFrame:
    """Rows (bucket, ...) -> one for each pair of blocks (i <= j) of its bucket that a row takes part in. A block has about MEMBERS rows and SHINGLES shingles at most."""
    size = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n_shingles") / SHINGLES)).cast("int")
    parts = rows.groupBy("bucket").agg(size.alias("parts"))
    out = rows.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    return out.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts").repartition(4 * partitions(rows.sparkSession), "bucket", "i", "j")


def near_pairs(pdf: pd.DataFrame, percent: int):
    """Row numbers (x, y) and distances, nearest first, of a block pair's pairs in different components whose sizes and sketches allow the
    threshold, each pair only in the first bucket that it shares."""
    equal = (1 + percent / 100) / 2
    most = int(128 * (1 - equal + 6 * (equal * (1 - equal) / 128) ** 0.5))
    n, root, part = pdf.n_shingles.to_numpy(), pdf.root.to_numpy(), pdf.part.to_numpy()
    s1, s2 = pdf.s1.to_numpy().view(np.uint64), pdf.s2.to_numpy().view(np.uint64)
    table = np.stack(pdf.bands.to_numpy())
    same_block = pdf.i.iloc[0] == pdf.j.iloc[0]
    bucket, found = pdf.bucket.iloc[0], []
    for lo in range(0, len(pdf), 256):
        hi = min(lo + 256, len(pdf))
        far = np.bitwise_count(s1[lo:hi, None] ^ s1).astype(np.int16) + np.bitwise_count(s2[lo:hi, None] ^ s2)
        ok = (far <= most) & (root[lo:hi, None] != root) & (np.arange(lo, hi)[:, None] < np.arange(len(pdf)))
        ok &= 100 * np.minimum(n[lo:hi, None], n) >= percent * np.maximum(n[lo:hi, None], n)
        if not same_block:
            ok &= part[lo:hi, None] != part
        x, y = np.nonzero(ok)
        for c in range(0, len(x), 1 << 16):
            p, q = x[c : c + (1 << 16)] + lo, y[c : c + (1 << 16)]
            here = table[p, np.argmax(table[p] == table[q], axis=1)] == bucket
            found.append((p[here], q[here], far[x[c : c + (1 << 16)], q][here]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    x, y, d = (np.concatenate(z) for z in zip(*found))
    order = np.argsort(d, kind="stable")
    return x[order], y[order]


def confirm_pairs(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges that join the components of a block pair's rows as all its links would."""
    x, y = near_pairs(pdf, percent)
    roots = pdf.root.to_numpy()
    up = {r: r for r in roots}

    def top(r):
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    held: dict[int, set] = {}
    ids, shingles, out = pdf.doc_id.to_numpy(), pdf.shingles.to_numpy(), []
    for p, q in zip(x.tolist(), y.tolist()):
        a, b = top(roots[p]), top(roots[q])
        if a == b:
            continue
        for k in (p, q):
            if k not in held:
                held[k] = set(shingles[k].tolist())
        common = len(held[p] & held[q])
        if 100 * common >= percent * (len(held[p]) + len(held[q]) - common):
            up[max(a, b)] = min(a, b)
            out.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def across(members: DataFrame, root: DataFrame, signs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket in different components. Their number may grow with a bucket's square, so blocks of a bucket meet in Python and only
    edges that join components come out; sets are sent for members only that have a partner to be checked."""
    known = members.select("bucket", "doc_id").join(root.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = known.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("bucket")
    left = cut(known.join(mixed, "bucket", "left_semi").join(signs, "doc_id").select("bucket", *SIGN), "mixed")

    def flagged(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = near_pairs(pdf, percent)
        return pdf.iloc[np.union1d(x, y).astype(int)][["bucket", "doc_id"]]

    some = cut(blocked(left).groupBy("bucket", "i", "j").applyInPandas(flagged, "bucket long, doc_id long").distinct(), "flagged")
    rows = left.join(some, ["bucket", "doc_id"], "left_semi").join(own.withColumnRenamed("id", "doc_id"), "doc_id")
    return blocked(rows).groupBy("bucket", "i", "j").applyInPandas(lambda pdf: confirm_pairs(pdf, percent), "a long, b long").distinct()


def links(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and edges (a, b) that connect exactly the documents that links at the threshold connect."""
    threshold = percent / 100
    one = cut(signed(docs, k, threshold), "signed")
    known = one.where("set_key is not null and doc_id is not null")
    sign = F.struct("n_shingles", "bands", "s1", "s2")
    classes = cut(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by(sign, "doc_id").alias("sign"), F.count("*").alias("copies")), "classes")
    signs = classes.select(F.col("rep").alias("doc_id"), "sign.*")
    reps = signs.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = reps.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    members = cut(reps.join(buckets, "bucket"), "members")
    stars = members.select(F.col("doc_id"), F.explode(F.array("lo", "hi")).alias("c"))
    stars = stars.select(F.least("doc_id", "c").alias("a"), F.greatest("doc_id", "c").alias("b")).where("a < b").distinct()
    stars = cut(stars, "stars")
    wanted = members.select("doc_id").distinct()
    text = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").join(wanted, "doc_id", "left_semi")
    own = cut(sets(text, k), "sets")
    first = cut(confirm(stars, own, percent).distinct(), "first")
    root = connected_components(first, "a", "b", cut)
    second = across(members, root, signs, own, percent)
    return one, cut(first.unionByName(second), "links").unionByName(copied(known, classes))


def copied(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) that join the documents of one set. A class is first joined in SALT parts by hash of the id, so that no task gets a large one whole."""
    salted = known.select("set_key", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt"))
    subs = cut(salted.groupBy("set_key", "salt").agg(F.min("doc_id").alias("sub"), F.count("*").alias("n")), "subs")
    inside = salted.join(subs.where("n > 1").drop("n"), ["set_key", "salt"]).select(F.col("sub").alias("a"), F.col("doc_id").alias("b"))
    between = subs.join(classes.where("copies > 1").select("set_key", "rep"), "set_key").select(F.col("rep").alias("a"), F.col("sub").alias("b"))
    return inside.unionByName(between).where("a < b")


def has_copies(docs: DataFrame) -> bool:
    """Whether any id that isn't null stands in more than one row."""
    return not docs.selectExpr("cast(doc_id as bigint) doc_id").groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty()


def linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of each row, ids being unique."""
    one, edges = links(docs, k, percent)
    root = connected_components(edges, "a", "b", cut)
    return one.join(root, F.col("doc_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("root", "doc_id")).select("doc_id", "n_shingles", "component_id")


def nodes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text, copies, n_shingles, component_id, least (of its component, by id and text) of each different pair of an id that isn't null and a text:
    every pair has a number, by which it is linked. A pair with equal rows is least or not as they all are."""
    own = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null").groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    own = cut(own.withColumn("no", F.monotonically_increasing_id()), "nodes")
    found = linked(own.select(F.col("no").alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("no"), "n_shingles", F.col("component_id").alias("root"))
    ranks = cut(own.select("no", "doc_id", F.md5("text").alias("digest")).join(found, "no"), "ranks")
    first = ranks.groupBy("root").agg(F.min(F.struct("doc_id", "digest", "no")).alias("first"))
    ranks = ranks.join(first, "root").select("no", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("no") == F.col("first.no")).alias("least"))
    return cut(own.join(ranks, "no").drop("no"), "known")


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    if not has_copies(docs):
        return linked(docs, k, percent).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    known = nodes(docs, k, percent).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    known = known.select("doc_id", "n_shingles", "component_id", (F.col("least") & ((F.col("n_shingles") == 0) | (F.col("copy") == 1))).alias("kept"))
    lone = signed(docs.where("doc_id is null"), k, percent / 100).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return known.unionByName(lone)


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest of their component, with all columns; of rows that share their id and text the least stays."""
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"))
    if not has_copies(docs):
        gone = components(docs, k, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
        return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select(*fields(docs))
    rows = rows.withColumn("digest", F.md5("row.text"))
    known = nodes(docs, k, percent).select(F.col("doc_id").alias("k_id"), F.md5("text").alias("k_digest"), "copies", "n_shingles", "least")
    same = (F.col("id") == F.col("k_id")) & (F.col("digest") == F.col("k_digest"))
    again = known.where("least and copies > 1 and n_shingles > 0")
    single = rows.join(known.where("not least").unionByName(again), same, "left_anti").select("row")
    least = rows.join(again, same, "left_semi").groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(least).select(*fields(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"), 3, 85)
