"""Sharding by extendible hashing (DataFrame operations only).

A document's key hashes to 60 bits. A shard is all documents whose hash begins with its bits; the directory maps prefixes
to shards. All documents begin as one shard of no bits; only shards over the limit split on another bit, so that several entries of the directory lead to one
shard elsewhere. The directory is summed once at the depth at which even hashing would fill shards to half their limit (partial sums before
the shuffle), and the shards of every depth up to there follow from it by summing upwards; documents of entries that are over the limit still go on, STEP
bits further a round.

Rows that share all they are hashed by can't be told apart by any number of bits. For keys that are null or occur more than once (found by a count first, and
joined in SALT parts) the hash covers the whole row, and exact copies of a row, counted before the shuffle, are numbered, in runs of COPIES where they are many.

Defined results: null keys hash as the empty string; null text has 0 bytes; a document larger than the limit gets a shard of
its own with fits = false; very long texts count whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

BITS = 60
STEP = 8
SALT, COPIES = 8, 10_000
LIMIT = 1 << 20


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_bytes, h: 60 bits, as a long."""
    bits = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("\u0001", *c)), 1, BITS // 4), 16, 10).cast("long")
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), k.alias("k"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    base = cut(base, "shard")
    again = base.where(F.col("key").isNotNull()).groupBy("k").count().where("count > 1").select(F.col("k").alias("k2"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s2"))
    salted = base.where(F.col("key").isNotNull()).withColumn("s", F.pmod(F.xxhash64("t", "n_bytes"), F.lit(SALT)).cast("int"))
    marked = salted.join(again, (F.col("k") == F.col("k2")) & (F.col("s") == F.col("s2")), "left")
    single = marked.where("k2 is null").select("key", "n_bytes", bits("k").alias("h"))
    copies = marked.where("k2 is not null").select("key", "k", "n_bytes", "t").unionByName(base.where(F.col("key").isNull()).select("key", "k", "n_bytes", "t")).groupBy("key", "k", "n_bytes", "t").count()
    runs = copies.withColumn("run", F.explode(F.expr(f"sequence(0L, count - 1, {COPIES}L)"))).repartition("t", "run")
    copies = runs.withColumn("no", F.explode(F.expr(f"sequence(run + 1, least(run + {COPIES}L, count))"))).select("key", "n_bytes", bits("k", "t", F.col("no").cast("string")).alias("h"))
    return single.unionByName(copies)


def shard(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> key, n_bytes, shard (its bits as a string of 0 and 1), depth, shard_bytes, shard_docs, fits."""
    if limit < 1:
        raise ValueError("limit must be 1 byte or more")
    rows = cut(hashed(docs, key, text), "hashed")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS - STEP, max(0, math.ceil(math.log2(max(1, 2 * total / limit)))))
    low, high, left, done = 0, depth, rows, []
    while True:
        left = left.withColumn("entry", F.shiftright("h", BITS - high))
        sums = cut(left.groupBy("entry").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")), "directory")
        ancestors = lambda first: sums.withColumn("d", F.explode(F.sequence(F.lit(first), F.lit(high)))).withColumn("p", F.expr(f"shiftright(entry, {high} - d)"))  # noqa: B023, E731
        nodes = ancestors(low).groupBy("d", "p").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")).withColumnsRenamed({"d": "depth", "p": "prefix"})
        nodes = cut(nodes.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS)), "nodes")
        top = nodes.agg(F.min("depth")).first()[0]  # above it nothing fits, and few entries share an ancestor there
        found = ancestors(high if top is None else top).join(nodes, (F.col("d") == F.col("depth")) & (F.col("p") == F.col("prefix")))
        found = found.groupBy("entry").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("to"))
        here = left.join(found, "entry", "left")
        done.append(here.where("to is not null").select(F.col("key").alias(key), "n_bytes", F.expr("right(lpad(bin(to.prefix), 64, '0'), to.depth)").alias("shard"), F.col("to.depth").alias("depth"), F.col("to.shard_bytes").alias("shard_bytes"), F.col("to.shard_docs").alias("shard_docs"), (F.col("to.shard_bytes") <= limit).alias("fits")))
        over = sums.where((F.col("bytes") > limit) & (F.col("docs") > 1))
        if high == BITS or not over.take(1):
            break
        low, left = high + 1, left.join(over.select("entry"), "entry", "left_semi")
        high = min(BITS, high + STEP)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH b AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
h AS (SELECT doc_id, n_bytes, CAST('0x' || substr(md5(k), 1, 15) AS BIGINT) AS h FROM b),
n AS (SELECT h.*, d.depth, h.h >> ({BITS} - d.depth) AS prefix FROM h, (SELECT CAST(unnest(range(0, {BITS} + 1)) AS INT) AS depth) d),
s AS (SELECT doc_id, n_bytes, depth, prefix, CAST(sum(n_bytes) OVER w AS BIGINT) AS shard_bytes, count(*) OVER w AS shard_docs FROM n WINDOW w AS (PARTITION BY depth, prefix)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS i FROM s WHERE shard_bytes <= {LIMIT} OR shard_docs = 1 OR depth = {BITS})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(CAST(CAST(prefix AS BIT) AS VARCHAR), 64, '0'), depth) END AS shard, depth, shard_bytes, shard_docs, shard_bytes <= {LIMIT} AS fits FROM f WHERE i = 1
"""
