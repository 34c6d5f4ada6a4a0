"""Bounded samples of labelled rows, for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(parts: int) -> Column:
    """The remainder of crc32(doc_id as text); a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: dict[int, int]) -> DataFrame:
    """doc_id, text, y of labelled documents outside the held-out fold: of each class at most `most` rows, those whose ids hash lowest.
    Rows with a null id, label or text don't count; an id with both labels doesn't either."""
    known = labels.where(F.col(label).isin(*most) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    known = known.where(fold(parts) != held).withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    picked = None
    for k, n in most.items():
        own = known.where(F.col("y") == k).orderBy("h", "doc_id").limit(n).select(F.col("doc_id").alias("id"), F.col("y").cast("int").alias("y"))
        picked = own if picked is None else picked.unionByName(own)
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")
