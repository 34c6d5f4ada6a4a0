"""New files as a stream: each batch is normalized, appended, and paired with what is known by blocking key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.normalize import normalize

KEYS = ("clean_tc", "clean_phone", "email_normalized_key")


def batch_pairs(new: DataFrame, known: DataFrame, keys=KEYS) -> DataFrame:
    """left_id < right_id of new records with known or new ones, by any of the keys."""
    out = None
    for k in keys:
        a = new.where(F.col(k) != "").select(F.col("record_id").alias("a"), F.col(k).alias("k"))
        b = known.where(F.col(k) != "").select(F.col("record_id").alias("b"), F.col(k).alias("k"))
        own = a.join(b, "k").where("a <> b").select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def watch(spark: SparkSession, source: str, schema: StructType, records_path: str, pairs_path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over the Parquet files that come into `source`. A batch writes under its own number, so a repeated batch replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        new = normalize(batch).withColumn("batch", F.lit(number))
        new.drop("batch").write.mode("overwrite").parquet(f"{records_path}/batch={number}")
        known = spark.read.parquet(records_path).where(F.col("batch") <= number)
        mine = known.where(F.col("batch") == number)
        batch_pairs(mine, known).write.mode("overwrite").parquet(f"{pairs_path}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
