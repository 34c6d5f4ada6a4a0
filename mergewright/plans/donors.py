"""Donor records derived from the customer table, and the tables around them, for queries over the driver's data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocking import bare_pairs
from ..operators.groups import groups
from ..operators.normalize import normalize

#: Runs alike on Spark and DuckDB. Variant v = c_custkey % 5 says how a record is perturbed.
DONORS = """
WITH base AS (
  SELECT c_custkey AS rid, CAST(floor(c_custkey * 3 / 5) AS BIGINT) AS pid, c_custkey % 5 AS v FROM customer),
fn(i, first) AS (VALUES (0,'Ahmet'),(1,'Ayşe'),(2,'İbrahim'),(3,'Gül'),(4,'Çağrı'),(5,'Ömer'),(6,'Şule'),(7,'Işıl'),(8,'Mehmet'),(9,'Zehra'),(10,'Hasan'),(11,'Üzeyir')),
ln(j, last) AS (VALUES (0,'Yılmaz'),(1,'Öztürk'),(2,'Şahin'),(3,'Çelik'),(4,'Güneş'),(5,'Kaya'),(6,'Demir'),(7,'Ateş'),(8,'Bağış'),(9,'Aydın')),
p AS (
  SELECT b.rid, b.pid, b.v, fn.first, ln.last,
         CAST(5300000000 + (b.pid - CASE WHEN b.pid % 11 = 1 THEN 1 ELSE 0 END) * 7919 % 99999999 AS STRING) AS ph,
         CAST(10000000000 + b.pid * 9973 % 89999999999 AS STRING) AS id11
  FROM base b JOIN fn ON fn.i = b.pid % 12 JOIN ln ON ln.j = CAST(floor(b.pid / 12) AS BIGINT) % 10)
SELECT rid AS record_id, 1 + pid % 3 AS upload_id,
  CASE v WHEN 1 THEN last || ' ' || first WHEN 3 THEN '  ' || first || '  ' || last || 'h.' WHEN 4 THEN substr(first,1,1) || '. ' || last
         ELSE CASE WHEN rid % 97 = 0 THEN '' ELSE first || ' ' || last END END AS name,
  CASE WHEN v IN (1,4) THEN '' WHEN v = 3 THEN substr(id11,1,3) || ' ' || substr(id11,4) WHEN pid % 13 = 0 AND v = 2 THEN '99999999999' ELSE id11 END AS tc,
  CASE v WHEN 0 THEN '0' || ph WHEN 1 THEN '+90 ' || substr(ph,1,3) || ' ' || substr(ph,4) WHEN 3 THEN CASE WHEN pid % 3 = 0 THEN '' ELSE ph END ELSE ph END AS phone,
  CASE v WHEN 0 THEN 'U.' || CAST(pid AS STRING) || '@Gmail.com' WHEN 1 THEN 'u' || CAST(pid AS STRING) || '+bagis@gmail.com'
         WHEN 4 THEN '' ELSE 'u.' || CAST(pid AS STRING) || '@example.com' END AS email,
  CASE pid % 5 WHEN 0 THEN 'İstanbul' WHEN 1 THEN 'Ankara' WHEN 2 THEN 'İzmir' WHEN 3 THEN 'Çanakkale' ELSE 'Muğla' END AS city,
  CASE WHEN v = 4 THEN '' ELSE 'Atatürk Cad. No:' || CAST(pid % 40 AS STRING) || CASE WHEN v = 1 THEN ' Daire 2' ELSE '' END END AS address,
  CASE WHEN pid % 4 = 0 THEN 'm ' || CAST(pid AS STRING) ELSE 'M' || CAST(rid AS STRING) END AS muhatap_no
FROM p
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DONORS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer").select("c_custkey"))


def records(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """dealt: to as many tasks as there are, since a small file with many rows is read by one."""
    found = donors(spark, sf_dir)
    return normalize(found.repartition("record_id") if dealt else found)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by multi-pass blocking with made-up scores and decisions; created_at in seconds."""
    p = bare_pairs(records(spark, sf_dir))
    sum_ = F.col("left_id") + F.col("right_id")
    return p.select(
        (F.col("left_id") * 1000000 + F.col("right_id")).alias("id"), F.lit(1).cast("long").alias("detection_run_id"), "left_id", "right_id", ((F.col("left_id") * 7 + F.col("right_id") * 13) % 101 / 100.0).alias("score"),
        F.when(sum_ % 4 == 0, None).otherwise((F.col("left_id") * 3 + F.col("right_id")) % 97 / 96.0).alias("confidence"), F.when(sum_ % 3 == 0, "approved").when(sum_ % 3 == 1, "rejected").otherwise("pending").alias("decision"),
        (F.col("left_id") % 1000).alias("created_at"), (1 + F.col("left_id") % 3).alias("upload_id"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews from the event stream."""
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "click", "rejected").otherwise("pending")
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") % 50).alias("match_id"), said.alias("decision"), F.col("ts").alias("decided_at"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection and normalization runs from the orders."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), (F.col("o_custkey") % 20).alias("upload_id"), (k % 7).alias("job_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), (k % 100).alias("total_processed"), F.when(k % 9 == 0, None).otherwise(k % 90).alias("success_count"), (k % 10).alias("failed_count"), F.when(k % 8 == 0, None).otherwise(k % 30).alias("duplicate_group_count"), (k % 60).alias("affected_record_count"))


def approved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates(spark, sf_dir)
    return groups(found.where("decision = 'approved'"), by_decision=False).select("record_id", "group_id")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = approved_groups(spark, sf_dir)
    return m.select(F.col("group_id").alias("entity_id"), F.col("record_id").alias("normalized_record_id"), F.when(F.col("record_id") % 5 == 0, "pending").otherwise("confirmed").alias("status"))


def entities(members: DataFrame) -> DataFrame:
    """One for each group with made-up canonical values, some of them empty."""
    e = F.col("entity_id")
    return members.select("entity_id").distinct().select(e.alias("id"), F.when(e % 2 == 0, F.concat(F.lit("ENTITY "), e)).otherwise("").alias("canonical_name"), F.when(e % 3 == 0, F.lit("ISTANBUL")).alias("canonical_city"), F.concat(F.lit("E"), e).alias("canonical_muhatap_no"), e.alias("golden_record_id"))
