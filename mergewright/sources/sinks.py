"""Sinks and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.text import ingestion_hash

#: The columns of an exported clean dataset.
CLEAN_FIELDS = ["source", "source_label", "id", "entity_id", "record_id", "upload_id", "normalization_run_id", "clean_name", "first_name", "last_name", "clean_email", "clean_phone", "clean_tc", "clean_city", "clean_address", "clean_muhatap_no", "is_valid", "blocking_key", "created_at"]


def raw_rows(df: DataFrame, upload_id: int, order: list[str] | None = None) -> DataFrame:
    """Source rows as raw records: payload, hash, 1-based row_index in the order given (else that of the hash), status pending."""
    payload = F.map_from_entries(F.array(*(F.struct(F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns)))
    out = df.select(payload.alias("raw_payload"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or [])]).withColumn("ingestion_hash", ingestion_hash(F.col("raw_payload")))
    keys = [f"_o{i}" for i, _ in enumerate(order or [])] + ["ingestion_hash"]
    return number(out, keys, "row_index").select(F.lit(upload_id).cast("long").alias("upload_id"), F.lit(f"upload-{upload_id}").alias("batch_id"), "row_index", "raw_payload", "ingestion_hash", F.lit("pending").alias("row_status"))


def number(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """1-based numbers in the order of the keys without bringing all rows into one task: range-partitioned, numbered inside, and shifted by the partitions' counts."""
    from ..plans.tables import cut

    parts = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "number")
    counts = parts.groupBy("_part").count().withColumn("_before", F.sum("count").over(W.orderBy("_part")) - F.col("count")).select("_part", "_before")
    inner = F.row_number().over(W.partitionBy("_part").orderBy(*keys))
    return parts.withColumn("_in", inner).join(F.broadcast(counts), "_part").withColumn(name, (F.col("_before") + F.col("_in")).cast("int")).drop("_part", "_in", "_before")


def insert_new(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What of the new rows an insert that ignores known keys would append; of equal keys among the new, one."""
    return new.dropDuplicates(keys).join(current.select(*keys).distinct(), keys, "left_anti")


def new_pairs(pairs: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Candidates with left_id < right_id, without loops; of one pair in a run the first by `position`; without those already known."""
    p = pairs.where("left_id <> right_id").withColumns({"left_id": F.least("left_id", "right_id"), "right_id": F.greatest("left_id", "right_id")})
    first = F.row_number().over(W.partitionBy("detection_run_id", "left_id", "right_id").orderBy("position"))
    p = p.withColumn("_n", first).where("_n = 1").drop("_n")
    return p if current is None else p.join(current.select("detection_run_id", "left_id", "right_id"), ["detection_run_id", "left_id", "right_id"], "left_anti")


def duplicate_results(side_by_side: DataFrame) -> DataFrame:
    """The first engine's result table: L_ and R_ columns as left_ and right_, and the row as JSON."""
    names = {c: ("left_" if c.startswith("L_") else "right_") + c[2:].lower().replace(" ", "_") for c in side_by_side.columns if c[:2] in ("L_", "R_")}
    return side_by_side.withColumn("payload", F.to_json(F.struct(*[F.col(f"`{c}`") for c in side_by_side.columns]), {"ignoreNullFields": "false"})).withColumnsRenamed(names)


def csv_view(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Every value as text: null is empty, nested values are JSON; the fields given, missing ones empty."""
    kinds = {f.name: f.dataType for f in df.schema}
    one = lambda c: F.lit("") if c not in kinds else F.coalesce(F.to_json(f"`{c}`") if isinstance(kinds[c], (ArrayType, MapType, StructType)) else F.col(f"`{c}`").cast("string"), F.lit(""))
    return df.select(*(one(c).alias(c) for c in fields or df.columns))


def export_csv(df: DataFrame, path: str, fields: list[str] | None = None, single: bool = False, bom: bool = False) -> None:
    """With a header; single: one file, for results that a person downloads. An empty result gives one blank row. bom: names carry a mark for spreadsheet programs."""
    out = csv_view(df, fields)
    if out.isEmpty():
        out = df.sparkSession.range(1).select(*(F.lit("").alias(c) for c in out.columns))
    if bom:
        out = out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0])
    (out.coalesce(1) if single else out).write.mode("overwrite").options(header=True, emptyValue="").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def upsert_settings(current: DataFrame, new: dict[str, str], by: str) -> DataFrame:
    """key, value (JSON), updated_by with some keys set."""
    own = current.sparkSession.createDataFrame([(k, v, by) for k, v in new.items()], "key string, value string, updated_by string")
    return current.select("key", "value", "updated_by").join(own.select("key"), "key", "left_anti").unionByName(own)
