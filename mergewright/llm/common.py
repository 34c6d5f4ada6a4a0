"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.tables import cut, drop, drop_since, shared_dir, shuffles_freed  # noqa: F401
from ..plans.tables import tables as cut_tables  # noqa: F401

#: What separates words in the contracts: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that Python holds as objects at a time.
BATCH_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names of an operator's own can't clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def fields(df: DataFrame, row: str = "row") -> list[Column]:
    """The columns of df from the struct that whole_row() made."""
    return [F.col(f"{row}.`{c}`").alias(c) for c in df.columns]


def map_rows(df: DataFrame, run) -> DataFrame:
    """mapInArrow() to the same columns, whatever their names: run sees them by position."""
    plain = [f"c{i}" for i in range(len(df.columns))]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(plain, df.schema)])
    return df.toDF(*plain).mapInArrow(run, schema).toDF(*df.columns)


def n_words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_tables: dict = {}
_last: list = [None]


def release(own=None) -> None:
    """Drops the tables that this worker process keeps for any other operator."""
    if others := [k for k in _tables if k != own]:
        for k in others:
            del _tables[k]
        gc.collect()  # they may hold cycles
    if _last != [own]:
        _last[:] = [own]
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)  # what others freed goes back to the system
        except (AttributeError, OSError):  # not every C library has it
            pass


def tables(key, make):
    """What a worker process keeps from task to task, for one operator at a time."""
    release(key)
    if key not in _tables:
        _tables[key] = make()
    return _tables[key]


def small_batches(batches, column: int, own=None):
    """Slices of record batches of about BATCH_BYTES of text. own: the key of the tables that the caller keeps."""
    release(own)
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            start = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, start + BATCH_BYTES)))
            yield b.slice(lo, hi - lo)
            lo = hi
