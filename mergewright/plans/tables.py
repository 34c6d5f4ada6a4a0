"""Tables written to end a lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder. Where neither is set, a folder of
    our own in local mode, as in tests; on a cluster RuntimeError, since a machine's own folder would lose rows there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif context.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="mergewright-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut", compression: str | None = None) -> DataFrame:
    """Writes df in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query ends, not once the driver happens to collect its garbage. A frame made in here that is run
    more than once shuffles each time."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that cut() returned, once nothing will read them again; other frames are left alone."""
    for df in frames:
        _delete(df.__dict__.get("_cut_path", ""))


def tables() -> set[str]:
    """The tables written and not deleted yet, for drop_since()."""
    return set(_written)


def drop_since(before: set[str], *but: DataFrame) -> None:
    """Deletes the tables written after `before` was taken, but for those behind the frames given."""
    keep = before | {df.__dict__.get("_cut_path", "") for df in but}
    for path in [p for p in _written if p not in keep]:
        _delete(path)


def _sweep() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session is gone; its folder goes with it
            return


atexit.register(_sweep)
