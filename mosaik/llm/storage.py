"""Where intermediate tables go: only ever a folder that every executor shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where the setting is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="mosaik-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    base = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Of the actions inside, shuffle files go when each action ends, instead of at some later collection, and
    Python workers get texts in small record batches, of which several copies are held."""
    own = {_CLEANUP: "true", _RECORDS: "1000"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_paths: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def clear() -> None:
    """Delete every intermediate table of this process that is still there; results that read them end here."""
    while _paths:
        spark, path = _paths.pop()
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table of this process: dropped() or clear() deletes it, and so does the end of the process."""
    path = f"{shared_dir(spark)}/mosaik/{name}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, as a Parquet table in the shared folder; its lineage is cut there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, name)
