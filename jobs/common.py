"""What the jobs share: reading what may not be there yet, settings, and a session of the command line."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def table_at(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, without rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write df by partitions; those that it has rows of are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def main(name: str, settings: Sequence[str], run: Callable[..., object], argv: Sequence[str] | None = None) -> None:
    """The command line of a job: a JSON file of settings, each of which an option of the same name replaces."""
    parser = argparse.ArgumentParser(prog=name)
    parser.add_argument("--config", help="JSON file, on any file system that Spark reads")
    for s in settings:
        parser.add_argument(f"--{s}")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        own = spark.read.option("multiLine", True).json(given["config"]).first().asDict() if given["config"] else {}
        own |= {s: given[s] for s in settings if given[s] is not None}
        if unknown := sorted(set(own) - set(settings)):
            raise SystemExit(f"unknown settings: {unknown}")
        run(spark, **own)
    finally:
        spark.stop()
