"""Result tables, matrix lists and tool output as DataFrames, and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def result_csv(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of all shards under path, all columns strings, with the file of each and its folder; summary files are left out."""
    rows = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    parts = F.split(F.input_file_name(), "/")
    rows = rows.withColumn("file", F.element_at(parts, -1)).withColumn("folder", F.element_at(parts, -2))
    return rows.filter(~F.col("file").contains(".summary."))


def matrix_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a list file; blank lines and those that begin with # are skipped."""
    return listed(spark.read.text(path).select(F.trim("value").alias("path")))


def sampled(paths: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """That share of a list, by a hash of the path: reruns and any order of lines give the same ones."""
    return paths.filter(F.pmod(F.xxhash64("path", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def first_paths(paths: DataFrame, n: int) -> DataFrame:
    """The first n paths, by name."""
    return paths.orderBy("path").limit(n)


def matching(paths: DataFrame, pattern: str) -> DataFrame:
    return paths.filter(F.col("path").rlike(pattern))


def basename(path: Column) -> Column:
    """The name of a matrix: the last part of its path without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.mtx(\.gz)?$", "")


def shard_of(file: Column) -> Column:
    """The number in the name of a shard's file, null if there is none."""
    return F.regexp_extract(file, r"shard_?(\d+)", 1).try_cast("int")


def listed(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("path") != "") & ~F.col("path").startswith("#"))


def report_value(text: Column, key: str) -> Column:
    """The value of a `key: value` line of a tool's output, null if absent."""
    found = F.regexp_extract(text, rf"(?m)^{key}:[ \t]*(.*)$", 1)
    return F.when(found == "", None).otherwise(found)


def setting(text: Column, key: str) -> Column:
    """The number of a `key=value` pair of a tool's output, null if absent or not a number."""
    return F.regexp_extract(text, rf"(?:^|[\s,;]){key}=([^\s,;]+)", 1).try_cast("double")


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)
