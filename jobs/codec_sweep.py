"""A sweep of value codecs over the matrices of shipments, which goes on where it was left and takes up what has changed.

    spark-submit jobs/codec_sweep.py --config jobs/codec_sweep.json --source lineitem.parquet --output out --marks state

Each year of shipping has four matrices of parts by suppliers, one for each measure. The sweep sizes and judges all codecs of
each, and says which one to take. Output is partitioned by year; a run evaluates the years that are new or whose lines are
not those of the mark, and replaces their partitions only. A mark (lines of a year, and two sums of their hashes) is
written once the output of its year stands, so a run that is cut short does the years without marks again, with the same result.

status: `empty` for a matrix without entries (one row, without codec), `pattern` where all magnitudes are equal, else `ok`. Lines
without a date are the year 0. Years whose lines are gone keep their output and their mark.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":  # as a script: the library lies beside this folder
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, replace_partitions, table_at
from mosaik.operators.evaluation import GATE, chosen, evaluated
from mosaik.queries.codecs import SHIPPED, evaluation_sql
from mosaik.sources.scratch import scratch
from mosaik.sources.tables import MEASURES, shipments

log = logging.getLogger("jobs.codec_sweep")

KEYS = ["year", "field"]
OUTPUT = (
    "field string, status string, nnz long, codec string, applicable boolean, exact boolean, payload_bits long, changed long, "
    "max_abs_error double, max_rel_error double, product_global_rel double, passes boolean, chosen boolean, year int"
)
MARKS = "lines long, low decimal(38,0), digest long, year int"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
_READ = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice")


def marks_of(lines: DataFrame) -> DataFrame:
    """A mark for each year of lines."""
    h = F.xxhash64(*[c for c in lines.columns if c != "year"])
    return lines.groupBy("year").agg(F.count("*").alias("lines"), F.sum(h.cast("decimal(38,0)")).cast("decimal(38,0)").alias("low"), F.bit_xor(h).alias("digest")).select("lines", "low", "digest", "year")


def sweep(lines: DataFrame, years: DataFrame, gate: float) -> DataFrame:
    """The report of the matrices of some years of lines; years: a row for each of these."""
    report = chosen(evaluated(shipments(lines), KEYS, gate), KEYS)
    flat = F.col("applicable") & F.col("codec").isin("all_one", "const_c", "sign2", "sign2_scale")
    status = report.groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS]).agg(F.when(F.bool_or(flat), "pattern").otherwise("ok").alias("status"))
    judged = report.join(status, [F.col(k) == F.col(f"_{k}") for k in KEYS])
    wanted = years.select("year", F.explode(F.array(*map(F.lit, MEASURES))).alias("field"))
    empty = wanted.join(report.select(*KEYS), KEYS, "left_anti").withColumn("status", F.lit("empty"))
    rows = judged.select(*_NAMES).unionByName(empty, allowMissingColumns=True)
    return rows.withColumn("nnz", F.coalesce("nnz", F.lit(0)))


def run(spark: SparkSession, source: str, output: str, marks: str, gate: float = GATE) -> list[int]:
    """Evaluate what is new or has changed in source; the years that were evaluated."""
    given = spark.read.parquet(source).select(*_READ)
    lines = given.withColumn("year", F.coalesce(F.year("l_shipdate"), F.lit(0)))
    now = marks_of(lines)
    todo = now.join(table_at(spark, marks, MARKS), ["year", "lines", "low", "digest"], "left_anti")
    new = todo.collect()  # a row for each year, of which dates have 9,999
    years = sorted(r.year for r in new)
    log.info("%s: read %d lines; years to do: %s", source, given.count(), years)
    if years:
        taken = spark.createDataFrame([tuple(r) for r in new], todo.schema).select(*[c.split()[0] for c in MARKS.replace("(38,0)", "").split(", ")])
        report = sweep(lines.filter(F.col("year").isin(years)), taken.select("year"), float(gate))
        # Some fifty short rows for each year.
        replace_partitions(report.select(*_NAMES).repartition("year"), output, "year")
        replace_partitions(taken.repartition("year"), marks, "year")
    wrote = table_at(spark, output, OUTPUT).filter(F.col("year").isin(years)).count()
    log.info("%s: wrote %d rows", output, wrote)
    return years


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on the line items of sf_dir, twice into one new folder; the second run finds nothing new."""
    path = scratch(spark, "codec-sweep")
    for _ in range(2):
        run(spark, f"{sf_dir}/lineitem.parquet", f"{path}/output", f"{path}/marks")
    errors = ("max_abs_error", "max_rel_error", "product_global_rel")
    return table_at(spark, f"{path}/output", OUTPUT).withColumns({c: F.round(c, 9) + 0 for c in errors})


SQL = f"""WITH {evaluation_sql(SHIPPED, 'year, field')},
k AS (SELECT year, field, CASE WHEN bool_or(applicable AND codec IN ('all_one', 'const_c', 'sign2', 'sign2_scale')) THEN 'pattern' ELSE 'ok' END AS status FROM report GROUP BY ALL),
n AS (SELECT * FROM (SELECT DISTINCT year FROM l), unnest(['quantity', 'discount', 'price', 'lines']) q(field))
SELECT year, field, coalesce(status, 'empty') AS status, coalesce(nnz, 0) AS nnz, codec, applicable, exact, payload_bits, changed, round(max_abs_error, 9) AS max_abs_error,
round(max_rel_error, 9) AS max_rel_error, round(product_global_rel, 9) AS product_global_rel, passes,
CASE WHEN status IS NOT NULL THEN passes AND codec = arg_min(codec, (payload_bits, codec)) FILTER (passes) OVER (PARTITION BY year, field) END AS chosen
FROM n LEFT JOIN report USING (year, field) LEFT JOIN k USING (year, field)"""

if __name__ == "__main__":
    main("codec_sweep", ("source", "output", "marks", "gate"), run)
