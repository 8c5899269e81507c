"""The corpus pipeline: documents to shards, by five operators of mosaik.llm in a row.

Each stage is written as Parquet and read again as the documents of the next one, so a stage that fails is
done again from what the one before has left, and no stage carries the lineage of another.

Defined results. Quality rules: null and empty texts and those without words go; rows that repeat get equal verdicts. Near
dedup: of rows that repeat, or differ in doc_id only, one stays, a row without doc_id only where no other is. Decontamination: a row is
judged by its own text, whatever its doc_id. Mixing: a null source is a source; a row gives up to three rows. Sharding: texts that are equal
share a shard. Long texts are taken whole. The first four stages keep the columns they are given, whatever their names, and the last adds
shard and slot, replacing columns so named. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaik.llm import decontaminate, mixing, near_copies, quality, sharding
from mosaik.llm.storage import new_path, shuffles_dropped


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail them."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_copies.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights, as documents."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and place in it."""
    return sharding.sharded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Fingerprints and seeded permutations have no SQL form; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        with shuffles_dropped(spark):
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
