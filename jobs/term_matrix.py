r"""Documents that arrive as files, to sparse matrices of terms in bitmap tiles.

    spark-submit jobs/term_matrix.py --config jobs/term_matrix.json --source 'in/*.parquet' --output out --checkpoint state

Each source of documents is a matrix: a row for each document, a column for each hash of a term, the number of times the term occurs
as value. A file stream takes the files that its checkpoint does not know and ends. Each batch writes two tables under output, by partitions that it alone owns:

    index/batch=N/              matrix, doc_id, row
    tiles/batch=N/matrix=M/     br, bc, bitmap, nnz, values: the 8 x 4 tiles of the batch

Rows are numbered on from those of the batches before, from a multiple of eight, so no tile spans two batches. A batch that a failure cut short is given again with the same files by
the checkpoint, sees only the batches before it, and replaces its own partitions with the same rows. A run without new files writes nothing.

A term is a word [^\x20\x09-\x0D]+ with A-Z in lower case; its column is the first 32 bits of its MD5 modulo `columns`. Rows of one doc_id and
source in a batch are one document. A document that a batch before holds is not taken again. Rows without doc_id cannot be named and are left out; their number is logged. A null source is
the matrix `none`, any other `source-` and its name. Documents without words have a row and no tiles.
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":  # as a script: the library lies beside this folder
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobs.common import main, replace_partitions, table_at
from mosaik.operators.order import digits, running
from mosaik.operators.tiles import BC, BR, counted, decoded
from mosaik.sources.scratch import scratch

log = logging.getLogger("jobs.term_matrix")

COLUMNS = 1 << 18
#: Fixed value: bytes of text whose words a task counts.
TASK_BYTES = 1 << 22
#: Bits of a term's count in a block row of at most LARGE bytes; a word takes two bytes, with what parts it from the next.
COUNT_BITS = 20
LARGE = (2 << COUNT_BITS) - 2
#: Documents whose ids are sent to all tasks by block rows, some 25 bytes each.
SENT = 1 << 22
INDEX = "matrix string, doc_id long, row long, batch long"
TILES = "br long, bc long, bitmap long, nnz long, values array<double>, batch long, matrix string"
_UP = "".join(map(chr, range(65, 91)))


def _matrix() -> Column:
    return F.coalesce(F.concat(F.lit("source-"), F.col("source").cast("string")), F.lit("none"))


def _documents(batch: DataFrame) -> DataFrame:
    return batch.filter("doc_id IS NOT NULL").select(_matrix().alias("matrix"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def numbered(ids: DataFrame, earlier: DataFrame) -> DataFrame:
    """(matrix, doc_id, row) of documents that earlier does not hold, by doc_id, after its rows."""
    new = ids.distinct().join(earlier.select("matrix", "doc_id"), ["matrix", "doc_id"], "left_anti")
    begin = earlier.groupBy(F.col("matrix").alias("of")).agg(((F.expr(f"max(row) DIV {BR}") + 1) * BR).alias("begin"))
    placed = running(new, digits("doc_id"), "place", group=("matrix",))
    # A row of begin for each source: Spark broadcasts it where it is small, and else splits the hot ones.
    return placed.join(begin, F.col("matrix") == F.col("of"), "left").select("matrix", "doc_id", (F.col("place") + F.coalesce("begin", F.lit(0))).alias("row"))


def places(docs: DataFrame, columns: int) -> DataFrame:
    """(matrix, br, bc, row, col) of each word of (matrix, br, row, text)."""
    text = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(F.translate("text", _UP, _UP.lower()))
    each = docs.select("matrix", "br", "row", F.explode(F.split(text, r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    col = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 8), 16, 10).cast("long") % columns
    return each.select("matrix", "br", "row", col.alias("col")).withColumn("bc", F.expr(f"col DIV {BC}"))


def tiles_of(docs: DataFrame, columns: int) -> DataFrame:
    """The tiles of (matrix, row, text): texts are dealt by block row, so that words are counted where they are split and never move themselves. The words of
    block rows of more than LARGE bytes are counted first and moved then, so that they spread over tasks; a smaller one has no term 2^COUNT_BITS times."""
    docs = docs.withColumn("br", F.expr(f"row DIV {BR}"))
    sizes = docs.groupBy("matrix", "br").agg(F.sum(F.octet_length("text") + F.lit(1).cast("long")).alias("size"))
    total, most = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    large, keys = sizes.filter(F.col("size") > LARGE).select("matrix", "br"), ["matrix", "br"]
    small = docs if most <= LARGE else docs.join(large, keys, "left_anti")
    tiles = counted(places(small.repartition(1 + total // TASK_BYTES, *keys), columns), COUNT_BITS, ("matrix",))
    if most <= LARGE:
        return tiles
    return tiles.unionAll(counted(places(docs.join(large, keys, "left_semi"), columns), keys=("matrix",)))


def take(batch: DataFrame, number: int, output: str, columns: int) -> None:
    """Write the index and the tiles of one batch."""
    spark = batch.sparkSession
    given, nameless = batch.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    docs = _documents(batch)
    earlier = table_at(spark, f"{output}/index", INDEX).filter(F.col("batch") < number)
    new = numbered(docs.select("matrix", "doc_id"), earlier).withColumn("batch", F.lit(number).cast("long"))
    replace_partitions(new, f"{output}/index", "batch")
    index = table_at(spark, f"{output}/index", INDEX).filter(F.col("batch") == number).drop("batch")
    tiles = tiles_of(docs.join(index, ["matrix", "doc_id"]).select("matrix", "row", "text"), columns).withColumn("batch", F.lit(number).cast("long"))
    replace_partitions(tiles.select(*[c.split()[0] for c in TILES.split(", ")]), f"{output}/tiles", "batch", "matrix")
    wrote = table_at(spark, f"{output}/tiles", TILES).filter(F.col("batch") == number).agg(F.count("*"), F.sum("nnz")).first()
    log.info("batch %d: read %d rows, %d without doc_id; wrote %d documents, %d tiles, %d entries", number, given, nameless, index.count(), wrote[0], wrote[1] or 0)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, columns: int = COLUMNS, files_per_batch: int = 1000) -> None:
    """Take the files of source (a folder or a pattern of Parquet files) that the checkpoint does not know yet."""
    columns, files = int(columns), int(files_per_batch)
    schema = spark.read.parquet(source).schema
    stream = (
        spark.readStream.schema(StructType([schema[c] for c in ("doc_id", "source", "text")]))
        .option("maxFilesPerTrigger", files)
        .option("maxFileAge", "36500d")  # a file is new because the checkpoint does not know it, whatever its age
        .parquet(source)
    )
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, output, columns))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    log.info("%s: %d batches", source, sum(1 for p in query.recentProgress if p["numInputRows"]))


def read(spark: SparkSession, output: str) -> DataFrame:
    """(matrix, doc_id, row, col, value): the entries of all tiles, with the documents of their rows."""
    index = table_at(spark, f"{output}/index", INDEX)
    ids = F.array(*[F.max(F.when(F.col("row") % BR == k, F.col("doc_id"))) for k in range(BR)])
    blocks = index.groupBy("matrix", F.expr(f"row DIV {BR}").alias("br")).agg(ids.alias("ids"))
    tiles = table_at(spark, f"{output}/tiles", TILES).join(F.broadcast(blocks) if index.count() <= SENT else blocks, ["matrix", "br"])
    return decoded(tiles, keys=("matrix", "ids")).select("matrix", F.get("ids", (F.col("row") % BR).cast("int")).alias("doc_id"), "row", "col", "value")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on the documents of sf_dir, twice into one new folder; the second run finds nothing new."""
    path = scratch(spark, "term-matrix")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet*", f"{path}/output", f"{path}/checkpoint")
    return read(spark, f"{path}/output")


SQL = rf"""WITH d AS (SELECT coalesce('source-' || source, 'none') AS matrix, doc_id, text FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT matrix, doc_id, row_number() OVER (PARTITION BY matrix ORDER BY doc_id) - 1 AS "row" FROM (SELECT DISTINCT matrix, doc_id FROM d)),
w AS (SELECT matrix, doc_id, unnest(string_split_regex(translate(text, '{_UP}', '{_UP.lower()}'), '[\x20\x09-\x0D]+')) AS word FROM d),
t AS (SELECT matrix, doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {COLUMNS} AS col, CAST(count(*) AS DOUBLE) AS value FROM w WHERE word <> '' GROUP BY ALL)
SELECT matrix, doc_id, "row", col, value FROM t JOIN i USING (matrix, doc_id)"""

if __name__ == "__main__":
    main("term_matrix", ("source", "output", "checkpoint", "columns", "files_per_batch"), run)
