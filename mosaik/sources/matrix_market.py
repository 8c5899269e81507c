"""MatrixMarket coordinate files as matrices, read and checked by Spark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..operators import coo

FIELDS = ("real", "integer", "pattern")
SYMMETRIES = ("general", "symmetric", "skew-symmetric")


@dataclass(frozen=True)
class Header:
    field: str
    symmetry: str
    rows: int
    cols: int
    stored: int
    lines: int  # of the header, the size line included


@dataclass(frozen=True)
class Loaded:
    matrix: Matrix
    header: Header
    stored_entries: int
    expanded_entries: int
    coalesced_duplicates: int


def _is_comment(line: str) -> bool:
    return not line or line[0] == "%"


def parse_header(lines: list[str]) -> Header:
    """Banner and size line; raises ValueError for what is not supported."""
    words = (lines[0] if lines else "").lower().split()
    if len(words) != 5 or words[0] != "%%matrixmarket":
        raise ValueError("not a MatrixMarket file")
    _, thing, form, field, symmetry = words
    if thing != "matrix" or form != "coordinate":
        raise ValueError(f"only coordinate matrices are supported, not {thing} {form}")
    if field not in FIELDS or symmetry not in SYMMETRIES:
        raise ValueError(f"unsupported field or symmetry: {field} {symmetry}")
    if field == "pattern" and symmetry == "skew-symmetric":
        raise ValueError("a pattern matrix cannot be skew-symmetric")
    for k, line in enumerate(lines[1:], 1):
        if not _is_comment(line):
            try:
                rows, cols, stored = map(int, line.split())
            except ValueError:
                raise ValueError(f"bad size line: {line!r}") from None
            if min(rows, cols, stored) < 0:
                raise ValueError(f"bad size line: {line!r}")
            return Header(field, symmetry, rows, cols, stored, k + 1)
    raise ValueError("no size line")


def head_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a file up to its size line, however many comments there are; compressed files are read by their suffix."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return []
    # Names come as URIs.
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0]))
    stream = at.getFileSystem(conf).open(at)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        out: list[str] = []
        while (line := reader.readLine()) is not None:
            out.append(line)
            if len(out) > 1 and not _is_comment(line):
                break
        return out
    finally:
        reader.close()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line): lines with their place, by file, beginning of the split and row of its partition. Splits are read as Spark cuts
    them; nothing is numbered."""
    text = spark.read.option("lineSep", "\n").text(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return text.select(at.alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))


def parse_entries(lines: DataFrame, header: Header) -> DataFrame:
    """(row, col, value) of entry lines (at, line), 0-based; a malformed or outlying entry fails the query."""
    t = F.split(F.trim("line"), r"\s+")
    value = F.lit(1.0) if header.field == "pattern" else F.get(t, 2).try_cast("double")
    e = lines.select("line", (F.get(t, 0).try_cast("long") - 1).alias("row"), (F.get(t, 1).try_cast("long") - 1).alias("col"), value.alias("value"))
    good = (F.col("row").between(0, header.rows - 1)) & (F.col("col").between(0, header.cols - 1)) & F.col("value").isNotNull()
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("bad matrix entry: "), "line")).cast("long"))
    return e.select(checked.alias("row"), "col", "value")


def entry_lines(lines: DataFrame, header: Header) -> DataFrame:
    """The stored entry lines: those after the size line, which is the first that is no comment; what follows the announced number is ignored.

    One pass counts them and finds the size line."""
    body = lines.filter((F.col("line") != "") & ~F.col("line").startswith("%"))
    found = body.agg(F.count("*").alias("n"), F.min("at").alias("first")).first()
    extra = found.n - 1 - header.stored
    if extra < 0:
        raise ValueError(f"{header.stored} entries announced, {header.stored + extra} found")
    place = lambda at: F.struct(F.lit(at.file).alias("file"), F.lit(at.block).alias("block"), F.lit(at.id).alias("id"))
    rest = body.filter(F.col("at") > place(found["first"]))
    if extra:
        last = rest.select("at").orderBy(F.desc("at")).limit(extra).agg(F.min("at").alias("at")).first()["at"]
        rest = rest.filter(F.col("at") < place(last))
    return rest


def write(m: Matrix, path: str, comments: list[str] | None = None, parts: int | None = None) -> None:
    """m as a folder of one real general file in parts: the first part has the head, the others the entries as they are partitioned (or
    dealt to parts), so the parts one after the other are a MatrixMarket file."""
    entries = m.entries if parts is None else m.entries.repartition(parts)
    head = ["%%MatrixMarket matrix coordinate real general", *(f"% {c}" for c in comments or []), f"{m.rows} {m.cols} {m.entries.count()}"]
    first = m.entries.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1)
    first.unionAll(entries.select(F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, F.col("value").cast("string")))).write.text(path)


def read(spark: SparkSession, path: str, drop_zeros: bool = True) -> Loaded:
    """A MatrixMarket file, or a folder of its parts by name, as a normalised matrix, with counts of its entries at each step."""
    lines = _lines(spark, path)
    header = parse_header(head_lines(spark, path))
    stored = parse_entries(entry_lines(lines, header), header)
    expanded = coo.mirrored(stored, header.symmetry)
    entries = coo.coalesced(expanded)
    entries = coo.without_zeros(entries) if drop_zeros else entries
    n, nnz = expanded.count(), entries.count()
    return Loaded(Matrix(entries, header.rows, header.cols), header, header.stored, n, n - nnz)
