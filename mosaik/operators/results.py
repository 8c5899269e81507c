"""Analytics on tables of benchmark results: speed-ups, curves, classes, summaries and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import cells, running
from .study import spearman_ordinal

#: Fixed values.
LOSSLESS_FAMILY = "lossless_value_specialized"
BASELINE_FAMILIES = ("baseline", "external_baseline")


def milliseconds(text: str) -> Column:
    """A time that may be missing or malformed."""
    return F.expr(f"try_cast({text} AS DOUBLE)")


def positive_ratio(baseline: Column, own: Column) -> Column:
    return F.when((baseline > 0) & (own > 0), baseline / own)


def shard_identity(rows: DataFrame, names: DataFrame, shards: int) -> DataFrame:
    """(shard, pos, matrix, path): the path of each shard row by its place; shards take every n-th name from their
    offset. The offset of a shard is the one at which all its rows carry the name's last part; two such offsets,
    or none, leave the shard out."""
    base = F.element_at(F.split("path", "/"), -1)
    n = names.select("path", (F.col("idx") % shards).alias("offset"), F.expr(f"idx DIV {shards}").alias("p"), base.alias("base"))
    met = rows.join(n, F.col("pos") == F.col("p")).withColumn("same", F.col("matrix") == F.col("base"))
    size = rows.groupBy(F.col("shard").alias("z")).agg(F.count("*").alias("n"))
    fits = met.groupBy("shard", "offset").agg(F.count_if("same").alias("hits")).join(size, F.col("shard") == F.col("z")).filter("hits = n")
    sure = fits.groupBy("shard").agg(F.min("offset").alias("offset"), F.count("*").alias("k")).filter("k = 1").select(F.col("shard").alias("s"), F.col("offset").alias("o"))
    return met.join(sure, (F.col("shard") == F.col("s")) & (F.col("offset") == F.col("o"))).select("shard", "pos", "matrix", "path")


def speedups(rows: DataFrame, baseline: str) -> DataFrame:
    """(matrix, operator, speedup) against the baseline operator of the same matrix; failed rows are left out."""
    ok = rows.filter("status = 'ok'").withColumn("ms", milliseconds("avg_ms"))
    base = ok.filter(F.col("operator") == baseline).groupBy("matrix").agg(F.min("ms").alias("base"))
    out = ok.join(base, "matrix").withColumn("speedup", positive_ratio(F.col("base"), F.col("ms")))
    return out.filter("speedup IS NOT NULL").select("matrix", "operator", "speedup")


def with_fallback(single: DataFrame, joint: DataFrame) -> DataFrame:
    """(matrix, speedup): times the joint factor where its gate passes, alone elsewhere."""
    j = joint.select(F.col("matrix").alias("m"), "factor", "passed")
    both = single.join(j, F.col("matrix") == F.col("m"), "left")
    return both.select("matrix", F.when(F.col("passed"), F.col("speedup") * F.col("factor")).otherwise(F.col("speedup")).alias("speedup"))


def survival(values: DataFrame, c: str) -> DataFrame:
    """(value, share): the share of rows at or above each value, ascending. Values are counted before they are put in order, and
    ordered within cells of approximate quantiles."""
    n = values.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    placed = running(n, [cells(n, F.col("value")), F.col("value")], "upto", F.col("n"))
    every = n.agg(F.sum("n").alias("every"))
    return placed.join(F.broadcast(every)).select("value", (1 - F.col("upto") / F.col("every")).alias("share"))


def decade_medians(rows: DataFrame, size: str, c: str, least: int = 5) -> DataFrame:
    d = rows.filter((F.col(size) >= 10) & (F.col(size) < 1e9)).groupBy(F.floor(F.log10(size)).alias("decade"))
    return d.agg(F.count("*").alias("n"), F.median(c).alias("median")).filter(F.col("n") >= least)


def failure_class() -> Column:
    """none, accuracy_fail, unsupported_value_domain, run_fail_before_timing or run_fail_after_timing."""
    ms = milliseconds("avg_ms")
    verify = F.lower(F.coalesce("verify_cpu", F.lit("")))
    accuracy = verify.contains("fail") | verify.contains("max_rel") | ((F.col("verify_gate") == "spmv_max_rel") & ms.isNotNull())
    return (
        F.when(F.col("status") == "ok", "none")
        .when(F.coalesce(accuracy, F.lit(False)), "accuracy_fail")
        .when((F.col("family") == LOSSLESS_FAMILY) & ms.isNull(), "unsupported_value_domain")
        .when(ms.isNull(), "run_fail_before_timing")
        .otherwise("run_fail_after_timing")
    )


def claim_status(rows: DataFrame, reference: str = "original_lb") -> DataFrame:
    """rows with failure and claim: what the result may be said to show beside the reference operator."""
    base = rows.filter(F.col("operator") == reference).groupBy(F.col("matrix").alias("m")).agg(F.min(milliseconds("avg_ms")).alias("base"))
    r = rows.join(base, F.col("matrix") == F.col("m"), "left").withColumn("failure", failure_class())
    gain = positive_ratio(F.col("base"), milliseconds("avg_ms"))
    claim = (
        F.when(F.col("failure") != "none", F.col("failure"))
        .when(F.col("family").isin(*BASELINE_FAMILIES) | (F.col("promotion") == "external_baseline") | (F.col("operator") == "cusparse_default"), "external_baseline")
        .when((F.col("operator") == reference) | (F.col("promotion") == "promoted"), "promoted_fallback")
        .when(F.col("family") == "non_load_balanced_traversal", "diagnostic_fallback")
        .when(gain.isNull(), "accuracy_pass_no_fallback")
        .when(gain > 1, "accuracy_pass_runtime_win")
        .otherwise("accuracy_pass_runtime_loss")
    )
    return r.withColumn("claim", claim).select("matrix", "operator", "failure", "claim")


def summary(s: DataFrame) -> DataFrame:
    """(operator, n, median, geomean, low, high) of speed-ups."""
    v = F.col("speedup")
    return s.groupBy("operator").agg(F.count("*").alias("n"), F.median("speedup").alias("median"), F.exp(F.avg(F.log(v))).alias("geomean"), F.min(v).alias("low"), F.max(v).alias("high"))


def baseline_report(rows: DataFrame) -> DataFrame:
    """(operator, ok, total, median, geomean, low, high): times of the rows that went well; the geometric mean is that of positive ones. An operator
    without any has nulls."""
    ms = F.when(F.col("status") == "ok", milliseconds("avg_ms"))
    r = rows.select("operator", (F.col("status") == "ok").alias("ok"), ms.alias("ms"))
    return r.groupBy("operator").agg(
        F.count_if("ok").alias("ok"),
        F.count("*").alias("total"),
        F.median("ms").alias("median"),
        F.exp(F.avg(F.when(F.col("ms") > 0, F.log("ms")))).alias("geomean"),
        F.min("ms").alias("low"),
        F.max("ms").alias("high"),
    )


def pivoted(rows: DataFrame, operators: list[str], value: str) -> DataFrame:
    """A row for each matrix: of each operator its greatest value and its status (`missing` where there is no row)."""
    wide = rows.groupBy("matrix").pivot("operator", operators).agg(F.max(value).alias("value"), F.max("status").alias("status"))
    return wide.select("matrix", *(F.col(f"{o}_value").alias(o) for o in operators), *(F.coalesce(f"{o}_status", F.lit("missing")).alias(f"{o}_status") for o in operators))


def scaled_up(rows: DataFrame, baseline: str) -> DataFrame:
    """(operator, ok, wins, geomean, passed, verified, upper_median): rows that went well, those faster than the baseline's, the geometric mean of
    their speed-ups, verdicts, and the upper median of their positive sizes."""
    ok = rows.filter("status = 'ok'").withColumn("ms", milliseconds("avg_ms"))
    base = ok.filter(F.col("operator") == baseline).groupBy(F.col("matrix").alias("m")).agg(F.min("ms").alias("base"))
    r = ok.join(base, F.col("matrix") == F.col("m"), "left").withColumn("speedup", positive_ratio(F.col("base"), F.col("ms")))
    verdict = F.upper("verify_cpu")
    own = r.groupBy("operator").agg(
        F.count("*").alias("ok"),
        F.count_if(F.col("speedup") > 1).alias("wins"),
        F.exp(F.avg(F.log("speedup"))).alias("geomean"),
        F.count_if(verdict == "PASS").alias("passed"),
        F.count_if(verdict.isin("PASS", "FAIL")).alias("verified"),
    )
    sizes = upper_median(ok.filter("value_bytes > 0"), "value_bytes", "operator").withColumnRenamed("operator", "o")
    return own.join(sizes, F.col("operator") == F.col("o"), "left").drop("o")


def joint_rows(rows: DataFrame, operator: str, bound: float) -> DataFrame:
    """(matrix, ms, passed, nnz) of one operator's rows that went well and have a time; passed: the error is at most bound."""
    own = rows.filter((F.col("operator") == operator) & (F.col("status") == "ok")).withColumn("ms", milliseconds("avg_ms"))
    return own.filter("ms IS NOT NULL").select("matrix", "ms", (F.col("error") <= bound).alias("passed"), "nnz")


def verified_rows(rows: DataFrame, operator: str) -> DataFrame:
    """(matrix, ms) of one operator's rows that went well, with a time, and whose check says PASS."""
    own = rows.filter((F.col("operator") == operator) & (F.col("status") == "ok") & (F.upper("verify_cpu") == "PASS"))
    return own.select("matrix", milliseconds("avg_ms").alias("ms")).filter("ms IS NOT NULL")


def core_full(rows: DataFrame, operators: list[str]) -> DataFrame:
    """(matrix, nnz, a time for each operator): raw measurements of the rows that went well and have a time and a size."""
    ok = rows.filter("status = 'ok'").withColumn("ms", milliseconds("avg_ms")).filter("ms IS NOT NULL AND nnz IS NOT NULL")
    return ok.groupBy("matrix").agg(F.max("nnz").alias("nnz"), *(F.max(F.when(F.col("operator") == o, F.col("ms"))).alias(o) for o in operators))


def showcased(rows: DataFrame, baseline: str, operators: list[str], k: int = 10) -> DataFrame:
    """(matrix, nnz, a speed-up for each operator) of the k largest matrices for which the baseline and all operators have a positive time."""
    full = core_full(rows, [baseline, *operators])
    whole = full.filter(" AND ".join(f"{o} > 0" for o in (baseline, *operators)))
    return whole.orderBy(F.desc("nnz"), "matrix").limit(k).select("matrix", "nnz", *((F.col(baseline) / F.col(o)).alias(o) for o in operators))


def evidence(rows: DataFrame, exact: str, lossy: str) -> DataFrame:
    """(matrix, nnz, fill, gain, error, bytes, speedup): what the structure, the values and the time of a matrix say, joined over matrices that have all three."""
    ok = rows.filter("status = 'ok'").withColumn("ms", milliseconds("avg_ms")).filter("ms > 0")
    a = ok.filter(F.col("operator") == exact).groupBy("matrix").agg(F.max("nnz").alias("nnz"), F.max("fill").alias("fill"), F.min("ms").alias("base"))
    b = ok.filter(F.col("operator") == lossy).groupBy(F.col("matrix").alias("m")).agg(F.max("gain").alias("gain"), F.max("error").alias("error"), F.max("value_bytes").alias("bytes"), F.min("ms").alias("ms"))
    return a.join(b, F.col("matrix") == F.col("m")).select("matrix", "nnz", "fill", "gain", "error", "bytes", (F.col("base") / F.col("ms")).alias("speedup"))


def strided(rows: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """rows with shard and pos: every n-th row of the order goes to the same shard."""
    placed = running(rows, order, "_k")
    return placed.withColumns({"shard": F.col("_k") % shards, "pos": F.expr(f"_k DIV {shards}")}).drop("_k")


def upper_median(rows: DataFrame, c: str, *by: str) -> DataFrame:
    """The element at place n // 2 of each group, ascending."""
    w = Window.partitionBy(*by)
    r = rows.withColumns({"k": F.row_number().over(w.orderBy(c)), "n": F.count("*").over(w)})
    return r.filter(F.expr("k = n DIV 2 + 1")).select(*by, F.col(c).alias("upper_median"))


def pareto(rows: DataFrame, codecs: list[str], family: list[str]) -> DataFrame:
    """(codec, n, coverage, bytes, error): medians of sizes and errors. Those of the family are taken over the matrices that all of them hold, others
    over their own; coverage is a codec's share of all matrices."""
    every = rows.select("matrix").distinct().agg(F.count("*").alias("every"))
    own = rows.filter(F.col("operator").isin(*codecs) & (F.col("status") == "ok") & (F.col("value_bytes") > 0) & (F.col("error") >= 0))
    shared = own.filter(F.col("operator").isin(*family)).groupBy(F.col("matrix").alias("m")).agg((F.count_distinct("operator") == len(family)).alias("shared"))
    held = own.join(shared, F.col("matrix") == F.col("m"), "left")
    counts = ~F.col("operator").isin(*family) | F.col("shared")
    taken = lambda c: F.median(F.when(counts, F.col(c)))
    a = held.groupBy(F.col("operator").alias("codec")).agg(F.count_if(counts).alias("n"), F.count_distinct("matrix").alias("own"), taken("value_bytes").alias("bytes"), taken("error").alias("error"))
    return a.join(F.broadcast(every)).select("codec", "n", (F.col("own") / F.col("every")).alias("coverage"), "bytes", "error")


def first_of_device(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("matrix", "device").orderBy("ordinal"))).filter("k = 1").drop("k")


def unfinished(wanted: DataFrame, done: DataFrame) -> DataFrame:
    return wanted.join(done.select("matrix").distinct(), "matrix", "left_anti")


def census(rows: DataFrame) -> DataFrame:
    """(bucket, n): matrices by the most distinct values seen; an overflow is continuous."""
    known = rows.filter(~((F.col("distinct") == 0) & ~F.col("overflow")))
    most = known.groupBy("matrix", "bytes").agg(F.max(F.when(F.col("overflow"), F.lit(1 << 62)).otherwise(F.col("distinct"))).alias("u"))
    u = F.col("u")
    bucket = F.when(u <= 1, "constant").when(u <= 2, "2").when(u <= 16, "16").when(u <= 256, "256").when(u <= 65536, "65536").otherwise("continuous")
    return most.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def sweep_status(exists: Column, size: Column, limit: float, nnz: Column, field: Column, error: Column | None = None) -> Column:
    """missing, skip_size, error, empty, pattern or ok; error: a message, null where there is none."""
    tried = F.when(~exists, "missing").when(size > limit, "skip_size")
    if error is not None:
        tried = tried.when(error.isNotNull(), F.concat(F.lit("error:"), F.left(error, F.lit(60))))
    return tried.when(nnz == 0, "empty").when(field == "pattern", "pattern").otherwise("ok")


def lpt(sizes: list[tuple[str, int]], shards: int) -> list[list[str]]:
    """Names to shards, largest first, each to the least loaded; for lists that fit a driver."""
    out: list[list[str]] = [[] for _ in range(shards)]
    load = [0] * shards
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        k = min(range(shards), key=lambda i: (load[i], i))
        out[k].append(name)
        load[k] += size
    return out


def frequency_summary(rows: DataFrame, covered: str, distinct: str, limit: int = 256) -> DataFrame:
    """(few, n, low, upper_median, mean, high, ge90, ge50): coverage of matrices with few and with many distinct values."""
    r = rows.withColumn("few", F.col(distinct) <= limit)
    a = r.groupBy("few").agg(
        F.count("*").alias("n"), F.min(covered).alias("low"), F.avg(covered).alias("mean"), F.max(covered).alias("high"), F.count_if(F.col(covered) >= 90).alias("ge90"), F.count_if(F.col(covered) >= 50).alias("ge50")
    )
    return a.join(upper_median(r, covered, "few"), "few")


def frequency_extremes(rows: DataFrame, covered: str, distinct: str, name: str, limit: int = 256, best: int = 12, worst: int = 10) -> DataFrame:
    """(side, name, covered): of the matrices with many distinct values the best covered ones (from 90) and the worst (below 50); ties by name."""
    many = rows.filter(F.col(distinct) > limit).select(name, covered)
    top = many.filter(F.col(covered) >= 90).orderBy(F.desc(covered), name).limit(best)
    low = many.filter(F.col(covered) < 50).orderBy(covered, name).limit(worst)
    return top.select(F.lit("best").alias("side"), name, covered).unionAll(low.select(F.lit("worst").alias("side"), name, covered))


def plottable(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: points that are finite and positive in all columns, and those with an infinite one."""
    good, infinite = F.lit(True), F.lit(False)
    for c in columns:
        good &= (F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(c)
        infinite |= F.abs(F.col(c)) == float("inf")
    return rows.agg(F.count_if(good).alias("points"), F.count_if(infinite).alias("infinite"))


def sweep_summary(rows: DataFrame, operators: list[str], baselines: dict[str, str]) -> DataFrame:
    """(place, matrix, operator, one speed-up for each baseline), operators by their place in the catalog."""
    place = F.array_position(F.array(*[F.lit(o) for o in operators]), F.col("operator"))
    out = rows.filter("status = 'ok'").select(place.alias("place"), "matrix", "operator", milliseconds("avg_ms").alias("ms"))
    for c, name in baselines.items():
        base = rows.filter((F.col("operator") == name) & (F.col("status") == "ok")).groupBy(F.col("matrix").alias("m")).agg(F.min(milliseconds("avg_ms")).alias("base"))
        out = out.join(base, F.col("matrix") == F.col("m"), "left").withColumn(c, positive_ratio(F.col("base"), F.col("ms"))).drop("m", "base")
    return out.drop("ms")


def group_gains(rows: DataFrame, gain: str, weight: str, fill: str, dense_from: float = 0.2) -> DataFrame:
    """(dense, n, weighted, median, low, high): gains of dense and sparse matrices."""
    g = rows.groupBy((F.col(fill) >= dense_from).alias("dense"))
    return g.agg(F.count("*").alias("n"), (F.sum(F.col(gain) * F.col(weight)) / F.sum(weight)).alias("weighted"), F.median(gain).alias("median"), F.min(gain).alias("low"), F.max(gain).alias("high"))


def gain_summary(rows: DataFrame, gain: str, fill: str, place: str) -> DataFrame:
    """One row over matrices: how many, how many gain, their share, the upper median, and the rank correlation of
    fill and gain with ties in the order of place, 0 where there is none."""
    positive, top = F.count_if(F.col(gain) > 0), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {gain} DESC)")
    s = rows.agg(F.count(gain).alias("n"), positive.alias("positive"), F.try_divide(positive.cast("double"), F.count(gain)).alias("positive_share"), top.cast("double").alias("median"))
    return s.join(spearman_ordinal(rows, fill, gain, place).select(F.coalesce("rho", F.lit(0.0)).alias("rho")))


def metadata_totals(rows: DataFrame) -> DataFrame:
    """One row: bytes of packed positions with 16 for each work item, and of compressed rows, over matrices."""
    packed = F.sum(F.col("position_bytes") + F.col("work_items") * 16)
    plain = F.sum(F.col("nnz") * 4 + (F.col("rows") + 1) * 4)
    return rows.agg(packed.alias("packed_bytes"), plain.alias("csr_bytes"), (packed / plain).alias("ratio"))
