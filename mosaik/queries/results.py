"""Queries on result tables. Line items stand for a sweep's results: a part is a matrix, the number of a line is an operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results as R
from ..operators.order import digits
from ..plans.planner import catalog
from ..plans.policy import load_balance
from ..sources import matrix_market
from ..sources.reports import basename, first_paths, listed, matching, matrix_list as read_list, report_value, result_csv, setting, shard_of, write_report
from ..sources.scratch import scratch
from ..sources.tables import table
from .parts import E, Query, parts, pattern, pattern_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Operators and their families, by the number of a line.
FAMILIES = {
    "cusparse_default": "baseline",
    "original_lb": "load_balanced_traversal",
    "sign2_lb": "lossless_value_specialized",
    "bfp8_lb": "controlled_lossy_value_specialized",
    "original_nolb": "non_load_balanced_traversal",
    "bf16_lb": "controlled_lossy_value_specialized",
    "bfp8_outlier_lb": "controlled_lossy_value_specialized",
}
OPERATORS = tuple(FAMILIES)


def _by_line(values) -> str:
    """The value of the line's number, the first one for any other."""
    names = list(values)
    return f"CASE l_linenumber {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(names[1:], 2))} ELSE '{names[0]}' END"


#: Sweep rows over all parts and operators, with failures, missing times and losses in them.
_ROWS = f"""SELECT concat('m', CAST(l_partkey AS {{s}})) AS matrix, {_by_line(OPERATORS)} AS operator, {_by_line(FAMILIES.values())} AS family,
CASE WHEN min(l_discount) >= 0.05 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN min(l_tax) >= 0.04 THEN '' ELSE CAST(sum(l_quantity) * 0.25{{d}} AS {{s}}) END AS avg_ms,
CASE WHEN max(l_tax) < 0.04 THEN 'FAIL' WHEN max(l_tax) > 0.07 THEN 'pass' ELSE '' END AS verify_cpu, CASE WHEN min(l_linestatus) = 'F' THEN 'spmv_max_rel' ELSE 'exact' END AS verify_gate,
CASE WHEN max(l_discount) <= 0.03 THEN 'promoted' ELSE 'candidate' END AS promotion, CAST(sum(sum(l_quantity)) OVER (PARTITION BY l_partkey) AS BIGINT) * (l_partkey % 1000 + 1) AS nnz,
count(DISTINCT l_quantity) * (l_partkey % 100) AS {{q}}distinct{{q}}, max(l_quantity) = 50 AS overflow, CAST(sum(count(*)) OVER (PARTITION BY l_partkey) AS BIGINT) AS bytes,
l_partkey * 8 + l_linenumber AS ordinal, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS device, max(l_discount) * 0.1{{d}} AS error, max(l_quantity) * 0.125{{d}} AS value_bytes,
max(l_discount) - max(l_tax) AS gain, count(*) / 16.0{{d}} AS fill, max(l_quantity) * 2 AS covered, count(*) AS lines FROM {{t}} GROUP BY l_partkey, l_linenumber"""
ROWS = "w AS (" + _ROWS.format(s="VARCHAR", d="::DOUBLE", q='"', t="lineitem") + ")"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark, d):
    return spark.sql(_ROWS.format(s="STRING", d="D", q="`", t="{lines}"), lines=table(spark, d, "lineitem"))


def _nine(df, *columns):
    return df.withColumns({c: F.round(c, 9) + 0 for c in columns})


def _speedups(spark, d):
    return R.speedups(_rows(spark, d), "cusparse_default")


OK = f"{ROWS}, ok AS (SELECT *, TRY_CAST(avg_ms AS DOUBLE) AS ms FROM w WHERE status = 'ok')"
SPEED = f"""{OK}, b AS (SELECT matrix, min(ms) AS base FROM ok WHERE operator = 'cusparse_default' GROUP BY matrix),
sp AS (SELECT ok.matrix, operator, base / ms AS speedup, nnz FROM ok JOIN b USING (matrix) WHERE base > 0 AND ms > 0)"""


@query(f"WITH {SPEED} SELECT matrix, operator, speedup FROM sp")
def speedup_join(spark, d):
    return _speedups(spark, d)


@query(f"""WITH {SPEED}, j AS (SELECT matrix, ms / nnz AS factor, error <= 0.005 AS passed FROM ok WHERE operator = 'bfp8_lb' AND ms IS NOT NULL)
SELECT sp.matrix, speedup * CASE WHEN passed THEN factor ELSE 1 END AS speedup FROM sp LEFT JOIN j USING (matrix) WHERE operator = 'original_lb'""")
def joint_dispatch(spark, d):
    r = _rows(spark, d)
    single = R.speedups(r, "cusparse_default").filter("operator = 'original_lb'").select("matrix", "speedup")
    joint = R.joint_rows(r, "bfp8_lb", 0.005).select("matrix", (F.col("ms") / F.col("nnz")).alias("factor"), "passed")
    return R.with_fallback(single, joint)


@query(f"WITH {OK} SELECT matrix, ms, error <= 0.005 AS passed, nnz FROM ok WHERE operator = 'bfp8_lb' AND ms IS NOT NULL")
def joint_filter(spark, d):
    return R.joint_rows(_rows(spark, d), "bfp8_lb", 0.005)


@query(f"WITH {OK} SELECT matrix, ms FROM ok WHERE operator = 'original_nolb' AND upper(verify_cpu) = 'PASS' AND ms IS NOT NULL")
def verified_filter(spark, d):
    return R.verified_rows(_rows(spark, d), "original_nolb")


_FULL = f"f AS (SELECT matrix, max(nnz) AS nnz, {', '.join(f"max(ms) FILTER (operator = '{o}') AS {o}" for o in OPERATORS)} FROM ok WHERE ms IS NOT NULL AND nnz IS NOT NULL GROUP BY matrix)"


@query(f"WITH {OK}, {_FULL} SELECT * FROM f")
def core_full(spark, d):
    return R.core_full(_rows(spark, d), list(OPERATORS))


@query(f"""WITH {SPEED}, v AS (SELECT speedup AS value, count(*) AS n FROM sp GROUP BY 1)
SELECT value, 1 - coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS share FROM v""")
def survival_curve(spark, d):
    return R.survival(_speedups(spark, d), "speedup")


@query(f"WITH {ROWS} SELECT CAST(floor(log10(nnz)) AS BIGINT) AS decade, count(*) AS n, median(value_bytes) AS median FROM w WHERE nnz >= 10 AND nnz < 1e9 GROUP BY 1 HAVING count(*) >= 5")
def decade_median(spark, d):
    return R.decade_medians(_rows(spark, d), "nnz", "value_bytes")


FAIL = """CASE WHEN status = 'ok' THEN 'none'
WHEN contains(lower(verify_cpu), 'fail') OR contains(lower(verify_cpu), 'max_rel') OR (verify_gate = 'spmv_max_rel' AND TRY_CAST(avg_ms AS DOUBLE) IS NOT NULL) THEN 'accuracy_fail'
WHEN family = 'lossless_value_specialized' AND TRY_CAST(avg_ms AS DOUBLE) IS NULL THEN 'unsupported_value_domain'
WHEN TRY_CAST(avg_ms AS DOUBLE) IS NULL THEN 'run_fail_before_timing' ELSE 'run_fail_after_timing' END"""


@query(f"WITH {ROWS} SELECT matrix, operator, {FAIL} AS failure FROM w")
def failure_class(spark, d):
    return _rows(spark, d).select("matrix", "operator", R.failure_class().alias("failure"))


@query(
    f"""WITH {ROWS}, f AS (SELECT *, {FAIL} AS failure, TRY_CAST(avg_ms AS DOUBLE) AS ms FROM w), b AS (SELECT matrix, min(ms) AS base FROM f WHERE operator = 'original_lb' GROUP BY matrix)
SELECT matrix, operator, failure, CASE WHEN failure <> 'none' THEN failure
WHEN family IN ('baseline', 'external_baseline') OR promotion = 'external_baseline' OR operator = 'cusparse_default' THEN 'external_baseline'
WHEN operator = 'original_lb' OR promotion = 'promoted' THEN 'promoted_fallback' WHEN family = 'non_load_balanced_traversal' THEN 'diagnostic_fallback'
WHEN NOT coalesce(base > 0 AND ms > 0, false) THEN 'accuracy_pass_no_fallback' WHEN base / ms > 1 THEN 'accuracy_pass_runtime_win' ELSE 'accuracy_pass_runtime_loss' END AS claim
FROM f LEFT JOIN b USING (matrix)"""
)
def claim_status(spark, d):
    return R.claim_status(_rows(spark, d))


@query(f"WITH {SPEED} SELECT operator, count(*) AS n, round(median(speedup), 9) AS median, round(exp(avg(ln(speedup))), 9) AS geomean, min(speedup) AS low, max(speedup) AS high FROM sp GROUP BY operator")
def speedup_summary(spark, d):
    return _nine(R.summary(_speedups(spark, d)), "median", "geomean")


@query(f"""WITH {ROWS}, m AS (SELECT operator, status = 'ok' AS ok, CASE WHEN status = 'ok' THEN TRY_CAST(avg_ms AS DOUBLE) END AS ms FROM w)
SELECT operator, count(*) FILTER (ok) AS ok, count(*) AS total, round(median(ms), 9) AS median, round(exp(avg(ln(ms)) FILTER (ms > 0)), 9) AS geomean, min(ms) AS low, max(ms) AS high FROM m GROUP BY operator""")
def baseline_summary(spark, d):
    return _nine(R.baseline_report(_rows(spark, d)), "median", "geomean")


@query(f"""WITH {ROWS} SELECT matrix, {', '.join(f"max(avg_ms) FILTER (operator = '{o}') AS {o}" for o in OPERATORS)},
{', '.join(f"coalesce(max(status) FILTER (operator = '{o}'), 'missing') AS {o}_status" for o in OPERATORS)} FROM w GROUP BY matrix""")
def baseline_pivot(spark, d):
    return R.pivoted(_rows(spark, d), list(OPERATORS), "avg_ms")


@query(f"""WITH {OK}, b AS (SELECT matrix, min(ms) AS base FROM ok WHERE operator = 'cusparse_default' GROUP BY matrix),
r AS (SELECT ok.*, CASE WHEN base > 0 AND ms > 0 THEN base / ms END AS speedup, row_number() OVER (PARTITION BY operator ORDER BY value_bytes) AS k, count(*) OVER (PARTITION BY operator) AS n FROM ok LEFT JOIN b USING (matrix))
SELECT operator, count(*) AS ok, count(*) FILTER (speedup > 1) AS wins, round(exp(avg(ln(speedup))), 9) + 0 AS geomean, count(*) FILTER (upper(verify_cpu) = 'PASS') AS passed,
count(*) FILTER (upper(verify_cpu) IN ('PASS', 'FAIL')) AS verified, max(value_bytes) FILTER (k = n // 2 + 1) AS upper_median FROM r GROUP BY operator""")
def scale_summary(spark, d):
    return _nine(R.scaled_up(_rows(spark, d), "cusparse_default"), "geomean")


_FAMILY = ["original_lb", "bf16_lb", "bfp8_lb", "bfp8_outlier_lb"]


@query(f"""WITH {ROWS}, o AS (SELECT * FROM w WHERE operator IN {(*_FAMILY, 'sign2_lb', 'original_nolb')} AND status = 'ok' AND value_bytes > 0 AND error >= 0),
c AS (SELECT matrix FROM o WHERE operator IN {tuple(_FAMILY)} GROUP BY matrix HAVING count(DISTINCT operator) = 4),
h AS (SELECT *, operator NOT IN {tuple(_FAMILY)} OR matrix IN (SELECT matrix FROM c) AS counts FROM o)
SELECT operator AS codec, count(*) FILTER (counts) AS n, count(DISTINCT matrix) / (SELECT count(DISTINCT matrix) FROM w) AS coverage,
median(value_bytes) FILTER (counts) AS bytes, round(median(error) FILTER (counts), 9) AS error FROM h GROUP BY operator""")
def pareto_common_set(spark, d):
    return _nine(R.pareto(_rows(spark, d), [*_FAMILY, "sign2_lb", "original_nolb"], _FAMILY), "error")


_SHOWN = ["original_lb", "bfp8_lb", "sign2_lb", "bf16_lb"]


@query(f"""WITH {OK}, {_FULL} SELECT matrix, nnz, {', '.join(f'cusparse_default / {o} AS {o}' for o in _SHOWN)} FROM f
WHERE {' AND '.join(f'{o} > 0' for o in ('cusparse_default', *_SHOWN))} ORDER BY nnz DESC, matrix LIMIT 10""")
def showcase_topk(spark, d):
    return R.showcased(_rows(spark, d), "cusparse_default", _SHOWN)


@query(f"""WITH {OK}, a AS (SELECT matrix, max(nnz) AS nnz, max(fill) AS fill, min(ms) AS base FROM ok WHERE operator = 'original_lb' AND ms > 0 GROUP BY matrix),
z AS (SELECT matrix, max(gain) AS gain, max(error) AS error, max(value_bytes) AS bytes, min(ms) AS ms FROM ok WHERE operator = 'bfp8_lb' AND ms > 0 GROUP BY matrix)
SELECT matrix, nnz, fill, round(gain, 9) + 0 AS gain, round(error, 9) + 0 AS error, bytes, base / ms AS speedup FROM a JOIN z USING (matrix)""")
def evidence_table(spark, d):
    return _nine(R.evidence(_rows(spark, d), "original_lb", "bfp8_lb"), "gain", "error")


@query(f"WITH {ROWS} SELECT matrix, device, ordinal, operator FROM w QUALIFY row_number() OVER (PARTITION BY matrix, device ORDER BY ordinal) = 1")
def crossdev_first(spark, d):
    return R.first_of_device(_rows(spark, d)).select("matrix", "device", "ordinal", "operator")


@query(f"""WITH {OK}, a AS (SELECT matrix, ms AS x FROM ok WHERE operator = 'original_lb'), z AS (SELECT matrix, ms AS y FROM ok WHERE operator = 'bfp8_lb')
SELECT matrix, x / y AS speedup FROM a JOIN z USING (matrix) WHERE x > 0 AND y > 0""")
def cg_speedup(spark, d):
    ok = _rows(spark, d).filter("status = 'ok'").withColumn("ms", R.milliseconds("avg_ms"))
    a, b = (ok.filter(F.col("operator") == o).select("matrix", F.col("ms").alias(c)) for o, c in (("original_lb", "x"), ("bfp8_lb", "y")))
    return a.join(b, "matrix").withColumn("speedup", R.positive_ratio(F.col("x"), F.col("y"))).filter("speedup IS NOT NULL").select("matrix", "speedup")


@query(f"WITH {ROWS} SELECT DISTINCT matrix FROM w WHERE matrix NOT IN (SELECT matrix FROM w WHERE status = 'failed')")
def resume_anti_join(spark, d):
    r = _rows(spark, d)
    return R.unfinished(r.select("matrix").distinct(), r.filter("status = 'failed'"))


@query(
    f"""WITH {ROWS}, m AS (SELECT matrix, bytes, max(CASE WHEN overflow THEN 4611686018427387904 ELSE "distinct" END) AS u FROM w WHERE NOT ("distinct" = 0 AND NOT overflow) GROUP BY ALL)
SELECT CASE WHEN u <= 1 THEN 'constant' WHEN u <= 2 THEN '2' WHEN u <= 16 THEN '16' WHEN u <= 256 THEN '256' WHEN u <= 65536 THEN '65536' ELSE 'continuous' END AS bucket, count(*) AS n FROM m GROUP BY 1"""
)
def value_census(spark, d):
    return R.census(_rows(spark, d))


_NAMED = """n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, concat('g', CAST(p_partkey % 9 AS VARCHAR), '/m', CAST(p_partkey AS VARCHAR)) AS path FROM part)"""


def _strided_parts(spark, d):
    """Names of matrices, one for each part, dealt to four shards."""
    names = table(spark, d, "part").select("p_partkey", F.expr("concat('g', p_partkey % 9, '/m', p_partkey)").alias("path"))
    return R.strided(names, digits("p_partkey", 1 << 36), 4)


@query(f"WITH {_NAMED} SELECT CAST(idx % 4 AS BIGINT) AS shard, idx // 4 AS pos, split_part(path, '/', 2) AS matrix, path FROM n")
def shard_identity(spark, d):
    dealt = _strided_parts(spark, d)
    names = dealt.select("path", (F.col("pos") * 4 + F.col("shard")).alias("idx"))
    rows = dealt.select("shard", "pos", F.element_at(F.split("path", "/"), 2).alias("matrix"))
    return R.shard_identity(rows, names, 4)


@query(f"WITH {_NAMED} SELECT CAST(idx % 4 AS BIGINT) AS shard, idx // 4 AS pos, path FROM n")
def stride_shards(spark, d):
    return _strided_parts(spark, d).select("shard", "pos", "path")


@query(f"""WITH {ROWS} SELECT ordinal AS id, CASE WHEN overflow THEN 'missing' WHEN nnz > 500000 THEN 'skip_size' WHEN verify_cpu = 'FAIL' THEN concat('error:', operator, ' ', verify_gate)
WHEN avg_ms = '' THEN 'empty' WHEN "distinct" <= 2 THEN 'pattern' ELSE 'ok' END AS status FROM w""")
def sweep_status(spark, d):
    error = F.when(F.col("verify_cpu") == "FAIL", F.concat_ws(" ", "operator", "verify_gate"))
    status = R.sweep_status(~F.col("overflow"), F.col("nnz"), 500000, F.length("avg_ms"), F.when(F.col("distinct") <= 2, "pattern").otherwise("real"), error)
    return _rows(spark, d).select(F.col("ordinal").alias("id"), status.alias("status"))


@query("SELECT concat('g', CAST(p_partkey % 9 AS VARCHAR), '/m', CAST(p_partkey AS VARCHAR), '.mtx') AS path FROM part WHERE p_partkey % 9 = 1 AND p_partkey % 10 > 1")
def matrix_list(spark, d):
    """A list of matrices, with notes and blank lines in it."""
    name = F.expr("CASE p_partkey % 10 WHEN 0 THEN concat('# ', p_partkey) WHEN 1 THEN '' ELSE concat('g', p_partkey % 9, '/m', p_partkey, '.mtx') END")
    return matching(listed(table(spark, d, "part").select(name.alias("path"))), "^g1/")


@query(f"WITH {ROWS} SELECT ordinal AS id, TRY_CAST(avg_ms AS DOUBLE) AS ms, operator AS codec FROM w")
def tool_output(spark, d):
    text = F.format_string("rows: %d\nvalue codec: %s\ntime: min_ms=%s, ok", F.col("bytes"), F.col("operator"), F.col("avg_ms"))
    t = _rows(spark, d).select(F.col("ordinal").alias("id"), text.alias("t"))
    return t.select("id", setting(F.col("t"), "min_ms").alias("ms"), report_value(F.col("t"), "value codec").alias("codec"))


@query(
    f"""WITH {ROWS}, z AS (SELECT "distinct" <= 256 AS few, covered AS c FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY few ORDER BY c) AS k, count(*) OVER (PARTITION BY few) AS n FROM z)
SELECT few, count(*) AS n, min(c) AS low, avg(c) AS mean, max(c) AS high, count(*) FILTER (c >= 90) AS ge90, count(*) FILTER (c >= 50) AS ge50, max(c) FILTER (k = n // 2 + 1) AS upper_median FROM k GROUP BY few"""
)
def frequency_summary(spark, d):
    return R.frequency_summary(_rows(spark, d), "covered", "distinct")


@query(
    f"""WITH {ROWS}, m AS (SELECT ordinal, covered FROM w WHERE "distinct" > 256), a AS (SELECT 'best' AS side, * FROM m WHERE covered >= 90 ORDER BY covered DESC, ordinal LIMIT 12),
b AS (SELECT 'worst' AS side, * FROM m WHERE covered < 50 ORDER BY covered, ordinal LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b"""
)
def frequency_extremes(spark, d):
    return R.frequency_extremes(_rows(spark, d), "covered", "distinct", "ordinal")


_POINTS = "CASE WHEN overflow THEN 'Infinity'::DOUBLE ELSE gain END AS x, value_bytes AS y"


@query(f"WITH {ROWS}, z AS (SELECT {_POINTS} FROM w) SELECT count(*) FILTER (x > 0 AND x < 'Infinity'::DOUBLE AND y > 0) AS points, count(*) FILTER (x = 'Infinity'::DOUBLE) AS infinite FROM z")
def accuracy_scatter(spark, d):
    x = F.when(F.col("overflow"), float("inf")).otherwise(F.col("gain"))
    return R.plottable(_rows(spark, d).select(x.alias("x"), F.col("value_bytes").alias("y")), "x", "y")


@query(
    f"""WITH {OK}, {', '.join(f"{a} AS (SELECT matrix, min(ms) AS {a}m FROM ok WHERE operator = '{o}' GROUP BY matrix)" for a, o in (('c', 'cusparse_default'), ('o', 'original_lb'), ('p', 'original_nolb')))}
SELECT CAST(list_position({list(OPERATORS)}, operator) AS BIGINT) AS place, matrix, operator, {', '.join(f'CASE WHEN {a}m > 0 AND ms > 0 THEN {a}m / ms END AS {n}' for a, n in (('c', 'vs_default'), ('o', 'vs_original'), ('p', 'vs_plain')))}
FROM ok LEFT JOIN c USING (matrix) LEFT JOIN o USING (matrix) LEFT JOIN p USING (matrix)"""
)
def sweep_summary(spark, d):
    return R.sweep_summary(_rows(spark, d), list(OPERATORS), {"vs_default": "cusparse_default", "vs_original": "original_lb", "vs_plain": "original_nolb"})


@query(
    f"""WITH {ROWS} SELECT fill >= 0.2::DOUBLE AS dense, count(*) AS n, round(sum(gain * nnz) / sum(nnz), 9) + 0 AS weighted, round(median(gain), 9) + 0 AS median,
round(min(gain), 9) + 0 AS low, round(max(gain), 9) + 0 AS high FROM w GROUP BY 1"""
)
def coreg_group_gains(spark, d):
    return _nine(R.group_gains(_rows(spark, d), "gain", "nnz", "fill"), "weighted", "median", "low", "high")


@query(
    f"""WITH {ROWS}, k AS (SELECT gain, row_number() OVER (ORDER BY fill, ordinal) AS a, row_number() OVER (ORDER BY gain, ordinal) AS b FROM w)
SELECT count(*) AS n, count(*) FILTER (gain > 0) AS positive, count(*) FILTER (gain > 0) / count(*) AS positive_share, round(list_sort(list(gain))[count(*) // 2 + 1], 9) + 0 AS median, round(corr(a, b), 9) AS rho FROM k"""
)
def coreg_gain_summary(spark, d):
    return _nine(R.gain_summary(_rows(spark, d), "gain", "fill", "ordinal"), "median", "rho")


@query(f"WITH {ROWS} SELECT CAST(sum(nnz * 2 + lines * 16) AS BIGINT) AS packed_bytes, CAST(sum(nnz * 4 + (bytes + 1) * 4) AS BIGINT) AS csr_bytes, sum(nnz * 2 + lines * 16) / sum(nnz * 4 + (bytes + 1) * 4) AS ratio FROM w")
def position_metadata_totals(spark, d):
    return R.metadata_totals(_rows(spark, d).select((F.col("nnz") * 2).alias("position_bytes"), F.col("lines").alias("work_items"), "nnz", F.col("bytes").alias("rows")))


# --- policy and catalog -----------------------------------------------------------------------------------

_POLICY = "CASE WHEN b <= 0 OR r <= 0 THEN 32 WHEN b < 30000 THEN 8 WHEN a >= 20000 AND b >= 700000 THEN 128 WHEN a >= 6000 AND b >= 400000 THEN 128 WHEN a >= 6000 AND b >= 250000 THEN 64 WHEN a >= 500 THEN CASE WHEN b < 120000 THEN 16 WHEN b >= 3000000 THEN 64 ELSE 32 END WHEN b >= 8000000 AND a >= 128 THEN 128 WHEN b >= 3000000 THEN 64 ELSE 32 END"


@query(f"""WITH {ROWS}, m AS (SELECT DISTINCT matrix, nnz AS b, bytes AS r FROM w)
SELECT matrix, b AS blocks, r AS "rows", {_POLICY} AS chunk FROM (SELECT *, b / greatest((r + 7) // 8, 1) AS a FROM m)""")
def lb_policy(spark, d):
    m = _rows(spark, d).select("matrix", F.col("nnz").alias("blocks"), F.col("bytes").alias("rows")).distinct()
    return m.select("matrix", "blocks", "rows", load_balance(F.col("blocks"), F.col("rows")).alias("chunk"))


_CATALOG = [(k, o.name, o.layout, o.codec, o.family, o.gate, o.promotion) for k, o in enumerate(catalog().values())]


@query(f"""WITH {ROWS}, c(place, name, layout, codec, family, gate, promotion) AS (VALUES {', '.join(map(str, _CATALOG))}), n AS (SELECT operator, count(*) AS n, count(*) FILTER (status = 'ok') AS ok FROM w GROUP BY operator)
SELECT c.*, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok FROM c LEFT JOIN n ON name = operator""")
def operator_catalog(spark, d):
    """Every known operator, with its rows in the sweep."""
    known = spark.createDataFrame(_CATALOG, "place int, name string, layout string, codec string, family string, gate string, promotion string")
    swept = _rows(spark, d).groupBy("operator").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"))
    met = known.join(swept, F.col("name") == F.col("operator"), "left").drop("operator")
    return met.fillna(0, ["n", "ok"])


# --- files: written from the driver's tables, and read again ----------------------------------------------

_SWEPT = """s AS (SELECT concat('m', CAST(l_suppkey AS {s})) AS matrix, CASE WHEN l_linenumber = 1 THEN 'cusparse_default' ELSE concat('op', CAST(l_linenumber AS {s})) END AS operator,
l_suppkey % 3 AS shard, CAST(sum(l_quantity) AS BIGINT) AS ms FROM lineitem GROUP BY 1, 2, 3)"""


def _shards(spark, d) -> str:
    """Sweep results of three shards and a summary, as files: a folder."""
    sweep = spark.sql(f"WITH {_SWEPT.format(s='STRING').replace('FROM lineitem', 'FROM {lines}')} SELECT * FROM s", lines=table(spark, d, "lineitem"))
    path = scratch(spark, "sweep")
    for k in range(3):
        own = sweep.filter(F.col("shard") == k).select("matrix", "operator", F.lit("ok").alias("status"), F.col("ms").cast("string").alias("avg_ms"))
        write_report(own, f"{path}/shard{k}.csv")
    return path


@query(f"""WITH {_SWEPT.format(s='VARCHAR')}, b AS (SELECT matrix, ms AS base FROM s WHERE operator = 'cusparse_default')
SELECT CAST(shard AS INTEGER) AS shard, matrix, operator, base / CAST(ms AS DOUBLE) AS speedup FROM s JOIN b USING (matrix) WHERE operator <> 'cusparse_default'""")
def result_files(spark, d):
    path = _shards(spark, d)
    rows = result_csv(spark, f"{path}/shard*.csv").withColumn("shard", shard_of(F.col("folder")))
    base = rows.filter("operator = 'cusparse_default'").select(F.col("matrix").alias("m"), F.col("avg_ms").cast("double").alias("base"))
    ours = rows.filter("operator <> 'cusparse_default'").join(base, F.col("matrix") == F.col("m"))
    return ours.select("shard", "matrix", "operator", (F.col("base") / F.col("avg_ms").cast("double")).alias("speedup"))


@query(f"""WITH {E} SELECT r, c, v FROM e""")
def matrix_market_scan(spark, d):
    path = scratch(spark, "market")
    matrix_market.write(parts(spark, d), path, [f"comment {k}" for k in range(3000)])
    return matrix_market.read(spark, path).matrix.entries.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("v"))


@query(f"WITH {pattern_sql('binary01')} SELECT r, c, v FROM e")
def matrix_market_stored_zeros(spark, d):
    """Entries that are zero stay where the reader is told to keep them."""
    path = scratch(spark, "market")
    matrix_market.write(pattern(spark, d, "binary01"), path, parts=5)
    return matrix_market.read(spark, path, drop_zeros=False).matrix.entries.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("v"))


@query("""WITH p AS (SELECT DISTINCT concat('Group', CAST(s_nationkey AS VARCHAR), '/m', CAST(s_suppkey AS VARCHAR), '/m', CAST(s_suppkey AS VARCHAR), '.mtx') AS path FROM supplier)
SELECT path, regexp_replace(split_part(path, '/', 3), '\\.mtx$', '') AS name FROM p WHERE regexp_matches(path, '^Group1') ORDER BY path LIMIT 7""")
def matrix_list_file(spark, d):
    path = scratch(spark, "list")
    group = F.concat(F.lit("Group"), F.col("s_nationkey").cast("string"))
    name = F.concat(F.lit("m"), F.col("s_suppkey").cast("string"))
    lines = table(spark, d, "supplier").select(F.concat_ws("/", group, name, F.concat(name, F.lit(".mtx"))).alias("value"))
    notes = spark.createDataFrame([("# a list",), ("",)], "value string")
    notes.unionAll(lines).write.text(path)
    found = first_paths(matching(read_list(spark, path), "^Group1"), 7)
    return found.select("path", basename(F.col("path")).alias("name"))
