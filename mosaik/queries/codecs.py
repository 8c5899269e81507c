"""Queries on value codecs: what they store, which one is chosen, and products through them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rounding import bf16, fp16
from ..operators import codecs, evaluation, metrics, payload, profile, split, tiles
from ..operators.spmv import spmv, spmv_parts
from ..plans.planner import gated
from ..sources.tables import deterministic_vector, embedding_matrix, input_vector, order_by_part, shipments, table
from .parts import EMBED, HASH, ORDERS, PATTERNS, TILES, E, Query, X, parts, pattern, pattern_sql, rounded, spmv_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EX = "x AS (SELECT i AS idx, ((i % 17) - 8) * CAST(0.125 AS DOUBLE) AS val FROM range(64) q(i))"
EROWS = "(SELECT max(vec_id) + 1 FROM embeddings)"


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# --- exact codecs: products must equal those of the plain values ------------------------------------------


def _through(name: str):
    def run(spark, d):
        m = pattern(spark, d, name)
        x = input_vector(spark, m.cols)
        if name in ("all_one", "const_c", "sign2", "sign2_scale", "binary01"):
            return spmv(codecs.exact_coded(m, name), x)
        coded, book = codecs.dictionary(m, 2 ** codecs.DICTIONARIES[name])
        return spmv(m.with_entries(codecs.from_dictionary(coded, book)), x)

    return run


for _name in PATTERNS:
    query(spmv_sql(pattern_sql(_name)), f"spmv_{_name}")(_through(_name))


@query(f"WITH {E}, b AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS id FROM (SELECT DISTINCT v FROM e)) SELECT r, c, id FROM e JOIN b USING (v)")
def dict_encode(spark, d):
    coded, _ = codecs.dictionary(parts(spark, d), 65536)
    return coded.select(F.col("row").alias("r"), F.col("col").alias("c"), "id")


_BYTES = {c: f"tiles * {4 * {'all_one': 0, 'const_c': 0, 'sign2': 1, 'sign2_scale': 1, **codecs.DICTIONARIES}[c]} + {dict(all_one='0', const_c='8', sign2='0', sign2_scale='8').get(c, 'd * 8')}" for c in codecs.LADDER}
_RULES = {"all_one": "d = 1 AND lo = 1", "const_c": "d = 1", "sign2": "d = 2 AND lo = -1 AND hi = 1", "sign2_scale": "d = 2 AND lo = -hi"} | {c: f"d <= {2**k}" for c, k in codecs.DICTIONARIES.items()}
FACTS = "f AS (SELECT count(*) AS nnz, least(count(DISTINCT v), 65537) AS d, min(v) AS lo, max(v) AS hi, (SELECT count(*) FROM (SELECT DISTINCT r // 8, c // 4 FROM e)) AS tiles FROM e)"


@query(f"WITH {E}, {FACTS} " + " UNION ALL ".join(f"SELECT '{c}' AS codec, {_RULES[c]} AS applicable, CAST({_BYTES[c]} AS BIGINT) AS tile_payload_bytes FROM f" for c in codecs.LADDER))
def codec_report_exact(spark, d):
    return codecs.exact_report(parts(spark, d))


_HOST = {"original": "nnz * 64", "all_one": "0", "const_c": "64", "sign2": "nnz * 2", "sign2_scale": "nnz + 64", "fp16": "nnz * 16", "bf16": "nnz * 16"} | {c: f"nnz * {k} + d * 64" for c, k in codecs.DICTIONARIES.items()}


@query(f"WITH {E}, {FACTS} " + " UNION ALL ".join(f"SELECT '{c}' AS codec, CAST({s} AS BIGINT) AS payload_bits, CAST({s} AS BIGINT) / nnz AS bits_per_nnz FROM f" for c, s in _HOST.items()))
def codec_report_host(spark, d):
    f = codecs.facts(parts(spark, d))
    each = F.array(*[F.struct(F.lit(c).alias("codec"), codecs.host_bits(c).alias("payload_bits")) for c in _HOST])
    return f.select("nnz", F.explode(each).alias("r")).select("r.codec", "r.payload_bits", (F.col("r.payload_bits") / F.col("nnz")).alias("bits_per_nnz"))


def _auto(name: str) -> str:
    ladder = " ".join(f"WHEN {_RULES[c]} AND {_BYTES[c]} < nnz * 8 THEN '{c}'" for c in codecs.LADDER)
    size = " ".join(f"WHEN '{c}' THEN {_BYTES[c]}" for c in codecs.LADDER)
    return f"SELECT '{name}' AS pattern, codec, nnz, d AS distinct, CAST(CASE codec {size} ELSE nnz * 8 END AS BIGINT) AS payload_bytes FROM (SELECT *, CASE {ladder} ELSE 'original' END AS codec FROM (WITH {pattern_sql(name)}, {FACTS} SELECT * FROM f))"


@query(" UNION ALL ".join(_auto(n).replace("AS distinct", 'AS "distinct"') for n in PATTERNS))
def auto_lossless(spark, d):
    return codecs.picked(codecs.facts_each(parts(spark, d), {k: value() for k, (value, _) in PATTERNS.items()}))


#: Exact exponent, then the nearest multiple of a power of two.
BF16 = "CASE WHEN f = 0 THEN f ELSE round_even(f / pow(2, greatest(x, -126) - 7), 0) * pow(2, greatest(x, -126) - 7) END"
FP16 = "CASE WHEN f = 0 THEN f ELSE round_even(f / pow(2, greatest(x, -14) - 10), 0) * pow(2, greatest(x, -14) - 10) END"


# --- all codecs of several matrices ------------------------------------------------------------------------

_EXPONENT = """CASE WHEN f = 0 THEN 0 WHEN pow(2, floor(log2(abs(f)))) > abs(f) THEN floor(log2(abs(f))) - 1
WHEN pow(2, floor(log2(abs(f))) + 1) <= abs(f) THEN floor(log2(abs(f))) + 1 ELSE floor(log2(abs(f))) END"""
_APPLY = {
    "original": ("true", "nnz * 64"),
    "all_one": ("lo = 1 AND hi = 1", "0"),
    "const_c": ("d = 1", "64"),
    "binary01": ("b AND NOT (lo = 1 AND hi = 1)", "nnz"),
    "sign2": ("s", "nnz * 2"),
    "sign2_scale": ("d = 2 AND lo = -hi", "nnz + 64"),
} | {c: (f"d <= {2**k}", f"nnz * {k} + d * 64") for c, k in codecs.DICTIONARIES.items()}


def evaluation_sql(entries: str, keys: str) -> str:
    """A CTE `report` for entries e (keys, r, c, v)."""
    exact = [
        f"SELECT {keys}, nnz, '{c}' AS codec, {a} AS applicable, true AS exact, CAST({b} AS BIGINT) AS payload_bits, 0::BIGINT AS changed, 0::DOUBLE AS max_abs_error, 0::DOUBLE AS max_rel_error, 0::DOUBLE AS product_max_rel, 0::DOUBLE AS product_global_rel, {a} AS passes FROM f"
        for c, (a, b) in _APPLY.items()
    ]
    lossy = [
        f"""SELECT {keys}, nnz, '{c}' AS codec, true AS applicable, false AS exact, CAST(nnz * 16 AS BIGINT) AS payload_bits, CAST(n_{c} AS BIGINT) AS changed, a_{c} AS max_abs_error, r_{c} AS max_rel_error,
e_{c} AS product_max_rel, g_{c} AS product_global_rel, e_{c} <= 1e-6 AS passes FROM f JOIN w USING ({keys})"""
        for c in ("fp16", "bf16")
    ]
    by_row = ", ".join(
        f"sum(CASE WHEN isinf(v_{c}) THEN 0 ELSE v_{c} - v END * p) AS d_{c}, count(*) FILTER (v_{c} <> v) AS n_{c}, max(abs(v_{c} - v)) AS a_{c}, max(abs(v_{c} - v) / greatest(abs(v), 1e-30)) AS r_{c}, bool_or(isinf(v_{c})) AS l_{c}" for c in ("fp16", "bf16")
    )
    whole = ", ".join(
        f"""sum(n_{c}) AS n_{c}, max(a_{c}) AS a_{c}, max(r_{c}) AS r_{c}, CASE WHEN bool_or(l_{c}) THEN 'inf'::DOUBLE ELSE max(abs(d_{c}) / greatest(abs(y), 1e-30)) END AS e_{c},
CASE WHEN bool_or(l_{c}) THEN 'inf'::DOUBLE ELSE max(abs(d_{c})) / greatest(max(abs(y)), 1e-30) END AS g_{c}"""
        for c in ("fp16", "bf16")
    )
    probe = f"(CASE WHEN {HASH.format('c')} % 2001 = 1000 THEN 1 ELSE {HASH.format('c')} % 2001 - 1000 END) / 257.0::DOUBLE"
    return f"""{entries},
f AS (SELECT {keys}, count(*) AS nnz, least(count(DISTINCT v), 65537) AS d, min(v) AS lo, max(v) AS hi, bool_and(v IN (0, 1)) AS b, bool_and(v IN (-1, 0, 1)) AND bool_or(v = -1) AS s FROM e GROUP BY {keys}),
z AS (SELECT *, CAST({_EXPONENT} AS INTEGER) AS x FROM (SELECT *, CAST(CAST(v AS FLOAT) AS DOUBLE) AS f FROM e)),
q AS (SELECT *, CASE WHEN abs(f) >= 65520 THEN sign(f) * 'inf'::DOUBLE ELSE {FP16} END AS v_fp16, {BF16} AS v_bf16, {probe} AS p FROM z),
y AS (SELECT {keys}, r, sum(v * p) AS y, {by_row} FROM q GROUP BY {keys}, r),
w AS (SELECT {keys}, {whole} FROM y GROUP BY {keys}),
report AS ({' UNION ALL '.join(exact + lossy)})"""


_ROUNDED_ERRORS = "round(max_abs_error, 9) AS max_abs_error, round(max_rel_error, 9) AS max_rel_error, round(product_global_rel, 9) AS product_global_rel"
SHIPPED = """l AS (SELECT CAST(coalesce(year(l_shipdate), 0) AS INTEGER) AS year, l_partkey AS r, l_suppkey AS c, sum(l_quantity) AS quantity, max(l_discount) AS discount, max(l_extendedprice) AS price, CAST(count(*) AS DOUBLE) AS lines FROM lineitem GROUP BY ALL),
e AS (SELECT year, field, r, c, v FROM (UNPIVOT l ON quantity, discount, price, lines INTO NAME field VALUE v) WHERE v <> 0)"""


@query(f"""WITH {evaluation_sql(SHIPPED, 'year, field')}
SELECT year, field, nnz, codec, applicable, exact, payload_bits, changed, {_ROUNDED_ERRORS}, passes, passes AND codec = arg_min(codec, (payload_bits, codec)) FILTER (passes) OVER (PARTITION BY year, field) AS chosen FROM report""")
def codec_evaluation(spark, d):
    keys = ["year", "field"]
    report = evaluation.chosen(evaluation.evaluated(shipments(table(spark, d, "lineitem")), keys), keys)
    return rounded(report.drop("product_max_rel"), 9, "max_abs_error", "max_rel_error", "product_global_rel")


_BY_LABEL = EMBED.replace("e AS", "e0 AS", 1) + ", e AS (SELECT label, r, c, v FROM e0 JOIN embeddings ON r = vec_id)"


@query(f"WITH {evaluation_sql(_BY_LABEL, 'label')} SELECT label, nnz, codec, applicable, exact, payload_bits, changed, {_ROUNDED_ERRORS}, passes FROM report")
def codec_evaluation_embed(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    entries = embedding_matrix(spark, d).entries.join(own, F.col("row") == F.col("id")).select("label", "row", "col", "value")
    return rounded(evaluation.evaluated(entries, ["label"]).drop("product_max_rel"), 9, "max_abs_error", "max_rel_error", "product_global_rel")


# --- rounding codecs --------------------------------------------------------------------------------------



def _rounded_sql(entries: str, how: str, out: str = "e", source: str = "e0") -> str:
    base = entries.replace("e AS", f"{source} AS", 1)
    return f"{base}, {out}f AS (SELECT r, c, v AS v0, CAST(CAST(v AS FLOAT) AS DOUBLE) AS f FROM {source}), {out}x AS (SELECT *, CAST(CASE WHEN f = 0 THEN 0 WHEN pow(2, floor(log2(abs(f)))) > abs(f) THEN floor(log2(abs(f))) - 1 WHEN pow(2, floor(log2(abs(f))) + 1) <= abs(f) THEN floor(log2(abs(f))) + 1 ELSE floor(log2(abs(f))) END AS INTEGER) AS x FROM {out}f), {out} AS (SELECT r, c, v0, {how} AS v FROM {out}x)"


def _embed_product(spark, d, m):
    return rounded(spmv(m, input_vector(spark, m.cols)), 6, "y")


@query(spmv_sql(_rounded_sql(EMBED, BF16), EX, EROWS, 6))
def spmv_bf16(spark, d):
    m = embedding_matrix(spark, d)
    return _embed_product(spark, d, codecs.rounded(m, bf16))


@query(spmv_sql(_rounded_sql(EMBED, FP16), EX, EROWS, 6))
def spmv_fp16(spark, d):
    m = embedding_matrix(spark, d)
    return _embed_product(spark, d, codecs.rounded(m, fp16))


@query(spmv_sql(_rounded_sql(EMBED, FP16), EX, EROWS, 6))
def spmv_fp16_tile512(spark, d):
    m = embedding_matrix(spark, d)
    return _embed_product(spark, d, m.with_entries(payload.from_word_tiles(payload.word_tiles(m, "fp16"), "fp16")))


@query(spmv_sql(_rounded_sql(EMBED, BF16), EX, EROWS, 6))
def spmv_bf16_tile512(spark, d):
    m = embedding_matrix(spark, d)
    return _embed_product(spark, d, m.with_entries(payload.from_word_tiles(payload.word_tiles(m, "bf16"), "bf16")))


@query(f"WITH {_rounded_sql(ORDERS, BF16)} SELECT count(*) FILTER (v <> v0) AS changed, count(*) FILTER (v <> v0) / count(*) AS changed_ratio, max(abs(v - v0)) AS max_abs_error, round(max(abs(v - v0) / greatest(abs(v0), 1e-30)), 12) AS max_rel_error FROM e")
def codec_report_rounding(spark, d):
    m = order_by_part(spark, d)
    return metrics.value_errors(m.entries, codecs.rounded(m, bf16).entries).withColumn("max_rel_error", F.round("max_rel_error", 12))


def _bfp_sql(entries: str, levels: int, source: str = "b0", out: str = "e") -> str:
    """Entries as block floating point of 8x4 tiles decodes them."""
    base = entries.replace("e AS", f"{source} AS", 1)
    scale = f"{out}s AS (SELECT br AS r, bc AS c, max(abs(v)) / {levels}::DOUBLE AS v FROM (SELECT r // 8 AS br, c // 4 AS bc, v FROM {source}) GROUP BY ALL)"
    rounded_scale = _rounded_sql("e AS (SELECT * FROM " + f"{out}s)", BF16, f"{out}q", f"{out}p")
    dec = f"{out} AS (SELECT a.r, a.c, greatest(-{levels}, least({levels}, sign(a.v / z) * floor(abs(a.v / z) + 0.5::DOUBLE))) * z AS v FROM {source} a JOIN (SELECT r AS br, c AS bc, CASE WHEN v = 0 THEN 1 ELSE v END AS z FROM {out}q) ON a.r // 8 = br AND a.c // 4 = bc)"
    return f"{base}, {scale}, {rounded_scale}, {dec}"


@query(spmv_sql(_bfp_sql(EMBED, 127), EX, EROWS, 6))
def spmv_bfp8(spark, d):
    return _embed_product(spark, d, codecs.bfp8(embedding_matrix(spark, d)))


@query(spmv_sql(_bfp_sql(EMBED, 7), EX, EROWS, 6))
def spmv_bfp4(spark, d):
    return _embed_product(spark, d, codecs.bfp4(embedding_matrix(spark, d)))


# --- payloads as bytes --------------------------------------------------------------------------------------


def _through_bytes(name: str):
    """The product of values that come from code words of a dictionary, packed in tiles."""

    def run(spark, d):
        m = pattern(spark, d, name)
        coded, book, n = payload.interned([m.entries])
        bits = payload.width_of(n)
        codes = payload.unpacked(payload.packed(coded[0].withColumnRenamed("id", "code"), bits), bits)
        return spmv(m.with_entries(codecs.from_dictionary(codes.withColumnRenamed("code", "id"), book)), input_vector(spark, m.cols))

    return run


for _name in codecs.DICTIONARIES:
    query(spmv_sql(pattern_sql(_name)), f"spmv_packed_{_name}")(_through_bytes(_name))


def _floating(bits: int):
    def run(spark, d):
        m = embedding_matrix(spark, d)
        return _embed_product(spark, d, m.with_entries(payload.from_floating_tiles(payload.floating_tiles(m, bits), bits)))

    return run


query(spmv_sql(_bfp_sql(EMBED, 127), EX, EROWS, 6), "spmv_packed_bfp8")(_floating(8))
query(spmv_sql(_bfp_sql(EMBED, 7), EX, EROWS, 6), "spmv_packed_bfp4")(_floating(4))

_WIDTHS = {"dict2": 1, "dict4": 2, "dict16": 4, "dict256": 8, "dict65536": 16}
_SIZES = [f"SELECT '{c}' AS codec, (SELECT count(*) FROM t) AS tiles, (SELECT count(*) FROM t) * {4 * bits} AS bytes" for c, bits in _WIDTHS.items()]
_SIZES += [f"SELECT '{c}', (SELECT count(*) FROM t), (SELECT count(*) FROM t) * {4 * bits + 2}" for c, bits in (("bfp4", 4), ("bfp8", 8))]


@query(f"WITH {E}, {TILES} {' UNION ALL '.join(_SIZES)}")
def payload_sizes(spark, d):
    m, out = parts(spark, d), None
    code = F.pmod(F.col("row") * 31 + F.col("col"), F.lit(1 << 16))
    made = {c: payload.packed(m.entries.withColumn("code", code % (1 << bits)), bits) for c, bits in _WIDTHS.items()}
    made |= {f"bfp{bits}": payload.floating_tiles(m, bits) for bits in (4, 8)}
    for c, t in made.items():
        one = t.agg(F.count("*").alias("tiles"), F.sum(F.octet_length("payload")).cast("long").alias("bytes")).select(F.lit(c).alias("codec"), "tiles", "bytes")
        out = one if out is None else out.unionAll(one)
    return out


_FIRST_SIGHT = f"""{E}, {TILES},
p AS (SELECT e.*, r // 8 AS br, r % 8 * 4 + c % 4 AS cell, c // 4 AS bc, CASE WHEN nnz <= 8 THEN 1 ELSE 0 END AS part FROM e JOIN t ON r // 8 = t.br AND c // 4 = t.bc),
f AS (SELECT v, row_number() OVER (ORDER BY part, br, bc, cell) - 1 AS id FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY part, br, bc, cell) AS nth FROM p) WHERE nth = 1)"""


def _interned(spark, d):
    m = parts(spark, d)
    return payload.interned(list(split.parted(m, split.marked(tiles.shapes(m), 8))))


@query(f"WITH {_FIRST_SIGHT} SELECT part, r, c, id FROM p JOIN f USING (v)")
def intern_first_sight(spark, d):
    (kept, residual), _, _ = _interned(spark, d)
    each = [x.select(F.lit(k).alias("part"), F.col("row").alias("r"), F.col("col").alias("c"), "id") for k, x in enumerate((kept, residual))]
    return each[0].unionAll(each[1])


@query(f"""WITH {_FIRST_SIGHT}, {X}, n AS (SELECT CASE WHEN count(*) <= 256 THEN 'dict_u8' ELSE 'dict_u16' END AS form FROM f)
SELECT form, r AS "row", sum(v * val) AS y FROM p JOIN x ON c = idx, n GROUP BY ALL""")
def spmv_joint_interned(spark, d):
    """Kept tiles as packed code words and residual entries as ids of one codebook; the number of values decides the width."""
    parts_, book, n = _interned(spark, d)
    form = payload.joint_form(n)
    bits = 8 if form == "dict_u8" else 16
    kept = payload.unpacked(payload.packed(parts_[0].withColumnRenamed("id", "code"), bits), bits).withColumnRenamed("code", "id")
    e = codecs.from_dictionary(kept.unionByName(parts_[1]), book)
    x = input_vector(spark, parts(spark, d).cols)
    p = e.join(x, F.col("col") == F.col("idx"))
    return p.groupBy("row").agg(F.sum(F.col("value") * F.col("val")).alias("y")).select(F.lit(form).alias("form"), "row", "y")


def _outlier_sql() -> str:
    base = EMBED.replace("e AS", "a0 AS", 1)
    th = "th AS (SELECT a AS t FROM (SELECT abs(v) AS a, row_number() OVER (ORDER BY abs(v)) - 1 AS k, count(*) OVER () AS n FROM a0) WHERE k = floor((1 - 0.005::DOUBLE) * n))"
    bulk = _bfp_sql("e AS (SELECT a0.* FROM a0, th WHERE abs(v) <= t)", 127, "b0", "bulk")
    return f"{base}, {th}, {bulk}, e AS (SELECT * FROM bulk UNION ALL SELECT a0.* FROM a0, th WHERE abs(v) > t)"


@query(spmv_sql(_outlier_sql(), EX, EROWS, 6))
def spmv_bfp8_outlier(spark, d):
    m = embedding_matrix(spark, d)
    return rounded(spmv_parts(m, list(codecs.bfp8_outlier(m)), input_vector(spark, m.cols)), 6, "y")


@query(_outlier_sql().join(["WITH ", " SELECT count(*) AS nnz, count(*) FILTER (abs(v) > t) AS outliers, count(*) - count(*) FILTER (abs(v) > t) + 2 * count(DISTINCT (r // 8, c // 4)) + 16 * count(*) FILTER (abs(v) > t) AS payload_bytes FROM a0, th"]))
def outlier_payload(spark, d):
    m = embedding_matrix(spark, d)
    out = F.abs("value") > F.col("threshold")
    e = m.entries.join(F.broadcast(codecs.outlier_threshold(m)))
    n = F.count_if(out)
    tiles_ = F.count_distinct(F.expr("row DIV 8"), F.expr("col DIV 4"))
    return e.agg(F.count("*").alias("nnz"), n.alias("outliers"), (F.count("*") - n + tiles_ * 2 + n * codecs.OUTLIER_BYTES).alias("payload_bytes"))


#: Ties of the residual's rounding go away from zero.
BF16_UP = BF16.replace("round_even(f / pow(2, greatest(x, -126) - 7), 0)", "sign(f) * floor(abs(f) / pow(2, greatest(x, -126) - 7) + 0.5::DOUBLE)")
_KEPT = "e AS (SELECT a.* FROM a0 a JOIN s ON r // 8 = br AND c // 4 = bc WHERE NOT residual)"
_RES = "e AS (SELECT a.* FROM a0 a JOIN s ON r // 8 = br AND c // 4 = bc WHERE residual)"
_SPLIT = TILES.replace("FROM e GROUP", "FROM a0 GROUP") + ", s AS (SELECT *, nnz <= 32 AND nnz < 10 AS residual FROM t)"
_ORD = E.replace("e AS", "a0 AS", 1).replace("CAST(sum(l_quantity) AS DOUBLE)", "CAST(sum(l_extendedprice) AS DOUBLE)").replace("sum(l_quantity) <> 0", "sum(l_extendedprice) <> 0")


def _joint_sql() -> str:
    return f"{_ORD}, {_SPLIT}, {_bfp_sql(_KEPT, 127, 'k0', 'k')}, {_rounded_sql(_RES, BF16_UP, 'w', 'w0')}, e AS (SELECT r, c, v FROM k UNION ALL SELECT r, c, v FROM w)"


def _priced(spark, d):
    from ..sources.tables import table

    m = parts(spark, d)
    e = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_extendedprice").alias("value"))
    m = m.with_entries(e.filter("value <> 0"))
    s = split.marked(tiles.shapes(m), 32, split.Costs())
    return m, *split.parted(m, s)


@query(spmv_sql(_joint_sql(), X, digits=5))
def spmv_joint_bfp8(spark, d):
    m, kept, residual = _priced(spark, d)
    return rounded(spmv_parts(m, codecs.joint(m.with_entries(kept), residual), input_vector(spark, m.cols)), 5, "y")


@query(spmv_sql(E))
def spmv_joint_dict(spark, d):
    m = parts(spark, d)
    s = split.marked(tiles.shapes(m), 32, split.Costs())
    coded, book = codecs.dictionary(m, 65536)
    e = m.with_entries(codecs.from_dictionary(coded, book))
    return spmv_parts(m, list(split.parted(e, s)), input_vector(spark, m.cols))


def _joint_outlier_sql() -> str:
    th = "th AS (SELECT a AS t FROM (SELECT abs(v) AS a, row_number() OVER (ORDER BY abs(v)) - 1 AS k, count(*) OVER () AS n FROM kk) WHERE k = floor((1 - 0.005::DOUBLE) * n))"
    kept = _KEPT.replace("e AS", "kk AS", 1)
    bulk = _bfp_sql("e AS (SELECT kk.* FROM kk, th WHERE abs(v) <= t)", 127, "k0", "k")
    return f"{_ORD}, {_SPLIT}, {kept}, {th}, {bulk}, {_rounded_sql(_RES, BF16_UP, 'w', 'w0')}, e AS (SELECT r, c, v FROM k UNION ALL SELECT r, c, v FROM w UNION ALL SELECT kk.r, kk.c, kk.v FROM kk, th WHERE abs(v) > t)"


@query(spmv_sql(_joint_outlier_sql(), X, digits=5))
def spmv_joint_outlier(spark, d):
    m, kept, residual = _priced(spark, d)
    bulk, out = codecs.bfp8_outlier(m.with_entries(kept))
    joint = codecs.joint(m.with_entries(kept), residual)
    return rounded(spmv_parts(m, [bulk, joint[1], out], input_vector(spark, m.cols)), 5, "y")


@query(spmv_sql(E))
def spmv_codebook256(spark, d):
    """139 distinct values fit the codebook, so it is exact."""
    m = parts(spark, d)
    return spmv(codecs.codebook256(m), input_vector(spark, m.cols))


def _kmeans(k: int):
    def run(spark, d):
        m = embedding_matrix(spark, d)
        return rounded(spmv(codecs.log_kmeans(m, k), deterministic_vector(spark, m.cols)), 4, "y")

    return run


for _k in (16, 32, 64, 128):
    query(None, f"spmv_logkmeans{_k}")(_kmeans(_k))


def _bfp_error(levels: int) -> str:
    return f"(WITH {_bfp_sql(EMBED, levels)} SELECT round(sum(abs(e.v - b0.v)) / sum(abs(b0.v)), 9) FROM e JOIN b0 USING (r, c))"


@query(f"SELECT 'bfp8' AS codec, {_bfp_error(127)} AS rel_l1 UNION ALL SELECT 'bfp4', {_bfp_error(7)}")
def bfp_value_error(spark, d):
    m = embedding_matrix(spark, d)
    out = None
    for n, levels in (("bfp8", 127), ("bfp4", 7)):
        b = codecs.block_floating(m, levels)
        one = b.agg(F.round(F.sum(F.abs(F.col("decoded") - F.col("value"))) / F.sum(F.abs("value")), 9).alias("rel_l1")).select(F.lit(n).alias("codec"), "rel_l1")
        out = one if out is None else out.unionAll(one)
    return out


# --- statistics of values ---------------------------------------------------------------------------------


@query(f"WITH {E} SELECT count(*) FILTER (v = 0) AS zeros, bool_and(v = 1) AS all_one, bool_and(v IN (0, 1)) AS is_binary, bool_and(v IN (-1, 0, 1)) AS sign_only, least(count(DISTINCT v), 16) AS distinct_capped, count(DISTINCT v) > 16 AS overflow, min(v) AS low, max(v) AS high FROM e")
def value_stats(spark, d):
    return profile.value_stats(parts(spark, d))


@query(f"WITH {E} SELECT v AS value, count(*) AS n FROM e GROUP BY v")
def value_histogram(spark, d):
    return profile.histogram(parts(spark, d))


@query(f"WITH {E}, h AS (SELECT count(*) AS n FROM e GROUP BY v) SELECT round(-sum(n / t * log2(n / t)), 9) AS entropy FROM h, (SELECT sum(n) AS t FROM h)")
def value_entropy(spark, d):
    return profile.entropy(parts(spark, d)).select(F.round("entropy", 9).alias("entropy"))


@query(f"WITH {EMBED}, b AS (SELECT CASE WHEN v = 0 THEN 0 WHEN isnan(v) OR abs(v) = 'Infinity'::DOUBLE THEN 17 ELSE 1 + greatest(0, least(15, trunc((floor(log2(abs(v))) + 64) / 8))) END AS bin FROM e) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY bin")
def abs_log2_hist(spark, d):
    return profile.magnitude_histogram(embedding_matrix(spark, d))


@query(f"WITH {EMBED}, b AS (SELECT CASE WHEN v = 0 THEN 0 WHEN isnan(v) OR abs(v) = 'Infinity'::DOUBLE THEN 17 ELSE 1 + greatest(0, least(15, trunc((floor(log2(abs(v))) + 64) / 8))) END AS bin FROM e), h AS (SELECT count(*) AS n FROM b GROUP BY bin) SELECT round(-sum(n / t * log2(n / t)), 9) + 0 AS entropy FROM h, (SELECT sum(n) AS t FROM h)")
def abs_log2_entropy(spark, d):
    return rounded(profile.magnitude_entropy(embedding_matrix(spark, d)), 9, "entropy")


@query(f"WITH {E} SELECT DISTINCT v AS value FROM e ORDER BY v LIMIT 17")
def sorted_unique(spark, d):
    return profile.sorted_unique(parts(spark, d), 16)


@query(f"WITH {E}, h AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC) AS k FROM e GROUP BY v) SELECT count(*) AS distinct_values, " + ", ".join(f"sum(n) FILTER (k <= {t}) * 100.0::DOUBLE / sum(n) AS top{t}" for t in (1, 16, 64, 256, 1024)) + " FROM h")
def value_freq_topk(spark, d):
    return profile.concentration(parts(spark, d))


@query(
    f"WITH {E}, t AS (SELECT count(DISTINCT v) AS u, count(*) AS n FROM e GROUP BY r // 8, c // 4), g AS (SELECT count(DISTINCT v) AS gu FROM e) SELECT count(*) AS blocks, count(*) FILTER (u = 1) * 100.0::DOUBLE / count(*) AS const_pct, count(*) FILTER (u <= 4) * 100.0::DOUBLE / count(*) AS le4_pct, "
    "any_value(gu) AS global_u, sum(u) / greatest(any_value(gu), 1) AS locality, sum(u * 8 + n) * 100.0::DOUBLE / (sum(n) * 8) AS local_pct, (any_value(gu) * 8 + sum(n) * greatest(1, ceil(log2(greatest(any_value(gu), 2)))) / 8.0::DOUBLE) * 100.0::DOUBLE / (sum(n) * 8) AS global_pct FROM t, g"
)
def tile_distinct(spark, d):
    return profile.tile_dictionaries(parts(spark, d))


# --- gates ------------------------------------------------------------------------------------------------


@query(spmv_sql(E))
def spmv_gated_fallback(spark, d):
    """Four-bit blocks fail the gate on these values, so the exact operator's result is returned."""
    m = parts(spark, d)
    return gated(m, input_vector(spark, m.cols), ["bfp4_lb", "original_lb"])[1]


@query(f"WITH {_outlier_sql().replace('e AS (SELECT * FROM bulk', 'o AS (SELECT * FROM bulk')}, {_bfp_sql('e AS (SELECT * FROM a0)', 127, 'p0', 'p')}, {EX}, y0 AS (SELECT r, sum(v * val) AS y FROM a0 JOIN x ON c = idx GROUP BY r), y1 AS (SELECT r, sum(v * val) AS y FROM p JOIN x ON c = idx GROUP BY r), y2 AS (SELECT r, sum(v * val) AS y FROM o JOIN x ON c = idx GROUP BY r) SELECT round(max(abs(y1.y - y0.y)) / max(abs(y0.y)), 9) AS bfp8_global, round(max(abs(y2.y - y0.y)) / max(abs(y0.y)), 9) AS outlier_global FROM y0 JOIN y1 USING (r) JOIN y2 USING (r)")
def outlier_acceptance(spark, d):
    m = embedding_matrix(spark, d)
    x = input_vector(spark, m.cols)
    y, a, b = spmv(m, x), spmv(codecs.bfp8(m), x), spmv_parts(m, list(codecs.bfp8_outlier(m)), x)
    one = lambda z, c: metrics.compared(y, z).select(F.round("global_rel", 9).alias(c))
    return one(a, "bfp8_global").join(one(b, "outlier_global"))
