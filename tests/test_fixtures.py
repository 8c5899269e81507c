"""Small matrices with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from mosaik.functions import rounding
from mosaik.functions.bounded import distinct_upto
from mosaik.matrix import Matrix
from mosaik.operators import codecs, coo, metrics, payload, profile, results, solvers, split, study, tiles
from mosaik.operators.spmv import spmv
from mosaik.sources import matrix_market as MM
from mosaik.sources import tables as T


def matrix(spark, rows, cols, entries):
    return Matrix(spark.createDataFrame([(r, c, float(v)) for r, c, v in entries], "row long, col long, value double"), rows, cols)


def csr(ptr, col, val):
    return [(r, col[k], val[k]) for r in range(len(ptr) - 1) for k in range(ptr[r], ptr[r + 1])]


def collected(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


@pytest.fixture(scope="module")
def f1(spark):
    return matrix(spark, 4, 4, csr([0, 2, 3, 5, 6], [0, 3, 1, 0, 2, 3], [1, 2, 3, 4, 5, 6]))


@pytest.fixture(scope="module")
def f5(spark):
    return matrix(spark, 4, 8, csr([0, 3, 4, 6, 7], [0, 1, 4, 0, 2, 3, 7], [1, 2, 3, 4, 5, 6, 7]))


def test_tiles_of_a_small_matrix(f1):
    t = tiles.tiled(f1, 2, 2)
    assert [(r.br, r.bc, r.bitmap, r["values"]) for r in t.orderBy("br", "bc").collect()] == [(0, 0, 9, [1.0, 3.0]), (0, 1, 2, [2.0]), (1, 0, 1, [4.0]), (1, 1, 9, [5.0, 6.0])]
    assert [r.val_ptr for r in tiles.value_pointers(tiles.shapes(f1, 2, 2)).orderBy("br", "bc").collect()] == [0, 2, 3, 4]
    assert sorted(tiles.decoded(t, 2, 2).collect()) == sorted(f1.entries.collect())
    assert tiles.tile_violations(t, f1, 2, 2).count() == 0
    broken = t.withColumn("values", F.array(F.lit(0.0)))
    assert {r.rule for r in tiles.tile_violations(broken, f1, 2, 2).collect()} == {"popcount", "stored zero"}


def test_product_of_a_small_matrix(spark, f1):
    x = spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "idx long, val double")
    assert collected(spmv(f1, x), "row") == [(0, 9.0), (1, 6.0), (2, 19.0), (3, 24.0)]
    empty = Matrix(f1.entries.filter("row = 0"), 3, 4)
    assert collected(spmv(empty, x), "row") == [(0, 9.0), (1, 0.0), (2, 0.0)]


def test_zeros_go_and_rules_are_watched(spark):
    m = matrix(spark, 2, 4, csr([0, 3, 5], [0, 1, 2, 1, 3], [0, 2, 0, 3, 0]))
    assert sorted(r.value for r in coo.without_zeros(m.entries).collect()) == [2.0, 3.0]
    bad = matrix(spark, 2, 2, [(0, 0, 0), (0, 5, 1), (-1, 0, 1), (1, 1, 1), (1, 1, 2)])
    assert {(r.rule, r.n) for r in coo.violations(bad).collect()} == {("stored zero", 1), ("column outside", 1), ("row outside", 1), ("duplicate", 1)}
    assert coo.violations(bad.with_entries(bad.entries.limit(0))).count() == 0


def test_splits(spark, f5):
    s = tiles.shapes(f5, 2, 2)
    by_size = split.marked(s, 1)
    kept, residual = split.parted(f5, by_size, 2, 2)
    assert sorted(r.value for r in residual.collect()) == [3.0, 7.0] and kept.count() == 5
    gated = split.marked(s, 3, split.Costs(2, 0, 0, 1)).agg(F.count_if("residual"), F.count_if("cost_skipped"), F.sum(F.when(F.col("cost_skipped"), F.col("nnz")))).first()
    assert tuple(gated) == (2, 2, 5)
    p = tiles.blockrow_coo(residual, 2, 2)
    assert collected(p, "br") == [(0, 8, 3.0), (1, 15, 7.0)]
    assert sorted(tiles.from_blockrow_coo(p, 2, 2).collect()) == sorted(residual.collect())
    sell = tiles.sliced(f5.with_entries(residual), 2)
    assert collected(sell.select("col", "value", "slice", "k", "lane"), "slice", "k", "lane") == [(4, 3.0, 0, 0, 0), (-1, 0.0, 0, 0, 1), (-1, 0.0, 1, 0, 0), (7, 7.0, 1, 0, 1)]
    assert sorted(tiles.from_sliced(sell, 2).collect()) == sorted(residual.collect())


def test_value_reports(spark):
    tern = matrix(spark, 3, 3, [(0, 0, 1), (0, 1, -1), (1, 1, 0), (2, 0, 1), (2, 2, -1)])
    assert profile.entropy(tern).first()[0] == pytest.approx(1.5219280948873621)
    f = codecs.facts(tern)
    bits = f.select(codecs.host_bits("original").alias("o"), codecs.host_bits("sign2").alias("s"), codecs.host_bits("dict4").alias("d4"), codecs.host_bits("dict16").alias("d16")).first()
    assert tuple(bits) == (320, 10, 202, 212)
    two = codecs.facts(matrix(spark, 2, 4, [(r, c, 2 if (r + c) % 2 else 7) for r in range(2) for c in range(4)]))
    assert tuple(two.select(*[codecs.host_bits(c) for c in codecs.DICTIONARIES]).first()) == (136, 144, 160, 192, 256)
    s = profile.value_stats(matrix(spark, 3, 3, [(0, 0, 1), (0, 1, 1), (1, 1, 0), (2, 2, 1)])).first()
    assert (s.zeros, s.all_one, s.is_binary, s.distinct_capped) == (1, False, True, 2)


DENSE = [(r, c) for r in range(8) for c in range(4)]


@pytest.mark.parametrize(
    "value, codec, size",
    [(lambda r, c: 1, "all_one", 0), (lambda r, c: 2.5, "const_c", 8), (lambda r, c: (-1) ** (r + c), "sign2", 4), (lambda r, c: 2.5 * (-1) ** (r + c), "sign2_scale", 12), (lambda r, c: (2, -3, 5)[(r + c) % 3], "dict4", 32)],
)
def test_the_codec_that_is_chosen(spark, value, codec, size):
    r = codecs.auto_lossless(matrix(spark, 8, 4, [(r, c, value(r, c)) for r, c in DENSE])).first()
    assert (r.codec, r.payload_bytes) == (codec, size)


def test_few_entries_stay_as_they_are(spark):
    five = matrix(spark, 4, 8, [(0, 0, 1), (0, 5, 2), (1, 1, 3), (2, 2, 4), (3, 7, 5)])
    assert tuple(codecs.auto_lossless(five).first())[:2] == ("original", 5)
    assert codecs.auto_lossless(five.with_entries(five.entries.limit(0))).first().codec == "original"


def test_rounding(spark):
    v = spark.createDataFrame([(x,) for x in (1.0, 1 / 3, -2.0, 0.125, 65519.0, 65520.0, 1e-8, 0.0, 3.0000001)], "v double")
    got = [tuple(r) for r in v.select(rounding.bf16(F.col("v")), rounding.fp16(F.col("v"))).collect()]
    assert got[:4] == [(1.0, 1.0), (0.333984375, 0.333251953125), (-2.0, -2.0), (0.125, 0.125)]
    assert got[4][1] == 65504.0 and math.isinf(got[5][1]) and got[6][1] == 0.0 and got[7] == (0.0, 0.0)
    half = spark.createDataFrame([(1.00390625,), (-1.00390625,)], "v double")
    assert [tuple(r) for r in half.select(rounding.bf16(F.col("v")), rounding.bf16_half_up(F.col("v"))).collect()] == [(1.0, 1.0078125), (-1.0, -1.0078125)]
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 256, 257)], "n long")
    assert [r[0] for r in n.select(rounding.ceil_log2(F.col("n"))).collect()] == [0, 1, 2, 2, 3, 8, 9]


def test_codebooks(spark):
    m = matrix(spark, 2, 2, [(0, 0, 1), (0, 1, 2), (1, 0, -1), (1, 1, -2)])
    assert codecs.kmeans_centers(m.entries.select(F.log2(F.abs("value")).alias("value")), 16) == [0.0, 1.0]
    assert sorted(codecs.log_kmeans(m, 16).entries.collect()) == sorted(m.entries.collect())
    coded, book = codecs.dictionary(m, 4)
    assert collected(book, "id") == [(0, -2.0), (1, -1.0), (2, 1.0), (3, 2.0)]
    with pytest.raises(ValueError):
        codecs.dictionary(m, 3)
    many = spark.range(5000).select((F.col("id") * 0.01).alias("value"))
    centers = codecs.kmeans_centers(many, 16)
    assert len(centers) == 16 and centers == sorted(centers) and 0 <= centers[0] and centers[-1] <= 50
    got = spark.createDataFrame([(1.5,), (1.6,), (-9.0,)], "v double").select(codecs.nearest(F.col("v"), [1.0, 2.0])).collect()
    assert [r[0] for r in got] == [1.0, 2.0, 1.0]
    assert codecs.codec_name(" Dict256-U8 ") == "dict256"
    with pytest.raises(ValueError):
        codecs.codec_name("zip")


def test_profiles(spark):
    six = matrix(spark, 6, 8, [(0, 0, 1), (0, 2, 1), (0, 4, 1), (2, 0, 1)])
    n = profile.imbalance(tiles.shapes(six, 2, 2), 3).first()
    assert (n.empty_rows, n.p50, n.p90, n.p99, n["max"], n.max_over_avg) == (1, 1, 3, 3, 3, 2.25)
    wide = matrix(spark, 6, 4096, [(0, 100, 1), (0, 104, 1), (0, 120, 1), (2, 700, 1), (2, 900, 1), (2, 1100, 1)])
    cols = wide.with_entries(wide.entries.withColumn("col", F.col("col") * 2))
    d = profile.column_deltas(tiles.shapes(cols, 2, 2)).first()
    assert (d.u8_rows, d.u16_rows) == (1, 2)


def write(tmp_path, text):
    p = tmp_path / "m.mtx"
    p.write_text(text)
    return str(p)


def test_matrix_market_files(spark, tmp_path):
    sym = MM.read(spark, write(tmp_path, "%%MatrixMarket MATRIX coordinate pattern symmetric\n% note\n\n3 3 2\n1 1\n2 3\n"))
    assert sym.expanded_entries == 3 and collected(sym.matrix.entries, "row", "col") == [(0, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    skew = MM.read(spark, write(tmp_path, "%%MatrixMarket matrix coordinate real skew-symmetric\n3 3 1\n1 3 2.5\n"))
    assert collected(skew.matrix.entries, "row") == [(0, 2, 2.5), (2, 0, -2.5)]
    whole = MM.read(spark, write(tmp_path, "%%MatrixMarket matrix coordinate integer general\r\n2 3 2\r\n1 1 7\r\n2 3 -4\r\n9 9 9\r\n"))
    assert collected(whole.matrix.entries, "row") == [(0, 0, 7.0), (1, 2, -4.0)]
    zeros = MM.read(spark, write(tmp_path, "%%MatrixMarket matrix coordinate real general\n3 4 5\n1 1 0\n2 2 2\n2 2 -2\n3 1 5\n3 4 -1\n"))
    assert zeros.matrix.entries.count() == 2 and zeros.coalesced_duplicates == 3
    assert [r.row_ptr for r in coo.row_pointers(zeros.matrix).orderBy("row").collect()] == [0, 0, 0]


@pytest.mark.parametrize(
    "text",
    ["", "%%MatrixMarket matrix array real general\n1 1\n", "%%MatrixMarket matrix coordinate complex general\n1 1 0\n", "%%MatrixMarket matrix coordinate pattern skew-symmetric\n1 1 0\n", "%%MatrixMarket matrix coordinate real general\n", "%%MatrixMarket matrix coordinate real general\n1 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 3\n1 1 1\n"],
)
def test_bad_files_are_refused(spark, tmp_path, text):
    with pytest.raises(ValueError):
        MM.read(spark, write(tmp_path, text))


@pytest.mark.parametrize("entry", ["1 9 1", "x 1 1", "1 1", "0 1 1", "   "])
def test_bad_entries_fail(spark, tmp_path, entry):
    with pytest.raises(Exception, match="bad matrix entry"):
        MM.read(spark, write(tmp_path, f"%%MatrixMarket matrix coordinate real general\n2 2 1\n{entry}\n")).matrix.entries.collect()


def test_conjugate_gradients_solve(spark):
    m = T.banded_spd(spark, 12, 2, 1.0)
    m = m.with_entries(solvers.cut(m.entries))
    x = T.input_vector(spark, 12)
    b = solvers.cut(solvers.times(m)(x))
    curve = solvers.conjugate_gradient(solvers.times(m), b, most=12, tolerances=(1e-6,))
    assert curve.ended == "converged" and curve.steps_to(1e-2) <= curve.steps_to(1e-6) and curve.floor <= 1e-6
    assert max(abs(r.val) for r in solvers.axpy(-1.0, curve.solution, x).collect()) < 1e-4
    minus = solvers.conjugate_gradient(lambda v: solvers.scaled(-1.0, v), b, most=2)
    assert minus.ended == "breakdown"


def test_gates_and_errors(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 4.0)], "row long, y double")
    b = spark.createDataFrame([(0, 1.5), (1, 4.0)], "row long, y double")
    r = metrics.compared(a, b).withColumns({"exact": metrics.exact_gate(), "lossy": metrics.lossy_gate()}).first()
    assert (r.max_abs, r.max_rel, r.global_rel, r.exact, r.lossy) == (0.5, 0.5, 0.125, False, False)
    assert metrics.compared(a, a).select(metrics.exact_gate()).first()[0]


def test_lists_and_shuffles(spark):
    assert results.lpt([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == [["a", "d"], ["b", "c"]]
    g = spark.createDataFrame([(i, i, float(i)) for i in range(50)], "row long, col long, g double")
    s = study.shuffled(g, 3, 50, 50).collect()
    for seed in (1, 2, 3):
        assert sorted(r.g for r in s if r.seed == seed) == [float(i) for i in range(50)] and sum(r.g != r["row"] for r in s if r.seed == seed) > 30
    assert len({tuple(r.g for r in sorted(s, key=lambda r: r["row"]) if r.seed == seed) for seed in (1, 2, 3)}) == 3


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutations_are_one_to_one_and_spread(spark, n):
    t = spark.range(n).select(F.col("id").alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seed"))
    got = t.withColumn("at", study.permuted(F.col("k"), n, F.col("seed"), 2)).orderBy("seed", "k").collect()
    for seed in (1, 2):
        assert sorted(r.at for r in got if r.seed == seed) == list(range(n))
    if n == 1000:
        near = [abs(a.at - b.at) for a, b in zip(got, got[1:], strict=False) if a.seed == b.seed]
        assert 250 < sum(near) / len(near) < 420  # a third of n


def test_exact_samples_by_hash(spark):
    t = spark.range(500).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    one = {r.a for r in study.least_hashed(t, 120, "a", "b").collect()}
    assert len(one) == 120 and one == {r.a for r in study.least_hashed(t.repartition(5), 120, "a", "b").collect()}
    assert study.least_hashed(t, 1000, "a", "b").count() == 500
    few = t.limit(99).withColumn("c", F.col("a") * 2)
    assert tuple(study.sampled_spearman(few, "a", "c", "a").first()) == (99, None)
    assert study.sampled_spearman(t.withColumn("c", -F.col("a")), "a", "c", "a", most=200).first() == (200, pytest.approx(-1.0))


@pytest.mark.parametrize("bits", payload.WIDTHS)
def test_code_words_lie_in_bit_order(spark, bits):
    codes = [(r, c, (r * 131 + c * 17 + 5) % (1 << bits)) for r in range(11) for c in range(9) if (r + c) % 3]
    t = payload.packed(spark.createDataFrame(codes, "row long, col long, code long"), bits)
    cells = {}
    for r, c, x in codes:
        cells.setdefault((r // 8, c // 4), {})[r % 8 * 4 + c % 4] = x
    for r in t.collect():
        own = cells[r.br, r.bc]
        whole = sum(x << (k * bits) for k, x in own.items())
        assert bytes(r.payload) == whole.to_bytes(payload.payload_bytes(bits), "little") and r.bitmap == sum(1 << k for k in own)
    assert sorted(map(tuple, payload.unpacked(t, bits).collect())) == codes
    assert payload.violations(t, bits).count() == 0
    short = t.withColumn("payload", F.expr("substring(payload, 2)"))
    assert [tuple(r) for r in payload.violations(short, bits).collect()] == [("payload size", t.count())]
    fewer = t.withColumn("bitmap", F.lit(0))
    assert {r.rule for r in payload.violations(fewer, bits).collect()} == {"code without entry", "empty tile"}
    with pytest.raises(ValueError):
        payload.payload_bytes(3)


def test_scaled_tiles_have_a_scale_and_signed_numbers(spark):
    m = matrix(spark, 16, 8, [(0, 0, 1.0), (0, 1, -1.0), (7, 3, 0.3), (8, 4, -250.0), (9, 5, 3.0), (15, 7, 0.0)])
    for bits, size in ((8, 34), (4, 18)):
        t = payload.floating_tiles(m, bits)
        assert {len(r.payload) for r in t.collect()} == {size} and payload.violations(t, bits, scaled=True).count() == 0
        want = {8: codecs.bfp8, 4: codecs.bfp4}[bits](m).entries.collect()
        assert sorted(map(tuple, payload.from_floating_tiles(t, bits).collect())) == sorted(map(tuple, want))


def test_interning_goes_by_first_sight_and_bits(spark):
    kept = matrix(spark, 16, 8, [(8, 0, 5.0), (0, 4, 0.0), (1, 0, 7.0), (0, 1, -0.0)]).entries
    rest = matrix(spark, 16, 8, [(0, 0, 9.0), (15, 7, 7.0)]).entries
    parts, book, n = payload.interned([kept, rest])
    assert [(r.id, str(r.value)) for r in book.orderBy("id").collect()] == [(0, "-0.0"), (1, "7.0"), (2, "0.0"), (3, "5.0"), (4, "9.0")] and n == 5
    assert sorted(map(tuple, parts[1].collect())) == [(0, 0, 4), (15, 7, 1)]
    many = spark.range(65537).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("col"), F.col("id").cast("double").alias("value"))
    assert payload.interned([many]) is None and payload.interned([many.limit(65536)])[2] == 65536
    assert [payload.joint_form(x) for x in (2, 256, 257, 65536, None)] == ["dict_u8", "dict_u8", "dict_u16", "dict_u16", "bfp8"]


@pytest.mark.parametrize("cap", [2, 16, 256])
def test_counts_of_distinct_values_stop_at_their_bound(spark, cap):
    for n in (0, 1, cap - 1, cap, cap + 1, 3 * cap, 50 * cap):
        t = spark.range(n).select((F.col("id") * 0.25).alias("v")).repartition(3)
        assert t.agg(distinct_upto(F.col("v"), cap)).first()[0] == min(n, cap + 1)


def test_parts_of_a_matrix_file_are_read_in_splits(spark, tmp_path):
    e = [(i, i * 7 % 50, float(i % 5 - 2)) for i in range(2000)]
    m = matrix(spark, 2000, 50, e)
    path = str(tmp_path / "market")
    MM.write(m, path, ["note"] * 300, parts=7)
    assert len([p for p in (tmp_path / "market").iterdir() if p.name.startswith("part-")]) == 8
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("512", "4096", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = MM.read(spark, path, drop_zeros=False)
            assert sorted(map(tuple, got.matrix.entries.collect())) == e and got.stored_entries == 2000
        whole = tmp_path / "whole.mtx"
        head = "%%MatrixMarket matrix coordinate real general\n" + "% note\n" * 500
        whole.write_text(head + "2000 50 1500\n" + "".join(f"{r + 1} {c + 1} {v}\n" for r, c, v in e))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        assert sorted(map(tuple, MM.read(spark, str(whole), drop_zeros=False).matrix.entries.collect())) == e[:1500]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
