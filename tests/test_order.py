import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaik.matrix import Matrix
from mosaik.operators import codecs, coo, split, study, tiles
from mosaik.operators.order import cells, digits, running
from mosaik.sources import matrix_market
from mosaik.sources.tables import _extent


@pytest.fixture(scope="module")
def lopsided(spark):
    """One row with half of all entries, over columns of several digits."""
    rng = np.random.default_rng(5)
    hot = [(7, int(c)) for c in rng.choice(40_000, 4000, replace=False)]
    rest = {(int(r), int(c)) for r, c in zip(rng.integers(0, 9000, 4000), rng.integers(0, 40_000, 4000), strict=True) if r != 7}
    rows = [(r, c, float((r * 31 + c) % 97 + 1)) for r, c in [*hot, *rest]]
    return Matrix(spark.createDataFrame(rows, "row long, col long, value double").repartition(4), 9000, 40_000), sorted(rows)


def test_running_sums_are_those_of_one_sorted_list(lopsided):
    m, rows = lopsided
    got = running(m.entries, [*digits("row"), *digits("col")], "k", F.col("value")).orderBy("row", "col").collect()
    before = np.cumsum([0, *(v for *_, v in rows)])[:-1]
    assert [(r.row, r.col, r.value, r.k) for r in got] == [(*x, int(b)) for x, b in zip(rows, before, strict=True)]
    within = running(m.entries, digits("col"), "k", group=("row",)).orderBy("row", "col").collect()
    seen: dict[int, int] = {}
    for r in within:
        assert r.k == seen.get(r.row, 0)
        seen[r.row] = r.k + 1


def test_long_rows_are_cut_and_sliced(lopsided):
    m, rows = lopsided
    chunks = {(r["row"], r.chunk): r.n for r in split.long_row_chunks(m.entries, 100, 1024).collect()}
    assert chunks == {(7, 0): 1024, (7, 1): 1024, (7, 2): 1024, (7, 3): 4000 - 3072}
    ptr = {r["row"]: r.row_ptr for r in coo.row_pointers(m).collect()}
    assert len(ptr) == 9000 and ptr[8] - ptr[7] == 4000 and ptr[8999] <= len(rows)
    pointed = tiles.value_pointers(tiles.shapes(m)).orderBy("br", "bc").collect()
    assert [r.val_ptr for r in pointed] == np.cumsum([0, *(r.nnz for r in pointed)])[:-1].tolist()
    small = Matrix(m.entries.filter("row < 16 AND col < 400"), 16, 400)
    back = tiles.from_sliced(tiles.sliced(small, 4), 4)
    assert sorted(map(tuple, back.select("row", "col", "value").collect())) == [r for r in rows if r[0] < 16 and r[1] < 400]


def plain_ranks(x):
    x = np.array(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_ranks_with_a_tie_of_half_of_all(spark):
    rng = np.random.default_rng(1)
    a = np.where(np.arange(400) % 2 == 0, 3.0, rng.normal(size=400))
    b = np.round(a + rng.normal(size=400), 1)
    t = spark.createDataFrame([(float(x), float(y), i) for i, (x, y) in enumerate(zip(a, b, strict=True))], "a double, b double, i long")
    assert study.spearman(t, "a", "b").first().rho == pytest.approx(np.corrcoef(plain_ranks(a), plain_ranks(b))[0, 1], abs=1e-9)
    place = lambda x: np.argsort(np.lexsort((np.arange(400), x)))
    assert study.spearman_ordinal(t, "a", "b", "i").first().rho == pytest.approx(np.corrcoef(place(a), place(b))[0, 1], abs=1e-9)
    assert t.select(cells(t, F.col("a")).alias("c"), "a").groupBy("a").agg(F.count_distinct("c").alias("n")).filter("n > 1").count() == 0


def test_outlier_threshold_is_the_plain_one(spark):
    v = np.random.default_rng(2).normal(size=3000)
    m = Matrix(spark.createDataFrame([(i, 0, float(x)) for i, x in enumerate(v)], "row long, col long, value double"), 3000, 1)
    assert codecs.outlier_threshold(m).first().threshold == np.sort(np.abs(v))[int((1 - 0.005) * 3000)]


def plain_kmeans(v, k, rounds=16):
    """Means of equal-width bins, centers at equal shares, Lloyd rounds; nearest, ties to the lower."""
    bins = max(16 * k, min(4096, len(v)))
    at = np.minimum(np.floor((v - v.min()) / ((v.max() - v.min()) / bins)), bins - 1).astype(int)
    use = np.unique(at)
    mean, weight = np.array([v[at == b].mean() for b in use]), np.array([(at == b).sum() for b in use], float)
    centers = np.interp((np.arange(k) + 0.5) / k, (np.cumsum(weight) - weight / 2) / weight.sum(), mean)
    for _ in range(rounds):
        own = np.abs(mean[:, None] - centers[None, :]).argmin(1)
        centers = np.sort([np.average(mean[own == j], weights=weight[own == j]) if (own == j).any() else centers[j] for j in range(k)])
    return centers


@pytest.mark.parametrize("k", [16, 256])
def test_codebooks_are_those_of_numpy(spark, k):
    """Over more distinct values than the codebook holds, so that the centers move."""
    v = np.random.default_rng(3).normal(size=2000) * 5
    v[0] = 0.0
    m = Matrix(spark.createDataFrame([(i, 0, float(x)) for i, x in enumerate(v)], "row long, col long, value double"), 2000, 1)
    centers = plain_kmeans(v, k)
    assert codecs.kmeans_centers(m.entries.select("value"), k) == pytest.approx(centers, abs=1e-9)
    if k == 256:
        got = {r["row"]: r.value for r in codecs.codebook256(m).entries.collect()}
        assert [got[i] for i in range(2000)] == pytest.approx([centers[np.abs(x - centers).argmin()] for x in v], abs=1e-9)
    else:
        logs = plain_kmeans(np.log2(np.abs(v[1:])), k)
        got = {r["row"]: r.value for r in codecs.log_kmeans(m, k).entries.collect()}
        want = [0.0, *(np.sign(x) * 2 ** logs[np.abs(np.log2(abs(x)) - logs).argmin()] for x in v[1:])]
        assert [got[i] for i in range(2000)] == pytest.approx(want, abs=1e-9)


def test_constants_are_found_from_the_values(spark):
    at = lambda f: Matrix(spark.createDataFrame([(r, c, f(r, c)) for r in range(20) for c in range(9) if (r + c) % 3], "row long, col long, value double"), 20, 9)
    for codec, f in {"const_c": lambda r, c: -4.25, "all_one": lambda r, c: 1.0, "sign2": lambda r, c: (-1.0) ** (r + c), "sign2_scale": lambda r, c: 7.5 * (-1.0) ** r, "binary01": lambda r, c: float(c % 2)}.items():
        m = at(f)
        assert sorted(map(tuple, codecs.exact_coded(m, codec).entries.select("row", "col", "value").collect())) == sorted(map(tuple, m.entries.collect()))
        with pytest.raises(ValueError, match="do not suit"):
            codecs.exact_coded(at(lambda r, c: float(r + 2)), codec)


def test_headers_of_any_length(spark, tmp_path):
    p = tmp_path / "long.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real general\n" + "% note\n" * 5000 + "2 2 2\n1 1 3.5\n2 2 4\n")
    got = matrix_market.read(spark, str(p))
    assert got.header.lines == 5002 and sorted(map(tuple, got.matrix.entries.collect())) == [(0, 0, 3.5), (1, 1, 4.0)]


def test_extents(spark):
    assert [_extent(spark.createDataFrame(r, "k long"), "k") for r in ([(0,)], [(4,), (2,)], [])] == [1, 5, 0]
