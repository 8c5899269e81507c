"""All windows near the densest are judged, however many there are."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaik.matrix import Matrix
from mosaik.operators import study
from mosaik.queries import studies
from mosaik.sources import tables

CELLS = 30


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Tables whose 30 occupied cells lie apart, so 120 windows hold one each. All have two tiles of four entries and lose something, but the last: it has seven, and loses nothing."""
    d = str(tmp_path_factory.mktemp("many"))
    lines = []
    for k in range(CELLS):
        last = k == CELLS - 1
        for i in range(7 if last else 8):
            lines.append(((2 * k + 1) * 32 + i // 4 * 8 + i % 4, (2 * k + 1) * 8 + i % 4, 7.0 if last else 17.0 + 11 * (i % 4)))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put(lines, "l_partkey long, l_suppkey long, l_quantity double", "lineitem")
    put([(64 * CELLS + 63,)], "p_partkey long", "part")
    put([(16 * CELLS + 15,)], "s_suppkey long", "supplier")
    return d


def by_sql(d, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{d}/lineitem.parquet/*.parquet')")
    r = c.sql(studies.SQL[name])
    return r.columns, sorted(r.fetchall())


def test_the_window_that_loses_least_need_not_be_among_the_eighty_densest(spark, many):
    got = studies.QUERIES["window_coherent"](spark, many)
    corner = (2 * CELLS - 2) * 32, (2 * CELLS - 2) * 8
    assert sorted(map(tuple, got.select("top", "left", "r", "c", "v").collect())) == [(*corner, 32 + i // 4 * 8 + i % 4, 8 + i % 4, 7.0) for i in range(7)]
    names, want = by_sql(many, "window_coherent")
    assert sorted(map(tuple, got.select(*names).collect())) == want


@pytest.mark.parametrize("dealt", [False, True])
def test_errors_are_of_all_windows_near_the_densest(spark, many, monkeypatch, dealt):
    if dealt:
        monkeypatch.setattr(tables, "TASK_ROWS", 20)
    got = studies.QUERIES["window_errors"](spark, many)
    names, want = by_sql(many, "window_errors")
    rows = got.collect()
    assert len(rows) == 4 * CELLS and [r.n for r in rows].count(7) == 4
    assert sorted(tuple(r[c] for c in names) for r in rows) == want
    if dealt:  # the counts and the errors both take lines by cell, and move cells to their windows; nothing else moves by key
        moves = re.findall(r"Exchange hashpartitioning\((\w+)", got.select("*")._jdf.queryExecution().executedPlan().toString())
        assert sorted(moves) == ["br", "br", "top", "top"]


def plain_judged(entries, h, w, br, bc, share, levels=127):
    """Each window by itself: its entries, its tiles, their errors."""
    held = {}
    for r, c, v in entries:
        for i in (0, 1):
            for j in (0, 1):
                corner = (r // (h // 2) - i) * (h // 2), (c // (w // 2) - j) * (w // 2)
                if min(corner) >= 0:
                    held.setdefault(corner, []).append((r, c, v))
    most, out = max(map(len, held.values())), {}
    for corner, own in held.items():
        tiles = {}
        for r, c, v in own:
            if abs(v) > 0:
                tiles.setdefault((r // br, c // bc), []).append(abs(v))
        if len(own) >= share * most and tiles:
            errors = [sum(abs(np.rint(a / max(t) * levels) * max(t) / levels - a) for a in t) / sum(t) for t in tiles.values()]
            out[corner] = len(own), float(np.median(errors))
    return out


@pytest.mark.parametrize("share", [0.6, 0.0])
def test_all_windows_near_the_densest_are_judged(spark, share):
    """Zeros count as entries of a window but not of its tiles; a window of zeros alone has no error."""
    rng = np.random.default_rng(7)
    at = sorted({(int(r), int(c)) for r, c in zip(rng.integers(0, 200, 3000), rng.integers(0, 100, 3000), strict=True)})
    rows = [(r, c, 0.0 if r >= 176 or (r + c) % 9 == 0 else float(rng.normal())) for r, c in at]
    m = Matrix(spark.createDataFrame(rows, "row long, col long, value double").repartition(3), 200, 100)
    want = plain_judged(rows, 32, 16, 8, 4, share)
    assert len(want) > 80
    carried = m.with_entries(m.entries.withColumns({"br": F.expr("row DIV 16"), "bc": F.expr("col DIV 8")}))
    for x in (m, carried):
        got = {(r.top, r.left): (r.n, r.median) for r in study.judged_windows(x, 32, 16, share=share).collect()}
        assert got == {k: (n, pytest.approx(median, abs=1e-11)) for k, (n, median) in want.items()}
