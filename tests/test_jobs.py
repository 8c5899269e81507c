"""The jobs: two runs over growing input, runs that were cut short, and the SQL of their queries."""

import datetime
import json
import os
import re
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import jobs
from jobs import codec_sweep, term_matrix
from mosaik.operators.tiles import counted, decoded
from mosaik.sources.scratch import scratch

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, source string, text string, extra int"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file://")) for f in names if f.endswith(".parquet")}


def plain(batches):
    """Documents of batches in order, as the entries that the job should have."""
    seen, rows, out = {}, Counter(), Counter()
    for batch in batches:
        new, words = {}, {}
        for d, s, t in batch:
            m = "none" if s is None else f"source-{s}"
            if d is not None and (m, d) not in seen:
                new.setdefault(m, set()).add(d)
                words.setdefault((m, d), []).extend(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        for m, ids in new.items():
            begin = -(-rows[m] // 8) * 8
            for k, d in enumerate(sorted(ids)):
                seen[m, d] = begin + k
            rows[m] = begin + len(ids)
        for (m, d), own in words.items():
            out.update((m, d, seen[m, d], column(w)) for w in own)
    return {(*k, float(n)) for k, n in out.items()}


def column(word):
    import hashlib

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
    return int(hashlib.md5(low.encode()).hexdigest()[:8], 16) % term_matrix.COLUMNS


BATCHES = [
    [(5, "a", "One two TWO"), (1, "a", "é É one"), (None, "a", "nameless"), (9, None, "x\ty\nx"), (2, "b", None), (3, "b", "  "), (5, "a", "more one")] + [(100 + i, "a", f"w{i} w") for i in range(20)],
    [(5, "a", "again, not taken"), (0, "a", "late but small"), (7, "", "empty name"), (11, "b", "one " * 3000)],
    [(1, "new/one=x", "odd name"), (12, "b", "last")],
]


def test_term_matrix_takes_only_new_files(spark):
    path = scratch(spark, "terms")
    add = lambda k: spark.createDataFrame([(*r, 1) for r in BATCHES[k]], DOCS).coalesce(1).write.mode("append").parquet(f"{path}/in")
    run = lambda: term_matrix.run(spark, f"{path}/in", f"{path}/out", f"{path}/state")
    got = lambda: {tuple(r) for r in term_matrix.read(spark, f"{path}/out").collect()}
    add(0)
    run()
    assert got() == plain(BATCHES[:1])
    first = files(f"{path}/out")
    run()
    assert files(f"{path}/out") == first
    add(1)
    run()
    assert got() == plain(BATCHES[:2]) and first < files(f"{path}/out")
    add(2)
    run()
    assert got() == plain(BATCHES)
    rows = term_matrix.read(spark, f"{path}/out").select("matrix", "row", "doc_id").distinct()
    assert rows.count() == rows.select("matrix", "row").distinct().count()


def test_a_batch_that_comes_again_gives_the_same(spark, monkeypatch):
    path = scratch(spark, "terms")
    spark.createDataFrame([(*r, 1) for r in BATCHES[0]], DOCS).coalesce(1).write.parquet(f"{path}/in")
    term_matrix.run(spark, f"{path}/in", f"{path}/out", f"{path}/state")
    spark.createDataFrame([(*r, 1) for r in BATCHES[1]], DOCS).coalesce(1).write.mode("append").parquet(f"{path}/in")
    replace = term_matrix.replace_partitions

    def cut_short(df, to, *by):
        replace(df, to, *by)
        raise RuntimeError("lost")

    monkeypatch.setattr(term_matrix, "replace_partitions", cut_short)
    with pytest.raises(Exception, match="lost"):
        term_matrix.run(spark, f"{path}/in", f"{path}/out", f"{path}/state")
    monkeypatch.setattr(term_matrix, "replace_partitions", replace)
    term_matrix.run(spark, f"{path}/in", f"{path}/out", f"{path}/state")
    assert {tuple(r) for r in term_matrix.read(spark, f"{path}/out").collect()} == plain(BATCHES[:2])


def test_term_matrix_in_several_batches_and_without_documents(spark):
    path = scratch(spark, "terms")
    spark.createDataFrame([], DOCS).coalesce(1).write.parquet(f"{path}/in")
    term_matrix.run(spark, f"{path}/in", f"{path}/out", f"{path}/state", files_per_batch=1)
    assert term_matrix.read(spark, f"{path}/out").count() == 0
    rows = [(i, "s", f"w{i}") for i in range(40)]
    spark.createDataFrame([(*r, 1) for r in rows], DOCS).repartition(3).write.mode("append").parquet(f"{path}/in")
    term_matrix.run(spark, f"{path}/in", f"{path}/out", f"{path}/state", files_per_batch=1)
    got = term_matrix.read(spark, f"{path}/out")
    assert {(r.doc_id, r.col, r.value) for r in got.collect()} == {(i, column(f"w{i}"), 1.0) for i in range(40)}
    assert spark.read.parquet(f"{path}/out/index").select("batch").distinct().count() == 3


def test_words_are_counted_where_texts_are_dealt(spark, monkeypatch):
    rows = [(i, "s" if i % 3 else None, f"Ab aB É w{i % 5} " + "and " * (i * 40)) for i in range(30)] + [(7, "s", "x " * 900)] * 4
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS)
    docs.coalesce(2).write.parquet(f"{(path := scratch(spark, 'terms'))}/in")
    want = plain([rows])
    placed = spark.createDataFrame(sorted({(f"source-{s}" if s else "none", d) for d, s, _ in rows}), "matrix string, doc_id long").selectExpr("*", "doc_id AS row")
    texts = term_matrix._documents(docs).join(placed, ["matrix", "doc_id"]).select("matrix", "row", "text")
    plan = term_matrix.tiles_of(texts, term_matrix.COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan[: plan.index("REPARTITION_BY_NUM")].count("Exchange") == 1
    for large in (term_matrix.LARGE, 4000, 0):  # no, some and all block rows have their words counted before these are moved
        monkeypatch.setattr(term_matrix, "LARGE", large)
        monkeypatch.setattr(term_matrix, "SENT", large)
        term_matrix.run(spark, f"{path}/in", f"{path}/out{large}", f"{path}/state{large}")
        assert {tuple(r) for r in term_matrix.read(spark, f"{path}/out{large}").collect()} == want


def test_counters_hold_what_their_bits_allow(spark):
    most = {(r, c): 1 + (r * 4 + c) % 7 for r in range(16) for c in range(5)}
    rows = [p for p, n in most.items() for _ in range(n)]
    for bits in (3, 20, 31, 62):
        got = decoded(counted(spark.createDataFrame(rows, "row long, col long"), bits))
        assert {tuple(r) for r in got.collect()} == {(r, c, float(n)) for (r, c), n in most.items()}


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_extendedprice double, l_shipdate timestamp"


def some_lines(year, n, shift=0.0):
    when = datetime.datetime(year, 5, 1) if year else None
    return [(i, i % 7, i % 5, float(i % 4 + 1), 0.0 if year == 2001 else 0.01 * (i % 3), 1000.25 * (i + 1) + shift, when) for i in range(n)]


def test_codec_sweep_takes_up_what_is_new_or_changed(spark):
    path = scratch(spark, "sweep")
    put = lambda rows: spark.createDataFrame(rows, LINES).write.mode("overwrite").parquet(f"{path}/in")
    run = lambda: codec_sweep.run(spark, f"{path}/in", f"{path}/out", f"{path}/marks")
    got = lambda: sorted(map(str, spark.read.parquet(f"{path}/out").collect()))
    put(some_lines(2000, 60) + some_lines(2001, 30))
    assert run() == [2000, 2001]
    first, rows = files(f"{path}/out"), got()
    assert run() == [] and files(f"{path}/out") == first
    put(some_lines(2000, 60) + some_lines(2001, 30) + some_lines(2002, 10) + some_lines(0, 3))
    assert run() == [0, 2002] and first < files(f"{path}/out") and set(rows) < set(got())
    put(some_lines(2000, 60) + some_lines(2001, 31) + some_lines(2002, 10) + some_lines(0, 3))
    assert run() == [2001]
    after = got()
    fresh = scratch(spark, "sweep")
    codec_sweep.run(spark, f"{path}/in", f"{fresh}/out", f"{fresh}/marks")
    assert sorted(map(str, spark.read.parquet(f"{fresh}/out").collect())) == after
    empty = spark.read.parquet(f"{path}/out").filter("status = 'empty'").collect()
    assert [(r.year, r.field, r.nnz, r.codec) for r in empty] == [(2001, "discount", 0, None)]


def test_a_sweep_without_marks_is_done_again(spark, monkeypatch):
    path = scratch(spark, "sweep")
    spark.createDataFrame(some_lines(2000, 20), LINES).write.parquet(f"{path}/in")
    replace = codec_sweep.replace_partitions

    def cut_short(df, to, *by):
        if to.endswith("marks"):
            raise RuntimeError("lost")
        replace(df, to, *by)

    monkeypatch.setattr(codec_sweep, "replace_partitions", cut_short)
    with pytest.raises(RuntimeError):
        codec_sweep.run(spark, f"{path}/in", f"{path}/out", f"{path}/marks")
    before = sorted(map(str, spark.read.parquet(f"{path}/out").collect()))
    monkeypatch.setattr(codec_sweep, "replace_partitions", replace)
    assert codec_sweep.run(spark, f"{path}/in", f"{path}/out", f"{path}/marks") == [2000]
    assert sorted(map(str, spark.read.parquet(f"{path}/out").collect())) == before


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    settings = dict(spark.sparkContext.getConf().getAll())
    overwrite = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    df = jobs.QUERIES[name](spark, sf_dir)
    c = duckdb.connect()
    for t in ("documents", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    r = c.sql(jobs.SQL[name])
    assert sorted(r.columns) == sorted(df.columns)
    names = sorted(df.columns)
    kinds = dict(zip(r.columns, map(str, r.types), strict=True))
    assert {n: {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}[t] for n, t in df.dtypes} == kinds
    got = sorted(str([row[n] for n in names]) for row in df.collect())
    want = sorted(str([row[r.columns.index(n)] for n in names]) for row in r.fetchall())
    assert got == want
    assert dict(spark.sparkContext.getConf().getAll()) == settings and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == overwrite


def test_command_line(tmp_path, sf_dir):
    config = tmp_path / "sweep.json"
    config.write_text(json.dumps({"gate": 1e-6, "output": str(tmp_path / "out")}))
    run = [sys.executable, os.path.join(ROOT, "jobs", "codec_sweep.py"), "--config", str(config), "--source", f"{sf_dir}/lineitem.parquet", "--marks", str(tmp_path / "marks")]
    done = subprocess.run(run, capture_output=True, text=True, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and any(p.name.startswith("year=") for p in (tmp_path / "out").iterdir())
