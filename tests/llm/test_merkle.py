import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from mosaik.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, k int, leaf int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(digests):
    """Root, and for each leaf its runs, all levels kept."""
    paths, at, now = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(now) > 1:
        runs = [now[i : i + 16] for i in range(0, len(now), 16)]
        for path, i in zip(paths, at, strict=True):
            path.append((i % 16, runs[i // 16]))
        at = [i // 16 for i in at]
        now = [h(r) for r in runs]
    return now[0], paths


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    trees = {s: tree([leaf(r) for r in ordered[s]]) for s in names}
    root, upper = tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, upper, strict=True):
        for r, path in zip(ordered[s], trees[s][1], strict=True):
            steps = path + up
            proof = h(x for i, run in steps for j, x in enumerate(run) if j != i)
            seen = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                seen = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node = leaf(seen)
            for i, run in steps:
                node = h([*run[:i], node, *run[i + 1 :]])
            out.append((r[0], leaf(r), trees[s][0], root, proof, node, node == root))
    return Counter(out)


def check(spark, rows):
    got = M.lower_cased(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)).collect()
    assert Counter(tuple(r) for r in got) == plain(rows)
    return got


def made(n, source, rng):
    return [(rng.randrange(10**6), source, "en", i, f"Text {i} É") for i in range(n)]


def test_sources_of_many_sizes(spark):
    rng = random.Random(5)
    rows = [r for n, s in ((1, "one"), (2, "two"), (16, "a"), (17, "b"), (256, "c"), (257, "é"), (300, ""), (5, None), (40, "B")) for r in made(n, s, rng)]
    rows += [(None, "a", None, None, None), (7, "a", None, 3, ""), (7, "a", None, 3, ""), (7, "a", "fr", 3, "x" * 100_000), (None, None, None, None, None)]
    rows += [(9, f"site{i:03}", "en", 1, "ABC") for i in range(30)]
    rng.shuffle(rows)
    got = check(spark, rows)
    assert {r.verified for r in got} == {True, False} and {len(r.root) for r in got} == {64}


def test_blocks_under_a_larger_tree(spark):
    rows = made(2 * M.BLOCK + 1, "big", random.Random(1)) + made(3, "small", random.Random(2))
    check(spark, rows)
    check(spark, [(i, "one", "en", 1, "Same") for i in range(M.BLOCK)])


def test_rows_that_repeat_keep_their_number(spark):
    check(spark, [(4, "s", "en", 1, "Again")] * 500)
    check(spark, [(None, None, None, None, None)] * 33)


def test_edges(spark):
    check(spark, [(1, "s", "en", 1, "A")])
    assert M.lower_cased(spark.createDataFrame([], SCHEMA)).collect() == []


def test_driver_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*M.COLUMNS).collect()]
    assert Counter(tuple(r) for r in M.lower_cased(docs).collect()) == plain(rows)


def test_sql_gives_the_same(spark, tmp_path):
    rng = random.Random(8)
    rows = [r for n, s in ((1, "one"), (17, "b"), (300, "é"), (20, None), (3, "")) for r in made(n, s, rng)] + [(None, "b", None, None, None), (5, "b", None, 3, "")]
    rows += [(9, f"site{i:03}", "en", 1, "ABC") for i in range(30)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).drop("k", "leaf").write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    out = c.sql(M.SQL)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(out.fetchall()) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 1000, 4095, 4096])
def test_traversal_gives_every_path(n):
    leaves = [str(i).encode() for i in range(n)]
    levels = M.height(n, 0)
    want_root, want = tree([x.decode() for x in leaves])
    assert M.root(leaves, levels).decode() == want_root
    for path, expected in zip(M.traversal(leaves, levels), want, strict=True):
        assert [(i, [x.decode() for x in run]) for i, run in path] == expected


def test_traversal_holds_a_bounded_number_of_nodes(monkeypatch):
    trees = []
    init = M.Subtree.__init__
    monkeypatch.setattr(M.Subtree, "__init__", lambda self, level: (init(self, level), trees.append(self))[0])
    for i, path in enumerate(M.traversal([b"x"] * M.BLOCK, M.HEIGHT)):
        held = sum(len(run) for _, run in path) + sum(len(run) for t in trees[-2 * M.HEIGHT :] for run in t.stack)
        assert held <= 2 * M.HEIGHT * M.ARITY * (M.HEIGHT + 1)
        if i > 600:
            break


def test_any_change_of_a_column_shows(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "s", "en", i, f"t{i}") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    for column in ("lang", "n_chars", "text"):
        out = M.audited(docs, F.col("doc_id") == 11, {column: F.lit(None)}).collect()
        assert [r.doc_id for r in out if not r.verified] == [11]
