import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from mosaik.llm import toxicity as X


def plain_kernel(s, t):
    """Normed sum over pairs of subsequences of four letters, straight from the definition."""

    def spelled(u):
        u, out = "^" + u, {}
        for at in combinations(range(len(u)), 4):
            skipped = at[3] - at[0] - 3
            if skipped <= X.GAP:
                out.setdefault("".join(u[i] for i in at), []).append(X.DECAY**skipped)
        return out

    a, b = spelled(s), spelled(t)
    norm = [sum(x * x for v in m.values() for x in v) ** 0.5 for m in (a, b)]
    return sum(sum(a[k]) * sum(b[k]) for k in a if k in b) / (norm[0] * norm[1])


def test_kernel_is_the_plain_one():
    names = ["idiot", "idioot", "lantern", "banana", "abc"]
    u = X.units(pa.array(names))
    marks = X._landmarks(u)
    k = X._kernel(u, marks)
    assert k == pytest.approx(np.array([[plain_kernel(s, t) for t in names] for s in names]), abs=1e-5)
    table = np.zeros(X._SIZE, np.float32)
    table[marks.spelled] = marks.weight[:, 0]
    assert X.scores(u, table) == pytest.approx(k[:, 0], abs=1e-5)


def spelled(u):
    letters = "".join(chr(96 + c) if c <= 26 else "*" for c in u.code)
    return [letters[a + 1 : b] for a, b in zip(u.first, u.first[1:])]


def test_units_see_through_marks_and_gaps():
    u = X.units(pa.array(["An i.d-i_o*t, an i d i o t and an 1d!0t!!!", None, "", "a b", "Ünder $tupid 2024"]))
    assert spelled(u)[:4] == ["idiot", "idiot", "and", "idiot"] and spelled(u)[-1] == "stupid"
    assert u.text.tolist() == [0, 0, 0, 0, 4, 4]


def some_rows(n=700):
    rng = np.random.default_rng(5)
    common = ["".join(rng.choice(list("aeioulnrstdm"), rng.integers(3, 9))) for _ in range(600)]
    out = []
    for i in range(n):
        w = rng.choice(common, rng.integers(5, 80)).tolist()
        if i % 4 == 0:
            bad = str(rng.choice(["blockhead", "nitwit", "fool"]))
            at = rng.integers(1, len(bad))
            bad = [bad, bad[:at] + "x" + bad[at:], "-".join(bad), bad + "ish"][rng.integers(0, 4)]
            w.insert(rng.integers(0, len(w)), bad)
        out.append((i, " ".join(w), int(i % 4 == 0)))
    return out


def test_held_out_texts_are_told_apart(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, ""), (9001, "", ""), (9001, "", ""), (None, "blockhead", ""), (9002, "word " * 50_000, "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(9000, None, 1), (12345, 1, 1), (9001, 7, 1)], "doc_id long, toxic int, y int")
    got = X.scored(docs, X.trained(docs, labels)).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    want = {i: y for i, _, y in rows}
    test = [(want[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in want]
    hit = sum(y == p == 1 for y, p in test)
    assert hit / sum(y for y, _ in test) > 0.8 and hit / max(1, sum(p for _, p in test)) > 0.8
    assert {r.doc_id: r.predicted for r in got}[9000] == 0


def test_of_contradicting_labels_the_toxic_one_counts(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in (1, 3)], "doc_id long, text string")
    for rows in ([(1, 0), (1, 1)], [(1, 1), (1, 0), (1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int").repartition(2)
        assert {r.score for r in X.scored(docs, X.trained(docs, labels)).collect()} == {1.0}


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    for labels, share in (([], 0.0), ([(1, 1), (3, 1)], 1.0)):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert {r.score for r in X.scored(docs, X.trained(docs, table)).collect()} == {share}
    assert X.scored(docs.limit(0), X.trained(docs, table)).count() == 0


def test_held_out_labels_of_the_driver_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = X.scored(docs, X.trained(docs, labels)).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    hit = sum(r.toxic == r.predicted == 1 for r in got)
    assert hit / sum(r.toxic for r in got) > 0.7 and hit / sum(r.predicted for r in got) > 0.8
