import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from mosaik.llm import substrings as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """Brute force: every window of every document against the least document that has it."""
    least, words = {}, [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 49):
            if d is not None:
                g = tuple(w[i : i + 50])
                least[g] = min(d, least.get(g, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - 49) if d is not None and least[tuple(w[i : i + 50])] < d for k in range(50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def some_rows():
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, rows = fresh(120), []
    for i in range(60):
        cut = rng.integers(30, 120)
        at = rng.integers(0, 120 - cut + 1)
        rows.append((i * 3, "  ".join(fresh(rng.integers(0, 90)) + passage[at : at + cut] + fresh(rng.integers(0, 40)))))
    rows += [(1000 + i, " ".join(passage[:n])) for i, n in enumerate((49, 50, 51, 120))]
    rows += [(7, None), (8, ""), (9, "\n\t"), (10, "é ü\x0b" * 200), (11, "x " * 400), (12, "x " * 60), (12, "x " * 70), (12, "x " * 60), (None, " ".join(passage))]
    rows += [(5000 + i, " ".join(passage)) for i in range(40)] + [(-4, "\n".join(passage[10:100]))]
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, places int")
    got = Counter(tuple(r) for r in S.removed(df).collect())
    assert got == plain(rows)
    return df


def test_every_repeated_window_goes(spark):
    df = check(spark, some_rows())
    out = S.without_repeats(df)
    assert out.columns == df.columns
    n = out.agg(F.count("*"), F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))).first()
    want = plain(some_rows())
    assert n[0] == sum(want.values()) and n[1] == sum((r[1] - r[2]) * k for r, k in want.items())


def test_cover_aligns_any_two_positions():
    reach = defaultdict(set)
    for i in range(S.PERIOD):
        for shift in range(S.PERIOD):
            if (i + shift) % S.PERIOD in S.COVER:
                reach[i].add(shift)
    assert all(reach[i] & reach[j] for i in reach for j in reach)


def test_a_row_that_repeats_has_one_set_of_places(spark):
    text = " ".join(f"w{i}" for i in range(600))
    rows = [(7, text)] * 1000 + [(3, text)] * 2
    df = check(spark, rows)
    places = S.windows_to_remove(df).collect()
    assert [(r.doc_id, len(r.places)) for r in places] == [(7, 551)]


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, None)])


def test_driver_table(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
