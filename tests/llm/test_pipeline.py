import re
from collections import Counter, defaultdict

import corpus_pipeline as C
import numpy as np
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def a_corpus(tmp_path, spark):
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("an", "or", "ti", "ue", "el", "os")]
    prose = lambda n: " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(rng.choice(words, n))) + "."
    items = [(i, prose(30)) for i in range(4)]
    rows = [(i, prose(int(rng.integers(60, 300))), "en", f"s{i % 4}", 0) for i in range(160)]
    clean = {r[0] for r in rows}
    rows += [(1000 + i, rows[i][1], "en", "s1", 0) for i in range(20)]  # copies
    rows += [(2000 + i, rows[i][1].replace(rows[i][1].split()[5], "edited", 1), "en", "s2", 0) for i in range(20)]
    rows += [(3000 + i, prose(80) + "\n" + items[i % 4][1], "en", "s3", 0) for i in range(12)]  # leaks
    rows += [(4000 + i, "Home | News | About\n" * 6, "en", "s0", 0) for i in range(5)] + [(5000, None, None, None, None), (5001, "", "", "", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, clean, {r[0]: r[1] for r in rows}


def test_each_stage_does_its_part(spark, tmp_path):
    d, clean, text = a_corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(C.STAGES[:-1]):
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns
        seen.append(Counter(r.doc_id for r in docs.collect()))
    quality, near, free, mix = seen
    assert set(quality) == set(text) - {4000 + i for i in range(5)} - {5000, 5001}
    assert set(near) == clean | {3000 + i for i in range(12)} and max(near.values()) == 1
    assert set(free) == clean
    assert set(mix) <= clean and max(mix.values()) <= 3
    out = C.run(spark, d)
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == mix
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        own = iter(WORD.findall(text[r.doc_id]))
        assert all(w in own for w in WORD.findall(r.text)) and r.n_chars == len(r.text)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_an_empty_corpus_gives_no_rows(spark, tmp_path):
    d, _, _ = a_corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet").filter(F.lit(False))
    for _, stage in C.STAGES:
        docs = stage(spark, docs, d)
    assert docs.count() == 0


def test_defined_results_of_every_stage(spark, tmp_path):
    """Repeated rows, nulls in every column, a very long text and columns with names that the operators use themselves."""
    d, _, text = a_corpus(tmp_path, spark)
    base = spark.read.parquet(f"{d}/documents.parquet")
    names = ["row", "key", "id", "node", "component", "size", "begin", "cell", "part", "copy", "w"]
    long = " ".join(f"{a}{i}" + ("." if i % 9 == 8 else "") for i in range(30_000) for a in ("wo", "ra", "ti"))
    more = [(0, text[0], "en", "s0", 0)] * 50 + [(None, text[1], None, None, None)] * 20 + [(None, "no id but words of its own, " + text[2][::-1] + ".", None, None, None), (7000, long, "en", "s1", None), (7000, long, "en", "s1", None)]
    docs = base.unionByName(spark.createDataFrame(more, base.schema)).select("*", *[F.lit(k).cast("int").alias(c) for k, c in enumerate(names)])
    columns, rows = docs.columns, []
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns
        rows.append(docs.collect())
    quality, near, free, mix = rows
    assert Counter(r.doc_id for r in quality)[0] == 51 and Counter(r.doc_id for r in quality)[7000] == 2
    for kept in (near, free):
        count = Counter(r.doc_id for r in kept)
        assert max(count.values()) == 1 and count[0] == count[1] == count[7000] == 1  # the row without doc_id yields to document 1
    assert max(Counter((r.doc_id, r.source) for r in mix).values()) <= 3
    out = C.STAGES[-1][1](spark, docs, d).collect()
    assert len(out) == len(mix) and all([r[c] for c in names] == list(range(len(names))) for r in out)
