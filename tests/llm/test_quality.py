import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from mosaik.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


CASES = [
    None, "", " \x0b\r\n\t ", "one", "a b c d e a b c d e a b c d", "Naïve café \U0001f600 text. " * 4,
    "Home | News | About | Contact\nA clean sentence of several plain words stands here. Another one, quite unlike the first, follows it.",
    "BUY NOW!! CHEAP!! OFFER!!\nHURRY UP!! TODAY ONLY!!\nCLICK HERE NOW FRIENDS OF OURS!!",
    "same line here.\nsame line here.\n same line here.\nother words are found in this last line of it.",
    "z " * 30000, " ".join(f"w{i}" for i in range(30000)) + ".",
]


def test_measures_are_the_plain_ones(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id long, text string, kept string")
    q = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = Q.measured(df).orderBy("row.doc_id").select(*[f"q.{c}" for c in q], "q.kept").collect()
    assert [tuple(r)[:6] for r in rows] == [plain(t) for t in CASES]
    assert [r.kept for r in rows] == [False] * 6 + [True, False, False, False, True]


def test_kept_documents_keep_their_columns(spark):
    df = spark.createDataFrame([(1, CASES[6], 5, "en"), (2, CASES[7], 5, "en")], "doc_id long, text string, n_chars long, t string")
    out = Q.kept_documents(df)
    assert out.columns == df.columns
    (row,) = out.collect()
    assert "Home" not in row.text and row.n_chars == len(row.text)
    assert Q.kept_documents(df.limit(0)).count() == 0


def test_sql_twin_agrees_on_the_cases(spark):
    df = spark.createDataFrame(list(enumerate(CASES[:9])), "doc_id long, text string")
    got = Q.measured(df).select("row.doc_id", "q.*").drop("cleaned").orderBy("doc_id").collect()
    documents = df.toPandas()  # noqa: F841  read by DuckDB
    want = duckdb.sql(Q.SQL + " ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in got] == want


def test_labels_of_the_driver_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    n = Q.measured(docs).select("row.doc_id", "q.*").join(labels, "doc_id").filter("NOT base_failed")
    assert n.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.97
    assert (n.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] or 0) < 0.1
