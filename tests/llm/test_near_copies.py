import re

import corpus_pipeline as C
import numpy as np
import pytest

from mosaik.llm import near_copies as N

WORDS = [f"{a}{b}{c}" for a in "bcdfgklmnprst" for b in ("an", "or", "ti", "ue", "el", "os") for c in "aeiou"]


def plain_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b)


def plain_kept(rows):
    """The least doc_id of each group that similarities of 0.8 connect, by comparing all pairs."""
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and similarity(rows[i][1], rows[j][1]) >= 0.8:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(least.values())


def edited(rng, text, n):
    words = text.split()
    for k in rng.choice(len(words), n, replace=False):
        words[k] = "zz" + str(rng.integers(1 << 30))
    return " ".join(words)


def a_table():
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice(WORDS, n))
    rows = []
    for i in range(160):
        n = int(rng.integers(50, 140))
        base = prose(n)
        rows += [(2 * i, base), (2 * i + 1, edited(rng, base, 1 + int(rng.integers(0, 6))))]
    base = prose(200)
    rows += [(1000 + i, edited(rng, base, 2)) for i in range(30)]  # one large group
    passage = prose(150)
    rows += [(2000 + i, passage + " " + prose(60)) for i in range(20)]  # one common passage, no copies
    rows += [(3000 + i, t) for i, t in enumerate(["", None, " \t\n", "one", "One", "one two three", "one two  three", "three two one", "a b c d e", "A b c d e f"])]
    return rows


@pytest.mark.parametrize("turns", [0, 1])
def test_the_near_dedup_stage_removes_what_has_a_similarity_of_08_and_nothing_else(spark, monkeypatch, turns):
    monkeypatch.setattr(N, "TURNS", turns)
    rows = a_table()
    near = [similarity(rows[i][1], rows[i + 1][1]) for i in range(0, 320, 2)]
    assert sum(0.8 <= s < 0.85 for s in near) > 10 and sum(0.5 <= s < 0.8 for s in near) > 40
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, print string")
    out = C.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == plain_kept(rows)


def test_repeated_rows_and_rows_without_an_id(spark):
    rows = [(None, "some words of a text here"), (None, "some words of a text here"), (7, "some words of a  text here"), (None, "quite another text that has no id"), (8, "x"), (8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in N.one_of_each(docs).collect()) == [("7", rows[2][1]), ("8", "x"), ("None", rows[3][1])]
    assert N.one_of_each(docs.limit(0)).count() == 0
