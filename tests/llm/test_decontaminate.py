import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from mosaik.llm import decontaminate as D

TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def low(t):
    return TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, items):
    """Brute force: the best alignment of every document with every item that has a window of enough equal tokens."""
    out = {}
    for d, t in docs:
        for i, s in items:
            a, b = low(t), low(s)
            n = min(D.WINDOW, len(b))
            if len(b) < D.LEAST_SEEDED:
                if b and any(a[k : k + len(b)] == b for k in range(len(a))):
                    out[d, i] = len(b)
                continue
            for shift in range(-len(b) + 1, len(a)):
                same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
                total = np.concatenate([[0], np.cumsum(same)])
                if len(b) >= n and (total[n:] - total[:-n]).max() >= np.ceil(D.LEAST_EQUAL * n):
                    out[d, i] = max(out.get((d, i), 0), sum(same))
    return {k: (v, round(v / len(low(dict(items)[k[1]])), 9)) for k, v in out.items()}


def test_masks_meet_every_pattern_of_a_quarter_substitutions():
    for n in range(8, 17):
        masks = D.MASKS[: D.FOR_LONG] if n >= D.LONG else D.MASKS
        for size in range(n // 4 + 1):
            for bad in combinations(range(n), size):
                whole = set(range(n)) - set(bad)
                assert any({p + o for o in m} <= whole for m in masks for p in range(n - m[-1])), (n, bad)


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("an", "or", "ti", "ue", "el")]
    prose = lambda n: rng.choice(words, n).tolist()
    items = [(i, " ".join(prose(int(n)))) for i, n in enumerate((8, 9, 13, 16, 17, 30, 60, 7, 3))] + [(50, None), (51, ""), (52, "Été " * 20)]
    docs = []
    for k in range(40):
        own = dict(items)[k % 7].split()
        for at in rng.choice(len(own), len(own) // (4 + k % 5), replace=False):
            own[at] = "changed"
        docs.append((k, ", ".join(prose(20)) + ".\n" + " ".join(own).upper() + "! " + " ".join(prose(15))))
    docs += [(100 + k, " ".join(prose(60))) for k in range(30)] + [(200, None), (201, ""), (202, "été " * 30), (203, dict(items)[6] + " x " + " ".join(prose(30000)))]
    docs += [(300 + k, " ".join(dict(items)[6].split()[k : k + 20])) for k in range(0, 40, 7)] + [(3, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block", [10**6, 40])
def test_overlaps_are_those_of_brute_force(spark, case, block):
    docs, items = case
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.n_equal, round(r.overlap, 9)) for r in D.overlaps(d, i, block).collect()}
    want = plain([x for x in docs if x[0] != 203], items)
    assert {k: v for k, v in got.items() if k[0] != 203} == want
    assert got[203, 6] == (60, 1.0) and len(want) > 30 and not any(100 <= k[0] < 202 for k in got)


def test_clean_documents_stay(spark, case):
    docs, items = case
    d = spark.createDataFrame([*docs, (None, dict(items)[6])], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    left = D.clean(d, i)
    assert left.columns == d.columns
    want = {k for k, _ in docs} - {k for k, _ in plain([x for x in docs if x[0] != 203], [x for x in items if len(low(x[1])) >= D.LEAST_TELLING])} - {203}
    assert {r.doc_id for r in left.collect()} == want
    assert {r.doc_id for r in D.clean(d, i, 40).collect()} == want  # several blocks
    assert D.overlaps(d.limit(0), i).count() == 0
    assert D.overlaps(d, i.limit(0)).count() == 0


def test_driver_table(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in D.overlaps(docs, items).collect()}
    texts, held = {r.doc_id: " ".join(low(r.text)) for r in docs.collect()}, {r.item_id: " ".join(low(r.text)) for r in items.collect()}
    assert found >= {(d, i) for d, t in texts.items() for i, s in held.items() if f" {s} " in f" {t} "}


def test_clean_judges_rows_of_one_id_by_their_own_texts(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(5, f"x {passage}"), (5, "a clean row of the same id"), (6, None), (7, ""), (None, f"{passage} y"), (None, "clean without id")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, _held int")
    out = D.clean(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 99, r.text or "") for r in out.collect()) == [(5, rows[1][1]), (6, ""), (7, ""), (99, "clean without id")]


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "Paris"), (2, "to be or not"), (3, "to be or not"), (4, "one two three four five six seven"), (5, "!"), (6, "is it")]
    docs = [(1, "In paris, it is."), (2, "To be -- or not; to be or not"), (3, "to be or to be"), (4, "x one two three four five six seven"), (5, None), (6, "one two three four five six"), (7, "it is it")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_equal, r.doc_token) for r in D.overlaps(d, i).collect()}
    assert got == {(1, 1): (1, 1), (2, 2): (4, 0), (2, 3): (4, 0), (4, 4): (7, 1), (7, 6): (2, 1)}
    assert set(got) == set(plain(docs, items))
    assert {r.doc_id for r in D.clean(d, i).collect()} == {1, 2, 3, 5, 6, 7}


@pytest.mark.parametrize("text", ["a", "a b", "a a b"])
def test_hot_seeds_take_bounded_room_and_lose_nothing(text):
    """Repeated words on both sides: a pair for each diagonal, some at a time, and the same rows as brute force."""
    item = (text + " ") * 30
    rows = [(1, 0, len(item.split()), D.tokens(pa.array([item]))[1].tobytes())]
    index = D.Index(rows)
    docs = [(text + " ") * 40, "x " * 30, "b " + (text + " ") * 9 + "y " * 5 + (text + " ") * 7]
    w, h = D.tokens(pa.array(docs))
    got = {(d, i): n for d, i, _, _, n in D.verified(index, h, w)}
    assert got == {(d, i): n for (d, i), (n, _) in plain(list(enumerate(docs)), [(1, item)]).items()}
    long = D.Index([(1, 0, 4096, D.tokens(pa.array([(text + " ") * 4096]))[1][:4096].tobytes())])
    w, h = D.tokens(pa.array([(text + " ") * 60_000]))
    sizes = [len(p) for p, _ in long.pairs(h, w)]
    assert max(sizes) <= D.PAIRS and sum(sizes) <= 8 * len(long.masks) * (len(h) + 4096)
    assert [(d, n) for d, _, _, _, n in D.verified(long, h, w)] == [(0, 4096)]


def test_pairs_beyond_a_chunk_lose_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    items = [" ".join(rng.choice(["p", "q"], 40)) for _ in range(12)]
    docs = [" ".join(rng.choice(["p", "q"], 300)) for _ in range(6)]
    index = D.Index([(k, 0, 40, D.tokens(pa.array([t]))[1].tobytes()) for k, t in enumerate(items)])
    w, h = D.tokens(pa.array(docs))
    want = {(d, i): n for (d, i), (n, _) in plain(list(enumerate(docs)), list(enumerate(items))).items()}
    for pairs, compared, done in ((1 << 18, 1 << 20, 1 << 20), (100, 1000, 50)):
        monkeypatch.setattr(D, "PAIRS", pairs)
        monkeypatch.setattr(D, "COMPARED", compared)
        monkeypatch.setattr(D, "DONE", done)
        assert {(d, i): n for d, i, _, _, n in D.verified(index, h, w)} == want and len(want) > 20
