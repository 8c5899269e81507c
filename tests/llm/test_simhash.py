import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mosaik.llm import simhash as S
from mosaik.llm import skew
from mosaik.llm.components import components


def plain_fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, threshold=4):
    f = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= threshold):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, format(int(f[i]), "016x"), least.get(root(i))) for i, (d, _) in enumerate(rows) if d is not None)


TEXTS = ["", None, " \t\n", "One", "one two three", "A b\tc  d\n\x0be", "é ß É " * 40, "x " * 3000, "w1 w2 w3 w4 w5", "W1 w2 w3 w4 w5"]


def test_fingerprint_is_the_plain_one():
    got = S.fingerprint(pa.array(TEXTS))
    assert got.tolist() == [plain_fingerprint(t) for t in TEXTS]
    assert S.fingerprint(pa.array(["zz", *TEXTS]).slice(1)).tolist() == got.tolist()


def test_anchors_meet_for_every_pair_within_the_threshold():
    rng = np.random.default_rng(7)
    f = rng.integers(0, 1 << 63, 3000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, np.uint64)
    g = f.copy()
    for i in range(len(g)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            g[i] ^= np.uint64(1) << np.uint64(b)
    keys = []
    for x in (f, g):
        r, k = S.anchors(x)
        own = [set() for _ in x]
        for i, key in zip(r.tolist(), k.tolist(), strict=True):
            own[i].add(key)
        keys.append(own)
    assert all(a & b for a, b in zip(*keys, strict=True))
    assert 25 < np.mean([len(a) for a in keys[0]]) < 33


def test_groups_of_a_table(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)]
    base = " ".join(f"t{i}" for i in range(200))
    rows += [(100 + i, base.replace("t7 ", f"u{i} ")) for i in range(30)] + [(100, base), (None, base)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    got = S.near_duplicates(df)
    assert sorted(tuple(r) for r in got.filter("doc_id IS NOT NULL").collect()) == plain_groups(rows)
    assert got.count() == len(rows)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_driver_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in S.near_duplicates(docs).collect()) == plain_groups(rows)


@pytest.mark.parametrize("crowded", [6, 4096])
def test_crowded_anchors_link_the_same(spark, crowded):
    f = sorted({0, *(1 << i for i in range(20)), *(3 << i for i in range(40, 62)), (1 << 63) - 1})
    df = spark.createDataFrame([(x, x, x) for x in f], "fingerprint long, confirm long, node long")
    got = {r.node: r.component for r in components(S.links(df, crowded=crowded)).collect()}
    near = [(a, b) for a in f for b in f if a < b and bin(a ^ b).count("1") <= 4]
    assert {a for p in near for a in p} == set(got)
    assert all(got[a] == got[b] for a, b in near)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7), (3, 2), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(1000, 1040), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hub_of_the_greatest_id_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HOT", 50)
    hub, dealt, own = 10**9, [], skew.hot_keys

    def watched(left, key):
        hot = own(left, key)
        dealt.append((key, hot is not None and hub in {r.hot for r in hot.collect()}))
        return hot

    monkeypatch.setattr(skew, "hot_keys", watched)
    links = spark.createDataFrame([(hub, i) for i in range(3000)], "a long, b long")
    assert {(r.node, r.component) for r in components(links).collect()} == {(i, 0) for i in [*range(3000), hub]}
    assert ("a", True) in dealt


def test_links_across_groups_are_all_pairs_or_one_of_each(spark):
    f = sorted({0, *(1 << i for i in range(20)), *(3 << i for i in range(40, 62))})
    rows = [(x, x, x % 3, x % 3, 7) for x in f]
    may = lambda x, y: (x[0] < 3) & (y[1] == 7)
    near = {(a, b) for a in f for b in f if a % 3 < b % 3 and bin(a ^ b).count("1") <= 4}
    df = spark.createDataFrame(rows, "fingerprint long, node long, group long, n long, p long")
    for crowded in (6, 4096):
        assert {tuple(r) for r in S.links(df, crowded=crowded, may=may).collect()} == near
        one = [tuple(r) for r in S.links(df, crowded=crowded, turn=1, may=may).collect()]
        assert S.links(df, crowded=crowded, may=lambda x, y: x[0] < 0).count() == 0
        assert {a for a, _ in one} == {x for p in near for x in p} and all((a, b) in near or (b, a) in near for a, b in one)


def test_hot_groups_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HOT", 5)
    base = " ".join(f"t{i}" for i in range(200))
    rows = [(i, base) for i in range(40)] + [(100 + i, base.replace("t7 ", f"u{i} ")) for i in range(40)] + [(200 + i, f"other {i}") for i in range(9)]
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    assert sorted(tuple(r) for r in S.near_duplicates(df).collect()) == plain_groups(rows)
    left = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(120)] + [(None, 0)], "k long, v long")
    right = spark.createDataFrame([(i, str(i)) for i in range(0, 200, 2)], "o long, w string")
    got = skew.joined(left, right, "k", "o", F.col("v")).select("k", "v", "w").collect()
    assert sorted(map(tuple, got)) == sorted((k, v, str(k)) for k, v in ((i % 3 if i < 90 else i, i) for i in range(120)) if k % 2 == 0)
    assert skew.hot_keys(left, "k").count() == 3
