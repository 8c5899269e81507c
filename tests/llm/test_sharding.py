import zlib
from collections import defaultdict

import pytest

from mosaik.llm import sharding as S


def plain_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c = (low + high) // 2
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        low, high = (low, c) if n <= shards else (c + 1, high)
    return low


def by_hand(spark, rows, shards):
    """The least capacity over groups in hash order, from the rows themselves."""
    df = spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "text string")
    key = {r.text: r.k for r in df.select("text", S.text_key(df.text).alias("k")).collect()}
    size = defaultdict(int)
    for _, t in rows:
        size[key[t or ""]] += len((t or "").encode()) + 1
    return plain_capacity([size[k] for k in sorted(size)], shards)


def check(spark, rows, shards=16):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, shard string")
    got = S.laid_out(df, shards).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    load, slots, texts = defaultdict(int), defaultdict(list), defaultdict(set)
    text = dict(rows)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        texts[raw].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in texts.values())
    assert not load or (max(load) < shards and max(load.values()) == by_hand(spark, rows, shards))
    return got


@pytest.mark.parametrize("bits", [(16, 8), (2, 1), (1, 3)])
def test_the_largest_shard_is_as_small_as_cuts_allow(spark, monkeypatch, bits):
    monkeypatch.setattr(S, "FIRST_BITS", bits[0])
    monkeypatch.setattr(S, "MORE_BITS", bits[1])
    rows = [(i, f"text {i} " * (1 + i * i % 37)) for i in range(300)] + [(1000 + i, "copy") for i in range(90)] + [(2000, None), (2001, ""), (2002, "long é" * 5000)]
    check(spark, rows, 7)


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, None)])
    check(spark, [(i, "same") for i in range(40)])
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert S.sharded(twice, 2).groupBy("shard", "slot").count().filter("count > 1").count() == 0


def test_driver_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


@pytest.mark.parametrize("share", [3, 20])
def test_a_large_group_does_not_open_every_range(spark, monkeypatch, share):
    monkeypatch.setattr(S, "FIRST_BITS", 10)
    asked, sums = [], S._sums
    monkeypatch.setattr(S, "_sums", lambda groups, ranges, *rest: asked.append(len(ranges or [])) or sums(groups, ranges, *rest))
    texts = [f"{i} " + "y" * (i * 7919 % 90) for i in range(6000)]
    size = sum(len(t) + 1 for t in texts)
    texts.append("z" * (size // (share - 1)))
    capacity, cuts = S.cut_points(spark.createDataFrame([(t,) for t in texts], "text string"), 4)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(S.text_key(df.text).alias("k"), S.text_size(df.text).alias("n"), S.shard_of(df.text, cuts).alias("s")).orderBy("k").collect()
    load = defaultdict(int)
    for r in rows:
        load[r.s] += r.n
    assert len(load) <= 4 and capacity == plain_capacity([r.n for r in rows], 4) == max(load.values())
    assert max(asked) <= 4 * (4 + 2)
