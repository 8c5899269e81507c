import math
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mosaik.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Shares by weight, with excess over the cap shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 3.0 * sizes[s]
        open_ -= above
    return target


def xx(*values):
    """Spark's xxhash64: strings, longs, and integers as np.int32; nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def by_hash(rows, *key):
    """Rows in the order of running_sum."""
    return sorted(rows, key=lambda r: (xx(*[r[k] for k in key]) % 4096, [(r[k] is not None, r[k]) for k in key]))


def plain_permuted(x, n, *key):
    seed = xx(*key)
    for k in map(np.int32, range(M.ROUNDS)):
        other = ((xx(seed, k) - x + (1 << 63)) % (1 << 64) - (1 << 63)) % n  # longs wrap around
        x = other if xx(max(x, other), k, seed) & 1 else x
    return x


def plain_slots(sizes, seed=0):
    """The mix, slot by slot: (shard, slot, source, block)."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = plain_targets(sizes)
    blocks = {s: -(-n // M.BLOCK) for s, n in sizes.items()}
    quota = {}
    for s, n in sizes.items():
        rounds = min(3, int(target[s] // n)) if n else 0
        quota[s] = rounds * blocks[s] + (min(blocks[s], math.floor((target[s] - rounds * n) / n * blocks[s] + 0.5)) if n and rounds < 3 else 0)
    total, line = sum(quota.values()), []
    for s in order:
        line += [s] * quota[s]
    of = defaultdict(list)
    for k in range(total):
        of[line[xx("draw", np.int32(seed), k) % total]].append({"slot": k})
    own, spare, gaps = [], [], []
    for s in order:
        draws = by_hash(of[s], "slot")
        own += [(d["slot"], s, i) for i, d in enumerate(draws[: quota[s]])]
        spare += [d["slot"] for d in draws[quota[s] :]]
        gaps += [(s, i) for i in range(len(draws), quota[s])]
    own += [(k, *g) for k, g in zip(spare, gaps, strict=True)]
    return [(k // M.SHARD_BLOCKS, k % M.SHARD_BLOCKS, s, plain_permuted(i % blocks[s], blocks[s], "block", np.int32(seed), s, i // blocks[s])) for k, s, i in own]


def plain_taken(rows):
    """Words taken of each row, in the order of plain blocks, and the words of each block."""
    sizes, of = defaultdict(int), defaultdict(list)
    for d, t, s in rows:
        words = WORD.findall(t or "")
        sizes[s] += len(words)
        of[s].append({"doc_id": d, "size": len(words), "key": xx(t or ""), "words": words})
    mix = plain_slots(sizes)
    times, out, text = Counter((s, b) for _, _, s, b in mix), [], defaultdict(list)
    for s, docs in of.items():
        at = 0
        for d in by_hash(docs, "doc_id", "size", "key"):
            out.append((d["doc_id"], d["size"], sum(times[s, (at + k) // M.BLOCK] for k in range(d["size"]))))
            for k, w in enumerate(d["words"]):
                text[s, (at + k) // M.BLOCK].append(w)
            at += d["size"]
    return out, [(a, b, s, k, " ".join(text[s, k])) for a, b, s, k in mix]


def check(spark, rows, schema="doc_id long, text string, source string, size string"):
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    got = M.taken(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target, source, total = plain_targets(sizes), {d: s for d, _, s in rows}, defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert abs(r.target - target[s]) <= 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 3 * r.size
        total[s] += r.taken
    for s in sizes:
        assert abs(total[s] - target[s]) <= M.BLOCK + 1e-6 * target[s], (s, total[s], target[s])
    want, blocks = plain_taken(rows)
    assert sorted(((r.doc_id, r["size"], r.taken) for r in got), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, M.packed(df).collect()), key=str) == sorted(blocks, key=str)
    return df


def test_sources_meet_their_targets(spark):
    rows = [(i, "w " * (i % 97), f"s{i % 7}") for i in range(900)] + [(2000 + i, "a b\tc\x0b" * 50, None) for i in range(40)]
    rows += [(3000, None, "s1"), (3001, "", ""), (3002, "x " * 9000, "é"), (3003, "one", "Z")] + [(4000 + i, "hot words here", "hot") for i in range(3000)]
    df = check(spark, rows)
    mix = M.mixed(df)
    assert mix.columns == df.columns
    a = {r.doc_id: r.n for r in mix.groupBy("doc_id").agg(F.sum(M.n_words(F.col("text"))).alias("n")).collect()}
    b = {r.doc_id: r.taken for r in M.taken(df).filter("taken > 0").collect()}
    assert a == b


def test_mixed_copies_are_parts_of_their_texts(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(30 + 7 * i)), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    text = {d: t for d, t, _ in rows}
    for r in M.mixed(df).collect():
        own = iter(text[r.doc_id].split())
        assert all(w in own for w in r.text.split())  # a subsequence


def test_slots_are_dealt_once_and_blocks_come_round(spark):
    sizes = spark.createDataFrame([("a", 100_000), ("b", 300_000), ("c", 900)], "source string, source_size long")
    s = M.slots(sizes).cache()
    n = s.count()
    assert s.select("shard", "slot").distinct().count() == n
    assert s.agg(F.max(F.col("shard") * M.SHARD_BLOCKS + F.col("slot"))).first()[0] == n - 1
    times = {r.source: (r.low, r.high, r.n) for r in s.groupBy("source", "block").count().groupBy("source").agg(F.min("count").alias("low"), F.max("count").alias("high"), F.count("*").alias("n")).collect()}
    assert all(high - low <= 1 for low, high, _ in times.values()) and times["c"] == (3, 3, 15)


@pytest.mark.parametrize("words", [(6_000_000, 3_000_000, 9_000_000), (500_000, 9_000_000, 9_000_000)])
def test_counts_of_shards_are_multinomial(spark, words):
    """Over the shards, the count of a source has the mean and the variance of a multinomial draw, and counts of two sources its covariance."""
    sizes = spark.createDataFrame(list(zip("abc", words, strict=True)), "source string, source_size long")
    rows = M.slots(sizes).groupBy("shard").pivot("source", ["a", "b", "c"]).count().fillna(0).orderBy("shard").collect()[:-1]
    n, x = len(rows), np.array([[r.a, r.b, r.c] for r in rows], float)
    assert n > 100 and (x.sum(1) == M.SHARD_BLOCKS).all()
    p = x.mean(0) / M.SHARD_BLOCKS
    want = M.SHARD_BLOCKS * (np.diag(p) - np.outer(p, p))
    scale = np.sqrt(np.outer(np.diag(want), np.diag(want)))
    assert (np.abs(np.cov(x.T) - want) <= 5 * scale * math.sqrt(2 / n)).all()


def test_permutations_are_bijections_without_a_pattern(spark):
    for n in (1, 2, 3, 64, 1000, 4097):
        got = [r.p for r in spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k"), F.lit(n)).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        assert got == [plain_permuted(x, n, "k", np.int32(n)) for x in range(n)]
        if n >= 1000:
            step = np.diff(got) % n
            assert len(np.unique(step)) > 0.55 * n and abs(np.corrcoef(np.arange(n), got)[0, 1]) < 5 / math.sqrt(n)


def test_rows_alike_are_rows_of_their_own(spark):
    rows = [(1, "a b c " * 40, "s")] * 5 + [(None, "x y " * 30, None)] * 4 + [(2, "k " * 300, "t"), (2, "", "t")]
    df = check(spark, rows)
    mix = M.mixed(df.withColumn("row", F.lit("kept"))).collect()
    assert sum(len(r.text.split()) for r in mix) == sum(r.taken for r in M.taken(df).collect())
    assert {r.row for r in mix} == {"kept"}


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, None, None)])
    check(spark, [(1, "a", "s"), (1, "a", "s"), (None, "b c", "s")])


@pytest.mark.parametrize("most", [0, 5])
def test_many_sources_are_ordered_by_ranges(spark, monkeypatch, most):
    """Beyond MOST_SOURCES_SENT sources no task sees all of them; the results are those of few sources."""
    monkeypatch.setattr(M, "MOST_SOURCES_SENT", most)
    check(spark, [(i, "w x y " * (i % 41), f"host{i % 60}") for i in range(600)] + [(700 + i, "a b c " * 90, None) for i in range(30)] + [(900, "", "no words")])
    check(spark, [])


def test_driver_table(spark, sf_dir):
    check(spark, [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
