"""SimHash near-duplicates by anchor-point covering.

A fingerprint has a bit set where over half of the XXH64 values of the text's word shingles have it.
Fingerprints at THRESHOLD = 4 or fewer differing bits are linked; a group is what links connect.

Search. The 64 bits fall into blocks of 22, 21 and 21. Of 4 differing bits at most 2 lie in some pair of
blocks, so such a pair has a middle point, in those two blocks, that differs from either fingerprint in
at most 1 bit. The anchors of a block are the 4096 words of the binary Golay code of length 23 (blocks
are padded with zeros), whose covering radius is 3: the middle point has an anchor within 3 in each
block, and both fingerprints lie within covering radius plus their share of the threshold of it, that
is 3 in both blocks or 3 in one and 4 in the other. Each fingerprint is replicated to all such anchors
(29 on average for three pairs of blocks, of 50 million anchors) and compared per anchor, so no pair is
missed. Equal fingerprints are one row before they are replicated.

A task compares the members of an anchor in blocks and returns a spanning forest of what it links, never
all pairs. Anchors of more than CROWDED members are cut into chunks, and each pair of chunks is a task.

A second fingerprint, of other shingles, may be asked to confirm a link. near_copies.py uses both to find texts
whose shingles are similar.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any
other. Fewer words than a shingle has: the whole sequence is the only shingle. Rows with the same doc_id
are rows of their own; a null doc_id is never a component_id unless its group has no other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .skew import joined
from .storage import written

THRESHOLD = 4
SHINGLE = 4
SEED = 42
#: Widths of the blocks, from the lowest bit.
BLOCKS = (22, 21, 21)
#: Generator polynomial of the binary Golay code of length 23 with 12 information bits.
GOLAY = 0xAE3
CROWDED = 4096
_U = np.uint64
_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], _U)


def fingerprint(col: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    import xxhash

    raw, texts = W.text_bytes(col)
    w = W.find(W.LOWER[raw], texts)
    size = w.ends - w.starts
    at = np.cumsum(size + 1) - size - 1
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    joined[W.ragged(at, size)] = w.data[W.ragged(w.starts, size)]
    n = np.diff(w.first)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = W.ragged(w.first[:-1], count)
    last = np.minimum(first + shingle, np.repeat(w.first[1:], count)) - 1
    text, hash64 = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((hash64(text[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] + size[last]).tolist(), strict=True)), _U, len(first))
    return majority(h, count)


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text, the bits that over half of its numbers have; count tells how many of h belong to each, in order."""
    out = np.zeros(len(count), _U)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    # Lanes of 8 bits hold sums of up to 255 shingles.
    parts = -(-count[some] // 255)
    begins = W.ragged(np.zeros(len(some), np.int64), parts) * 255 + np.repeat(np.cumsum(count[some]) - count[some], parts)
    owner = np.cumsum(parts) - parts
    octets = h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, k]], begins)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        bits = (2 * sums > count[some][:, None]).astype(_U)
        out[some] |= (bits << np.arange(8, dtype=_U)).sum(1, dtype=_U) << _U(8 * k)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key: a hash of the text, fingerprint as signed long) of each row."""

    def scan(batches):
        for b in W.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fingerprint(b.column("text"), shingle).view(np.int64))], ["doc_id", "key", "fingerprint"])

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return own.mapInArrow(scan, "doc_id long, key long, fingerprint long")


@lru_cache(maxsize=1)
def _cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the Golay code: the remainder of each upper half word; by remainder, the error of weight 3 at most,
    and the five errors of weight 4 (zeros where there are none)."""

    def remainder(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= GOLAY << (k - 11)
        return v

    upper = np.array([remainder(v << 11) for v in range(4096)], np.int64)
    near, far, n = np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64), np.zeros(2048, int)
    unit = [remainder(1 << k) for k in range(23)]
    for size in range(5):
        for places in combinations(range(23), size):
            e, s = 0, 0
            for k in places:
                e |= 1 << k
                s ^= unit[k]
            if size < 4:
                near[s] = e
            else:
                far[s, n[s]] = e
                n[s] += 1
    return upper, near, far


def anchors(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) of every replica."""
    upper, near, far = _cosets()
    low, homes, others = 0, [], []
    for width in BLOCKS:
        v = ((f >> _U(low)) & _U((1 << width) - 1)).astype(np.int64)
        low += width
        s = upper[v >> 11] ^ (v & 2047)
        homes.append((v ^ near[s]) >> 11)
        e = far[s]
        others.append(np.where(e > 0, (v[:, None] ^ e) >> 11, -1))
    rows, keys = [], []
    everyone = np.arange(len(f))
    for pair, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        rows.append(everyone)
        keys.append((pair << 24) | (homes[i] << 12) | homes[j])
        for a, b in ((others[i], homes[j][:, None]), (homes[i][:, None], others[j])):
            a, b = np.broadcast_arrays(a, b)
            r, c = np.nonzero((a >= 0) & (b >= 0))
            rows.append(r)
            keys.append((pair << 24) | (a[r, c] << 12) | b[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _replicate(batches):
    """(print, fingerprint, ...) to (key, fingerprint, ...): each row once for each anchor; prints have anchors of their own."""
    for b in batches:
        names = b.schema.names[1:]
        for a in range(0, b.num_rows, 20_000):
            which, *own = (c.to_numpy(zero_copy_only=False) for c in b.slice(a, 20_000).columns)
            r, k = anchors(own[0].view(_U))
            yield pa.RecordBatch.from_arrays([pa.array(k | which[r] << 26), *(pa.array(x[r]) for x in own)], ["key", *names])


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent after the sets of a[i] and b[i] have been joined; each node points to the least of its set."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def forest(key: np.ndarray, f: np.ndarray, g: np.ndarray, threshold: int, agreed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect the same rows as all pairs of one key with f within the threshold and g within
    agreed bits do; key is sorted."""
    n = len(key)
    parent = np.arange(n)
    lag, left = 1, np.arange(n - 1)
    while len(left) and lag <= 32:
        left = left[left + lag < n]
        left = left[key[left] == key[left + lag]]
        close = left[(np.bitwise_count(f[left] ^ f[left + lag]) <= threshold) & (np.bitwise_count(g[left] ^ g[left + lag]) <= agreed)]
        parent = _unite(parent, close, close + lag)
        lag += 1
    if len(left):
        cuts = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, n], strict=True):
            if b - a > 32:
                step = max(1, (1 << 20) // (b - a))
                for c in range(a, b, step):
                    d = min(b, c + step)
                    i, j = np.nonzero((np.bitwise_count(f[c:d, None] ^ f[None, a:b]) <= threshold) & (np.bitwise_count(g[c:d, None] ^ g[None, a:b]) <= agreed))
                    parent = _unite(parent, i + c, j + a)
    kids = np.flatnonzero(parent != np.arange(n))
    return kids, parent[kids]


def across(key: np.ndarray, f: np.ndarray, group: np.ndarray, threshold: int, one: bool, may: Callable | None):
    """Pairs of rows of one key and different groups with f within the threshold that may(i, j) leaves, some at a time:
    all of them, or for each row the first such one."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(key)], strict=True):
        step = max(1, (1 << 18) // max(1, b - a))
        for c in range(a, b, step):
            d = min(b, c + step)
            apart = group[c:d, None] != group[None, a:b] if one else group[c:d, None] < group[None, a:b]
            i, j = np.nonzero((np.bitwise_count(f[c:d, None] ^ f[None, a:b]) <= threshold) & apart)
            i, j = i + c, j + a
            if may is not None and len(i):
                left = may(i, j)
                i, j = i[left], j[left]
            if one:
                i, at = np.unique(i, return_index=True)
                j = j[at]
            if len(i):
                yield i, j


def _compare(threshold: int, agreed: int, crowded: int | None, turn: int | None, may: Callable | None):
    """Sorted replicas to links (a, b): (key, fingerprint, node, confirm) to a forest, (key, fingerprint, node, group, ...) to pairs
    across groups, of which may is asked about the columns beyond.

    The replicas of an anchor with more than crowded come back as they are."""

    def links_of(rows: list[np.ndarray]):
        if turn is not None:
            order = np.lexsort((W.mix(rows[2].view(_U) + _U(turn)), rows[0]))
            rows = [x[order] for x in rows]
        key, f, node, other, *more = rows
        f = f.view(_U)
        pairs = [forest(key, f, other.view(_U), threshold, agreed)] if may is None else across(key, f, other, threshold, turn is not None, lambda i, j: may([x[i] for x in more], [x[j] for x in more]))
        for i, j in pairs:
            yield found(False, [node[i], node[j], *([i * 0] * (len(rows) - 2))])

    def found(back: bool, rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), back)), *map(pa.array, rows)], ["?", *_columns(len(rows))])

    def compare(batches):
        held, full = None, None
        for b in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if full is not None:  # the rest of a crowded anchor
                same = rows[0] == full
                yield found(True, [x[same] for x in rows])
                rows = [x[~same] for x in rows]
                if not len(rows[0]):
                    continue
                full = None
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            k = rows[0]
            if crowded is not None:
                change = np.flatnonzero(np.diff(k)) + 1
                begin, end = np.r_[0, change], np.r_[change, len(k)]
                many = np.repeat(end - begin > crowded, end - begin)
                if many.any():
                    yield found(True, [x[many] for x in rows])
                    full = k[-1] if many[-1] else None
                    rows = [x[~many] for x in rows]
                    k = rows[0]
            last = np.searchsorted(k, k[-1]) if len(k) and full is None else len(k)
            held = [x[last:] for x in rows]
            if last:
                yield from links_of([x[:last] for x in rows])
        if held is not None and len(held[0]):
            yield from links_of(held)

    return compare


def _columns(n: int) -> list[str]:
    return [f"c{k}" for k in range(n)]


def _per_anchor(replicas: DataFrame, threshold: int, agreed: int, crowded: int | None, turn: int | None, may: Callable | None) -> DataFrame:
    parts = int(replicas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = replicas.repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compare(threshold, agreed, crowded, turn, may), ", ".join(["crowded boolean", *(f"{c} long" for c in _columns(len(replicas.columns)))]))


def links(distinct: DataFrame, threshold: int = THRESHOLD, agreed: int = 64, crowded: int = CROWDED, turn: int | None = None, may: Callable | None = None) -> DataFrame:
    """Links (a, b) of nodes that connect the given rows (fingerprint, node, confirm), distinct, as all pairs with
    fingerprints within the threshold and confirm within agreed bits would.

    A column print, if there is one, tells several fingerprints of a node apart: only those of one print are compared.
    With may, rows are (fingerprint, node, group, ...), and what comes is pairs of nodes with fingerprints within the threshold whose groups
    differ and that may, asked about lists of the columns beyond of both, leaves: all of them, or, with a
    number in turn, for each node as a at each anchor the first b in an order that the turn chooses."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the anchors cover thresholds up to {THRESHOLD}")
    first = ["fingerprint", "node", "confirm" if may is None else "group"]
    carried = first if may is None else [*first, *(c for c in distinct.columns if c not in (*first, "print"))]
    own = F.col("print").cast("long") if "print" in distinct.columns else F.lit(0).cast("long")
    replicas = distinct.select(own.alias("print"), *carried).mapInArrow(_replicate, ", ".join(f"{c} long" for c in ["key", *carried]))
    found = written(_per_anchor(replicas, threshold, agreed, crowded, turn, may), "anchors")
    out = found.filter("NOT crowded").select(F.col("c0").alias("a"), F.col("c1").alias("b"))
    names = ["key", *carried]
    full = found.filter("crowded").select(*(F.col(c).alias(name) for c, name in zip(_columns(len(names)), names, strict=True)))
    if full.isEmpty():
        return out
    # Each pair of chunks of a crowded anchor becomes an anchor of its own.
    sizes = full.groupBy(F.col("key").alias("k")).agg(F.ceil(F.count("*") / F.lit(crowded // 2)).alias("n_chunks"))
    chunk = joined(full, sizes, "key", "k", F.col("node")).withColumn("c", F.pmod(F.xxhash64("node"), "n_chunks")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)))
    pairs = chunk.select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("key"), *carried)
    return out.unionAll(_per_anchor(pairs, threshold, agreed, None, turn, may).select(F.col("c0").alias("a"), F.col("c1").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id: the least doc_id of its group) of each row.

    Groups and their least doc_ids meet by node and by component, of which one may hold most rows: those are dealt to several tasks."""
    own = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(own.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    distinct = nodes.select("fingerprint", F.col("fingerprint").alias("confirm"), F.col("fingerprint").alias("node"))
    groups = components(links(distinct, threshold))
    linked = written(groups.join(nodes, F.col("node") == F.col("fingerprint")).select("node", "component", "least"), "linked")
    ids = written(linked.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id")), "ids")
    of = joined(linked, ids, "component", "c", F.col("node")).select("node", "component_id")
    each = nodes.join(of, F.col("fingerprint") == F.col("node"), "left")
    each = each.select(F.col("fingerprint").alias("node"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = joined(own, written(each, "components"), "fingerprint", "node", F.struct("doc_id", "key"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
