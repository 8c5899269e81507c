"""Sharding by minimax contiguous partition, with DataFrame functions only.

Equal texts are one atomic group. Groups stand in the order of a hash of their text, and the smallest
capacity is found for which greedy filling, in that order, needs no more than the given number of
shards; the shards are cut there. So the largest shard is as small as any cut of that order allows.

The driver never sees the groups. It sees sums over ranges of the hash, first 2 ** FIRST_BITS of them. The
cuts of a capacity then lie between two walks over the ranges: one takes it that a range can be cut
anywhere, the other that a cut loses as much as the largest group there. What the walks agree on bounds
the least capacity; for the one in the middle, ranges in which its own cuts can fall are summed again in
2 ** MORE_BITS parts, and so on until the bounds meet and each cut is known. A round sums no more than
shards * (shards + 2) ranges again, whatever the sizes of the groups; the search is exact.

Assigning a document compares its hash with the cuts: no join and no shuffle of texts. The place in a
shard comes from numbering.running_sum.

Defined results: a null text is the empty one (size 1, CRC 0). Texts that share the 64-bit hash are one
group. Fewer groups than shards leave shards empty; an empty table gives no rows. Repeated rows and rows
without doc_id are rows like others; extra columns of any name are kept by sharded().
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import running_sum
from .storage import dropped, written

SHARDS = 16
FIRST_BITS, MORE_BITS = 16, 8


class Range(NamedTuple):
    """Groups whose hash lies in [low, low + 2 ** (64 - bits)): their bytes, the largest, and how many there are."""

    low: int
    bits: int
    size: int
    largest: int
    groups: int

    @property
    def whole(self) -> bool:
        return self.groups == 1 or self.bits >= 64


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) + 1).cast("long")


def text_key(text: Column) -> Column:
    """The hash that orders groups."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


class Ends:
    """Ranges in order, with the running sums of their bytes."""

    def __init__(self, ranges: list[Range]):
        self.ranges, self.ends, total = ranges, [], 0
        for r in ranges:
            total += r.size
            self.ends.append(total)
        self.total = total
        self.largest = max(r.largest for r in ranges)

    def cut(self, at: int) -> tuple[int, int]:
        """The least and the greatest byte at which the last group that ends by that byte can end."""
        i = bisect_right(self.ends, at)
        if i == len(self.ends):
            return self.total, self.total
        base = self.ends[i - 1] if i else 0
        r = self.ranges[i]
        return max(base, at - r.largest + 1), base if r.whole else at

    def walks(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Between which bytes greedy filling ends each shard."""
        low, high, out = 0, 0, []
        for _ in range(shards):
            low, high = self.cut(low + capacity)[0], self.cut(high + capacity)[1]
            out.append((low, high))
        return out

    def bounds(self, shards: int) -> tuple[int, int]:
        """Of the least capacity."""
        least = max(self.largest, -(-self.total // shards))
        out = []
        for side in (1, 0):
            low, high = least, least + self.largest
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if self.walks(middle, shards)[-1][side] >= self.total else (middle + 1, high)
            out.append(low)
        return out[0], out[1]

    def unsure(self, capacity: int, shards: int) -> list[int]:
        """Which ranges of several groups its cuts can fall in; of a cut with many, those at both ends."""
        out: set[int] = set()
        before = (0, 0)
        for now in self.walks(capacity, shards):
            first, last = (bisect_right(self.ends, b + capacity) for b in before)
            out.update(range(first, last + 1) if last - first <= shards else (first, last))
            before = now
        return [i for i in sorted(out) if i < len(self.ranges) and not self.ranges[i].whole]


def _sums(groups: DataFrame, ranges: list[Range] | None) -> list[Range]:
    """All ranges of the first width, or the parts of the given ones.

    The given ranges are looked up in one set of beginnings for each width, so the expression is flat however many there are."""
    part = lambda bits: F.expr(f"(_key >> {64 - bits}) << {64 - bits}") if bits < 64 else F.col("_key")
    if ranges is None:
        low, bits = part(FIRST_BITS), lambda _: FIRST_BITS
    else:
        by_width: dict[int, list[int]] = {}
        for r in ranges:
            by_width.setdefault(r.bits, []).append(r.low)
        finer = {b: min(64, b + MORE_BITS) for b in by_width}
        low = F.coalesce(*[F.when(part(b).isin(lows), part(finer[b])) for b, lows in by_width.items()])
        starts = [r.low for r in ranges]
        bits = lambda at: finer[ranges[bisect_right(starts, at) - 1].bits]
    rows = groups.groupBy(low.alias("low")).agg(F.sum("_size").alias("size"), F.max("_size").alias("largest"), F.count("*").alias("groups")).filter("low IS NOT NULL").collect()
    return [Range(r["low"], bits(r["low"]), r["size"], r["largest"], r["groups"]) for r in rows]


def cut_points(docs: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """The smallest capacity in bytes, and the hash at which each shard after the first begins (fewer if the rest stay empty)."""
    sized = docs.select(text_key(F.col("text")).alias("_key"), text_size(F.col("text")).alias("_size"))
    groups = written(sized.groupBy("_key").agg(F.sum("_size").alias("_size")), "groups")
    ranges = sorted(_sums(groups, None))
    if not ranges:
        return 0, []
    while True:
        known = Ends(ranges)
        low, high = known.bounds(shards)
        capacity = (low + high) // 2
        left = [ranges[i] for i in known.unsure(capacity, shards)]
        if not left:
            break
        gone = set(left)
        ranges = sorted([r for r in ranges if r not in gone] + _sums(groups, left))
    dropped(groups)
    begins = [known.ends.index(at) + 1 for at, _ in known.walks(capacity, shards)[:-1] if at < known.total]
    return capacity, [ranges[i].low for i in begins]


def shard_of(text: Column, cuts: list[int]) -> Column:
    key = text_key(text)
    out = F.lit(0)
    for c in cuts:
        out = out + (key >= F.lit(c)).cast("int")
    return out.cast("int")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with shard (int) and slot (long, gapless from 0 in each shard); both names are replaced if present."""
    _, cuts = cut_points(docs, shards)
    own = docs.drop("shard", "slot")
    placed = own.withColumn("shard", shard_of(F.col("text"), cuts))
    return running_sum(placed, ["shard"], ["doc_id"], F.lit(1), "slot")


def laid_out(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row, without carrying texts through a shuffle."""
    _, cuts = cut_points(docs, shards)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), shard_of(F.col("text"), cuts).alias("shard")
    )
    out = running_sum(rows, ["shard"], ["doc_id"], F.lit(1), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
