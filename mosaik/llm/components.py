"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is two aggregations, of the least neighbour of each node, and two joins of the links with them.
The aggregates are written before they are joined: so a node with very many links is summed up before it
moves, and in the join its links are dealt to several tasks. Each round is written to the shared folder, too, which
cuts the lineage and lets lost executors be replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import joined
from .storage import dropped, written


def _large_star(e: DataFrame, least: DataFrame) -> DataFrame:
    up = e.select(F.col("b").alias("low"), F.col("a").alias("high")).filter("high > low")
    return joined(up, least, "low", "a", F.col("high")).select(F.col("high").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame, least: DataFrame) -> DataFrame:
    own = least.select(F.col("a").alias("hub"), "m")
    rest = joined(e, own, "a", "hub", F.col("b")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionAll(rest).distinct()


def _both(e: DataFrame) -> DataFrame:
    return e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _round(e: DataFrame) -> DataFrame:
    """The links after one large-star and one small-star step."""
    least = written(_both(e).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    large = written(_large_star(e, least), "links")
    dropped(e, least)
    least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
    small = written(_small_star(large, least), "links")
    dropped(large, least)
    return small


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b), both long; component is its least node.

    Links may repeat, point either way or from a node to itself; nulls are ignored. No links: no rows."""
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "links")
    state = _state(e)
    while state[0]:
        e = _round(e)
        before, state = state, _state(e)
        if state == before:
            break
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
