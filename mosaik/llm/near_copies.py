"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words are runs of bytes between white space, ASCII letters in lower case; a text of fewer words than a shingle
has the whole sequence as its only shingle, and texts without words equal each other.

Search. A text has PRINTS SimHash fingerprints of its words, each under a hash of its own; a word counts as often as the
square root of its occurrences, so that neither the commonest words nor rare ones decide alone. At a
similarity of 0.8 about one word in forty has changed, and three or four bits of 64 differ; the anchors of simhash.py meet
all fingerprints within its threshold. A SimHash of the shingles within AGREED bits vouches for a pair (at 0.8 ten bits differ,
with a deviation of three; of unrelated texts 32). Verdict. The sets of shingles of a pair are made again and compared, element by element;
only pairs of 0.8 or more are links, and a group is what links connect. Sets come with the parity of how many of their
elements fall in each of PARITIES cells: where more parities differ than elements may at 0.8, the sets need no comparison.

A pair of 0.8 is missed where all its fingerprints are further apart; README has the measured recall. What is met is judged without
loss and without all pairs of a group: first a forest of the candidates is compared. Where one of its links fails, the
nodes that hang together there are taken again, with their sizes and parities, which settle most pairs at the anchor. Each is compared
with one possible candidate outside of its group so far, which joins nearly all that belongs together, and then with all that are left.

Equal texts are one node. Texts that share a 64-bit hash are equal, shingles likewise.

Defined results of one_of_each(): a null text is the empty one, and all texts without words are one group, of which one
row stays. Rows alike in doc_id and text count once. Of a group the row with the least doc_id stays; one without doc_id only
where no row of the group has one. Columns of any name are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from . import words as W
from .components import components
from .skew import joined
from .storage import dropped, written

SHINGLE = 5
PRINTS = 4
AGREED = 22
TURNS = 1
PARITIES = 1024
_U = np.uint64
_BLANK = _U(0x2545F4914F6CDD1D)


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, in order and with repeats, and how many each text has, one at least."""
    raw, texts = W.text_bytes(col)
    w = W.find(W.LOWER[raw], texts)
    h, n, first = W.hashes(w), np.diff(w.first), w.first[:-1]
    count = np.maximum(n - SHINGLE + 1, 1)
    begin = np.cumsum(count) - count
    out = np.full(int(count.sum()), _BLANK, _U)
    for size in range(1, SHINGLE + 1):
        own = np.flatnonzero(n == size if size < SHINGLE else n >= size)
        if len(own):
            out[W.ragged(begin[own], count[own])] = W.runs(h, size)[W.ragged(first[own], count[own])]
    return out, count


def word_prints(col: pa.Array) -> np.ndarray:
    """A row of PRINTS fingerprints for each text, of its words."""
    w = W.find(W.LOWER[(raw := W.text_bytes(col))[0]], raw[1])
    h, text = W.hashes(w), W.of_text(w)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    at = np.flatnonzero(np.r_[np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
    weight = np.rint(np.sqrt(np.diff(np.r_[at, len(h)]))).astype(np.int64)
    count = np.bincount(text[at], weights=weight, minlength=len(col)).astype(np.int64)
    out = np.zeros((len(col), PRINTS), _U)
    for k in range(PRINTS):
        out[:, k] = simhash.majority(np.repeat(W.mix(h[at] ^ _U(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))), weight), count)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key: a hash of the text, text) of each row."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


_PRINTS = [f"f{k}" for k in range(PRINTS)]


def _printed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, confirm: the fingerprint of the shingles, f0, f1, ...) of each row."""

    def scan(batches):
        for b in W.slices(batches):
            prints = word_prints(b.column("text")).view(np.int64)
            confirm = simhash.majority(*shingles(b.column("text"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(confirm), *(pa.array(x) for x in np.ascontiguousarray(prints.T))], ["doc_id", "key", "confirm", *_PRINTS])

    return _keyed(docs).mapInArrow(scan, ", ".join(f"{c} long" for c in ["doc_id", "key", "confirm", *_PRINTS]))


_BITS = [f"p{k}" for k in range(PARITIES // 64)]


def parities(h: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """A row of PARITIES bits for each text, as 64-bit numbers, from the distinct shingles of each."""
    odd = np.bincount(owner * PARITIES + (h >> _U(32)).astype(np.int64) % PARITIES, minlength=texts * PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64).reshape(texts, -1)


def _sets(docs: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set: its distinct shingles, n: how many, p0, p1, ...: its parities) of the given nodes; own: the rows of _printed()."""

    def scan(batches):
        for b in W.slices(batches):
            h, count = shingles(b.column("text"))
            owner = np.repeat(np.arange(len(count)), count)
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, owner = h[new], owner[new]
            ends = np.searchsorted(owner, np.arange(len(count) + 1)).astype(np.int32)
            bits = parities(h, owner, len(count))
            columns = [b.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64))), pa.array(np.diff(ends)), *(pa.array(x) for x in np.ascontiguousarray(bits.T))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "set", "n", *_BITS])

    # Of the rows of one text, very many perhaps, only the one with the least doc_id moves.
    known = own.groupBy(F.col("key").alias("k")).agg(F.min("doc_id").alias("d")).join(nodes, F.col("k") == F.col("node"), "left_semi")
    rows = _keyed(docs).join(known, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").dropDuplicates(["key"])
    return rows.select("key", "text").mapInArrow(scan, "node long, set array<long>, n int, " + ", ".join(f"{c} long" for c in _BITS))


def _may_be(x: str, y: str) -> Column:
    """Whether sets with these sizes and parities can have the similarity; at 0.8 a ninth of all elements, at most, is not in both."""
    differ = sum((F.bit_count(F.col(f"{x}_{c}").bitwiseXOR(F.col(f"{y}_{c}"))) for c in _BITS), F.lit(0))
    sizes = F.col(f"{x}_n") + F.col(f"{y}_n")
    return (9 * F.abs(F.col(f"{x}_n") - F.col(f"{y}_n")) <= sizes) & (9 * differ <= sizes)


def _of(sets: DataFrame, side: str) -> DataFrame:
    return sets.select(*[F.col(c).alias(f"{side}_{c}") for c in sets.columns])


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with what is known of both; a node may be the b of very many pairs."""
    return joined(pairs, _of(sets, "y"), "b", "y_node", F.col("a")).join(_of(sets, "x"), F.col("a") == F.col("x_node"))


def may_be(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The same of rows (n, p0, p1, ...) of many pairs."""
    sizes = x[0] + y[0]
    left = np.flatnonzero(9 * np.abs(x[0] - y[0]) <= sizes)
    differ = np.zeros(len(left), np.int64)
    for p, q in zip(x[1:], y[1:], strict=True):
        differ += np.bitwise_count((p[left] ^ q[left]).view(_U))
    out = np.zeros(len(sizes), bool)
    out[left] = 9 * differ <= sizes[left]
    return out


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    found = _met(pairs, sets).filter(9 * F.size(F.array_intersect("x_set", "y_set")) >= 4 * (F.col("x_n") + F.col("y_n")))
    return written(found.select("a", "b"), "links")


def links(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Links (a, b) of nodes, the hashes of texts, that connect what all candidates of similarity 0.8 do; own: the rows of _printed()."""
    nodes = written(own.drop("doc_id").dropDuplicates(["key"]), "nodes")
    prints = nodes.select(F.posexplode(F.array(*_PRINTS)).alias("print", "fingerprint"), "confirm", F.col("key").alias("node"))
    tried = written(simhash.links(prints, agreed=AGREED).distinct(), "pairs")
    sets = written(_sets(docs, own, tried.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "shingles")
    marks = sets.drop("set")
    possible = written(_met(tried, marks).filter(_may_be("x", "y")).select("a", "b"), "possible")
    found = _alike(possible, sets)
    failed = tried.join(found, ["a", "b"], "left_anti")
    if failed.isEmpty():
        return found
    # What hangs together with a candidate that is no link: other candidates may be links there.
    together = components(tried)
    doubtful = failed.join(together, F.col("a") == F.col("node")).select("component").distinct()
    members = together.join(doubtful, "component", "left_semi").select(F.col("node").alias("member"))
    marked = members.join(marks, F.col("member") == F.col("node")).drop("node")
    rows = prints.drop("confirm").join(marked, F.col("node") == F.col("member")).drop("member")
    rows = written(rows.withColumn("n", F.col("n").cast("long")), "doubtful")
    for turn in [*range(TURNS), None]:
        groups = components(found).withColumnRenamed("node", "linked")
        grouped = rows.join(groups, F.col("node") == F.col("linked"), "left").withColumn("group", F.coalesce("component", "node")).drop("linked", "component")
        pairs = written(simhash.links(grouped, turn=turn, may=may_be).distinct(), "pairs")
        more = _alike(pairs, sets)
        dropped(pairs)
        if more.isEmpty():
            continue
        found = written(found.unionAll(more), "links")
    dropped(nodes, tried, sets, possible, rows)
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the one with the least doc_id (one without only where no other is), then the least hash of text."""
    own = written(_printed(docs), "prints").select("doc_id", "key", "confirm", *_PRINTS)
    nodes = own.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r"))
    groups = components(links(docs, own))
    least = nodes.join(groups, F.col("key") == F.col("node"), "left").groupBy(F.coalesce("component", "key").alias("component")).agg(F.min("r").alias("r"))
    stay = least.select(F.col("r.doc_id").alias("d"), F.col("r.key").alias("k"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"))
    out = rows.join(stay, F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi")
    if not own.groupBy("doc_id", "key").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["id", "key"])  # repeated rows
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
