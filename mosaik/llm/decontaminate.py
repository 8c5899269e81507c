"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits. A mask names the token positions that a seed
looks at; the positions between are ignored, so a seed survives substitutions there. Seeds of the
test items and of the documents meet by their hashes, and where they do the two token rows are
laid on each other: a document holds an item where min(16, tokens of the item) aligned tokens have
at least three quarters equal. The first four masks meet every such overlap of 13 tokens or more, and four
more those of items with fewer; the tests try all patterns of substitutions. Items of fewer than LEAST_SEEDED
tokens are found where a document has all their tokens in a row.

Hot seeds. Of seeds that follow each other on one diagonal of document and item only the first makes a pair:
entries of the index are in the order of (seed, the seed one token before), so those that go on from
an earlier hit are left out unseen. Pairs are made a bounded number at a time, become diagonals, and a
diagonal is compared as a whole; so texts of one repeated word cost a pair for each diagonal, not for each two tokens.

The document side is never shuffled: the item side goes to the executors in blocks of a bounded
number of tokens, one pass over the documents for each block. Items are cut into tokens once, into a written table.

Defined results: a null or empty text holds nothing, a null item or one without tokens is in nothing. Repeated rows
of documents give one row for each doc_id and item; extra columns are ignored. Documents may be of any length.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .storage import dropped, written

MASKS = ((0, 1, 2, 4, 5), (0, 3, 5, 6, 7), (0, 1, 2, 3, 7), (0, 1, 2, 3, 4), (0, 1, 4, 5, 6), (0, 2, 3, 4, 5), (0, 1, 2, 4, 7), (0, 1, 3, 4, 7))
#: Items of so many tokens are met by the first so many masks.
LONG, FOR_LONG = 13, 4
WINDOW = 16
LEAST_EQUAL = 0.75
#: Items of fewer tokens are found by all their tokens in a row.
LEAST_SEEDED = 8
#: clean() takes no document away for an item of fewer tokens, which any text may hold.
LEAST_TELLING = 5
#: Tokens of one piece of an item, and of the items that are sent to the executors at once (8 bytes each).
PIECE, BLOCK = 4096, 1_000_000
#: Pairs that are held at once, tokens that are compared at once, and diagonals that are remembered as compared.
PAIRS, COMPARED, DONE = 1 << 18, 1 << 20, 1 << 20

FOUND = "doc_id long, item_id long, n_equal int, item_tokens int, overlap double, doc_token long"
_ROWS = "doc_id long, item_id long, n_equal int, item_tokens int, doc_token long"


def tokens(col: pa.Array) -> tuple[W.Words, np.ndarray]:
    data, texts = W.text_bytes(col)
    w = W.find(W.LOWER[data], texts, W.PUNCT)
    return w, W.hashes(w)


def _pieces(batches):
    """Item rows to (item_id, begin of the piece, n: tokens of the item, token hashes)."""
    for batch in batches:
        w, h = tokens(batch.column("text"))
        for k, item in enumerate(batch.column("item_id").to_pylist()):
            own = h[w.first[k] : w.first[k + 1]].view(np.int64)
            if item is None or not len(own):
                continue
            step = PIECE - WINDOW
            at = range(0, max(1, len(own) - WINDOW), step)
            yield pa.RecordBatch.from_pydict(
                {"item_id": [item] * len(at), "begin": list(at), "n": [len(own)] * len(at), "hashes": [own[a : a + PIECE] for a in at]},
                schema=pa.schema([("item_id", pa.int64()), ("begin", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64()))]),
            )


def seeds(h: np.ndarray, at: np.ndarray, mask: int) -> np.ndarray:
    total = np.full(len(at), mask + 1, np.uint64)
    for k, o in enumerate(MASKS[mask]):
        total += h[at + o] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) % (1 << 64))
    return W.mix(total)


def _seeded(h: np.ndarray, first: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the seeds of a mask in token rows with those beginnings, the seeds, and for each the seed one
    token before (zero at the beginning of a row)."""
    n = np.maximum(np.diff(first) - MASKS[mask][-1], 0)
    at = W.ragged(first[:-1], n)
    s = seeds(h, at, mask)
    before = np.zeros(len(s), np.uint64)
    before[1:] = s[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = 0
    return at, s, before


class Index:
    """The seeds of a block of item pieces, and its short items."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]):
        short = [r for r in rows if r[2] < LEAST_SEEDED]
        rows = [r for r in rows if r[2] >= LEAST_SEEDED]
        parts = [np.frombuffer(r[3], np.int64).view(np.uint64) for r in rows]
        self.item = np.array([r[0] for r in rows], np.int64)
        self.length = np.array([r[2] for r in rows], np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.tokens = np.concatenate([*parts, np.zeros(0, np.uint64)])
        self.piece = np.repeat(np.arange(len(parts)), np.diff(self.first))
        self.masks = range(0 if not rows else FOR_LONG if self.length.min() >= LONG else len(MASKS))
        self.tables = []
        bits = max(10, min(26, 4 + int(len(self.tokens) * len(self.masks)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.known = np.zeros(1 << bits, bool)
        for mask in self.masks:
            at, s, before = _seeded(self.tokens, self.first, mask)
            order = np.lexsort((before, s))
            self.tables.append((s[order], before[order], at[order]))
            self.known[s >> self.shift] = True
        # Short items by their length: distinct runs, and the items of each.
        self.short: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in sorted({r[2] for r in short}):
            by_run: dict[int, list[int]] = {}
            for r in short:
                if r[2] == n:
                    by_run.setdefault(int(W.runs(np.frombuffer(r[3], np.int64).view(np.uint64), n)[0]), []).append(r[0])
            runs = sorted(by_run)
            self.short[n] = np.array(runs, np.uint64), [by_run[r] for r in runs]

    def pairs(self, h: np.ndarray, w: W.Words):
        """Pairs of a token of the documents and one of the items at which equal seeds begin that do not go on from
        equal seeds one token before, some PAIRS at a time."""
        for mask in self.masks:
            at, s, before = _seeded(h, w.first, mask)
            maybe = np.flatnonzero(self.known[s >> self.shift])
            at, s, before = at[maybe], s[maybe], before[maybe]
            known, earlier, place = self.tables[mask]
            low, high = np.searchsorted(known, s, "left"), np.searchsorted(known, s, "right")
            met = np.flatnonzero(high > low)
            at, before, low, high = at[met], before[met], low[met], high[met]
            # Within [low, high) the entries of the same seed before lie together, in [a, b); at a beginning there are none.
            a, b = (_place(earlier, low, high, before, side) for side in ("left", "right"))
            b = np.where(before == 0, a, b)
            left, right = a - low, high - b
            for mine, theirs in ((left, low), (right, b)):
                ends = np.cumsum(mine)
                for c in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                    k = np.arange(c, min(c + PAIRS, int(ends[-1])))
                    row = np.searchsorted(ends, k, "right")
                    yield at[row], place[theirs[row] + k - (ends - mine)[row]]


def _place(values: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
    """searchsorted of x[i] in the sorted values[low[i]:high[i]], for all i at once."""
    a, b = low.copy(), high.copy()
    while (open_ := np.flatnonzero(a < b)).size:
        m = (a[open_] + b[open_]) // 2
        v = values[m]
        up = v < x[open_] if side == "left" else v <= x[open_]
        a[open_[up]] = m[up] + 1
        b[open_[~up]] = m[~up]
    return a


def _compared(index: Index, h: np.ndarray, w: W.Words, d: np.ndarray, piece: np.ndarray, shift: np.ndarray):
    """Of whole diagonals: which hold, with the number of equal tokens and the first of them in the text."""
    low = np.maximum(w.first[d] - shift, index.first[piece])
    size = np.minimum(w.first[d + 1] - shift, index.first[piece + 1]) - low
    need = np.minimum(WINDOW, index.length[piece])
    ends = np.cumsum(size)
    out, cuts = [], np.searchsorted(ends, np.arange(COMPARED, int(ends[-1]) + COMPARED, COMPARED)) + 1
    a = 0
    for b in sorted({*np.minimum(cuts, len(d)).tolist(), len(d)}):
        if a == b:
            continue
        n, j = size[a:b], W.ragged(low[a:b], size[a:b])
        same = h[j + np.repeat(shift[a:b], n)] == index.tokens[j]
        total = np.concatenate([[0], np.cumsum(same)])
        begin = np.cumsum(n) - n
        # Windows of the length that an item needs; at the ends of an overlap they reach beyond it, where nothing is equal.
        width = np.repeat(need[a:b], n)
        k = np.arange(len(j))
        count = total[np.minimum(k + width, np.repeat(begin + n, n))] - total[k]
        best = np.maximum.reduceat(count, begin)
        least = np.ceil(LEAST_EQUAL * need[a:b])
        held = np.flatnonzero(best >= least)
        first = np.searchsorted(total, total[begin[held]] + 1) - 1
        equal = total[begin[held] + n[held]] - total[begin[held]]
        out.append(np.stack([d[a:b][held], piece[a:b][held], j[first] + shift[a:b][held] - w.first[d[a:b][held]], equal], 1))
        a = b
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def _best(found: np.ndarray) -> np.ndarray:
    """Of the rows of one text and piece, the one with the most equal tokens, then the least place."""
    order = np.lexsort((found[:, 2], -found[:, 3], found[:, 1], found[:, 0]))
    found = found[order]
    new = np.ones(len(found), bool)
    new[1:] = (np.diff(found[:, :2], axis=0) != 0).any(1)
    return found[new]


def verified(index: Index, h: np.ndarray, w: W.Words) -> list[tuple[int, int, int, int, int]]:
    """(text, item, its tokens, first equal token of the text, equal tokens): the best alignment with each piece that the texts hold."""
    texts = W.of_text(w)
    # A diagonal as one number: how far apart the tokens are, by piece; it tells the text, too, once that is known.
    span = len(h) + len(index.tokens) + 1
    best, done = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
    for p, q in index.pairs(h, w):
        d, piece, shift = texts[p], index.piece[q], p - q
        key = (d * len(index.item) + piece) * (2 * span) + shift + span
        key, at = np.unique(key, return_index=True)
        new = done[np.minimum(np.searchsorted(done, key), len(done) - 1)] != key if len(done) else np.ones(len(key), bool)
        if not new.any():
            continue
        at = at[new]
        done = np.sort(np.concatenate([done, key[new]])) if len(done) < DONE else key[new]
        best = _best(np.concatenate([best, _compared(index, h, w, d[at], piece[at], shift[at])]))
    out = [(d, int(index.item[k]), int(index.length[k]), t, n) for d, k, t, n in best.tolist()]
    for n, (runs, items) in index.short.items():
        at = W.whole(w, n)
        s = W.runs(h, n)[at]
        k = np.searchsorted(runs, s)
        met = np.flatnonzero(runs[np.minimum(k, len(runs) - 1)] == s)
        # In each text the first place of each run.
        _, one = np.unique(texts[at[met]] * len(runs) + k[met], return_index=True)
        for m in met[one].tolist():
            d = int(texts[at[m]])
            out += [(d, item, n, int(at[m] - w.first[d]), n) for item in items[k[m]]]
    return out


_held: list = [None, None]


def _index(sent: tuple) -> Index:
    """The index of a block of items, built once in each Python process."""
    key, rows = sent
    if _held[0] != key:
        _held[:] = [None, None]
        _held[:] = [key, Index(rows.value)]
    return _held[1]


def _scan(sent):
    def scan(batches):
        index = _index(sent)
        for batch in W.slices(batches):
            w, h = tokens(batch.column("text"))
            found = verified(index, h, w)
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": [ids[d] for d, *_ in found],
                    "item_id": [i for _, i, *_ in found],
                    "n_equal": [n for *_, n in found],
                    "item_tokens": [size for _, _, size, *_ in found],
                    "doc_token": [t for *_, t, _ in found],
                },
                schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_equal", pa.int32()), ("item_tokens", pa.int32()), ("doc_token", pa.int64())]),
            )

    return scan


class _Items:
    """The pieces of the items, cut into tokens once, and sent to the executors a block at a time."""

    def __init__(self, items: DataFrame, least: int, block: int):
        rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces, "item_id long, begin long, n long, hashes array<long>")
        self.table = written(rows.filter(F.col("n") >= least), "items")
        total = self.table.agg(F.sum(F.size("hashes"))).first()[0] or 0
        self.blocks = -(-total // block)

    def sent(self, b: int) -> tuple:
        """A key, and the rows of a block."""
        mine = self.table.filter(F.pmod(F.xxhash64("item_id", "begin"), F.lit(self.blocks)) == b).collect()
        rows = [(r.item_id, r.begin, r.n, np.array(r.hashes, np.int64).tobytes()) for r in mine]
        return uuid.uuid4().hex, self.table.sparkSession.sparkContext.broadcast(rows)


def overlaps(docs: DataFrame, items: DataFrame, block: int = BLOCK, least_tokens: int = 1) -> DataFrame:
    """One row for each document and test item, of least_tokens or more, that it holds: equal tokens on the best alignment,
    their share of the item, and the token of the document at which that alignment begins.

    The driver holds one block of items at a time; where there are several, the rows of each are written before the next."""
    spark: SparkSession = docs.sparkSession
    pieces = _Items(items, least_tokens, block)
    if not pieces.blocks:
        dropped(pieces.table)
        return spark.createDataFrame([], FOUND)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for b in range(pieces.blocks):
        sent = pieces.sent(b)
        found = texts.mapInArrow(_scan(sent), _ROWS)
        if pieces.blocks > 1:
            found = written(found, "overlaps")
            sent[1].destroy()
        out = found if out is None else out.unionAll(found)
    dropped(pieces.table)
    best = out.groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("n_equal", "item_tokens", "doc_token"), F.struct("n_equal", -F.col("doc_token"))).alias("b")
    )
    return best.select(
        "doc_id", "item_id", "b.n_equal", "b.item_tokens", F.least(F.lit(1.0), F.col("b.n_equal") / F.col("b.item_tokens")).alias("overlap"), "b.doc_token"
    )


def _without(sent):
    def scan(batches):
        index = _index(sent)
        for batch in W.slices(batches):
            w, h = tokens(batch.column("text"))
            free = np.ones(batch.num_rows, bool)
            free[[d for d, *_ in verified(index, h, w)]] = False
            yield batch.filter(pa.array(free))

    return scan


def clean(docs: DataFrame, items: DataFrame, block: int = BLOCK, least_tokens: int = LEAST_TELLING) -> DataFrame:
    """The documents that hold no test item of least_tokens or more. Rows are judged by their own texts, also where several
    share a doc_id or have none. Nothing is shuffled; each block of items is a pass that is written for the next one."""
    pieces = _Items(items, least_tokens, block)
    out = docs.withColumn("text", F.col("text").cast("string"))
    for b in range(pieces.blocks):
        sent, last = pieces.sent(b), out
        out = last.mapInArrow(_without(sent), last.schema)
        if b + 1 < pieces.blocks:
            out = written(out, "clean")
            sent[1].destroy()
    dropped(pieces.table)
    return out
