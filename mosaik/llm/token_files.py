r"""Token-id files in patched frame-of-reference blocks.

Documents are dealt out by ranges of (doc_id, hash of text), sorted, and encoded; every document ends
with END. A partition becomes segments of whole documents, about SEGMENT ids each, and a segment is one
binary value in a table that Spark's own writer commits, on any file system, so a lost executor leaves
no half-written file behind. A row of the table has the partition and the number of the segment in it,
the ids before it in the partition, the documents with their lengths, and the bytes:

    4s magic, u32 number of ids, u32 number of blocks, u32 start of each block, then the blocks:
    u32 least id, u8 width, u8 number of outliers, the low width bits of id - least for BLOCK ids,
    packed from the lowest bit, u8 places of outliers, u32 their bits above the width.

The width of a block is what nine tenths of its ids need, by the PERCENTILE of id - least; the others
are outliers. The last block of a segment is filled up with its least id. The block starts give access
to any id without unpacking those before it.

Encoding. Byte-level BPE never joins a word with the white space after it, nor a letter with a mark
after it, so a text is encoded by pieces that begin at white space after a word or at an ASCII mark after
an ASCII letter; each distinct piece is given to the tokenizer once and remembered, for a bounded number
of pieces. Texts with white space beyond ASCII, or what looks like a special token, are
encoded whole.
Pieces are recognised by 64-bit hashes.

Defined results: a null text is the empty one and has END alone. Rows without doc_id come first. Rows
with one doc_id are ordered by a hash of their texts. Extra columns are ignored. No rows: an empty table.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .storage import shuffles_dropped

END = 0
BLOCK = 128
PERCENTILE = 90
SEGMENT = 1 << 18
MAGIC = b"PFR1"
#: Distinct pieces that an encoder remembers, in about 60 MB; then it begins anew.
REMEMBERED = 1_000_000
_U32 = np.uint32


# --- blocks -------------------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """The bytes of a segment."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    x = np.empty(blocks * BLOCK, _U32)
    x[:n] = ids
    if blocks:
        x[n:] = x[(blocks - 1) * BLOCK : n].min()
    x = x.reshape(blocks, BLOCK)
    least = x.min(1) if blocks else np.zeros(0, _U32)
    d = x - least[:, None]
    k = -(-BLOCK * PERCENTILE // 100) - 1
    typical = np.partition(d, k, axis=1)[:, k] if blocks else least
    width = np.frexp(typical.astype(np.float64))[1].astype(np.uint8)  # the bits that it needs
    above = d >> np.minimum(width, 31)[:, None].astype(_U32)
    above[width >= 32] = 0
    out = above > 0
    count = out.sum(1)
    body: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        for rows in np.array_split(np.flatnonzero(width == w), max(1, int((width == w).sum()) // 2048)):
            bits = np.unpackbits(np.ascontiguousarray(d[rows]).view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            for r, p in zip(rows.tolist(), packed, strict=True):
                body[r] = p.tobytes()
    block, place = np.nonzero(out)
    at = np.concatenate([[0], np.cumsum(count)]).tolist()
    places, high = place.astype(np.uint8).tobytes(), above[block, place].astype("<u4").tobytes()
    parts, starts, size = [], [], 12 + 4 * blocks
    for b, (m, w, c) in enumerate(zip(least.tolist(), width.tolist(), count.tolist(), strict=True)):
        part = struct.pack("<IBB", m, w, c) + body[b] + places[at[b] : at[b + 1]] + high[4 * at[b] : 4 * at[b + 1]]
        starts.append(size)
        size += len(part)
        parts.append(part)
    return struct.pack("<4sII", MAGIC, n, blocks) + np.array(starts, "<u4").tobytes() + b"".join(parts)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first to last (not included) of a segment; blocks outside are not touched."""
    magic, n, blocks = struct.unpack_from("<4sII", data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, _U32)
    begin, end = first // BLOCK, -(-last // BLOCK)
    raw = np.frombuffer(data, np.uint8)
    start = np.frombuffer(data, "<u4", blocks, 12)[begin:end].astype(np.int64)
    head = raw[start[:, None] + np.arange(6)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, count = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    x = np.zeros((len(start), BLOCK), _U32)
    for w in np.unique(width):
        if not w:
            continue
        for rows in np.array_split(np.flatnonzero(width == w), max(1, int((width == w).sum()) // 2048)):
            packed = raw[(start[rows] + 6)[:, None] + np.arange(BLOCK * w // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            full = np.zeros((len(rows), BLOCK, 32), np.uint8)
            full[:, :, :w] = bits
            x[rows] = np.packbits(full, axis=2, bitorder="little").view("<u4")[:, :, 0]
    if count.any():
        block = np.repeat(np.arange(len(start)), count)
        nth = W.ragged(np.zeros(len(start), np.int64), count)
        tail = start + 6 + BLOCK * width // 8
        place = raw[tail[block] + nth]
        high = np.ascontiguousarray(raw[(tail + count)[block][:, None] + 4 * nth[:, None] + np.arange(4)]).view("<u4")[:, 0]
        x[block, place] |= high << width[block].astype(_U32)
    x += least[:, None]
    return x.reshape(-1)[first - begin * BLOCK : last - begin * BLOCK]


# --- encoding -----------------------------------------------------------------------------------------


def _odd(data: np.ndarray) -> np.ndarray:
    """Offsets of white space beyond ASCII, and of what may begin a special token."""
    n = len(data)
    a = data
    b = np.concatenate([data[1:], np.zeros(1, np.uint8)])[:n]
    c = np.concatenate([data[2:], np.zeros(2, np.uint8)])[:n]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    others = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return np.flatnonzero(two | general | others | ((a == 60) & (b == 124)))


_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[48:58] = False
_MARK &= ~_ALPHA


class Places:
    """Numbers 0, 1, ... for 64-bit keys in the order of their coming: an open-addressing table in NumPy."""

    def __init__(self) -> None:
        self.keys, self.values, self.used = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32), 0

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is new. No key is 0."""
        mask = np.uint64(len(self.keys) - 1)
        at = (key & mask).astype(np.int64)
        out = np.where(self.keys[at] == key, self.values[at], -1)
        left = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & int(mask)
            here = self.keys[at]
            hit = here == key[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (here != 0)
            left, at = left[on], at[on]
        return out

    def add(self, key: np.ndarray) -> None:
        """Number distinct keys that are new."""
        if (self.used + len(key)) * 2 > len(self.keys):
            old = self.keys > 0
            keys, values = self.keys[old], self.values[old]
            size = len(self.keys)
            while (self.used + len(key)) * 2 > size:
                size *= 2
            self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(keys, values)
        self._put(key, np.arange(self.used, self.used + len(key), dtype=np.int32))
        self.used += len(key)

    def _put(self, key: np.ndarray, value: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (key & np.uint64(mask)).astype(np.int64)
        while len(key):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]], self.values[at[free]] = key[free], value[free]
            on = self.keys[at] != key  # taken, or another key came last
            key, value, at = key[on], value[on], (at[on] + 1) & mask


class Encoder:
    """Texts to token ids, as the tokenizer would encode each text whole."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_str(vocabulary), remembered
        self._forget()

    def _forget(self) -> None:
        self.places = Places()
        self.pool, self.used = np.zeros(1 << 18, _U32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), _U32, int(size.sum()))
        n = self.places.used
        while n + len(found) > len(self.start):
            self.start, self.length = (np.concatenate([v, np.zeros_like(v)]) for v in (self.start, self.length))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(found)] = self.used + np.cumsum(size) - size
        self.length[n : n + len(found)] = size
        self.used += len(flat)
        self.places.add(keys)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of ids of each."""
        data, texts = W.text_bytes(col)
        count = np.zeros(len(texts) - 1, np.int64)
        if not len(data):
            return np.zeros(0, _U32), count
        space = W.SPACE[data]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[1:] |= _MARK[data[1:]] & _ALPHA[data[:-1]]
        begins[texts[np.flatnonzero(np.diff(texts))]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, texts)
        key = np.maximum(W.hashes(W.Words(data, texts, starts, ends, first)), 1)
        slot = self.places.find(key)
        new = np.flatnonzero(slot < 0)
        if len(new):
            keys, at = np.unique(key[new], return_index=True)
            if self.places.used + len(keys) > self.remembered:
                self._forget()
                new = np.arange(len(key))
                keys, at = np.unique(key, return_index=True)
            at, raw = new[at], data.tobytes()
            self._learn(keys, [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slot[new] = self.places.find(key[new])
        size = self.length[slot].astype(np.int64)
        ids = self.pool[W.ragged(self.start[slot], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        count = total[first[1:]] - total[first[:-1]]
        odd = np.unique(np.searchsorted(texts, _odd(data), "right") - 1)
        if len(odd):
            own = np.split(ids, np.cumsum(count)[:-1])
            for t in odd.tolist():
                own[t] = np.array(self.tokenizer.encode(data[texts[t] : texts[t + 1]].tobytes().decode(), add_special_tokens=False).ids, _U32)
                count[t] = len(own[t])
            ids = np.concatenate(own)
        return ids, count


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of this process, which keeps what it has learned from task to task."""
    return Encoder(vocabulary, remembered)


# --- tables -------------------------------------------------------------------------------------------

_SEGMENTS = "part int, segment int, ids_before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
_DOCUMENTS = "part int, doc_id long, ids_before long, n_tokens long, ids_crc32 long"


def _write(vocabulary):
    kind = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def write(batches):
        encoder, part = encoder_of(vocabulary.value), TaskContext.get().partitionId()
        segment, before, size, held, docs, lengths = 0, 0, 0, [], [], []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "segment": [segment], "ids_before": [before], "n_ids": [size], "doc_ids": [docs], "lengths": [lengths], "payload": [pack(np.concatenate(held))]}, schema=kind)

        for b in W.slices(batches):
            ids, count = encoder.encode(b.column("text"))
            out = np.full(len(ids) + len(count), END, _U32)
            ends = np.cumsum(count + 1)
            out[W.ragged(ends - count - 1, count)] = ids
            cut = 0
            names = b.column("doc_id").to_pylist()
            while cut < len(count):
                begin = int(ends[cut - 1]) if cut else 0
                stop = min(len(count), int(np.searchsorted(ends, begin + SEGMENT - size)) + 1)
                held.append(out[begin : ends[stop - 1]])
                docs += names[cut:stop]
                lengths += (count[cut:stop] + 1).tolist()
                size += int(ends[stop - 1]) - begin
                cut = stop
                if size >= SEGMENT:
                    yield full()
                    segment, before, size, held, docs, lengths = segment + 1, before + size, 0, [], [], []
        if docs:
            yield full()

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the token ids of docs, in ascending doc_id order, to path; tokenizer: a file of the tokenizers library."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The number of a row in its input parts rows alike in doc_id and text, which may be a third of all, among several ranges.
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(parts, "doc_id", "h", "n").sortWithinPartitions("doc_id", "h")
    with shuffles_dropped(spark):
        ordered.select("doc_id", "text").mapInArrow(_write(vocabulary), _SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def _each_document(batches):
    kind = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("ids_before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in batches:
        for i in range(b.num_rows):
            part, before, docs, lengths, payload = (b.column(c)[i] for c in ("part", "ids_before", "doc_ids", "lengths", "payload"))
            raw = memoryview(unpack(payload.as_buffer().to_pybytes()).astype("<u4").tobytes())
            size = np.array(lengths.as_py(), np.int64)
            end = np.cumsum(size)
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((end - size).tolist(), end.tolist(), strict=True)]
            start = before.as_py() + end - size
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(size), pa.int32()), pa.array(docs.as_py(), pa.int64()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], schema=kind)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and the CRC-32 of the ids (as little-endian u32), from the files."""
    table = spark.read.schema(_SEGMENTS).parquet(path)
    sums = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each partition that was written: their number was a parameter of the writer.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    each = table.select("part", "ids_before", "doc_ids", "lengths", "payload").mapInArrow(_each_document, _DOCUMENTS)
    return each.join(F.broadcast(offsets), F.col("part") == F.col("p")).select("doc_id", (F.col("ids_before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, segment, ids) of each segment."""

    def scan(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids = unpack(b.column("payload")[i].as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([b.column("part").slice(i, 1), b.column("segment").slice(i, 1), pa.array([ids.astype(np.int64)])], ["part", "segment", "ids"])

    return spark.read.schema(_SEGMENTS).parquet(path).select("part", "segment", "payload").mapInArrow(scan, "part int, segment int, ids array<long>")
