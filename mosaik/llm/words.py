"""Vectorised word scanning of Arrow text columns.

Texts are scanned as one byte buffer per slice of a record batch, so that finding words and hashing
words or runs of words costs a few NumPy passes and no Python step per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: [\x20\x09-\x0D]: what separates words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All but ASCII letters, ASCII digits and bytes of longer code points.
PUNCT = np.ones(256, bool)
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = PUNCT[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SLICE_BYTES = 1 << 20
_U = np.uint64


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts of the slice
    texts: np.ndarray  # n + 1 byte offsets of texts
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    first: np.ndarray  # n + 1 word offsets of texts


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task still counts."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of each batch with at most that many bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)
    release()


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def find(data: np.ndarray, texts: np.ndarray, gap: np.ndarray = SPACE) -> Words:
    """Words: longest runs of bytes outside of gap, within one text."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, texts, none, none, np.zeros(len(texts), np.int64))
    word = ~gap[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    begins = texts[:-1]
    before[begins[begins < n]] = False
    closes = texts[1:]
    after[closes[closes > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return Words(data, texts, starts, ends, np.searchsorted(starts, texts))


def of_text(w: Words) -> np.ndarray:
    """The index of the text of each word."""
    return np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASES = (0xD1342543DE82EF95, 0xDA942042E4DD58B5)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, _U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _room(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(w.starts):
        return np.zeros(0, _U)
    up, down = _powers(_room(len(w.data) + 1), _BASES[0])
    total = np.empty(len(w.data) + 1, _U)
    total[0] = 0
    np.cumsum(_BYTE[w.data] * up[: len(w.data)], out=total[1:])
    return mix((total[w.ends] - total[w.starts]) * down[w.starts] + (w.ends - w.starts).astype(_U))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size words; runs may cross texts, whole() tells."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = _powers(_room(len(h) + 1), _BASES[1])
    total = np.empty(len(h) + 1, _U)
    total[0] = 0
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:n] + _U(size))


def whole(w: Words, size: int) -> np.ndarray:
    """Word indexes at which a run of size words begins that stays in its text."""
    n = np.maximum(np.diff(w.first) - size + 1, 0)
    return ragged(w.first[:-1], n)


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] numbers), begin[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    shift = np.asarray(begin, np.int64) - (np.cumsum(count) - count)
    return out + np.repeat(shift, count)
