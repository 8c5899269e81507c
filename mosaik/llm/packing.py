r"""Packing of tokenised examples into sequences by vector bin packing.

An example is a prompt, which bears no loss, and a text, which does; its ids are those of the prompt, those of the text, and END.
A sequence has three limits at once: tokens, segments (pieces of examples, so that attention masks stay small), and tokens that bear loss.
Each example waiting is a vector of its demands as shares of the limits. The open sequence takes, of the examples that
fit in all three, that with the greatest dot product of demand and room left, each dimension weighted by the mean demand of
those waiting (so a dimension counts as it is scarce), until nothing fits. Then the best example is cut to the room that
is left; what remains of it waits on. Examples over a limit are cut to pieces that meet it first. A sequence that another
limit closes early is cut back to a power of two, where it needs no padding, and the rest waits on; so are the last sequences
of a task. With cut=False examples are cut only where a limit is below them alone, and sequences are padded.

Each task packs the rows of its own input partition, so texts are never shuffled and no key can crowd a task; it holds
WINDOW waiting pieces, each at most a sequence long, and one slice of its input. A sequence is a row of a table: number of the partition and of
the sequence in it, padded size, the ids as little-endian numbers of `width` bytes (2 where the vocabulary allows, else 4), and for each
piece its example, start there, length, tokens before its loss begins and the tokens of its example. Sequence ids are partition * 2 ** 33 + number. The same files, read in the same partitions, give the same sequences.

Defined results: a null text or prompt is the empty one; an example without both is END alone. Rows with one doc_id, or none, are examples
of their own. Texts may be of any length. Extra columns are ignored. No rows: an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .storage import shuffles_dropped
from .token_files import encoder_of

END = 1
#: Pieces that wait for a sequence at once, in each task.
WINDOW = 512


class Limits(NamedTuple):
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class Piece(NamedTuple):
    example: int | None
    start: int  # ids of the example before it
    ids: np.ndarray
    silent: int  # tokens at its beginning that bear no loss
    whole: int  # ids of the example

    @property
    def loss(self) -> int:
        return len(self.ids) - self.silent

    def parted(self, n: int) -> tuple[Piece, Piece]:
        """Its first n tokens, and the others."""
        return self._replace(ids=self.ids[:n], silent=min(n, self.silent)), self._replace(start=self.start + n, ids=self.ids[n:], silent=max(0, self.silent - n))

    def fits(self, tokens: int, loss: int) -> int:
        """How many of its tokens fit."""
        return min(len(self.ids), tokens, self.silent + loss)


class Packer:
    """Sequences, each a list of pieces, from examples that come one by one."""

    def __init__(self, limits: Limits = Limits(), cut: bool = True, window: int = WINDOW):
        if min(limits) < 1:
            raise ValueError("limits are positive")
        self.limits, self.cut, self.window = limits, cut, window
        self.most = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.waiting: list[Piece] = []
        self.demand = np.empty((2 * window, 3))

    def _wait(self, piece: Piece) -> None:
        n = len(self.waiting)
        if n == len(self.demand):
            self.demand = np.concatenate([self.demand, np.empty_like(self.demand)])
        self.demand[n] = len(piece.ids), 1, piece.loss
        self.waiting.append(piece)

    def _taken(self, i: int) -> Piece:
        piece, last = self.waiting[i], self.waiting.pop()
        if last is not piece:
            self.waiting[i] = last
            self.demand[i] = self.demand[len(self.waiting)]
        return piece

    def add(self, example: int | None, ids: np.ndarray, silent: int = 0) -> Iterator[list[Piece]]:
        """Sequences that are ready once this example waits; silent: its first tokens, that bear no loss."""
        rest = Piece(example, 0, ids, silent, len(ids))
        while len(rest.ids) > (n := rest.fits(self.limits.tokens, self.limits.loss)) or n == self.limits.tokens:
            piece, rest = rest.parted(n)
            if n == self.limits.tokens:
                yield [piece]
            else:
                self._wait(piece)
            if not len(rest.ids):
                break
        if len(rest.ids):
            self._wait(rest)
        while len(self.waiting) >= self.window:
            yield self._sequence()

    def close(self) -> Iterator[list[Piece]]:
        """The sequences of all that waits."""
        while self.waiting:
            yield self._sequence()

    def _sequence(self) -> list[Piece]:
        room, out = self.most.copy(), []
        weight = self.demand[: len(self.waiting)].mean(0) / self.most**2
        while self.waiting and room[0] >= 1 and room[1] >= 1:
            demand = self.demand[: len(self.waiting)]
            product = demand @ (weight * room / self.most)
            fits = (demand <= room).all(1)
            if fits.any():
                piece = self._taken(int(np.where(fits, product, -1.0).argmax()))
            elif self.cut:
                piece = self._cut(product, int(room[0]), int(room[2]))
                if piece is None:
                    break
            else:
                break
            out.append(piece)
            room -= (len(piece.ids), 1, piece.loss)
        return self._trimmed(out) if self.cut else out

    def _cut(self, product: np.ndarray, tokens: int, loss: int) -> Piece | None:
        """The part of the best piece that fits; None where no token of any piece does."""
        if loss < 1:
            some = np.array([p.silent > 0 for p in self.waiting])
            product = np.where(some, product, -1.0)
        best = int(product.argmax())
        n = self.waiting[best].fits(tokens, loss)
        if product[best] < 0 or not n:
            return None
        piece, rest = self._taken(best).parted(n)
        self._wait(rest)
        return piece

    def _trimmed(self, pieces: list[Piece]) -> list[Piece]:
        """Of a sequence that is not full, as much as makes a power of two; the others wait again."""
        size = sum(len(p.ids) for p in pieces)
        if size == self.limits.tokens:
            return pieces
        left, out = 1 << (size.bit_length() - 1), []
        for p in pieces:
            if len(p.ids) > left:
                p, rest = p.parted(left)
                self._wait(rest)
            if len(p.ids):
                out.append(p)
            left -= len(p.ids)
        return out


def padded(size: int, tokens: int) -> int:
    """The size of a sequence with its padding: powers of two need none."""
    return size if size & (size - 1) == 0 else tokens


# --- tables -------------------------------------------------------------------------------------------

_SEQUENCES = "part int, number long, size int, width int, ids binary, doc_ids array<long>, starts array<long>, lengths array<int>, silent array<int>, doc_tokens array<long>"
_KIND = pa.schema(
    [("part", pa.int32()), ("number", pa.int64()), ("size", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("silent", pa.list_(pa.int32())), ("doc_tokens", pa.list_(pa.int64()))]
)
#: Sequences in a record batch.
_BATCH = 256


def _batch(part: int, number: int, sequences: list[list[Piece]], tokens: int, width: int) -> pa.RecordBatch:
    pieces = [p for s in sequences for p in s]
    count = np.cumsum([0, *map(len, sequences)])
    length = np.array([len(p.ids) for p in pieces])
    total = np.concatenate([[0], np.cumsum(length)])[count]
    lists = lambda values, kind, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
    columns = [
        pa.array([part] * len(sequences), pa.int32()),
        pa.array(np.arange(number, number + len(sequences))),
        pa.array([padded(n, tokens) for n in np.diff(total).tolist()], pa.int32()),
        pa.array([width] * len(sequences), pa.int32()),
        pa.array([np.concatenate([p.ids for p in s]).astype(f"<u{width}").tobytes() for s in sequences], pa.binary()),
        lists([p.example for p in pieces], pa.int64(), count),
        lists([p.start for p in pieces], pa.int64(), count),
        lists(length.astype(np.int32), pa.int32(), count),
        lists([p.silent for p in pieces], pa.int32(), count),
        lists([p.whole for p in pieces], pa.int64(), count),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_KIND)


def _pack(vocabulary, limits: Limits, cut: bool):
    def pack(batches):
        encoder, packer, part = encoder_of(vocabulary.value), Packer(limits, cut), TaskContext.get().partitionId()
        number, ready, width = 0, [], 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4

        def examples():
            for b in W.slices(W.slices(batches, "prompt")):
                asked, n_asked = encoder.encode(b.column("prompt"))
                said, n_said = encoder.encode(b.column("text"))
                names = b.column("doc_id").to_pylist()
                q, a = np.concatenate([[0], np.cumsum(n_asked)]).tolist(), np.concatenate([[0], np.cumsum(n_said)]).tolist()
                end = np.array([END], asked.dtype)
                for i, name in enumerate(names):
                    yield from packer.add(name, np.concatenate([asked[q[i] : q[i + 1]], said[a[i] : a[i + 1]], end]), q[i + 1] - q[i])
            yield from packer.close()

        for sequence in examples():
            ready.append(sequence)
            if len(ready) == _BATCH:
                yield _batch(part, number, ready, limits.tokens, width)
                number, ready = number + _BATCH, []
        if ready:
            yield _batch(part, number, ready, limits.tokens, width)

    return pack


def write_packed(examples: DataFrame, path: str, tokenizer: str, prompt: str | None = None, limits: Limits = Limits(), cut: bool = True) -> None:
    """Write examples (doc_id, text, and a column of prompts if there is one) as sequences to path; tokenizer: a file of the tokenizers library."""
    spark = examples.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    asked = examples[prompt].cast("string") if prompt else F.lit("")
    rows = examples.select(examples["doc_id"].cast("long").alias("doc_id"), asked.alias("prompt"), examples["text"].cast("string").alias("text"))
    with shuffles_dropped(spark):
        rows.mapInArrow(_pack(vocabulary, limits, cut), _SEQUENCES).write.parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """sequence_id, size with padding, ids (numbers of `width` bytes), and the pieces as parallel arrays."""
    id_ = F.shiftleft(F.col("part").cast("long"), 33) + F.col("number")
    return spark.read.schema(_SEQUENCES).parquet(path).select(id_.alias("sequence_id"), "size", "width", "ids", "doc_ids", "starts", "lengths", "silent", "doc_tokens")


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def unpacked(ids: pa.BinaryScalar | bytes, width: int) -> np.ndarray:
    """The ids of a sequence."""
    return np.frombuffer(ids if isinstance(ids, bytes) else ids.as_buffer(), f"<u{width}").astype("<u4")


def _each_piece(batches):
    kind = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")])
    for b in batches:
        count = b.column("lengths").value_lengths().to_numpy(zero_copy_only=False)
        length, silent = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lengths", "silent"))
        raw = memoryview(np.concatenate([unpacked(i, w) for i, w in zip(b.column("ids"), b.column("width").to_pylist(), strict=True)]).tobytes())
        end = np.cumsum(length)
        crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((end - length).tolist(), end.tolist(), strict=True)]
        first = np.repeat(np.cumsum(count) - count, count)
        offset = end - length - (end - length)[first]
        columns = [b.column("doc_ids").flatten(), b.column("starts").flatten(), length, crc, b.column("doc_tokens").flatten(), np.repeat(b.column("sequence_id").to_numpy(), count), offset, length - silent]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], schema=kind)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece in the files at path, with the CRC-32 of its ids (as little-endian u32)."""
    return read_sequences(spark, path).drop("size").mapInArrow(_each_piece, _PIECES)
