r"""Removal of repeated passages by difference-cover anchors.

A window is 50 consecutive words of one document. A word goes if a window that covers it has a word
sequence that also starts in a document with a smaller doc_id.

COVER is a perfect difference set modulo PERIOD = 31: of any two positions, some shift of 0 to 30 words
brings both to cover positions. So two equal windows share an aligned anchor, that is a run of
ANCHOR = 20 = 50 - 31 + 1 words that begins at a cover position in either document and ends within the
window. Only these anchors, 6 of 31 positions, are hashed and met over the whole corpus. An anchor found
in two documents is extended to the windows that hold it, the hashes of those windows meet in turn, and
each window learns the least document in which it starts.

Both meetings are aggregations by hash, combined before they are shuffled, and joins whose large keys
Spark can split, so an anchor or window of a third of all documents is no burden; no pairs are formed.
Hashes have 64 bits. Two different windows are taken for equal only if their hashes agree and each
holds an anchor that is shared: odds of about 1 in 10 ** 10 for a billion candidate windows.

Defined results: a null or empty text has no words. Rows with the same doc_id are one document for
"smaller doc_id", and one that repeats any number of times has one set of places; a row without doc_id is never smaller and never loses words. Texts may be of any
length. Extra columns, whatever their names, pass through without_repeats(). Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .storage import dropped, written

WINDOW = 50
PERIOD = 31
#: A perfect difference set: every difference modulo 31 but 0 arises exactly once.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
_COVERED = np.isin(np.arange(PERIOD), COVER)


def _anchor_places(w: W.Words) -> np.ndarray:
    """Word indexes of the anchors: cover positions, counted from the start of each text."""
    at = W.whole(w, ANCHOR)
    n = np.maximum(np.diff(w.first) - ANCHOR + 1, 0)
    own = at - np.repeat(w.first[:-1], n)
    long = np.repeat(np.diff(w.first) >= WINDOW, n)
    return at[_COVERED[own % PERIOD] & long]


def _hits(b: pa.RecordBatch, w: W.Words, h: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    doc = W.of_text(w)[at]
    own = [pa.array(b.column(c).to_numpy(zero_copy_only=False)[doc]) for c in ("doc_id", "key")]
    return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), *own, pa.array((at - w.first[doc]).astype(np.int32))], ["hash", "doc_id", "key", "at"])


_HIT = "hash long, doc_id long, key long, at int"


def _places(b: pa.RecordBatch, w: W.Words) -> np.ndarray:
    """The word indexes that the column places lists, by text."""
    places = b.column("places")
    count = np.nan_to_num(places.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return places.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.first[:-1], count)


def _covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in some range [low, high)."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, low, 1)
    np.add.at(mark, high, -1)
    return np.cumsum(mark)[:n] > 0


def _anchors(batches):
    for b in W.slices(batches):
        w = W.find(*W.text_bytes(b.column("text")))
        yield _hits(b, w, W.runs(W.hashes(w), ANCHOR), _anchor_places(w))


def _windows(batches):
    """Texts and places of shared anchors to the windows that hold one of them."""
    for b in W.slices(batches):
        w = W.find(*W.text_bytes(b.column("text")))
        at = _places(b, w)
        begin = w.first[W.of_text(w)[at]]
        start = W.whole(w, WINDOW)
        start = start[_covered(np.maximum(at - PERIOD + 1, begin), at + 1, len(w.starts))[start]]
        yield _hits(b, w, W.runs(W.hashes(w), WINDOW), start)


def _left(batches):
    """Rows and places of windows to remove to what is left of the texts."""
    for b in W.slices(batches):
        w = W.find(*W.text_bytes(b.column("text")))
        at = _places(b, w)
        gone = _covered(at, at + WINDOW, len(w.starts))
        total = np.concatenate([[0], np.cumsum(gone)])
        data, kept = w.data.tobytes(), []
        for x, y in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            left = np.flatnonzero(~gone[x:y]) + x
            kept.append(b" ".join([data[i:j] for i, j in zip(w.starts[left].tolist(), w.ends[left].tolist(), strict=True)]).decode())
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), pa.array(np.diff(w.first)), pa.array(total[w.first[1:]] - total[w.first[:-1]]), pa.array(kept, pa.string())],
            ["row", "n_words", "n_removed", "kept_text"],
        )


def _repeats(rows: DataFrame) -> DataFrame:
    """Hashes that more than one document has, with the least of them."""
    met = rows.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return met.filter("least < most").select(F.col("hash").alias("shared"), "least")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, key, text): the key tells rows with one doc_id apart."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def windows_to_remove(docs: DataFrame) -> DataFrame:
    """(doc_id, key, places): by row, the first words of windows that also start in a document with a smaller doc_id."""
    texts = _keyed(docs).filter("doc_id IS NOT NULL")
    anchors = texts.mapInArrow(_anchors, _HIT)
    shared = written(_repeats(anchors).select("shared"), "anchors")
    found = anchors.join(shared, F.col("hash") == F.col("shared")).groupBy("doc_id", "key").agg(F.collect_set("at").alias("places"))
    # A document's words bound its set of places, however often its row repeats.
    places = written(found, "places")
    windows = written(texts.join(places, ["doc_id", "key"]).mapInArrow(_windows, _HIT), "windows")
    least = written(_repeats(windows), "least")
    gone = windows.join(least, F.col("hash") == F.col("shared")).filter("doc_id > least").groupBy("doc_id", "key").agg(F.collect_set("at").alias("places"))
    out = written(gone, "gone")
    dropped(shared, places, windows, least)
    return out


def _measured(docs: DataFrame) -> DataFrame:
    """(row: the struct of a row of docs, n_words, n_removed, kept_text)."""
    gone = windows_to_remove(docs).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "places")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = own.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    met = keyed.join(gone, (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("k")), "left").select("row", "text", "places")
    kind = T.StructType([T.StructField("row", own.schema["row"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")), T.StructField("kept_text", T.StringType())])
    return met.mapInArrow(_left, kind)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the words of repeated passages taken out of text: what is left of a text that lost any is joined by spaces."""
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    return _measured(docs).select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words kept, joined by single spaces, of each row."""
    out = _measured(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
