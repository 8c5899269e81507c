r"""Toxicity scores by a subsequence string-kernel support vector machine with Nystroem landmarks.

Units are words without what is not a letter: marks inside a word are dropped, digits and signs that pass
for letters become them, and single letters in a row are one unit, so "i.d-i o t" reads as "idiot". The
kernel of two units sums over all subsequences of four letters that they share, with up to GAP letters
skipped among them, weighted by DECAY to the letters skipped; the start of a unit counts as a letter. So
inserted or missing letters only weaken a match.

Training. Labels belong to whole texts: each toxic one has some toxic unit, a clean one has none. From
units picked by how much commoner their subsequences are in toxic texts, a machine is trained, the units
of toxic texts that it scores highest are picked again, with the highest of clean texts against them, and
so on. The machine is a linear one, with squared hinge loss, on the Nystroem features of LANDMARKS units.
Since the kernel is a product of explicit subsequence counts, its weights fold into one table over
letter quadruples, and scoring a text costs ten table look-ups a letter, whatever the number of landmarks.
The three highest units of a text and its number of units give the score by logistic regression, which is
fitted on sample rows that the machine was not trained on.

The fit uses at most SAMPLE labelled rows of each class, chosen by a hash of doc_id; scoring reads every
whole text. What executors receive is the table, 4 MB.

Defined results: a null or empty text is scored like any text without units (low). Without labelled rows
of both classes every score is the share of label 1 (0 if there are none). Repeated rows get equal scores.
Labels other than 0 and 1, null ones and rows without a document are not learned from. Extra columns of
either table are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

GAP = 2
DECAY = 0.7
LANDMARKS = 320
ROUNDS = 6
#: Labelled rows of each class from which is learned.
SAMPLE = 1500
THRESHOLD = 0.3
SIGNS = {"0": "o", "1": "i", "!": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t"}
#: Distances of the three further letters of a subsequence from its first one, and its weight.
_STEPS = [(a, a + b, a + b + c, DECAY ** (a + b + c - 3)) for a in range(1, 4) for b in range(1, 4) for c in range(1, 4) if a + b + c <= 3 + GAP]
_SIZE = 32**4
START = 31


def _letters() -> np.ndarray:
    """Byte to letter class: 1 to 26 for letters, 27 to 30 by the last byte of longer code points, 0 for none."""
    out = np.zeros(256, np.uint8)
    for k in range(26):
        out[97 + k] = out[65 + k] = k + 1
    for sign, letter in SIGNS.items():
        out[ord(sign)] = ord(letter) - 96
    for b in range(0x80, 0xC0):
        # Capitals of Latin-1 letters differ from small ones by 32.
        out[b] = 27 + (b & 0x1F) % 4
    return out


LETTER = _letters()
_SIGN = np.zeros(256, bool)
_SIGN[[ord(s) for s in SIGNS]] = True


class Units(NamedTuple):
    code: np.ndarray  # START and letters of all units, 32-bit
    first: np.ndarray  # n + 1 offsets of units
    text: np.ndarray  # text of each unit


def units(col: pa.Array) -> Units:
    """Units of three or more letters."""
    w = W.find(*W.text_bytes(col))
    if not len(w.starts):
        return Units(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    code = LETTER[w.data].copy()
    # Signs after the last true letter of a word are punctuation, or all of it is a number.
    sign = np.flatnonzero(_SIGN[w.data])
    true = np.where((code > 0) & ~_SIGN[w.data], np.arange(len(code)), -1)
    last = np.maximum.accumulate(true)[w.ends - 1]
    of = np.searchsorted(w.starts, sign, "right") - 1
    code[sign[sign > last[of]]] = 0
    letter = code > 0
    before = np.concatenate([[0], np.cumsum(letter)])
    size = before[w.ends] - before[w.starts]
    text = W.of_text(w)
    some = np.flatnonzero(size)
    size, text, start = size[some], text[some], before[w.starts][some]
    one = size == 1
    joined = np.zeros(len(size), bool)
    if len(size):
        joined[1:] = one[1:] & one[:-1] & (text[1:] == text[:-1])
    head = np.flatnonzero(~joined)
    # Letters stand in order, so joined units are one stretch of them.
    begin = start[head]
    end = np.append(begin[1:], before[-1])
    long = end - begin >= 3
    begin, n = begin[long], (end - begin)[long]
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(first[-1]), START, np.int32)
    out[W.ragged(first[:-1] + 1, n)] = code[letter][W.ragged(begin, n)]
    return Units(out, first, text[head][long])


def _norms(longest: int) -> np.ndarray:
    """By length of unit, the root of the squared weights of its subsequences."""
    n = np.arange(longest + 1)
    total = np.zeros(longest + 1)
    for *_, c, weight in _STEPS:
        total += np.maximum(n - c, 0) * weight**2
    return np.sqrt(np.maximum(total, 1e-12))


def _spelled(code: np.ndarray, i: np.ndarray, a: int, b: int, c: int) -> np.ndarray:
    return (code[i] << 15) | (code[i + a] << 10) | (code[i + b] << 5) | code[i + c]


def _parts(u: Units, letters: int = 400_000) -> list[np.ndarray]:
    """Units in runs of about so many letters."""
    if len(u.first) < 2:
        return []
    cuts = np.flatnonzero(np.diff(u.first[:-1] // letters)) + 1
    return np.split(np.arange(len(u.first) - 1), cuts)


def scores(u: Units, table: np.ndarray) -> np.ndarray:
    """The product of the table with each unit's normed subsequence weights."""
    out = np.zeros(len(u.first) - 1)
    for part in _parts(u):
        v = _select(u, part)
        n, size = len(v.code), np.diff(v.first)
        room = np.repeat(v.first[1:], size) - np.arange(n)  # letters from each one to the end of its unit
        total = np.zeros(n, np.float32)
        for a, b, c, weight in _STEPS:
            i = np.flatnonzero(room > c)
            total[i] += np.float32(weight) * table[_spelled(v.code, i, a, b, c)]
        out[part] = np.add.reduceat(total.astype(np.float64), v.first[:-1]) / _norms(int(size.max()))[size]
    return out


def _subsequences(u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, letters, normed weight) of all subsequences."""
    n, size = len(u.code), np.diff(u.first)
    owner = np.repeat(np.arange(len(size)), size)
    room = np.repeat(u.first[1:], size) - np.arange(n)
    norm = _norms(int(size.max()) if len(size) else 0)[size]
    out = []
    for a, b, c, weight in _STEPS:
        i = np.flatnonzero(room > c)
        out.append((owner[i], _spelled(u.code, i, a, b, c), weight / norm[owner[i]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _select(u: Units, keep: np.ndarray) -> Units:
    n = np.diff(u.first)[keep]
    return Units(u.code[W.ragged(u.first[:-1][keep], n)], np.concatenate([[0], np.cumsum(n)]), u.text[keep])


class Landmarks(NamedTuple):
    spelled: np.ndarray  # the subsequences that some landmark has, ascending
    weight: np.ndarray  # their weights in each landmark


def _landmarks(u: Units) -> Landmarks:
    own, spelled, weight = _subsequences(u)
    known, at = np.unique(spelled, return_inverse=True)
    out = np.zeros((len(known), len(u.first) - 1), np.float32)
    np.add.at(out, (at, own), weight)
    return Landmarks(known, out)


def _kernel(u: Units, marks: Landmarks) -> np.ndarray:
    """Kernel of units with landmarks."""
    out = np.zeros((len(u.first) - 1, marks.weight.shape[1]), np.float32)
    for a in range(0, len(out), 1000):
        own, spelled, weight = _subsequences(_select(u, np.arange(a, min(len(out), a + 1000))))
        at = np.minimum(np.searchsorted(marks.spelled, spelled), len(marks.spelled) - 1)
        met = marks.spelled[at] == spelled
        own, at, weight = own[met], at[met], weight[met]
        order = np.argsort(own, kind="stable")
        own, at, weight = own[order], at[order], weight[order]
        if len(own):
            begins = np.flatnonzero(np.r_[True, np.diff(own) > 0])
            out[a + own[begins]] = np.add.reduceat(marks.weight[at] * weight[:, None].astype(np.float32), begins)
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Squared hinge loss with a ridge, by Newton steps; y of -1 and 1."""
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(z.shape[1])
    eye = np.eye(len(w)) * ridge * len(x) / len(w)
    eye[-1, -1] = 1e-6
    for _ in range(20):
        on = y * (z @ w) < 1
        a = (z[on] * weight[on][:, None]).T @ z[on] + eye
        new = np.linalg.solve(a, (z[on] * weight[on][:, None]).T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


class Model(NamedTuple):
    table: np.ndarray  # by four letters
    bias: float
    logistic: np.ndarray  # constant, the three highest units, log of number of units
    share: float | None  # a constant score instead


def _top(u: Units, f: np.ndarray, texts: int, n: int) -> np.ndarray:
    """The n units of each text that score highest."""
    order = np.lexsort((-f, u.text))
    rank = np.arange(len(order)) - np.searchsorted(u.text[order], u.text[order])
    return order[rank < n]


def _features(u: Units, f: np.ndarray, texts: int) -> np.ndarray:
    out = np.full((texts, 5), -2.0)
    out[:, 0] = 1
    best = _top(u, f, texts, 3)
    rank = np.arange(len(best)) - np.searchsorted(u.text[best], u.text[best])
    out[u.text[best], rank + 1] = np.maximum(f[best], -2.0)
    out[:, 4] = np.log1p(np.bincount(u.text, minlength=texts))
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 1e-2
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _all_units(texts: list[str | None]) -> Units:
    """The units of many texts, found a few texts at a time."""
    code, size, text = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    for b in W.slices(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]), most=1 << 19):
        v = units(b.column("text"))
        code.append(v.code)
        size.append(np.diff(v.first))
        text.append(v.text + at)
        at += b.num_rows
    return Units(np.concatenate(code), np.concatenate([[0], np.cumsum(np.concatenate(size))]), np.concatenate(text))


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """The model of some labelled texts."""
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(_SIZE, np.float32), 0.0, np.zeros(5), float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(11)
    u = _all_units(texts)
    hold = np.arange(len(y)) % 3 == 2
    hold &= np.array([(~hold & (y == c)).any() for c in (0, 1)]).all()
    toxic, train = (y == 1)[u.text], ~hold[u.text]
    if not len(u.text) or not (toxic & train).any() or not (~toxic & train).any():
        return Model(np.zeros(_SIZE, np.float32), 0.0, np.zeros(5), float(y.mean()))
    # To begin with, subsequences that are surely commoner in toxic texts: the normal score of the difference in shares.
    part = np.zeros((2, _SIZE), np.int64)
    for some in np.array_split(np.arange(len(y)), max(1, len(u.code) // 200_000)):
        v = _select(u, np.flatnonzero((u.text >= some[0]) & (u.text <= some[-1]) & train) if len(some) else some)
        own, spelled, _ = _subsequences(v)
        seen = np.unique(v.text[own] * _SIZE + spelled)
        for c in (0, 1):
            part[c] += np.bincount(seen[y[seen // _SIZE] == c] % _SIZE, minlength=_SIZE)
    docs = [(y[~hold] == c).sum() for c in (0, 1)]
    both = (part[0] + part[1] + 1) / (docs[0] + docs[1] + 2)
    sure = (part[1] / docs[1] - part[0] / docs[0]) / np.sqrt(both * (1 - both) * (1 / docs[0] + 1 / docs[1]))
    f = scores(u, np.maximum(sure - 2, 0).astype(np.float32))
    some_clean = rng.permutation(np.flatnonzero(~toxic & train))[:6000]
    table, bias = np.zeros(_SIZE, np.float32), 0.0
    for turn in range(ROUNDS):
        best = _top(u, f, len(y), 3)
        good = best[toxic[best] & train[best]]
        # The highest unit of each toxic text, and the next two where they are on the toxic side, too.
        good = good[np.r_[True, np.diff(u.text[good]) != 0] | ((f[good] > 0.5) & (turn > 0))]
        bad = np.concatenate([best[~toxic[best] & train[best]], some_clean])
        chosen = _select(u, np.concatenate([good, bad]))
        target = np.r_[np.ones(len(good)), -np.ones(len(bad))]
        picks = np.concatenate([rng.permutation(len(good))[: LANDMARKS // 2], len(good) + rng.permutation(len(bad))[: LANDMARKS // 2]])
        marks = _landmarks(_select(chosen, picks))
        k = _kernel(chosen, marks)
        value, vector = np.linalg.eigh(k[picks].astype(np.float64))
        strong = value > 1e-4 * value.max()
        root = vector[:, strong] / np.sqrt(value[strong])  # k(landmarks) to the power -1/2
        w, bias = _machine(k @ root, target, np.where(target > 0, len(bad) / max(1, len(good)), 1.0))
        table = np.zeros(_SIZE, np.float32)
        table[marks.spelled] = marks.weight @ (root @ w)
        f = scores(u, table) + bias
    x = _features(u, f, len(y))
    test = hold if hold.any() and len(set(y[hold].tolist())) == 2 else ~hold
    return Model(table, bias, _logistic(x[test], y[test]), None)


def score(model: Model, col: pa.Array) -> np.ndarray:
    """The score of each text, 0 to 1."""
    n = len(col)
    if model.share is not None:
        return np.full(n, model.share)
    u = units(col)
    x = _features(u, scores(u, model.table) + model.bias, n)
    return 1 / (1 + np.exp(-np.clip(x @ model.logistic, -30, 30)))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled documents that are not held out; of labels that contradict each other the toxic one counts."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~_held_out()).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64("id", F.lit("sample"))
    picked = [known.filter(F.col("y") == c).orderBy(order, "id").limit(sample) for c in (0, 1)]
    rows = picked[0].unionAll(picked[1])  # at most two times sample rows
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = own.join(F.broadcast(rows), F.col("doc_id") == F.col("id")).groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r.id * 2654435761 % 2**32, r.id))
    return fit([r.text for r in found], [r.y for r in found])


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for b in W.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(sent.value, b.column("text")))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
