"""Documents scored by cross-entropy difference of two matched bigram models.

Both models have the same order, smoothing and vocabulary, the ids of one public byte-level tokenizer
(50,257, so nothing is ever outside it) and one id for the edges of texts. The background model counts
all documents, the target model all texts of the target table; no count is capped or cut off. With c the
counts of a model, N their sum and V the size of the vocabulary,

    p(w | v) = MIX * c(v, w) / c(v) + (1 - MIX) * (c(w) + 1) / (N + V)

where an unseen v gives all weight to the second part. The loss of a token is -ln p, and the score of a
document is the mean over its tokens of target loss minus background loss: the lower, the more it looks
like the target.

Losses depend on the bigram alone, and every bigram of a document is in the background, so the models
meet in one table of bigrams with two losses. Its most frequent rows, TABLE_SENT at most, are sent to the executors, sorted,
and texts are scored where they lie. Only tokens of rarer bigrams leave their text: their numbers by document are joined with the
rest of the table by bigram, and the sums added. Nothing is cut off, whatever the size of the table.

Defined results: a null or empty text is one token, the closing edge. Rows with the same doc_id and text
get equal scores. A row without doc_id is scored like others. An empty target makes its model uniform.
Extra columns are ignored. No documents: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import dropped, written
from .token_files import encoder_of

MIX = 0.75
EDGE = 50_257
VOCABULARY = EDGE + 1
TABLE_SENT = 2_000_000
#: Bigrams that a task gathers before it passes on their counts.
_GATHERED = 1_000_000
#: Pieces of text that an encoder remembers here: counting and scoring need memory, too.
REMEMBERED = 200_000


def _encoded(vocabulary):
    def scan(batches):
        encoder = encoder_of(vocabulary.value, REMEMBERED)
        for b in W.slices(batches):
            ids, count = encoder.encode(b.column("text"))
            ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), lists], [*(c for c in b.schema.names if c != "text"), "ids"])

    return scan


def _bigrams(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams (v << 16 | w) of all texts, with an edge before and after each, and the number for each text."""
    count = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    padded = np.full(int(count.sum()) + 2 * len(count), EDGE, np.int64)
    begin = np.cumsum(count + 2) - count - 2
    padded[W.ragged(begin + 1, count)] = col.flatten().to_numpy(zero_copy_only=False)
    at = W.ragged(begin, count + 1)
    return (padded[at] << 16) | padded[at + 1], count + 1


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(gram, kind="stable")
    gram, n = gram[order], n[order]
    begin = np.flatnonzero(np.r_[True, np.diff(gram) > 0])
    return gram[begin], np.add.reduceat(n, begin)


def _counted(batches):
    """Token lists to (gram, n), summed within the task as far as memory goes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for b in batches:
        for a in range(0, b.num_rows, 256):
            gram, _ = _bigrams(b.column("ids").slice(a, 256))
            if not len(gram):
                continue
            held.append(np.unique(gram, return_counts=True))
            size += len(held[-1][0])
            if size > _GATHERED:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > _GATHERED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["gram", "n"])
                    held, size = [], 0
    if held:
        gram, n = _merged(held)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])
    del held
    W.release()


def bigram_counts(encoded: DataFrame) -> DataFrame:
    """(gram, n) over all texts."""
    return encoded.select("ids").mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _losses(table: DataFrame, n: str, loss: str, total: int) -> DataFrame:
    """table with the loss of each bigram in the model whose counts, total of them, are in column n."""
    v, w = F.shiftright("gram", 16), F.col("gram").bitwiseAND(F.lit(65535))
    before = table.groupBy(v.alias("v")).agg(F.sum(n).alias("cv"))  # the size of the vocabulary bounds both
    after = table.groupBy(w.alias("w")).agg(F.sum(n).alias("cw"))
    t = table.join(F.broadcast(before), v == F.col("v")).join(F.broadcast(after), w == F.col("w"))
    low = (F.col("cw") + 1) / F.lit(float(total + VOCABULARY))
    p = F.when(F.col("cv") > 0, F.lit(MIX) * F.col(n) / F.greatest(F.col("cv"), F.lit(1)) + F.lit(1 - MIX) * low).otherwise(low)
    return t.withColumn(loss, -F.log(p)).select(*table.columns, loss)


def loss_table(background: DataFrame, target: DataFrame) -> DataFrame:
    """(gram, n, target_loss, background_loss) of each bigram of the background, from both counts; n is that of the background."""
    # Bigrams of the target alone are part of its model, though no document asks for them.
    b = background.select("gram", F.col("n").alias("nb"))
    t = target.select("gram", F.col("n").alias("nt"))
    both = written(b.join(t, "gram", "full").select("gram", F.coalesce("nb", F.lit(0)).alias("nb"), F.coalesce("nt", F.lit(0)).alias("nt")), "bigrams")
    total = both.agg(F.coalesce(F.sum("nb"), F.lit(0)), F.coalesce(F.sum("nt"), F.lit(0))).first()
    lost = _losses(_losses(both, "nt", "target_loss", total[1]), "nb", "background_loss", total[0])
    return lost.filter("nb > 0").select("gram", F.col("nb").alias("n"), "target_loss", "background_loss")


def _mean(total: Column) -> Column:
    return total / F.col("n")


def _least_sent(table: DataFrame, most: int) -> int:
    """The least power of two such that no more than that many bigrams occur so often."""
    rows = table.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().orderBy(F.col("k").desc()).collect()  # 64 rows at most
    least, sum_ = 1 << 62, 0
    for r in rows:
        sum_ += r["count"]
        if sum_ > most:
            return least
        least = 1 << r.k
    return 1


_SCORED = "doc_id long, row long, gram long, n long, target double, background double"


def _scored(encoded: DataFrame, sent) -> DataFrame:
    """Of each text one row without gram: its tokens and the sums of the losses of those bigrams that are sent; and a row for each other bigram, with its number."""

    def scan(batches):
        known, *losses = sent.value
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                gram, count = _bigrams(part.column("ids"))
                at = np.minimum(np.searchsorted(known, gram.astype(np.uint32)), max(0, len(known) - 1))
                here = known[at] == gram if len(known) else np.zeros(len(gram), bool)
                begin, texts = np.cumsum(count) - count, len(count)
                sums = [np.add.reduceat(np.where(here, x[at], 0.0) if len(known) else np.zeros(len(gram)), begin) for x in losses]
                text = np.repeat(np.arange(texts), count)[~here]
                rest, n = np.unique((text << 32) | gram[~here], return_counts=True)
                of = pa.array(np.r_[np.arange(texts), rest >> 32])
                none = np.r_[np.ones(texts, bool), np.zeros(len(rest), bool)]
                grams = pa.array(np.r_[np.zeros(texts, np.int64), rest & 0xFFFFFFFF], mask=none)
                zeros = np.zeros(len(rest))
                columns = [part.column("doc_id").take(of), part.column("row").take(of), grams, pa.array(np.r_[count, n]), *(pa.array(np.r_[x, zeros]) for x in sums)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "gram", "n", "target", "background"])

    return encoded.select("doc_id", F.xxhash64("ids").alias("row"), "ids").mapInArrow(scan, _SCORED)


def _with_rest(scored: DataFrame, rest: DataFrame) -> DataFrame:
    """The rows of the texts with the losses of their other bigrams, from the rest of the table, added."""
    lost = scored.filter("gram IS NOT NULL").select("doc_id", "row", F.col("gram").alias("g"), F.col("n").alias("times")).join(rest.hint("merge"), F.col("g") == F.col("gram"))
    sums = lost.groupBy("doc_id", "row").agg(F.sum(F.col("times") * F.col("target_loss")).alias("t"), F.sum(F.col("times") * F.col("background_loss")).alias("b"))
    own = scored.filter("gram IS NULL")
    # Rows alike in doc_id and text have the same sums, and what they lack fell together: each gets its share.
    alike = own.groupBy("doc_id", "row").agg(F.count("*").alias("k"))
    s, k = sums.alias("s"), alike.alias("k")
    share = s.join(k, F.col("s.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("s.row") == F.col("k.row"))).select("s.doc_id", "s.row", (F.col("t") / F.col("k")).alias("t"), (F.col("b") / F.col("k")).alias("b"))
    o, h = own.alias("o"), share.alias("h")
    met = o.join(h, F.col("o.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("o.row") == F.col("h.row")), "left")
    zero = F.lit(0.0)
    return met.select("o.doc_id", "o.n", (F.col("target") + F.coalesce("t", zero)).alias("target"), (F.col("background") + F.coalesce("b", zero)).alias("background"))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, tokenizer: str, table_sent: int = TABLE_SENT) -> DataFrame:
    """doc_id, n_tokens, target_loss and background_loss (means over tokens, in nats) and score of each row."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = written(own.mapInArrow(_encoded(vocabulary), "doc_id long, ids array<int>"), "ids")
    # Written, too: otherwise a task would encode and count at once, in two Python workers.
    wanted = written(target.select(F.col("text").cast("string").alias("text")).mapInArrow(_encoded(vocabulary), "ids array<int>"), "target")
    table = written(loss_table(bigram_counts(encoded), bigram_counts(wanted)), "losses")
    least = _least_sent(table, table_sent)
    rows = table.filter(F.col("n") >= least).select("gram", "target_loss", "background_loss").toArrow()  # table_sent rows at most
    order = np.argsort(rows.column("gram").to_numpy())
    sent = spark.sparkContext.broadcast((rows.column("gram").to_numpy()[order].astype(np.uint32), rows.column("target_loss").to_numpy()[order], rows.column("background_loss").to_numpy()[order]))
    sums = written(_scored(encoded, sent), "sums")
    if least > 1:
        whole = written(_with_rest(sums, table.filter(F.col("n") < least).select("gram", "target_loss", "background_loss")), "sums")
        dropped(sums)
        sums = whole
    dropped(encoded, wanted, table)
    out = sums.select("doc_id", F.col("n").alias("n_tokens"), _mean(F.col("target")).alias("target_loss"), _mean(F.col("background")).alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
