import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaik.llm import packing as P
from mosaik.llm import storage
from mosaik.llm.token_files import Encoder

os.environ["TOKENIZERS_PARALLELISM"] = "false"
FILE = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = open(FILE, encoding="utf-8").read()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abS'sTdZ19!?. \t\n\r 　’éÉΣ̸́=İ\U0001f600\x1c\x85_"), max_size=30), max_size=6))
def test_words_encode_as_whole_texts(texts):
    e = Encoder(VOCABULARY)
    ids, count = e.encode(pa.array(texts, pa.string()))
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def packed(sizes, limits, cut=True, window=16):
    p = P.Packer(limits, cut, window)
    out = []
    for i, (n, silent) in enumerate(sizes):
        out += p.add(i, np.arange(n), silent)
    out += p.close()
    assert len(p.waiting) == 0
    return out


def whole(sequences, sizes, limits):
    """Every token of every example lies in one piece, and no sequence is over a limit."""
    met = defaultdict(list)
    for s in sequences:
        assert 1 <= sum(len(x.ids) for x in s) <= limits.tokens and len(s) <= limits.segments and sum(x.loss for x in s) <= limits.loss
        for x in s:
            assert len(x.ids) and x.ids[0] == x.start and x.whole == sizes[x.example][0]
            assert x.silent == min(len(x.ids), max(0, sizes[x.example][1] - x.start))
            met[x.example].append((x.start, len(x.ids)))
    for i, (n, _) in enumerate(sizes):
        at = 0
        for start, length in sorted(met[i]):
            assert start == at
            at += length
        assert at == n


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 90), st.integers(0, 90)).map(lambda x: (x[0], min(x[0] - 1, x[1]))), max_size=60),
    st.tuples(st.sampled_from([8, 16, 32]), st.integers(1, 6), st.integers(1, 32)).map(lambda x: P.Limits(*x)),
    st.booleans(),
)
def test_every_token_lies_in_one_piece_within_all_limits(sizes, limits, cut):
    out = packed(sizes, limits, cut)
    whole(out, sizes, limits)
    if cut:
        assert all(P.padded(n, limits.tokens) == n for n in (sum(len(x.ids) for x in s) for s in out))


def test_the_dot_product_mixes_demands():
    """Examples that are all loss meet those that are nearly none: either kind alone fills a limit and leaves the other half empty."""
    sizes = [(50, 0)] * 40 + [(50, 49)] * 40
    out = packed(sizes, P.Limits(200, 8, 102), cut=False, window=100)
    whole(out, sizes, P.Limits(200, 8, 102))
    assert len(out) == 20 and all(sum(x.silent > 0 for x in s) == 2 for s in out)


def test_few_sequences_are_not_full():
    rng = np.random.default_rng(1)
    sizes = [(int(n), 0) for n in rng.lognormal(5.5, 1.2, 3000).astype(int) + 1]
    out = packed(sizes, P.Limits(), window=P.WINDOW)
    whole(out, sizes, P.Limits())
    total = sum(n for n, _ in sizes)
    assert len(out) <= total // 2048 + 12
    loose = packed(sizes, P.Limits(), cut=False, window=P.WINDOW)
    assert total / (2048 * len(loose)) > 0.97


def test_a_limit_below_one_example_cuts_it():
    out = packed([(10, 3)], P.Limits(8, 2, 2), cut=False)
    whole(out, [(10, 3)], P.Limits(8, 2, 2))
    with pytest.raises(ValueError):
        P.Packer(P.Limits(8, 0, 2))


def check(spark, rows, schema="doc_id long, text string, start int, prompt string", **kw):
    df = spark.createDataFrame([(*r, 1, None)[:4] for r in rows], schema) if isinstance(rows, list) else rows
    path = storage.new_path(spark, "packed")
    P.write_packed(df, path, FILE, **kw)
    pieces = P.read_pieces(spark, path).collect()
    tk = Encoder(VOCABULARY).tokenizer
    want = defaultdict(list)
    for r in df.collect():
        prompt = r[kw["prompt"]] if "prompt" in kw else None
        ids = np.array([*tk.encode(prompt or "", add_special_tokens=False).ids, *tk.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want[r.doc_id].append(ids)
    got, size = defaultdict(list), defaultdict(list)
    for p in pieces:
        size[p.sequence_id].append((p.offset, p.length))
        own = [x for x in want[p.doc_id] if len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32]
        assert own
        got[p.doc_id].append((p.start, p.length))
    for d, texts in want.items():
        assert sum(n for _, n in got[d]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for start, n in sorted(got[d]):
                assert start == at
                at += n
    total = 0
    for parts in size.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        total += P.padded(at, 2048) - at
    return total, pieces, path


def test_files_give_back_every_piece(spark):
    texts = [None, "", " \n", "one", "It's TWO  words", "é ü\x0b" * 200, "long words here " * 5000, "<|endoftext|> x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, None), (None, "no id")]
    padding, _, path = check(spark, rows)
    assert padding == 0
    first = P.read_sequences(spark, path).first()
    assert len(P.unpacked(bytes(first.ids), first.width)) == sum(first.lengths) == first.size
    assert check(spark, [])[1] == []
    assert check(spark, [(1, "the same text of a third of all rows")] * 500)[0] == 0


def test_conversations_meet_all_three_limits(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = turns.filter("turn % 2 = 0").select("conv_id", "turn", F.col("text").alias("prompt"))
    said = turns.filter("turn % 2 = 1").select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), "text")
    examples = asked.join(said, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t"))).select(F.hash("conv_id", "turn").cast("long").alias("doc_id"), "prompt", "text").checkpoint()
    limits = P.Limits(512, 8, 300)
    _, pieces, path = check(spark, examples, prompt="prompt", limits=limits)
    held = defaultdict(lambda: [0, 0, 0])
    for p in pieces:
        for i, n in enumerate((p.length, 1, p.loss_tokens)):
            held[p.sequence_id][i] += n
    assert all(a <= b for v in held.values() for a, b in zip(v, limits, strict=True))


def test_driver_table(spark, sf_dir):
    padding, _, _ = check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    assert padding == 0
