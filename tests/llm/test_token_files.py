import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaik.llm import storage
from mosaik.llm import token_files as T

os.environ["TOKENIZERS_PARALLELISM"] = "false"
FILE = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = open(FILE, encoding="utf-8").read()
TEXTS = [None, "", " ", "\n\n ", "a", " a", "two  words\n\n next\tline ", "it's we're 12 345!? <|endoftext|> x", "café   x   y　\n z", "’quoted’ — dash\r\n", "\x1c\x1d \x85 ", "\U0001f600 ok " * 50, "long " * 20000]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), rng.zipf(1.3, n) % 2**32, np.full(n, 2**32 - 1), rng.integers(0, 2, n) * (2**32 - 1), np.arange(n)):
        ids = ids.astype(np.uint32)
        data = T.pack(ids)
        assert (T.unpack(data) == ids).all() and len(T.unpack(data)) == n
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (T.unpack(data, a, b) == ids[a:b]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(128, dtype=np.uint32) % 16
    ids[::20] = 50_000
    assert len(T.pack(ids)) < 12 + 4 + 6 + 128 * 4 // 8 + 7 * 5 + 1
    with pytest.raises(ValueError):
        T.unpack(b"nope" + bytes(20))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sZ19!?. \t\n\r  　’é\U0001f600\x1c\x85"), max_size=30), max_size=6))
def test_pieces_encode_as_whole_texts(texts):
    e = T.Encoder(VOCABULARY)
    ids, count = e.encode(pa.array(texts, pa.string()))
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def check(spark, rows, monkeypatch=None):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, part int")
    path = storage.new_path(spark, "tokens")
    T.write_tokens(df, path, FILE)
    got = T.read_documents(spark, path).orderBy("start").collect()
    tk = T.Encoder(VOCABULARY).tokenizer
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    want = {}
    for d, t in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens


def test_files_give_back_every_document(spark, monkeypatch):
    rows = [(7 * i % 31, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again"), (-5, "first")]
    check(spark, rows)
    check(spark, [])


def test_rows_alike_are_dealt_to_several_files(spark):
    rows = [(None, "one text of many rows")] * 3000 + [(4, "again")] * 2000 + [(5, "other")]
    check(spark, rows)
    path = storage.new_path(spark, "tokens")
    T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, FILE)
    sizes = [sum(map(len, r.d)) for r in spark.read.parquet(path).groupBy("part").agg(F.collect_list("doc_ids").alias("d")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_driver_table(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
