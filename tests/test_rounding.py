"""Words of 16 bits are those that NumPy gives, and tell their numbers back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaik.functions.rounding import bf16, fp16, from_word16, word16
from mosaik.matrix import Matrix
from mosaik.operators import codecs, payload

VALUES = [0.0, 1.0, -1.0, 0.1, -2.5, 65504.0, 65519.0, 65520.0, -1e9, 6.1e-5, 6.0e-5, -5.96e-8, 2.9e-8, 3.1e-8, 1 / 3, 1023.5, 2049.0, 2051.0, 1e-40, 3.0e38]


@pytest.mark.parametrize("form", ["fp16", "bf16"])
def test_words_are_those_of_the_format(spark, form):
    t = spark.createDataFrame([(v,) for v in VALUES], "v double")
    f = {"fp16": fp16, "bf16": bf16}[form](F.col("v"))
    rows = t.select("v", f.alias("f"), word16(f, form).alias("w")).withColumn("back", from_word16(F.col("w"), form)).collect()
    for r in rows:
        if form == "fp16":
            with np.errstate(over="ignore"):
                want = int(np.array(r.v, np.float32).astype(np.float16).view(np.uint16))
        else:
            u = int(np.array(r.v, np.float32).view(np.uint32))
            want = (u + 0x7FFF + (u >> 16 & 1)) >> 16
        assert r.w == want, r
        assert r.back == r.f, r


@pytest.mark.parametrize("form", ["fp16", "bf16"])
def test_tiles_of_words_hold_64_bytes_and_keep_stored_zeros(spark, form):
    e = [(0, 0, 0.1), (7, 3, -2.0), (8, 4, 0.0), (100, 9, 1 / 3)]
    m = Matrix(spark.createDataFrame(e, "row long, col long, value double"), 101, 10)
    t = payload.word_tiles(m, form)
    assert {(r.br, r.bc, len(r.payload)) for r in t.collect()} == {(0, 0, 64), (1, 1, 64), (12, 2, 64)}
    want = codecs.rounded(m, {"fp16": fp16, "bf16": bf16}[form]).entries.collect()
    got = payload.from_word_tiles(t, form).collect()
    assert sorted(map(tuple, got)) == sorted((r["row"], r["col"], r["value"]) for r in want)
    empty = m.with_entries(m.entries.limit(0))
    assert payload.from_word_tiles(payload.word_tiles(empty, form), form).count() == 0
