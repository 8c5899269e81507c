import pytest
from pyspark.sql import functions as F

from mosaik.operators.spmv import spmv
from mosaik.plans import planner as P
from mosaik.plans.policy import load_balance
from mosaik.sources.tables import input_vector, part_by_supplier


def test_catalog_and_presets():
    c = P.catalog()
    assert len(c) == 43 and list(c)[0] == "original_lb" and "bfp8_outlier_nolb" not in c
    assert P.preset("full") == list(c)
    assert P.preset("lossy_lb") == ["original_lb", "fp16_lb", "bf16_lb", "bfp8_lb", "bfp8_outlier_lb", "bfp4_lb", "cusparse_default"]
    assert len(P.preset("lossless_lb")) == 12 and set(P.preset("paper_perf")) == set(P.PAPER)
    assert all(n.endswith("_lb") or n == "cusparse_default" for n in P.preset("lb_perf"))
    with pytest.raises(ValueError):
        P.preset("none")


def test_combinations_that_make_no_sense():
    assert P.checked("col_bitmap64_flag_lb", "all_one", "binary_implicit_one") == "binary_implicit_one"
    assert P.checked("col_bitmap64", "dict4", "binary_implicit_one", manual_override=True) == "manual"
    for bad in (("col_bitmap64", "all_one", "binary_implicit_one"), ("cusparse_csr", "dict4"), ("col_bitmap64", "bfp8_outlier")):
        with pytest.raises(ValueError):
            P.checked(*bad)


@pytest.mark.parametrize("name", ["original_nolb", "dict256_u8_lb", "dict65536_u16_nolb", "auto_lossless_lb", "hybrid_lb", "cusparse_default"])
def test_exact_operators_agree(spark, sf_dir, name):
    m = part_by_supplier(spark, sf_dir)
    x = input_vector(spark, m.cols)
    assert sorted(P.product(m, x, name).collect()) == sorted(spmv(m, x).collect())


def test_gates_fall_back(spark, sf_dir):
    m = part_by_supplier(spark, sf_dir)
    x = input_vector(spark, m.cols)
    assert P.gated(m, x, ["bfp4_lb", "original_lb"])[0] == "original_lb"
    assert P.gated(m, x, ["fp16_lb", "original_lb"])[0] == "fp16_lb"
    with pytest.raises(ValueError):
        P.product(m, x, "all_one_lb")
    ones = m.with_value(F.lit(1.0))
    assert sorted(P.product(ones, x, "all_one_lb").collect()) == sorted(spmv(ones, x).collect())


def test_load_balance_rules(spark):
    cases = {(5, 4): 8, (14948, 105): 8, (66480, 136): 16, (319126, 171): 64, (422802, 512): 128, (2516849, 1791489): 32, (9000000, 400000): 128, (800000, 240): 128, (4000000, 48000): 64, (0, 5): 32}
    t = spark.createDataFrame(list(cases), "b long, r long")
    assert {(r.b, r.r): r.chunk for r in t.select("b", "r", load_balance(F.col("b"), F.col("r")).alias("chunk")).collect()} == cases
