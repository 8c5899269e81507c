"""Named product operators: what each one is, how it is run, and how a failed gate falls back.

Load-balanced and plain variants differ on other hardware only; here both become the same plan, whose partial
aggregation balances loads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..operators import codecs, metrics, split, tiles
from ..operators.solvers import cut
from ..operators.spmv import spmv, spmv_parts

#: Codecs of the catalog, in its order, and the families and gates of their operators.
LOSSLESS = ("all_one", "const_c", "sign2", "sign2_scale", "dict2", "dict4", "dict16", "dict256_u8", "dict65536_u16", "auto_lossless")
LOSSY = ("fp16", "bf16", "bfp8", "bfp8_outlier", "bfp4", "codebook256_u8", "global_logkmeans16", "global_logkmeans32", "global_logkmeans64", "global_logkmeans128")
EXACT_GATE, LOSSY_GATE = "exact_abs_or_rel", "spmv_max_rel"
ONLY_BALANCED = ("bfp8_outlier",)
PROMOTED = ("original_lb", "all_one_lb", "hybrid_lb")
PAPER = ("original_lb", "original_nolb", "dict65536_u16_lb", "auto_lossless_lb", "fp16_lb", "bf16_lb", "bfp8_lb", "bfp8_outlier_lb", "bfp4_lb", "hybrid_lb", "cusparse_default")
LAYOUTS = {"lb": "col_bitmap64_flag_lb", "nolb": "col_bitmap64"}


@dataclass(frozen=True)
class Operator:
    name: str
    layout: str
    codec: str
    family: str
    gate: str
    promotion: str


def _operator(codec: str, kind: str) -> Operator:
    name = f"{codec}_{kind}"
    if codec == "original":
        family = "load_balanced_traversal" if kind == "lb" else "non_load_balanced_traversal"
    else:
        family = "controlled_lossy_value_specialized" if codec in LOSSY else "lossless_value_specialized"
    return Operator(name, LAYOUTS[kind], codec, family, LOSSY_GATE if codec in LOSSY else EXACT_GATE, "promoted" if name in PROMOTED else "buildable_needs_report")


def catalog() -> dict[str, Operator]:
    """All named operators, in order."""
    ops = [_operator(c, k) for c in ("original", *LOSSLESS, *LOSSY) for k in ("lb", "nolb") if not (c in ONLY_BALANCED and k == "nolb")]
    ops.append(Operator("hybrid_lb", "csr_bitbsr_fused_lb", "", "structural_hybrid", EXACT_GATE, "promoted"))
    ops.append(Operator("cusparse_default", "cusparse_csr", "", "baseline", EXACT_GATE, "external_baseline"))
    return {o.name: o for o in ops}


def preset(name: str) -> list[str]:
    """The operators of a preset, in catalog order."""
    every = list(catalog())
    balanced = [n for n in every if n == "cusparse_default" or n.endswith("_lb")]
    chosen = {
        "full": every,
        "paper_perf": PAPER,
        "lb_perf": balanced,
        "lossless_lb": [n for n in balanced if n.removesuffix("_lb") in ("original", *LOSSLESS, "cusparse_default")],
        "lossy_lb": [n for n in balanced if n.removesuffix("_lb") in ("original", *LOSSY[:5], "cusparse_default")],
    }
    if name not in chosen:
        raise ValueError(f"unknown preset: {name}")
    return [n for n in every if n in set(chosen[name])]


def checked(layout: str, codec: str, policy: str = "manual", manual_override: bool = False) -> str:
    """The load-balance policy that holds; ValueError for combinations that make no sense."""
    policy = "manual" if manual_override else policy
    if policy == "binary_implicit_one" and (layout != LAYOUTS["lb"] or codec != "all_one"):
        raise ValueError("the implicit-one policy needs balanced tiles and the all_one codec")
    if layout == "cusparse_csr" and codec not in ("", "original"):
        raise ValueError("value codecs need tiles")
    if codec in ONLY_BALANCED and layout != LAYOUTS["lb"]:
        raise ValueError(f"{codec} needs balanced tiles")
    return policy


def product(m: Matrix, x: DataFrame, name: str) -> DataFrame:
    """y of the named operator."""
    op = catalog().get(name)
    if op is None:
        raise ValueError(f"unknown operator: {name}")
    if name == "cusparse_default":
        return spmv(m, x)
    if name == "hybrid_lb":
        return spmv_parts(m, list(split.parted(m, split.marked(tiles.shapes(m), split.THRESHOLD, split.Costs()))), x)
    codec = op.codec
    if codec == "auto_lossless":
        codec = codecs.auto_lossless(m).first().codec
    lossy: dict[str, Callable[[Matrix], Matrix]] = codecs.LOSSY | {"codebook256_u8": codecs.codebook256} | {f"global_logkmeans{k}": codecs.LOSSY[f"logkmeans{k}"] for k in (16, 32, 64, 128)}
    if codec == "bfp8_outlier":
        return spmv_parts(m, list(codecs.bfp8_outlier(m)), x)
    if codec in lossy:
        return spmv(lossy[codec](m), x)
    exact = codec.removesuffix("_u8").removesuffix("_u16")
    if exact != "original" and not codecs.facts(m).select(codecs.applies(exact)).first()[0]:
        raise ValueError(f"the values do not suit {codec}")
    if exact in ("all_one", "const_c", "sign2", "sign2_scale"):
        return spmv(codecs.exact_coded(m, exact), x)
    if exact in codecs.DICTIONARIES:
        return spmv(m.with_entries(codecs.from_dictionary(*codecs.dictionary(m, 2 ** codecs.DICTIONARIES[exact]))), x)
    return spmv(m.with_entries(tiles.decoded(tiles.tiled(m))), x)


def gated(m: Matrix, x: DataFrame, names: list[str]) -> tuple[str, DataFrame]:
    """The first of the named operators whose result passes its gate, and the result; the last name must be exact."""
    exact = cut(spmv(m, x))  # vectors of both are read more than once
    ops = catalog()
    for name in names:
        y = cut(product(m, x, name))
        gate = metrics.lossy_gate() if ops[name].gate == LOSSY_GATE else metrics.exact_gate()
        if metrics.compared(exact, y).select(gate).first()[0]:
            return name, y
    raise ValueError("no operator passed its gate")
