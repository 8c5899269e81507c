"""Load-balance policy: how many tiles a work item takes, from the number of tiles and how crowded block rows are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (least tiles per block row, least tiles, most tiles, chunk); the first rule that holds decides.
RULES = (
    (0.0, 1, 29_999, 8),
    (20_000.0, 700_000, None, 128),
    (6_000.0, 400_000, None, 128),
    (6_000.0, 250_000, None, 64),
    (500.0, 1, 119_999, 16),
    (500.0, 3_000_000, None, 64),
    (500.0, 1, None, 32),
    (128.0, 8_000_000, None, 128),
    (0.0, 3_000_000, None, 64),
)
DEFAULT = 32


def load_balance(blocks: Column, rows: Column) -> Column:
    """Tiles of a work item, and beyond how many a block row is cut."""
    crowd = blocks / F.greatest(F.floor((rows + 7) / 8), F.lit(1))
    out = F.lit(DEFAULT)
    for per_row, least, most, chunk in reversed(RULES):
        rule = (crowd >= per_row) & (blocks >= least)
        out = F.when(rule if most is None else rule & (blocks <= most), chunk).otherwise(out)
    return F.when((blocks <= 0) | (rows <= 0), DEFAULT).otherwise(out).cast("int")
