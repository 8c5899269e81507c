"""Runnable jobs over tables, and the queries that run them on the driver's tables."""

from __future__ import annotations

from . import codec_sweep, term_matrix

QUERIES = {"job1_term_matrix": term_matrix.query, "job2_codec_sweep": codec_sweep.query}
SQL = {"job1_term_matrix": term_matrix.SQL, "job2_codec_sweep": codec_sweep.SQL}
