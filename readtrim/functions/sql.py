"""The kernels as SQL functions: ``register(spark)``, then use them in any query.

| function | result |
|---|---|
| ``read_adapter(seq, adapter, tolerance)`` | struct(idx, n): best placement of the adapter's first 16 bases, (0, 0) without one |
| ``read_quality_keep(qual, score, window)`` | bases that the sliding window keeps (offset 33) |
| ``read_poly_tail(seq, base, mismatches)`` | struct(idx, n): first base and length of a tail of one base |
| ``read_complexity(seq)`` | one minus the share of equal neighbours in blocks of 16 |
| ``read_count_n(seq)`` | ambiguity in units of N |
| ``read_revcomp(seq)`` | reverse complement |

All are vectorised (Arrow batches). Nulls count as empty reads; constants may differ from row to row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import kernels
from .batch import LETTER, Mate, reverse_complement, to_column, to_matrix


def _mate(seq: pd.Series) -> Mate:
    column = pa.array(seq.fillna(""), pa.string())
    return Mate.of(column, column)


def _by_value(*columns: pd.Series):
    """(values, rows) of each distinct combination of constants."""
    keys = list(zip(*columns, strict=True))
    for key in dict.fromkeys(keys):
        yield key, np.array([k == key for k in keys])


def adapter(seq: pd.Series, needle: pd.Series, tolerance: pd.Series) -> pd.DataFrame:
    idx, n = np.zeros(len(seq), np.int64), np.zeros(len(seq), np.int64)
    for (a, tol), rows in _by_value(needle, tolerance):
        m = _mate(seq[rows])
        hit = kernels.scan(kernels.needle(a), m.codes, m.n, 1, int(tol))
        idx[rows], n[rows] = hit.idx, hit.n
    return pd.DataFrame({"idx": idx, "n": n})


def quality_keep(qual: pd.Series, score: pd.Series, window: pd.Series) -> pd.Series:
    keep = np.zeros(len(qual), np.int64)
    for (s, w), rows in _by_value(score, window):
        q, n = to_matrix(pa.array(qual[rows].fillna(""), pa.string()))
        keep[rows] = kernels.quality_keep(q, n, int(s), int(w), 33)
    return pd.Series(keep)


def poly_tail(seq: pd.Series, base: pd.Series, mismatches: pd.Series) -> pd.DataFrame:
    idx, n = np.zeros(len(seq), np.int64), np.zeros(len(seq), np.int64)
    for (b, k), rows in _by_value(base, mismatches):
        idx[rows], n[rows] = kernels.poly_tail(_mate(seq[rows]), b, int(k))
    return pd.DataFrame({"idx": idx, "n": n})


def complexity(seq: pd.Series) -> pd.Series:
    return pd.Series(kernels.complexity(_mate(seq)))


def count_n(seq: pd.Series) -> pd.Series:
    return pd.Series(kernels.count_n(_mate(seq)))


def revcomp(seq: pd.Series) -> pd.Series:
    m = _mate(seq)
    return pd.Series(to_column(LETTER[reverse_complement(m.codes, m.n)], m.n).to_pylist())


_PLACE = "struct<idx: bigint, n: bigint>"
FUNCTIONS = {
    "read_adapter": (adapter, _PLACE),
    "read_quality_keep": (quality_keep, "bigint"),
    "read_poly_tail": (poly_tail, _PLACE),
    "read_complexity": (complexity, "double"),
    "read_count_n": (count_n, "double"),
    "read_revcomp": (revcomp, "string"),
}


def register(spark: SparkSession) -> None:
    for name, (function, kind) in FUNCTIONS.items():
        spark.udf.register(name, F.pandas_udf(function, kind))
