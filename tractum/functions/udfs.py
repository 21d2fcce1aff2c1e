"""The few places where user code runs in Python, Arrow-batched."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractum.functions.columns import FNV_OFFSET, FNV_PRIME


@F.pandas_udf(T.LongType())
def fnv1a_udf(text: pd.Series) -> pd.Series:
    """32-bit FNV-1a, one character position of the whole batch at a time."""
    fixed = text.fillna("").to_numpy(dtype="U")
    width = max(fixed.dtype.itemsize // 4, 1)
    codes = fixed.view(np.uint32).reshape(len(fixed), width).astype(np.uint64)
    state = np.full(len(fixed), FNV_OFFSET, dtype=np.uint64)
    for i in range(width):
        live = codes[:, i] != 0
        state[live] = ((state[live] ^ codes[live, i]) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
    return pd.Series(state.astype(np.int64))


@F.pandas_udf(T.StringType())
def limited_join_udaf(labels: pd.Series) -> str:
    distinct = sorted(set(labels))
    head = ";".join(distinct[:2])
    return head if len(distinct) <= 2 else f"{head}...({len(distinct)} total)"


def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Local maxima of one series: above the value before, not below the next."""
    pdf = pdf.sort_values("t")
    v = pdf["v"].to_numpy()
    before, after = np.r_[-1, v[:-1]], np.r_[v[1:], -1]
    at = pdf["t"].to_numpy()[(v > before) & (v >= after)]
    if not len(at):
        return pd.DataFrame({"id": [], "n_peaks": [], "first_peak": [], "last_peak": []}).astype("int64")
    return pd.DataFrame({"id": [pdf["id"].iloc[0]], "n_peaks": [len(at)], "first_peak": [at[0]], "last_peak": [at[-1]]})


@F.arrow_udtf(returnType="region string, role string, id long")
class EndpointRows:
    """(region, role, id) for both ends of each row of a table, a batch at a time."""

    def eval(self, edges: pa.RecordBatch):
        for role in ("pre", "post"):
            yield pa.table({"region": edges.column("region"), "role": pa.array([role] * edges.num_rows), "id": edges.column(role)})
