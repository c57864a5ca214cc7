"""Vectors as whole numbers: which rows take part, and their components as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x).
SCALE = 1024


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose `embedding` is not NULL and holds neither NULL nor non-finite components."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull()).where(~odd)


def whole(values: pa.Array, width: int) -> np.ndarray:
    """Components as 64-bit whole numbers (rows x width); a shorter vector has zeros at its end, a longer one is cut."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks() if values.num_chunks != 1 else values.chunk(0)
    flat = np.floor(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(flat) and not np.abs(flat).max() < 2.0**62:
        raise OverflowError("a component does not fit into a long")
    lengths = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, inside = np.repeat(np.arange(len(lengths)), lengths), place < width
    out = np.zeros((len(values), width), dtype=np.int64)
    out[row[inside], place[inside]] = flat[inside].astype(np.int64)
    return out


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0
