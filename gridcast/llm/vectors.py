"""Whole-number vectors: which rows of an embedding table can be used, and their scaled components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Scaled components up to this size keep every square, product and sum of a vector exact in 64 bits.
LARGEST = 1 << 26


def usable(vector: Column) -> Column:
    """Whether ``vector`` (array of numbers) has components, all of them numbers within ``LARGEST`` once scaled.

    Null arrays, null components, NaN and the infinities fail; so do finite components too large to be squared exactly.
    """
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * SCALE) <= LARGEST, F.lit(False)) & ~F.isnan(x.cast("double")))
    return F.coalesce(fits & (F.size(vector) > 0), F.lit(False))


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, *others: Column) -> tuple[DataFrame, int]:
    """The usable rows as (id, *others, x: array<int>), and the number of components.

    All vectors must have one length to be compared. It is that of the smallest usable id (nulls last, then the
    longest); rows of another length are left out like unusable ones. Without usable rows the length is 0.
    """
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    rows = df.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), *others, x.alias("x"))
    first = F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)), -F.size("x"))
    width = rows.agg(F.min_by(F.size("x"), first)).first()[0] or 0
    return rows.where(F.size("x") == width), width


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` values, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))
