"""Filters of fixed size that keep whole rows out of joins which few of them need."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from loamstack.operators.folds import Packed, or_fold

FILTER_BITS = 25  #: cells of a filter, as a power of two


def _filter(df: DataFrame, keys: list[str], fold: str) -> Column:
    """Whether the cell of a row's keys was hit by a row of ``df`` (fold ``or``), or by two of them (fold ``two``)."""
    def cells(h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def add(arr: np.ndarray, batch: pa.RecordBatch) -> None:
        cell, times = np.unique(cells(batch.column(0).to_numpy(zero_copy_only=False)), return_counts=True)
        arr[cell] = 1 if fold == "or" else np.minimum(arr[cell] + times, 2)

    hit = or_fold(df.select(F.xxhash64(*keys)), 1 << FILTER_BITS, "uint8", fold, add)
    bits = df.sparkSession.sparkContext.broadcast(Packed(np.packbits(hit == (1 if fold == "or" else 2))))

    @F.pandas_udf(BooleanType())
    def has(h: pd.Series) -> pd.Series:
        cell = cells(h.to_numpy())
        return pd.Series((bits.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1)

    return has(F.xxhash64(*keys))


def among(df: DataFrame, keys: list[str]) -> Column:
    """True of every row whose keys are among those of ``df``, and in error of some others.

    A filter of fixed size: a join behind it shuffles few rows and gives what
    it would give without it.  ``df`` must be cheap to compute again.
    """
    return _filter(df, keys, "or")


def repeated(df: DataFrame, keys: list[str]) -> Column:
    """True of every row whose keys stand in ``df`` twice or more, and in error of some others."""
    return _filter(df, keys, "two")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """An anti join with a small ``gone``; rows surely not in it are not shuffled."""
    hit = among(gone, keys)
    return rows.where(~hit).unionByName(rows.where(hit).join(gone, keys, "left_anti").select(*rows.columns))
