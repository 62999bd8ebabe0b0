"""Vectors as packed little-endian float32 bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def encode(v: pd.Series) -> pd.Series:
    """Null for null and empty vectors."""
    return v.map(lambda x: None if x is None or len(x) == 0 else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _decode(blob: pd.Series, dimension: pd.Series) -> pd.Series:
    def one(b, n):
        if b is None or pd.isna(n):
            return None
        x = np.frombuffer(b, "<f4")
        if len(x) != n:
            raise ValueError(f"{len(x)} numbers where {int(n)} were stored")
        return x

    return pd.Series([one(b, n) for b, n in zip(blob, dimension, strict=True)])


def decode(blob: Column, dimension: Column) -> Column:
    return _decode(blob, dimension.cast("int"))
