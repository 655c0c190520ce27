"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def newton_sqrt(x: Column) -> Column:
    """The square root; 0 for what isn't positive."""
    return F.when(x > 0, F.sqrt(x)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different or no length, or of norm 0."""
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    both = norm(a) * norm(b)
    return F.when(usable & (both > 0), dot(a, b) / F.when(both > 0, both)).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine: 1 where the cosine isn't defined."""
    return F.lit(1.0) - cosine(a, b)


@F.pandas_udf(T.DoubleType())
def cosine_in_batches(a: pd.Series, b: pd.Series) -> pd.Series:
    """cosine() in numpy, a batch at a time: for vectors that come out of a Python embedder anyway."""
    out = np.zeros(len(a))
    sizes = np.array([(len(x), len(y)) if x is not None and y is not None else (0, 0) for x, y in zip(a, b)]).reshape(-1, 2)
    for n in np.unique(sizes[:, 0]):
        rows = np.flatnonzero((sizes[:, 0] == n) & (sizes[:, 1] == n))
        if n and len(rows):
            x, y = (np.stack([np.asarray(c.iloc[i], np.float64) for i in rows]) for c in (a, b))
            both = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
            out[rows] = np.divide((x * y).sum(1), both, out=np.zeros(len(rows)), where=both > 0)
    return pd.Series(out)
