"""A user's own functions of numpy arrays, where operators take functions of columns.

``over_group`` makes an aggregate of a function of a group's values; it stands beside built-in aggregates, since the values
are gathered by the aggregation and only then given to Python, a batch of groups at a time. ``over_values`` makes a
column function of one that works element by element. A group's values must fit into a worker; nulls are left out, as
numpy knows none, and a group without values gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def over_group(fun: Callable[[np.ndarray], float], returns: str = "double") -> Callable[[Column], Column]:
    """An aggregate of columns from ``fun`` of one array; values come in no order."""

    @F.pandas_udf(returns)
    def each(groups: pd.Series) -> pd.Series:
        return pd.Series([None if g is None or not len(g) else fun(np.asarray(g)) for g in groups], dtype=object if returns == "string" else None)

    return lambda c: each(F.collect_list(c))


def over_values(fun: Callable[[np.ndarray], np.ndarray], returns: str = "boolean") -> Callable[[Column], Column]:
    """A function of a column from ``fun`` of an array of values, whatever their number."""

    @F.pandas_udf(returns)
    def each(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = pd.Series([None] * len(values), dtype=object)
        out[known] = pd.Series(fun(values[known].to_numpy()), index=out.index[known])
        return out

    return lambda c: each(c)


def aggregate(fun: Callable) -> Callable[[Column], Column]:
    """``fun`` itself if it is one of columns, wrapped if it is numpy's own."""
    home = getattr(fun, "__module__", None) or ""
    return over_group(fun) if isinstance(fun, np.ufunc) or home.split(".")[0] == "numpy" else fun
