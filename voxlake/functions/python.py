"""Column functions in Python, over Arrow batches, for what no built-in expresses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def by_value(fn: Callable, kind: str) -> Callable[..., Column]:
    """A column function that applies fn to the values of its columns; it is made where it is used, so modules import without a session."""

    def call(*columns: Column | str) -> Column:
        def run(*parts: pd.Series) -> pd.Series:
            return pd.Series([fn(*values) for values in zip(*parts, strict=True)], dtype=object)

        run.__annotations__ = {"parts": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)(*columns)

    return call
