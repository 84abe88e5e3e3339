"""Small relational helpers: first occurrences, caps by group, availability."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def distinct_first(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Of repeated values of a group the first, with its place among the first ones (``seq`` from 0); combines before the shuffle."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias(order))
    return first.withColumn("seq", F.row_number().over(W.partitionBy(*keys).orderBy(order, value)) - 1)


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group (a group limit, so that no more than n rows of a group are shuffled)."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def missing_modules(*modules: str) -> list[str]:
    """Which of the modules are missing; none is imported."""
    out = []
    for name in modules:
        try:
            found = importlib.util.find_spec(name)
        except (ImportError, ValueError):
            found = None
        if found is None:
            out.append(name)
    return out
