"""The same aggregates over a stream: one row per group for what has arrived.

All aggregates that are partially aggregated work, in update or complete mode;
those that need row order or whole groups do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.aggregates import Options, aggregate, kind_of
from tallyfold.operators.validate import check, key_list


def stream_agg(df: DataFrame, by: str | Sequence[str], target: str, agg: str, **options) -> DataFrame:
    """Key columns and the aggregate, named like ``target``, of a streaming or static frame."""
    keys = key_list(by)
    dtype = check(df, keys, target, agg)
    if agg == "median" or agg == "prod" and kind_of(dtype) in ("int", "bool"):
        raise ValueError(f"{agg} of {dtype.simpleString()} needs whole groups and does not run on a stream")
    return df.na.drop(subset=keys).groupBy(*keys).agg(aggregate(agg, F.col(target), dtype, Options(**options)).alias(target))
