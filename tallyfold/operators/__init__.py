"""Operators on DataFrames."""

from tallyfold.operators.groupby import GroupedFrame, groupby_agg

__all__ = ["GroupedFrame", "groupby_agg"]
