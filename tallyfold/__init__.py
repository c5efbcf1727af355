"""Grouped numerical analytics on Spark DataFrames."""

from tallyfold.operators.groupby import GroupedFrame, attach, detach, groupby_agg, is_attached

__all__ = ["GroupedFrame", "attach", "detach", "groupby_agg", "is_attached"]
