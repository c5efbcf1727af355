"""Column functions."""

from tallyfold.functions.aggregates import AGGREGATES, Options, aggregate

__all__ = ["AGGREGATES", "Options", "aggregate"]
