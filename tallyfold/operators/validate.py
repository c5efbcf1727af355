"""Checks of arguments against a schema, before anything is planned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyfold.functions.aggregates import AGGREGATES, NUMERIC, kind_of

#: Keys that one call may group by.
MOST_KEYS = 10


def key_list(by: str | Sequence[str]) -> list[str]:
    """A single name and a list of one name mean the same."""
    keys = [by] if isinstance(by, str) else list(by)
    if not keys:
        raise ValueError("At least one key column is required")
    return keys


def column_type(df: DataFrame, name: str) -> T.DataType:
    """Type of the one column of that name."""
    found = [f.dataType for f in df.schema if f.name == name]
    if not found:
        raise KeyError(name)
    if len(found) > 1:
        raise ValueError(f"column {name!r} is not unique")
    return found[0]


def check(df: DataFrame, keys: list[str], target: str, agg: str, *, most_keys: int | None = MOST_KEYS) -> T.DataType:
    """Type of ``target``, if the call makes sense.

    Unknown aggregates, no keys and too many are ValueErrors, unknown columns
    KeyErrors, and aggregates of numbers over anything else TypeErrors.
    """
    if agg not in AGGREGATES:
        raise ValueError(f"unsupported aggregation {agg!r}; known: {', '.join(AGGREGATES)}")
    if not keys:
        raise ValueError("At least one key column is required")
    if most_keys is not None and len(keys) > most_keys:
        raise ValueError(f"at most {most_keys} key columns are supported, got {len(keys)}")
    for k in keys:
        column_type(df, k)
    dtype = column_type(df, target)
    kind = kind_of(dtype)
    if kind == "other" and agg != "count" or kind == "time" and agg in ("sum", "prod", "var") or kind == "string" and agg in NUMERIC and agg != "sum":
        raise TypeError(f"{agg} needs numbers; {target!r} is {dtype.simpleString()}")
    return dtype


def supports(df: DataFrame, by: str | Sequence[str], target: str, agg: str) -> bool:
    """Whether the integer-key numeric form covers a call: integer keys, at most ten, and a number to reduce."""
    keys = key_list(by)
    if len(keys) > MOST_KEYS or agg not in AGGREGATES:
        return False
    return all(kind_of(column_type(df, k)) == "int" for k in keys) and kind_of(column_type(df, target)) in ("int", "float")
