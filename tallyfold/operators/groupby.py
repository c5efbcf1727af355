"""Group a DataFrame by key columns and reduce one or more columns.

Plain aggregates are one partial and one final hash aggregation over the pruned
columns. Three need more, because a group may hold a large share of all rows:

* ``median``: groups of at most ``max_group_rows`` rows (counted first) are sorted in
  one array; beyond that, distinct (key, value) counts are dealt out by range of key and
  value and the middle ranks are looked up, so no task holds a group.
* ``prod`` of integers wraps modulo 2^64: every task multiplies its own rows by key
  and the partial products meet after one shuffle.
* ``strict_order`` folds floats in row order. That is one sequence per group by
  definition; a group of more than ``max_group_rows`` rows raises an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions import aggregates as A
from tallyfold.operators.validate import MOST_KEYS, check, column_type, key_list

#: Rows of one group that may meet in one array.
MAX_GROUP_ROWS = 5_000_000
_FIRST, _ROW = "_first_seen", "_row"


def _inner(keys: Sequence[str]) -> list[str]:
    """Names that the keys have inside a plan, so that no name of the caller meets one used here."""
    return [f"_key{i}" for i in range(len(keys))]


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _shared_checkpoints(spark: SparkSession) -> None:
    """See to it that checkpoints have a folder that all executors see."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-tallyfold-"))


def _order_column(df: DataFrame, order_by: str | Column | None) -> Column:
    """What says which row came first: a given column, or the place in the files that ``df`` was read from."""
    if order_by is not None:
        return _column(order_by) if isinstance(order_by, str) else order_by
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    try:
        df.select(place)
    except AnalysisException as e:
        raise ValueError("rows have no order here: name a column in order_by") from e
    return place


def _with_keys(df: DataFrame, keys: list[str], dropna: bool) -> DataFrame:
    return df.na.drop(subset=keys) if dropna else df


def _largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def _middle_by_rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): medians of any group size, from counts of (key, value) dealt out by range."""
    counts = rows.where(F.col("_value").isNotNull()).groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))
    parts = counts.repartitionByRange(*keys, "_value").withColumn("_part", F.spark_partition_id())
    parts = parts.select(*keys, "_part", "_value", "_n")
    _shared_checkpoints(rows.sparkSession)
    parts = parts.checkpoint()
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_here"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_before"))
    total = parts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.withColumn("_to", F.sum("_n").over(inside)).join(sums, [*keys, "_part"]).join(total, keys)
    end = F.col("_before") + F.col("_to")
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    holds = lambda rank: (end - F.col("_n") <= rank) & (rank < end)
    value = F.col("_value").cast("double")
    two = ranked.groupBy(*keys).agg(F.max(F.when(holds(low), value)).alias("_lo"), F.max(F.when(holds(high), value)).alias("_hi"), F.max("_total").alias("_total"))
    return two.select(*keys, F.when(F.col("_total") % 2 == 1, F.col("_lo")).otherwise((F.col("_lo") + F.col("_hi")) / 2.0).alias("_value"))


def _wrapped_products(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): products of longs modulo 2^64; missing values count as 1."""

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for f in frames:
            f = f.assign(_value=f["_value"].fillna(1).astype(np.int64))
            held.append(f.groupby(keys, sort=False, dropna=False, as_index=False)["_value"].prod())
            size += len(held[-1])
            if size > 500_000:
                merged = pd.concat(held).groupby(keys, sort=False, dropna=False, as_index=False)["_value"].prod()
                if len(merged) > 250_000:
                    yield merged
                    merged = merged.iloc[:0]
                held, size = [merged], len(merged)
        if held:
            yield pd.concat(held).groupby(keys, sort=False, dropna=False, as_index=False)["_value"].prod()

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key, so all but the last key of a batch are finished."""
        carry = None
        for f in frames:
            f = f if carry is None else pd.concat([carry, f])
            made = f.groupby(keys, sort=False, dropna=False, as_index=False)["_value"].prod()
            carry = made.iloc[-1:]
            if len(made) > 1:
                yield made.iloc[:-1]
        if carry is not None:
            yield carry

    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_value", T.LongType())])
    rows = rows.withColumn("_value", F.coalesce("_value", F.lit(1).cast("long")))
    return rows.mapInPandas(multiply, schema).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(finish, schema)


def _needs_own_plan(agg: str, kind: str, strict: bool) -> bool:
    return agg == "median" or agg == "prod" and kind in ("int", "bool") or strict or kind == "string" and agg == "sum"


def groupby_agg(
    df: DataFrame,
    by: str | Sequence[str],
    target: str,
    agg: str,
    *,
    sort: bool | None = True,
    order_by: str | Column | None = None,
    dropna: bool = True,
    skipna: bool = True,
    min_count: int | None = None,
    ddof: int = 1,
    strict_order: bool = False,
    wrap_overflow: bool = True,
    max_group_rows: int = MAX_GROUP_ROWS,
    most_keys: int | None = MOST_KEYS,
    keep_first: str | None = None,
    time_origin: int | None = None,
) -> DataFrame:
    """Key columns and the aggregate, named like ``target``; one row per group.

    ``sort``: True for ascending keys, False for order of first appearance (by ``order_by``
    or the place in the source files; a row counts even if its value is missing), None
    for no order. ``median`` and the forms in row order count their largest group when this
    is called, which is a job; all else runs with the result. ``dropna`` leaves out rows with a missing key. ``keep_first`` names a column
    for the order value of each group's first row. ``time_origin`` takes the mean of times as a
    double of the microseconds since then, as engines that average doubles do; without it, it is exact. Empty input gives an empty result of the same schema.
    """
    keys = key_list(by)
    dtype = check(df, keys, target, agg, most_keys=most_keys)
    kind = A.kind_of(dtype)
    opt = A.Options(skipna, min_count, ddof, wrap_overflow, time_origin)
    strict = strict_order and kind == "float" and agg in ("sum", "mean", "prod", "std", "var")
    own = _needs_own_plan(agg, kind, strict)
    ordered = sort is False or keep_first is not None
    names = _inner(keys)
    columns = [_column(k).alias(n) for k, n in zip(keys, names)] + [_column(target).alias("_target")]
    if ordered or strict or kind == "string" and agg == "sum":
        columns.append(_order_column(df, order_by).alias(_ROW))
    rows = _with_keys(df.select(*columns), names, dropna)
    extra = [F.min(_ROW).alias(_FIRST)] if ordered else []
    c = F.col("_target")
    if not own:
        out = rows.groupBy(*names).agg(A.aggregate(agg, c, dtype, opt).alias("_out"), *extra)
    else:
        x = A.present(c, kind)
        if kind == "time":
            x = F.unix_micros(c.cast("timestamp"))
        if strict or kind == "string":
            if _largest(rows, names) > max_group_rows:
                raise ValueError(f"a group has more than {max_group_rows} rows; fold it without strict order")
            pairs = F.collect_list(F.struct(F.col(_ROW).alias("order"), x.alias("value")))
            made = F.concat_ws("", F.transform(F.sort_array(pairs), lambda p: p["value"])) if kind == "string" else A.ordered_fold(agg, pairs)
            out = rows.groupBy(*names).agg(A.guarded(agg, made, c, x, kind, opt).alias("_out"), *extra)
        elif agg == "median":
            big = _largest(rows, names) > max_group_rows
            made = A.middle(F.sort_array(F.collect_list(x))) if not big else None
            out = _joined(rows, names, c, x, kind, opt, agg, extra, made, _middle_by_rank)
            if kind == "time":
                out = out.withColumn("_out", F.timestamp_micros(F.round("_out").cast("long")))
        else:
            out = _joined(rows, names, c, x, kind, opt, agg, extra, None, _wrapped_products)
    if sort is False:
        out = out.orderBy(_FIRST)
    elif sort:
        out = out.orderBy(*names)
    first = [F.col(_FIRST).alias(keep_first)] if keep_first else []
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("_out").alias(target), *first)


def _joined(rows, keys, c, x, kind, opt, agg, extra, made, build) -> DataFrame:
    """One aggregation if ``made`` says how, else a plan of its own joined to the groups, which are never lost."""
    if made is not None:
        return rows.groupBy(*keys).agg(A.guarded(agg, made, c, x, kind, opt).alias("_out"), *extra)
    values = build(rows.select(*keys, x.alias("_value")), keys)
    guard = A.guarded(agg, F.lit(True), c, x, "other", opt)
    groups = rows.groupBy(*keys).agg(F.coalesce(guard, F.lit(False)).alias("_ok"), *extra)
    same = [groups[k].eqNullSafe(values[k]) for k in keys]
    out = groups.join(values, same, "left").select(*[groups[k] for k in keys], "_value", "_ok", *([_FIRST] if extra else []))
    plain = F.coalesce("_value", F.lit(1).cast("long")) if agg == "prod" else F.coalesce("_value", A.nan())
    return out.withColumn("_out", F.when(F.col("_ok"), plain).otherwise(F.lit(None) if agg == "prod" else A.nan()))


class GroupedColumn:
    """One target column of a grouped frame."""

    def __init__(self, frame: GroupedFrame, target: str):
        column_type(frame.df, target)
        self.frame, self.target = frame, target

    def agg(self, agg: str, **options) -> DataFrame:
        f = self.frame
        return groupby_agg(f.df, f.by, self.target, agg, **{"sort": f.sort, "order_by": f.order_by, "dropna": f.dropna, "most_keys": None, **options})

    aggregate = agg

    def __getattr__(self, name: str):
        if name in A.AGGREGATES:
            return lambda **options: self.agg(name, **options)
        raise AttributeError(name)

    def transform(self, agg: str, **options) -> DataFrame:
        """All rows with their group's aggregate in a column ``{target}_{agg}``; rows with a missing key get NULL."""
        f, name = self.frame, f"{self.target}_{agg}"
        values = self.agg(agg, **{"sort": None, **options})
        own = [f"_{uuid.uuid4().hex[:12]}" for _ in (*f.by, name)]
        values = values.toDF(*own)
        same = [f.df[k].eqNullSafe(F.col(n)) for k, n in zip(f.by, own)]
        return f.df.join(values, same, "left").select(*[f.df[c] for c in f.df.columns], F.col(own[-1]).alias(name))


class GroupedColumns:
    """Several target columns; an aggregate of all of them is one pass."""

    def __init__(self, frame: GroupedFrame, targets: list[str]):
        self.frame, self.targets = frame, targets

    def __getattr__(self, name: str):
        if name in A.AGGREGATES:
            return lambda **options: self.frame.agg({t: name for t in self.targets}, **options)
        raise AttributeError(name)


class GroupedFrame:
    """``GroupedFrame(df, by)[target].sum()``: a DataFrame with keys, not yet aggregated. Any number of keys is allowed here."""

    def __init__(self, df: DataFrame, by: str | Sequence[str], *, sort: bool | None = True, dropna: bool = True, order_by: str | Column | None = None):
        self.df, self.by, self.sort, self.dropna, self.order_by = df, key_list(by), sort, dropna, order_by
        for k in self.by:
            column_type(df, k)

    def __getitem__(self, target: str | list[str]) -> GroupedColumn | GroupedColumns:
        return GroupedColumns(self, list(target)) if isinstance(target, (list, tuple)) else GroupedColumn(self, target)

    def agg(self, what: dict[str, str | list[str]], **options) -> DataFrame:
        """Aggregates of several columns: {target: aggregate or list of them}; columns are named target, or target_aggregate for a list."""
        wanted = [(t, a, t if isinstance(v, str) else f"{t}_{a}") for t, v in what.items() for a in ([v] if isinstance(v, str) else v)]
        opt = A.Options(**options)
        types = {(t, a): check(self.df, self.by, t, a, most_keys=None) for t, a, _ in wanted}
        single = [w for w in wanted if _needs_own_plan(w[1], A.kind_of(types[w[:2]]), False)]
        plain = [w for w in wanted if w not in single]
        keys = _inner(self.by)
        inside = {t: f"_target{i}" for i, t in enumerate(what)}
        columns = [*[_column(k).alias(n) for k, n in zip(self.by, keys)], *[_column(t).alias(n) for t, n in inside.items()]]
        in_order = self.sort is False or any(A.kind_of(types[w[:2]]) == "string" for w in single)
        if in_order:
            columns.append(_order_column(self.df, self.order_by).alias(_ROW))
        rows = _with_keys(self.df.select(*columns), keys, self.dropna)
        extra = [F.min(_ROW).alias(_FIRST)] if self.sort is False else []
        at = {w: f"_out{i}" for i, w in enumerate(wanted)}
        out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *extra, *[A.aggregate(w[1], F.col(inside[w[0]]), types[w[:2]], opt).alias(at[w]) for w in plain])
        for w in single:
            one = groupby_agg(rows, keys, inside[w[0]], w[1], sort=None, dropna=False, order_by=_ROW if in_order else None, most_keys=None, **options)
            one = one.toDF(*[f"_same{i}" for i in range(len(keys))], at[w])
            out = out.join(one, [out[k].eqNullSafe(F.col(f"_same{i}")) for i, k in enumerate(keys)], "left").drop(*[f"_same{i}" for i in range(len(keys))])
        out = out.orderBy(*([_FIRST] if self.sort is False else keys)) if self.sort is not None else out
        return out.select(*[F.col(n).alias(k) for k, n in zip(self.by, keys)], *[F.col(at[w]).alias(w[2]) for w in wanted])

    def size(self) -> DataFrame:
        """Rows of each group, missing values included."""
        out = _with_keys(self.df, self.by, self.dropna).groupBy(*self.by).agg(F.count(F.lit(1)).alias("size"))
        return out.orderBy(*self.by) if self.sort else out

    def ngroups(self) -> int:
        return _with_keys(self.df.select(*self.by), self.by, self.dropna).distinct().count()

    def apply(self, function, schema: str | T.StructType) -> DataFrame:
        """A pandas function of each group's rows, for what the aggregates cannot say; a group meets in one task."""
        return _with_keys(self.df, self.by, self.dropna).groupBy(*self.by).applyInPandas(function, schema)

    def __repr__(self) -> str:
        return f"GroupedFrame(by={self.by}, sort={self.sort}, dropna={self.dropna})"

    def __len__(self) -> int:
        return self.ngroups()

    def __dir__(self) -> list[str]:
        return sorted({*super().__dir__(), *self.df.columns})


def attach() -> None:
    """Give DataFrames a method ``grouped(by, ...)``; calling it again changes nothing."""
    DataFrame.grouped = lambda self, by, **options: GroupedFrame(self, by, **options)


def detach() -> None:
    """Take that method away again."""
    if is_attached():
        del DataFrame.grouped


def is_attached() -> bool:
    return hasattr(DataFrame, "grouped")
