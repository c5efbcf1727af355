"""The nine aggregates as Spark columns, with missing values (NULL and NaN) left out and defined results for groups without values.

Every expression but the ordered folds and the collected median is partially
aggregated before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGGREGATES = ("sum", "mean", "median", "prod", "std", "var", "min", "max", "count")
#: Aggregates that need numbers (or times, for mean and median and std).
NUMERIC = ("sum", "mean", "median", "prod", "std", "var")


def nan() -> Column:
    return F.lit(float("nan"))


def kind_of(dtype: T.DataType) -> str:
    """int, float, decimal, bool, string, time or other."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "other"


@dataclass(frozen=True)
class Options:
    """What an aggregate may be asked for besides its name."""

    skipna: bool = True
    min_count: int | None = None
    ddof: int = 1
    wrap_overflow: bool = True
    #: Mean of times: None is exact; else the mean, as a double, of the microseconds since this number of them.
    time_origin: int | None = None


def present(c: Column, kind: str) -> Column:
    """The value as a number, or NULL where it is missing."""
    if kind == "float":
        c = c.cast("double")
        return F.when(~F.isnan(c), c)
    if kind in ("int", "bool"):
        return c.cast("long")
    return c


def missing(c: Column, kind: str) -> Column:
    return c.isNull() | F.isnan(c) if kind == "float" else c.isNull()


def _limbs(v: Column) -> list[Column]:
    """Sums of the 22 low bits, the 22 next and the signed rest: exact for up to 2^41 rows of a group."""
    low = F.lit((1 << 22) - 1)
    return [F.sum(v.bitwiseAND(low)), F.sum(F.shiftright(v, 22).bitwiseAND(low)), F.sum(F.shiftright(v, 44))]


def wrapped_sum(v: Column) -> Column:
    """Sum of longs modulo 2^64, never raising on overflow."""
    low = F.lit((1 << 22) - 1)
    a, b, c = _limbs(v)
    b = b + F.shiftright(a, 22)
    c = c + F.shiftright(b, 22)
    return F.shiftleft(c, 44).bitwiseOR(F.shiftleft(b.bitwiseAND(low), 22)).bitwiseOR(a.bitwiseAND(low))


def _exact_decimal(v: Column) -> Column:
    a, b, c = (x.cast("decimal(38,0)") for x in _limbs(v))
    return c * F.lit(1 << 44).cast("decimal(15,0)") + b * F.lit(1 << 22).cast("decimal(8,0)") + a


def exact_mean(v: Column) -> Column:
    """Mean of longs as a decimal of 18 digits behind the point, NULL without values; as a double it is rounded once."""
    total, n = _exact_decimal(v).cast("decimal(38,0)"), F.nullif(F.count(v), F.lit(0)).cast("decimal(19,0)")
    rest = (total % n).cast("decimal(19,0)")
    return ((total - rest) / n).cast("decimal(19,0)") + rest / n


def _spread(x: Column, ddof: int) -> Column:
    if ddof == 1:
        return F.var_samp(x)
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / (n - ddof))


def _reduced(agg: str, x: Column, kind: str, opt: Options) -> Column:
    if agg == "count":
        return F.count(x)
    if agg in ("min", "max"):
        out = F.min(x) if agg == "min" else F.max(x)
        return F.coalesce(out, nan()) if kind == "float" else out
    if agg == "sum":
        if kind == "float":
            return F.coalesce(F.sum(x), F.lit(0.0))
        if kind == "decimal":
            return F.coalesce(F.sum(x), F.lit(0).cast("decimal(38,0)"))
        return F.coalesce(wrapped_sum(x) if opt.wrap_overflow else F.sum(x), F.lit(0).cast("long"))
    if agg == "mean":
        if kind in ("int", "bool"):
            return F.coalesce(exact_mean(x).cast("double"), nan())
        return F.coalesce(F.avg(x).cast("double"), nan())
    if agg == "prod":
        return F.coalesce(F.product(x.cast("double")), F.lit(1.0))
    spread = F.coalesce(_spread(x.cast("double"), opt.ddof), nan())
    return spread if agg == "var" else F.sqrt(spread)


def aggregate(agg: str, c: Column, dtype: T.DataType, opt: Options = Options()) -> Column:
    """The aggregate of a column, for all but ``median`` and the product of integers, which the group operator builds."""
    kind = kind_of(dtype)
    if kind == "time" and agg in ("mean", "std"):
        micros = F.unix_micros(c.cast("timestamp"))
        if agg == "mean":
            if opt.time_origin is None:
                return F.timestamp_micros(F.round(exact_mean(micros)).cast("long"))
            origin = F.lit(opt.time_origin).cast("long")
            return F.timestamp_micros(F.round(exact_mean(micros - origin).cast("double")).cast("long") + origin)
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.sqrt(_spread(micros.cast("double"), opt.ddof)) / 1e6).cast("decimal(18,6)"))
    if kind == "bool" and agg in ("min", "max", "count"):
        x = c
    elif kind == "int" and agg in ("min", "max"):
        x = c
    else:
        x = present(c, kind)
    return guarded(agg, _reduced(agg, x, kind, opt), c, x, kind, opt)


def guarded(agg: str, out: Column, c: Column, x: Column, kind: str, opt: Options) -> Column:
    """``out``, or missing where a missing value may not be skipped or there are too few values."""
    if agg == "count":
        return out
    none = F.lit(None) if kind not in ("int", "float", "bool", "decimal") else nan() if kind == "float" or agg not in ("min", "max", "sum", "prod") else F.lit(None)
    if not opt.skipna:
        out = F.when(~F.coalesce(F.bool_or(missing(c, kind)), F.lit(False)), out).otherwise(none)
    if opt.min_count is not None and agg in ("sum", "prod"):
        out = F.when(F.count(x) >= opt.min_count, out).otherwise(none)
    return out


def middle(values: Column) -> Column:
    """Median of a sorted array without missing values; an even number of values is averaged after conversion, so that large ones overflow."""
    n = F.size(values)
    at = lambda i: F.get(values, i.cast("int")).cast("double")
    upper = F.floor(n / 2)
    return F.when(n == 0, nan()).when(n % 2 == 1, at(upper)).otherwise((at(upper - 1) + at(upper)) / 2.0)


def ordered_fold(agg: str, pairs: Column) -> Column:
    """Left-to-right sum, product or mean over an array of (order, value) structs; missing values are skipped."""
    values = F.filter(F.transform(F.sort_array(pairs), lambda p: p["value"]), lambda v: v.isNotNull())
    if agg == "prod":
        return F.aggregate(values, F.lit(1.0), lambda a, v: a * v)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    if agg == "sum":
        return total
    if agg == "mean":
        return F.when(F.size(values) > 0, total / F.size(values)).otherwise(nan())
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a: Column, v: Column) -> Column:
        n = a["n"] + 1.0
        d = v - a["mean"]
        mean = a["mean"] + d / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + d * (v - mean)).alias("m2"))

    state = F.aggregate(values, start, step)
    var = F.when(state["n"] > 1.0, F.greatest(state["m2"] / (state["n"] - 1.0), F.lit(0.0))).otherwise(nan())
    return var if agg == "var" else F.sqrt(var)
