"""pandas at the edges: frames in with their row order, results out as Series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: pandas types by name and what they become; unsigned integers take the next wider type.
_TYPES = {"uint8": "short", "uint16": "int", "uint32": "long", "uint64": "decimal(20,0)", "int8": "byte", "int16": "short", "int32": "int", "float32": "float"}


def from_pandas(spark: SparkSession, pdf: pd.DataFrame, *, row: str | None = "rid") -> DataFrame:
    """A Spark frame of a pandas frame; ``row`` names a column for the place of each row. Unsigned integers become the next wider signed type, missing extension values NULL."""
    if row is not None:
        pdf = pdf.assign(**{row: np.arange(len(pdf), dtype=np.int64)})
    casts = {c: _TYPES[str(t).lower()] for c, t in pdf.dtypes.items() if str(t).lower() in _TYPES}
    plain = pdf.copy()
    for c, t in pdf.dtypes.items():
        if str(t).lower() == "uint64":
            plain[c] = [None if pd.isna(v) else str(v) for v in pdf[c]]
        elif isinstance(t, pd.CategoricalDtype):
            plain[c] = pdf[c].astype(object).where(pdf[c].notna(), None)
    df = spark.createDataFrame(plain)
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in plain.columns}
    return df.select(*[quoted[c].cast(casts[c]).alias(c) if c in casts else quoted[c] for c in plain.columns])


def to_series(result: DataFrame, target: str) -> pd.Series:
    """A grouped result as a Series with its keys as index, in the order of the result; keys and integers keep their types."""
    keys = [c for c in result.columns if c != target]
    pdf = result.toPandas()
    types = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.DoubleType: "float64"}
    for f in result.schema:
        if (kind := types.get(type(f.dataType))) and not (kind.startswith("int") and pdf[f.name].isna().any()):
            pdf[f.name] = pdf[f.name].astype(kind)
    return pdf.set_index(keys if len(keys) > 1 else keys[0])[target]
