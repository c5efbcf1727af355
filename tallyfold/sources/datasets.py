"""Seeded synthetic workloads: uniform integer keys and a uniform value, made by Spark where they are needed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, rows and key cardinalities of the benchmark workloads (values are doubles, the seed is 42).
PRESETS: dict[str, tuple[int, dict[str, int]]] = {
    "1key": (5_000_000, {"key": 1000}),
    "2key": (5_000_000, {"region": 50, "category": 100}),
    "3key": (5_000_000, {"region": 50, "category": 100, "year": 5}),
    "4key": (5_000_000, {"region": 50, "category": 100, "year": 5, "quarter": 4}),
    "5key": (5_000_000, {"region": 50, "category": 100, "year": 5, "quarter": 4, "channel": 10}),
    "high_cardinality_1key": (5_000_000, {"key": 5_000_000}),
    "high_cardinality_2key": (5_000_000, {"k1": 5000, "k2": 5000}),
    "high_cardinality_3key": (5_000_000, {"k1": 500, "k2": 500, "k3": 500}),
    "low_cardinality_3key": (5_000_000, {"k1": 10, "k2": 10, "k3": 10}),
    "quick_2key": (1_000_000, {"k1": 100, "k2": 50}),
    "quick_3key": (1_000_000, {"k1": 100, "k2": 50, "k3": 20}),
    "threshold_180k": (5_000_000, {"k1": 1000, "k2": 90}),
    "threshold_200k": (5_000_000, {"k1": 1000, "k2": 100}),
    "threshold_220k": (5_000_000, {"k1": 1000, "k2": 110}),
}


def generate(spark: SparkSession, rows: int, keys: Mapping[str, int], *, value: str = "value", value_type: str = "double", seed: int = 42) -> DataFrame:
    """``rows`` rows with a row number ``rid``, long keys in [0, cardinality) and a double in [0, 1000) or a long in [0, 10000)."""
    if value_type not in ("double", "long"):
        raise ValueError("value_type is double or long")
    columns = [F.floor(F.rand(seed + i) * n).cast("long").alias(k) for i, (k, n) in enumerate(keys.items())]
    size = 1000.0 if value_type == "double" else 10_000.0
    made = F.rand(seed + len(columns)) * size
    return spark.range(rows).select(F.col("id").alias("rid"), *columns, (made if value_type == "double" else F.floor(made).cast("long")).alias(value))


def preset(spark: SparkSession, name: str, **options) -> DataFrame:
    rows, keys = PRESETS[name]
    return generate(spark, rows, keys, **options)


def describe(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_rows, card_<key> for each key, n_groups and group_ratio (groups by rows)."""
    whole = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(k).alias(f"card_{k}") for k in keys])
    groups = df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_groups"))
    return whole.join(F.broadcast(groups)).withColumn("group_ratio", F.coalesce(F.col("n_groups") / F.nullif("n_rows", F.lit(0)), F.lit(0.0)))
