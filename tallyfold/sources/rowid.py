"""Row order of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row_order(df: DataFrame, name: str = "row_order") -> DataFrame:
    """``df``, as read from Parquet files, with a sortable column (file, place in file).

    Call it before anything that shuffles. Files count in the order of their names.
    """
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))
