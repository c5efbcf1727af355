"""The shared folder of a cluster: intermediate tables and files that survive lost executors.

Every operator cuts its lineage by writing a table below ``spark.checkpoint.dir``
and reading it again. Where that setting is missing, a temporary folder of this
machine takes its place if Spark runs on this machine alone, as in tests; on a
cluster that is an error, since executors would not see the folder.

Results are planned over such tables, so the tables have to stay until a result has
been written or collected. Tables that no result needs are deleted by the operators;
the rest goes with ``clean_up(spark)``, to be called when no result is open.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN = "tallyfold.shared.dir"
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not found:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tallyfold-")
        spark.conf.set(_OWN, found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    # Spark has no public call for this; it needs a session with a JVM (not a remote one)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables and files that this process has made; results not yet written are lost."""
    while _MADE:
        _delete(spark, _MADE.pop())


class Scratch:
    """Tables of one run, below one new folder of the shared directory."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made: list[str] = []
        _MADE.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a table of this run and return it as read back."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        self.made.append(name)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def counted(self, df: DataFrame, name: str, rows: Column | None = None) -> tuple[DataFrame, int]:
        """``write`` and the number of rows (or the sum that ``rows`` gives), taken while they are written, without a query of its own."""
        seen = Observation()
        table = self.write(df.observe(seen, (F.count(F.lit(1)) if rows is None else rows).alias("rows")), name)
        return table, seen.get["rows"]

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; names without a table are passed over."""
        for name in names:
            if name in self.made:
                _delete(self.spark, self.path(name))
                self.made.remove(name)

    def keep(self, *names: str) -> None:
        """Delete all tables of this run but those named."""
        self.drop(*[n for n in self.made if n not in names])


def small_side(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are at most ``most``; else as it is, for a shuffled join."""
    return df.hint("broadcast") if rows <= most else df


def open_input(uri: str):
    """A file of the shared folder for random reads."""
    fs, path = _filesystem(uri)
    return fs.open_input_file(path)


def open_output(uri: str):
    """A new file of the shared folder; its folder is made if missing."""
    fs, path = _filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":/", ":///", 1))


def list_files(uri: str, end: str) -> list[str]:
    """Files in a folder of the shared directory whose names end in ``end``, in order, as URIs."""
    from pyarrow.fs import FileSelector

    fs, path = _filesystem(uri)
    base = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    return sorted(base + f.path for f in fs.get_file_info(FileSelector(path)) if f.path.endswith(end))
