"""Token ids of documents as files of rANS blocks in ascending order of id, and back.

Steps: documents are dealt out by ranges of (id, hash of the text, row) and sorted within
a range; each task encodes its texts and writes files of about ``file_tokens`` tokens. A
file holds the frequency table that all its blocks share, so a folder is read without
anything else: the list of files that successful tasks wrote is a table in it, and
files of lost attempts are never read. Reading is one task a file: table and blocks are
verified and decoded, ``start`` continues from the files before.

Defined results: a null or empty text is a document of its end id alone. Null ids
come first. Repeated ids stand next to each other, ordered by hash; equal rows are
interchangeable. An empty table gives no documents. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.rans import Reader, write_file
from tallyfold.llm.shared import open_input, open_output
from tallyfold.llm.tokens import encoder, text_slices

#: Tokens of a file, about, and bytes of text of a task.
FILE_TOKENS = 4 << 20
TASK_BYTES = 16 << 20
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


_FILES = "part long, place long, uri string, tokens long"


def _write(folder: str, tokenizer: str, end_id: int, file_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        docs: list[tuple[int | None, np.ndarray]] = []
        made: list[tuple[int, int, str, int]] = []
        tokens = 0

        def close() -> None:
            uri = f"{folder}/{part:08d}-{len(made):06d}-{uuid.uuid4().hex[:8]}.rans"
            write_file(open_output(uri), docs)
            made.append((part, len(made), uri, tokens))
            docs.clear()

        for batch in batches:
            texts = batch.column(1).fill_null("")
            for lo, hi in text_slices(texts):
                ids, at = enc.flat(texts.slice(lo, hi - lo), end_id)
                for doc_id, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    docs.append((doc_id, ids[a:b]))
                    tokens += b - a
                    if tokens >= file_tokens:
                        close()
                        tokens = 0
        if docs:
            close()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _FILES.split(", ")])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with open_input(uri) as file:
                rows = list(Reader(file).documents())
            n = np.array([r[1] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([r[2] for r in rows], pa.int64())], names=[c.split()[0] for c in OUT.split(", ")]
            )


def write_token_files(
    docs: DataFrame, folder: str, *, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """Write ``docs`` below ``folder``; returns the table of files (part, place, uri, tokens), which is in the folder too."""
    spark, text = docs.sparkSession, F.col(text_col).cast("string")
    tasks = 1 + (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // task_bytes
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = rows.repartitionByRange(tasks, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    order.mapInArrow(_write(f"{folder}/data", tokenizer, end_id, file_tokens), _FILES).write.mode("overwrite").parquet(f"{folder}/files")
    return spark.read.schema(_FILES).parquet(f"{folder}/files")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, decoded from the files in ``folder``."""
    rows, start = [], 0
    for r in spark.read.schema(_FILES).parquet(f"{folder}/files").orderBy("part", "place").collect():
        rows.append((r.uri, start))
        start += r.tokens
    return spark.createDataFrame(rows, "uri string, start long").repartition(max(1, len(rows))).mapInArrow(_read, OUT)
