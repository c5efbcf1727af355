"""Media columns: payloads kept as PNG members of archives and read back by a data source of byte ranges.

Writing: each task writes its rows' payloads as members of ZIP archives (stored, not
compressed again) of about ``ARCHIVE_BYTES``, under names of its own; the list of
archives that successful tasks closed is a table, so archives of lost attempts are
never read. A payload of n bytes is padded with bytes 0 to a positive multiple of
64 and stored as the samples of an 8-bit grey PNG image 64 wide, deflated without
loss, with n in a text chunk. Equal payloads give equal images.

Reading (``ArchiveSource``, format ``tallyfold_archive``): the driver plans ranges of
``range_bytes`` from the archives' sizes in that table and opens none; a task reads the members whose header
starts within its range, by the archive's directory, and hands them on as Arrow
batches. The directory is tried as often as a member. Each member is read, and on a failed read or checksum read again from its
own offset up to ``attempts`` times on a new handle; what still fails ends the task
(``on_error`` = fail) or is a row with a null payload and the error (``on_error`` = null).

Defined results: null and empty texts are 64 bytes 0. Rows are stored one by one, so
repeated rows and null ids give members of their own. An empty table gives no
archives and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import warnings
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyfold.llm.shared import Scratch, list_files, open_input, open_output

WIDTH = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
LEVEL = 4
_PNG = b"\x89PNG\r\n\x1a\n"
MEMBERS = "archive string, offset long, name string, media binary, error string"
OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_png(data: bytes) -> bytes:
    """An 8-bit grey PNG whose samples are the padded payload."""
    rows = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0" + str(len(data)).encode()) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(padded payload, its length before padding) of an image written by ``to_png``."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, packed, n = 8, [], None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"the chunk at {at} is damaged")
        if kind == b"IDAT":
            packed.append(data)
        elif kind == b"tEXt" and data.startswith(b"Length\0"):
            n = int(data[7:])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes(), n


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, shares of 16 levels in thousandths, and an 8 x 8 brightness hash."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    shares = np.bincount(x.reshape(-1) >> 4, minlength=16) * 1000 // x.size
    bands = np.linspace(0, len(x), 9).astype(int)
    cells = np.array([x[a : max(b, a + 1)].reshape(-1, 8, 8).sum((0, 2), dtype=np.int64) / max(b - a, 1) for a, b in zip(np.minimum(bands[:-1], len(x) - 1), bands[1:])])
    bits = np.packbits((cells > cells.mean()).reshape(-1)).tobytes().hex()
    return f"mean={x.mean():.4f};std={x.std():.4f};levels={'.'.join(map(str, shares))};hash={bits}"


def _store(folder: str, archive_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.filterwarnings("ignore", "Duplicate name")
        archive = sink = uri = None
        closed: list[tuple[str, int, int]] = []
        size = count = 0

        def close() -> None:
            archive.close()
            closed.append((uri, sink.tell(), count))
            sink.close()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if archive is None:
                    uri, size, count = f"{folder}/{uuid.uuid4().hex}.zip", 0, 0
                    sink = open_output(uri)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                media = to_png(text or b"")
                archive.writestr(zipfile.ZipInfo(f"{count}/{'' if doc_id is None else doc_id}.png"), media)
                size, count = size + len(media), count + 1
                if size >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in closed], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "bytes", "members"])

    return run


def store(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write every text's UTF-8 bytes below ``folder``; returns the place of the table of archives."""
    scratch = Scratch(docs.sparkSession, "media")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scratch.write(texts.mapInArrow(_store(folder, archive_bytes), "archive string, bytes long, members long"), "archives")
    return scratch.path("archives")


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


def read_member(archive: str, info: zipfile.ZipInfo, file, attempts: int, reopen: Callable = open_input) -> tuple[bytes, object]:
    """(bytes of a member, handle to go on with); tries again from the member's offset on a new handle."""
    for attempt in range(attempts):
        try:
            if attempt:
                file = reopen(archive)
            file.seek(info.header_offset)
            head = file.read(30)
            name, extra = struct.unpack_from("<HH", head, 26)
            file.seek(info.header_offset + 30 + name + extra)
            data = file.read(info.compress_size)
            if head[:4] != b"PK\x03\x04" or len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
                raise OSError(f"the member at {info.header_offset} of {archive} is damaged")
            return data, file
        except (OSError, struct.error) as e:
            last = e
    raise OSError(f"{attempts} attempts: {last}")


def read_directory(archive: str, attempts: int, reopen: Callable = open_input) -> list[zipfile.ZipInfo]:
    """The members an archive lists; tries again on a new handle."""
    for attempt in range(attempts):
        try:
            with reopen(archive) as file, zipfile.ZipFile(file) as z:
                return z.infolist()
        except (OSError, zipfile.BadZipFile) as e:
            last = e
    raise OSError(f"{attempts} attempts at the directory of {archive}: {last}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.manifest = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", 3))
        self.on_error = options.get("on_error", "fail")

    def partitions(self) -> list[InputPartition]:
        import pyarrow.parquet as pq

        out: list[InputPartition] = []
        for part in list_files(self.manifest, ".parquet"):
            with open_input(part) as f:
                for archive, size in zip(*(c.to_pylist() for c in pq.read_table(f, columns=["archive", "bytes"]).columns)):
                    out += [Range(archive, at, min(size, at + self.range_bytes)) for at in range(0, size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        rows: list[tuple] = []
        size = 0
        infos = [i for i in read_directory(partition.archive, self.attempts) if partition.start <= i.header_offset < partition.end]
        file = open_input(partition.archive)
        for info in infos:
            try:
                (data, file), error = read_member(partition.archive, info, file, self.attempts), None
            except OSError as e:
                if self.on_error == "fail":
                    raise
                data, error = None, str(e)
            rows.append((partition.archive, info.header_offset, info.filename, data, error))
            size += len(data or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in MEMBERS.split(", ")])


class ArchiveSource(DataSource):
    """``spark.read.format("tallyfold_archive").load(place of the table of archives)``; options range_bytes, attempts, on_error."""

    @classmethod
    def name(cls) -> str:
        return "tallyfold_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            doc_id = name.partition("/")[2].removesuffix(".png")
            payload, n = from_png(media)
            rows.append((int(doc_id) if doc_id else None, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in OUT.split(", ")])


def read_members(spark: SparkSession, archives: str, **options) -> DataFrame:
    """The members of all archives listed at ``archives``: archive, offset, name, media, error."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tallyfold_archive").options(**options).load(archives)


def digests(members: DataFrame) -> DataFrame:
    """One row per member: what ``OUT`` names, of the payload read back."""
    return members.select("name", "media").mapInArrow(_digest, OUT)
