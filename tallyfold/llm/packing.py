"""Sum-of-squares online packing of token documents into sequences.

Method: windows of ``capacity`` tokens are filled online. ``levels[h]`` counts
the partially filled windows with h tokens. A document of a tokens goes to the
level h (0: a new window) for which the sum of squares of ``levels`` is smallest
after the move from h to h + a; ties go to the fullest window. Of a document
longer than a window, the whole windows are complete at once and the rest is
placed.

Each task packs the rows of its own partition, so nothing is shuffled and a lost
task is done again with the same result. At a task's end, or when ``OPEN`` windows
are open, the emptiest open windows are cut to fill the fullest ones exactly, and
the last rest is cut into sequences whose lengths are powers of two, which need no
padding. So the packing has no padding at all, at the price of few cuts.

Defined results: a null or empty text is a document of its end id alone. Rows
are packed one by one, so repeated rows and null ids give pieces of their own. An
empty table gives no sequences. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tokens import encoder, text_slices

#: Open windows of a task before they are closed by cutting.
OPEN = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: A piece: (doc_id, start, ids, tokens of the document).
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Windows of one task; closed sequences are handed to ``emit`` as lists of pieces."""

    def __init__(self, capacity: int, emit: Callable[[list[Piece]], None], most_open: int = OPEN):
        self.capacity, self.emit, self.most_open = capacity, emit, most_open
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.windows: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level that keeps the sum of squares smallest."""
        levels, top = self.levels, self.capacity - size
        cost = 2 * (levels[size:] - levels[: top + 1]) + 2
        cost[0] = 2 * levels[size] + 1  # a new window
        cost[top] = 1 - 2 * levels[top] if top else 0  # the window is complete
        cost[1:][levels[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self.emit([(doc_id, at, ids[at : at + self.capacity], n)])
            at += self.capacity
        if at == n:
            return
        size = n - at
        h = self.level_for(size)
        window = self.windows[h].pop() if h else []
        if h:
            self.levels[h] -= 1
            self.open -= 1
        window.append((doc_id, at, ids[at:].copy(), n))
        if h + size == self.capacity:
            self.emit(window)
        else:
            self.levels[h + size] += 1
            self.windows.setdefault(h + size, []).append(window)
            self.open += 1
            if self.open > self.most_open:
                self.close()

    def close(self) -> None:
        """Complete all open windows without padding."""
        left = [(h, w) for h in sorted(self.windows, reverse=True) for w in self.windows[h]]
        self.windows, self.open = {}, 0
        self.levels[:] = 0
        i, j = 0, len(left) - 1
        while i < j:
            fill, window = left[i]
            while fill < self.capacity and i < j:
                low, donor = left[j]
                doc_id, at, ids, n = donor.pop()
                room = self.capacity - fill
                if len(ids) > room:
                    donor.append((doc_id, at + room, ids[room:], n))
                    ids = ids[:room]
                window.append((doc_id, at, ids, n))
                fill += len(ids)
                left[j] = (low - len(ids), donor)
                if not donor:
                    j -= 1
            left[i] = (fill, window)
            if fill == self.capacity:
                self.emit(window)
                i += 1
        if i == j and left[i][1]:
            self._powers(left[i][1])

    def _powers(self, pieces: list[Piece]) -> None:
        """The last rest, as sequences whose lengths are powers of two."""
        rest = sum(len(p[2]) for p in pieces)
        pieces = pieces[::-1]
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            out: list[Piece] = []
            while room:
                doc_id, at, ids, n = pieces.pop()
                if len(ids) > room:
                    pieces.append((doc_id, at + room, ids[room:], n))
                    ids = ids[:room]
                out.append((doc_id, at, ids, n))
                room -= len(ids)
            self.emit(out)


def _pack(tokenizer: str, end_id: int, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        enc = encoder(tokenizer)
        rows: list[tuple] = []
        count = 0

        def emit(window: list[Piece]) -> None:
            nonlocal count
            offset = 0
            for doc_id, at, ids, n in window:
                rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), n, first + count, offset))
                offset += len(ids)
            count += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in SCHEMA.split(", ")])
            rows.clear()
            return out

        packer = Packer(capacity, emit)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            for lo, hi in text_slices(texts):
                ids, at = enc.flat(texts.slice(lo, hi - lo), end_id)
                for doc_id, part in zip(doc_ids[lo:hi], np.split(ids.astype("<u4"), at[1:-1])):
                    packer.add(doc_id, part)
                if len(rows) > 20_000:
                    yield flush()
        packer.close()
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 0, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: document, place in it, crc32 of its ids, sequence and place in that (see ``SCHEMA``).

    ``tokenizer`` is the path of a tokenizers file that every executor can read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_pack(tokenizer, end_id, capacity), SCHEMA)
