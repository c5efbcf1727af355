"""Static range asymmetric numeral system for token ids: blocks of interleaved lanes over one shared frequency table.

A block holds up to ``BLOCK`` tokens in ``LANES`` lanes (token i in lane i mod
LANES) with a 64-bit state each, renormalised by 32-bit words. Blocks are
independent, so any range of them can be decoded alone; here many are coded at
once, one vector step for a token of every lane.

A file is: magic, table, blocks, footer, trailer, and needs nothing else to be decoded.
The table (zlib) lists symbols and frequencies. A block is its lanes' final states
followed by its words. The footer (zlib) holds the crc32 and length of the table, lists
the documents (id, null flag, number of tokens) and for each block its offset (the
checkpoint), tokens, words, crc32 as stored and crc32 of the decoded ids. The trailer
has the footer's length and crc32. Vocabularies of up to 2^19 symbols fit.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BITS = 20
LANES = 64
BLOCK = 16_384
#: Blocks coded at once.
GROUP = 64
MAGIC = b"tokrans2"
_LOW = np.uint64(1 << 31)
_W = np.uint64(32)
_B = np.uint64(BITS)


class Table:
    """Frequencies of symbols, scaled to a sum of 2^BITS with at least 1 each."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, counts = np.asarray(symbols)[order].astype(np.uint32), np.asarray(counts)[order].astype(float)
        if len(self.symbols) > 1 << (BITS - 1):
            raise ValueError(f"{len(self.symbols)} symbols are too many for a table of {1 << BITS}")
        freq = np.ones(0, np.int64)
        if len(counts):
            room = (1 << BITS) - len(counts)
            freq = 1 + np.floor(counts / counts.sum() * room).astype(np.int64)
            freq[np.argmax(freq)] += (1 << BITS) - freq.sum()
        self._scaled(freq)

    def _scaled(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.place = np.full(int(self.symbols.max(initial=0)) + 1, -1, dtype=np.int32)
        self.place[self.symbols] = np.arange(len(freq))

    def to_bytes(self) -> bytes:
        steps = np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4")
        return zlib.compress(struct.pack("<I", len(steps)) + steps.tobytes() + self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        data = zlib.decompress(data)
        (n,) = struct.unpack_from("<I", data)
        out = cls.__new__(cls)
        out.symbols = np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.uint32)
        freq = np.frombuffer(data, "<u4", n, 4 + 4 * n).astype(np.int64)
        if n and freq.sum() != 1 << BITS:
            raise ValueError("the frequency table is damaged")
        out._scaled(freq)
        return out

    def index(self, ids: np.ndarray) -> np.ndarray:
        """Place of each id in the table."""
        at = self.place[np.minimum(ids, len(self.place) - 1)]
        if len(ids) and (ids.max() >= len(self.place) or at.min() < 0):
            raise ValueError("a token is missing from the frequency table")
        return at


def encode_blocks(ids: np.ndarray, table: Table) -> list[tuple[bytes, int, int, int]]:
    """(bytes, tokens, words, crc32 of the ids) of each block of ``ids``."""
    out = []
    for lo in range(0, len(ids), BLOCK * GROUP):
        part = ids[lo : lo + BLOCK * GROUP].astype("<u4")
        n = -(-len(part) // BLOCK)
        at = np.zeros(n * BLOCK, dtype=np.int32)
        at[: len(part)] = table.index(part)
        at = at.reshape(n, BLOCK // LANES, LANES)
        steps = at.shape[1] if n > 1 else -(-len(part) // LANES)
        x = np.full((n, LANES), _LOW)
        words, sent = np.zeros((n, steps, LANES), dtype=np.uint32), np.zeros((n, steps, LANES), dtype=bool)
        for t in range(steps - 1, -1, -1):
            f, c = table.freq[at[:, t]], table.cum[at[:, t]]
            full = x >= f << np.uint64(63 - BITS)
            words[:, t], sent[:, t] = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), full
            x = np.where(full, x >> _W, x)
            q = x // f
            x = (q << _B) + (x - q * f) + c
        for b in range(n):
            w = words[b][sent[b]]
            tokens = part[b * BLOCK : (b + 1) * BLOCK]
            out.append((x[b].astype("<u8").tobytes() + w.astype("<u4").tobytes(), len(tokens), len(w), zlib.crc32(tokens.tobytes())))
    return out


def decode_blocks(blocks: list[tuple[bytes, int, int]], table: Table) -> list[np.ndarray]:
    """Ids of blocks given as (bytes, tokens, words)."""
    n = len(blocks)
    x = np.stack([np.frombuffer(b, "<u8", LANES) for b, _, _ in blocks]).astype(np.uint64)
    words = np.concatenate([*[np.frombuffer(b, "<u4", w, LANES * 8) for b, _, w in blocks], np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.cumsum([0, *[w for _, _, w in blocks[:-1]]])[:, None]
    steps = -(-max(t for _, t, _ in blocks) // LANES)
    left = np.array([-(-t // LANES) for _, t, _ in blocks])
    out = np.empty((n, steps, LANES), dtype=np.uint32)
    for t in range(steps):
        slot = x & np.uint64((1 << BITS) - 1)
        s = table.slot[slot]
        out[:, t] = s
        x = table.freq[s] * (x >> _B) + slot - table.cum[s]
        need = (x < _LOW) & (left > t)[:, None]
        count = np.cumsum(need, axis=1)
        got = words[np.minimum(at + count - 1, len(words) - 1)]
        x = np.where(need, (x << _W) | got, x)
        at = at + count[:, -1:]
    return [table.symbols[out[b].reshape(-1)[: blocks[b][1]]] for b in range(n)]


class Writer:
    """One file; documents come in order."""

    def __init__(self, sink, table: Table):
        packed = table.to_bytes()
        self.sink, self.table, self.at = sink, table, len(MAGIC) + len(packed)
        self.head = struct.pack("<QI", len(packed), zlib.crc32(packed))
        sink.write(MAGIC + packed)
        self.docs: list[tuple[int | None, int]] = []
        self.blocks: list[tuple[int, int, int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK * GROUP:
            whole = np.concatenate(self.held)
            cut = len(whole) // BLOCK * BLOCK
            self._put(whole[:cut])
            self.held, self.size = [whole[cut:]], len(whole) - cut

    def _put(self, ids: np.ndarray) -> None:
        for data, tokens, words, crc in encode_blocks(ids, self.table):
            self.blocks.append((self.at, tokens, words, zlib.crc32(data), crc))
            self.sink.write(data)
            self.at += len(data)

    def close(self) -> None:
        if self.size:
            self._put(np.concatenate(self.held))
        ids = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        none = np.array([d is None for d, _ in self.docs], np.uint8).tobytes()
        sizes = np.array([n for _, n in self.docs], "<i8").tobytes()
        footer = zlib.compress(self.head + struct.pack("<QQ", len(self.docs), len(self.blocks)) + ids + none + sizes + np.array(self.blocks, "<u8").tobytes(), 1)
        self.sink.write(footer + struct.pack("<QI", len(footer), zlib.crc32(footer)) + MAGIC)
        self.sink.close()


def write_file(sink, docs: list[tuple[int | None, np.ndarray]]) -> None:
    """A file of documents (id, token ids) with the frequencies of their tokens as its table."""
    symbols, counts = np.unique(np.concatenate([np.zeros(0, np.uint32), *[ids for _, ids in docs]]), return_counts=True)
    writer = Writer(sink, Table(symbols, counts))
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()


class Reader:
    """Documents and blocks of one file; every checksum is verified."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        length, crc, magic = struct.unpack("<QI8s", self._read(size - 20, 20))
        footer = self._read(size - 20 - length, length) if magic == MAGIC else b""
        if magic != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError("the footer is damaged")
        data = zlib.decompress(footer)
        length, crc, n, m = struct.unpack_from("<QIQQ", data)
        table, at = self._read(len(MAGIC), length), struct.calcsize("<QIQQ")
        if zlib.crc32(table) != crc:
            raise ValueError("the frequency table is damaged")
        self.table = Table.from_bytes(table)
        self.ids = np.frombuffer(data, "<i8", n, at)
        self.none = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        self.sizes = np.frombuffer(data, "<i8", n, at + 9 * n)
        self.blocks = np.frombuffer(data, "<u8", 5 * m, at + 17 * n).reshape(m, 5)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Ids of the blocks from ``lo`` to before ``hi``."""
        got = []
        for at, tokens, words, crc, _ in self.blocks[lo:hi].tolist():
            data = self._read(at, LANES * 8 + 4 * words)
            if zlib.crc32(data) != crc:
                raise ValueError(f"the block at {at} is damaged")
            got.append((data, tokens, words))
        parts = decode_blocks(got, self.table) if got else []
        for ids, b in zip(parts, self.blocks[lo:hi].tolist()):
            if zlib.crc32(ids.astype("<u4").tobytes()) != b[4]:
                raise ValueError(f"the block at {b[0]} does not decode")
        return np.concatenate([np.zeros(0, np.uint32), *parts])

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(id, tokens, crc32 of its ids) of each document in order."""
        held, block = np.zeros(0, np.uint32), 0
        for doc_id, none, n in zip(self.ids.tolist(), self.none.tolist(), self.sizes.tolist()):
            crc, left = 0, n
            while left:
                if not len(held):
                    held = self.read(block, block + GROUP)
                    block += GROUP
                take, held = held[:left], held[left:]
                crc, left = zlib.crc32(take.astype("<u4").tobytes(), crc), left - len(take)
            yield None if none else doc_id, n, crc
