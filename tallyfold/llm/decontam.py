"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Method: every window of ``window`` item words is a pattern (an item of fewer
words is one pattern). Patterns of similar length form a class with tables of its
own: a shift table over hashed blocks of two words tells how far the search may jump,
the block that ends a pattern's first m words and the one that begins it lead to a
bucket of patterns, and a direct comparison confirms an occurrence. The symbols are
words rather than bytes, since windows begin and end at words; words of items are
numbered, and a word of no item lets the search jump over it. Tables are arrays of
about 40 bytes for each item word, and 200 for each distinct one.

Items of equal text are put together by Spark, and travel to the executors as a
broadcast of at most about ``block_bytes`` (an item longer than that is a block); a
larger benchmark is searched block by block over all rows and the hits are put
together by row.

Defined results: null or empty texts have no words and no hits. Items without
words are no pattern; an item without id counts as ''. Items of one id count once.
Repeated rows give repeated result rows; empty tables give no rows (documents) or
no hits (items). Long texts are read in pieces that overlap by a pattern.
"""

from __future__ import annotations

import re
import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.shared import Scratch
from tallyfold.llm.wordhash import mix

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_PIECE = 1 << 22
#: Bytes of benchmark text and ids in one broadcast.
BLOCK_BYTES = 4 << 20
SCHEMA = "row long, doc_id long, n_words long, spans array<struct<s:long,e:long>>, items array<string>"


def item_words(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters and anything beyond ASCII, A-Z lower-cased."""
    return _WORD.findall((text or "").encode().lower())


_SPREAD = 0x9E3779B1


class WuManber:
    """Search for windows of numbered words.

    ``flat`` holds the words of all texts, ``begin`` and ``size`` say where each pattern
    stands in it and ``owner`` the number of its text; equal patterns are one.
    """

    def __init__(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray):
        self.m, self.longest = int(size.min()), int(size.max())
        self.block = min(2, self.m)
        self.far = self.m - self.block + 1
        self.mask = (1 << max(8, (8 * len(begin) - 1).bit_length())) - 1
        h = size.astype(np.uint64)
        for k in range(self.longest):
            at = np.minimum(begin + k, len(flat) - 1)
            h = np.where(k < size, mix(h + flat[at].astype(np.uint64) + np.uint64(1)), h)
        order = np.lexsort((owner, h))
        begin, size, owner, h = begin[order], size[order], owner[order], h[order]
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (size[1:] == size[:-1])
        for k in range(self.longest):
            both = np.flatnonzero(same & (k < size))
            same[both] = flat[begin[both] + k] == flat[begin[both - 1] + k]
        first = np.flatnonzero(~same)
        bounds = np.append(first, len(h))
        begin, size = begin[first], size[first]
        shift = np.full(self.mask + 1, self.far, dtype=np.uint8 if self.far < 256 else np.int64)
        for q in range(self.block, self.m + 1):
            np.minimum.at(shift, self._keys(flat, begin + q), self.m - q)
        bucket = (self._keys(flat, begin + self.m) << 32) | self._keys(flat, begin + self.block)
        order = np.argsort(bucket, kind="stable")
        self.shift = shift.tobytes() if shift.dtype == np.uint8 else shift.tolist()
        self.flat, self.bucket = array("i", flat.tobytes()), array("q", bucket[order].tobytes())
        self.begin, self.size = array("q", begin[order].astype(np.int64).tobytes()), array("q", size[order].astype(np.int64).tobytes())
        self.owners = array("i", owner.astype(np.int32).tobytes())
        self.of = array("q", bounds[:-1][order].astype(np.int64).tobytes()), array("q", bounds[1:][order].astype(np.int64).tobytes())

    def _keys(self, flat: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the blocks that end before the places ``end``."""
        last = flat[end - 1].astype(np.int64)
        return (last if self.block == 1 else flat[end - 2].astype(np.int64) * _SPREAD + last) & self.mask

    def search(self, words: array, base: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Append the occurrences in ``words``, whose first has the number ``base``; -1 is a word of no item."""
        shift, two, mask, m, n = self.shift, self.block == 2, self.mask, self.m, len(words)
        i = m
        while i <= n:
            b = words[i - 1]
            if b < 0:
                i += m
                continue
            if two:
                a = words[i - 2]
                if a < 0:
                    i += m - 1
                    continue
                b = (a * _SPREAD + b) & mask
            else:
                b &= mask
            jump = shift[b]
            if jump:
                i += jump
                continue
            self._compare(words, i - m, b, base, spans, found)
            i += 1

    def _compare(self, words: array, at: int, last: int, base: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        head = words[at + self.block - 1] if self.block == 1 else words[at] * _SPREAD + words[at + 1]
        key = (last << 32) | (head & self.mask)
        for p in range(bisect_left(self.bucket, key), bisect_right(self.bucket, key)):
            size, begin = self.size[p], self.begin[p]
            if words[at : at + size] == self.flat[begin : begin + size]:
                if spans and spans[-1][0] <= base + at <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], base + at + size))
                else:
                    spans.append((base + at, base + at + size))
                found.update(self.owners[self.of[0][p] : self.of[1][p]])


class Searches:
    """The numbers of all words of a block of items, given as (ids, text), and a search for each class of pattern lengths."""

    def __init__(self, items: list[tuple[list[str], str]], window: int):
        self.number: dict[bytes, int] = {}
        self.ids = [ids for ids, _ in items]
        flat, classes = array("i"), ([], [], [])
        for k, (_, text) in enumerate(items):
            words = item_words(text)
            if not words:
                continue
            size = min(window, len(words))
            group = 0 if size == window else 1 if size > 3 else 2
            n = len(words) - size + 1
            classes[group].append((len(flat), n, size, k))
            flat.extend([self.number.setdefault(w, len(self.number)) for w in words])
        whole = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)
        self.classes = []
        for c in filter(None, classes):
            n = np.array([x[1] for x in c])
            begin = np.concatenate([np.arange(at, at + k) for at, k, _, _ in c])
            self.classes.append(WuManber(whole, begin, np.repeat([x[2] for x in c], n), np.repeat([x[3] for x in c], n)))
        self.keep = max((s.longest for s in self.classes), default=1) - 1


_BUILT: dict[str, Searches] = {}


def _tables(key: str, items: Broadcast, window: int) -> Searches:
    """The tables of one block, built once for each Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Searches(items.value, window)
    return _BUILT[key]


def _pieces(data: bytes) -> Iterator[bytes]:
    """Pieces of a lower-cased text that end between words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and _WORD.match(data, end, end + 1):
            end += 1
        yield data[at:end]
        at = end


def scan(data: bytes, searches: Searches) -> tuple[int, list[tuple[int, int]], list[str]]:
    """(number of words, spans of hit words, items) of one text as UTF-8."""
    spans: list[tuple[int, int]] = []
    found: set[int] = set()
    n, tail, number = 0, array("i"), searches.number.get
    for piece in _pieces(data.lower()):
        words = tail + array("i", map(number, _WORD.findall(piece), repeat(-1)))
        for s in searches.classes:
            s.search(words, n - len(tail), spans, found)
        n += len(words) - len(tail)
        tail = words[len(words) - min(searches.keep, len(words)) :]
    return n, spans, sorted({i for k in found for i in searches.ids[k]})


def _scan(key: str, items: Broadcast, window: int, hits_only: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _tables(key, items, window)
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for batch in batches:
            got = [scan(x or b"", searches) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            spans = pa.array([[{"s": s, "e": e} for s, e in g[1]] for g in got], kind)
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.int64()), spans, pa.array([g[2] for g in got], pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "spans", "items"],
            )
            yield out.filter(pa.array([bool(g[1]) for g in got])) if hits_only else out

    return run


def _covered(spans: Column) -> Column:
    """Words in any of the spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to"))
    return F.aggregate(F.array_sort(spans), start, step)["n"]


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(ids, text, bytes) of all items, those of equal text together, and the number of blocks they need."""
    tests = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")).where("text <> ''").distinct()
    tests = tests.groupBy("text").agg(F.sort_array(F.collect_list("item")).alias("ids"), (F.sum(F.octet_length("item") + 8) + F.first(F.octet_length("text"))).alias("bytes"))
    tests = Scratch(items.sparkSession, "benchmark").write(tests.select("ids", "text", "bytes"), "items")
    total, largest = tests.agg(F.sum("bytes"), F.max("bytes")).first()
    blocks = 1 + (total or 0) // block_bytes
    while blocks > 1:
        most = tests.groupBy(_block(blocks)).agg(F.sum("bytes").alias("n")).agg(F.max("n")).first()[0]
        if most <= max(2 * block_bytes, largest):
            break
        blocks *= 2
    return tests, blocks


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(blocks))


def _held(tests: DataFrame, blocks: int, k: int) -> tuple[str, Broadcast]:
    """Block ``k`` of the items as a broadcast, with a name of its own."""
    part = tests.where(_block(blocks) == k).select("ids", "text")
    return uuid.uuid4().hex, tests.sparkSession.sparkContext.broadcast([(r.ids, r.text) for r in part.collect()])


def contamination(
    docs: DataFrame, items: DataFrame, *, window: int = 10, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of word numbers), items."""
    spark = docs.sparkSession
    texts = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tests, blocks = _blocks(items, item_col, item_text_col, block_bytes)

    def searched(rows: DataFrame, k: int, hits_only: bool) -> DataFrame:
        return rows.mapInArrow(_scan(*_held(tests, blocks, k), window, hits_only), SCHEMA)

    if blocks == 1:
        out = searched(texts, 0, False)
    else:
        scratch = Scratch(spark, "decontam")
        numbered = scratch.write(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
        hits = None
        for k in range(blocks):
            part = scratch.write(searched(numbered, k, k > 0), f"block{k}")
            hits = part if hits is None else hits.union(part)
        out = hits.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = _covered(F.col("spans"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans", "items"
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, *, window: int = 10, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs, all columns as they are."""
    at = docs.columns.index(text_col)

    def clean(key: str, held: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = _tables(key, held, window)
            for batch in batches:
                yield batch.filter(pa.array([not scan(x or b"", searches)[1] for x in batch.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

        return run

    tests, blocks = _blocks(items, item_col, item_text_col, block_bytes)
    scratch = Scratch(docs.sparkSession, "decontam")
    for k in range(blocks):
        key, held = _held(tests, blocks, k)
        docs = docs.mapInArrow(clean(key, held), docs.schema)
        if k + 1 < blocks:
            docs = scratch.write(docs, f"clean{k}")
    return docs
