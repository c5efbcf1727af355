"""Token counts by section: whole texts are encoded once and their tokens attributed through their offsets.

Method: a text is encoded whole by byte-level BPE ranks, so token k spans the bytes
from the sum of the lengths of the tokens before it. Sections are given as
boundaries in the same bytes; the interval join of tokens and sections is a binary
search of token starts and ends in the boundaries. A token inside one section
belongs to it. A token that crosses boundaries is allocated by rule:

* ``first``: to the section of its first byte;
* ``most``: to the section that holds most of its bytes, the earliest on a tie;
* ``share``: to every section it touches, in proportion to its bytes there.

The counts of a text's sections add up to its tokens under every rule. By default
the sections of a text are its lines, each with its line break.

Several columns ("fields") are counted as one text joined by ``joint``, a field
being a section that holds the joint after it.

Defined results: a null or empty text has one section, empty, with no tokens. Rows
are counted one by one, so repeated rows and null ids give rows of their own. An
empty table gives no rows. Columns not named are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "most", "share")
#: Bytes of one piece of a very long text; pieces end where no word crosses.
PIECE = 1 << 22
#: Sections handed on at once.
ROWS = 50_000


@cache
def _encoding(ranks_path: str, pattern: str):
    """(encoding, bytes of each token) of a file of base64 tokens and ranks."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_ends(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    """The byte after each token of a text."""
    encoding, sizes = _encoding(ranks_path, pattern)
    ids: list[int] = []
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            # a piece may end before a single space between visible characters: words keep the space before them
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and not text[end + 1 : end + 2].isspace()):
                end += 1
        ids += encoding.encode_ordinary(text[at:end])
        at = end
    return np.cumsum(sizes[np.array(ids, np.int64)])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; section i spans the bytes from ``bounds[i]`` to before ``bounds[i + 1]``."""
    n = len(bounds) - 1
    if not len(ends) or not n:
        return np.zeros(n)
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    out = np.bincount(first[first == last], minlength=n).astype(float)
    for t in np.flatnonzero(first != last):
        touched = np.arange(first[t], last[t] + 1)
        held = np.minimum(bounds[touched + 1], ends[t]) - np.maximum(bounds[touched], starts[t])
        if rule == "first":
            out[touched[0]] += 1
        elif rule == "most":
            out[touched[int(np.argmax(held))]] += 1
        else:
            out[touched] += held / held.sum()
    return out


def line_bounds(data: bytes) -> np.ndarray:
    """Byte boundaries of lines, each with its line break; one empty section for no bytes."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], breaks, [len(data)]])) if data else np.zeros(2, np.int64)


def field_bounds(parts: list[str], joint: str) -> np.ndarray:
    """Byte boundaries of joined fields."""
    extra = len(joint.encode())
    sizes = [len(p.encode()) + (extra if i + 1 < len(parts) else 0) for i, p in enumerate(parts)]
    return np.concatenate([[0], np.cumsum(sizes)])


def _count(fields: list[str] | None, ranks_path: str, pattern: str, rule: str, joint: str) -> Callable:
    names = ["doc_id", "section", "start_byte", "end_byte", "n_tokens", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list] = [[] for _ in names]
            ids, columns = batch.column(0).to_pylist(), [c.to_pylist() for c in batch.columns[1:]]
            for doc_id, *parts in zip(ids, *columns):
                parts = [p or "" for p in parts]
                text = parts[0] if fields is None else joint.join(parts)
                bounds = line_bounds(text.encode()) if fields is None else field_bounds(parts, joint)
                ends = token_ends(text, ranks_path, pattern)
                n = len(bounds) - 1
                for put, values in zip(held, ([doc_id] * n, range(n) if fields is None else fields, bounds[:-1].tolist(), bounds[1:].tolist(), attribute(ends, bounds, rule).tolist(), [len(ends)] * n)):
                    put.extend(values)
                if len(held[0]) > ROWS:
                    yield _batch(held, names, fields)
                    held = [[] for _ in names]
            if held[0]:
                yield _batch(held, names, fields)

    return run


def _batch(held: list[list], names: list[str], fields: list[str] | None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64() if fields is None else pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(held, kinds)], names=names)


def section_tokens(docs: DataFrame, *, ranks_path: str, pattern: str, rule: str = "most", id_col: str = "doc_id", text_col: str = "text", fields: list[str] | None = None, joint: str = "\n") -> DataFrame:
    """One row per section: doc_id, section (number of the line, or name of the field), start_byte, end_byte, n_tokens, doc_tokens.

    ``n_tokens`` is a double, whole numbers unless the rule is ``share``.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; known: {', '.join(RULES)}")
    columns = [F.col(c).cast("string") for c in (fields or [text_col])]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(f"_{i}") for i, c in enumerate(columns)])
    kind = "long" if fields is None else "string"
    return rows.mapInArrow(_count(fields, ranks_path, pattern, rule, joint), f"doc_id long, section {kind}, start_byte long, end_byte long, n_tokens double, doc_tokens long")
