"""Secret scan with corpus-wide ownership frequency.

Method: every text is searched for candidates; the 128-bit hash of each candidate's
value is counted over the whole corpus by distinct owners and distinct
repositories (pairs of owner and repository). A value is a copied example if ``widely``
owners hold it, or two owners at least and ``many`` repositories; any other looks like a
live credential of its owner, in however many of that owner's repositories it stands.

Kinds of spans, in this order: ``assign``, ``access`` and ``hex`` are the base
kinds and always reported; ``key`` is a run of 24 or more letters, digits, ``_`` and
``-`` with an upper-case letter, a lower-case letter and two digits that touches
no base span, reported only where its value looks live.

Counts are pre-aggregated before each shuffle; verdicts return to the rows by a
join on the hash (broadcast only below a counted size, else a join whose skewed
hashes adaptive execution splits), then once by row.

Defined results: null and empty texts have no spans. A null owner or repository
counts as ''. Repeated rows give repeated result rows. Offsets are code points,
end exclusive. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.shared import Scratch, small_side

KINDS = ("assign", "access", "hex", "key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEY = re.compile(r"[A-Za-z0-9_-]{24,}")
_MIXED = re.compile(r"(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9].*[0-9])", re.S)
BROADCAST_ROWS = 400_000

#: A candidate: (start, number of its kind, end, value).
Candidate = tuple[int, int, int, str]


def candidates(text: str) -> list[Candidate]:
    """Candidates of a text by start, then kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    starts = sorted(s for s, _, _, _ in out)
    ends = list(accumulate((e for _, e in sorted((s, e) for s, _, e, _ in out)), max))
    for m in _KEY.finditer(text):
        before = bisect_left(starts, m.end())
        if _MIXED.match(m[0]) and not (before and ends[before - 1] > m.start()):
            out.append((m.start(), 3, m.end(), m[0]))
    return sorted(out)


def _joined(found: list[Candidate]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found)


_FOUND = "array<struct<s:long,k:int,e:long,hash:binary>>"


def _search(names: list[str], texts_at: int) -> Callable:
    kind = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64()), ("hash", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, base = [], []
            for text in batch.column(texts_at).to_pylist():
                got = candidates(text or "")
                base.append(hashlib.sha256(_joined([c for c in got if c[1] < 3]).encode()).hexdigest())
                found.append([{"s": s, "k": k, "e": e, "hash": hashlib.blake2b(v.encode(), digest_size=16).digest()} for s, k, e, v in got])
            keep = [batch.column(i) for i in range(batch.num_columns) if i != texts_at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(base), pa.array(found, kind)], names=[*names, "base_sha256", "found"])

    return run


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", widely: int = 3, many: int = 10) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, owners_repos, text_hash, found.

    ``found`` holds the reported spans as array<struct<s, k, e, live, owners, repos>>, ``owners_repos`` the two
    counts of each as owners:repositories, comma-joined; ``text_hash`` is xxhash64 of the text.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.col(text_col).cast("string")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), name(owner_col).alias("owner"), name(repo_col).alias("repo"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    names = ["doc_id", "owner", "repo", "text_hash"]
    found = rows.mapInArrow(_search(names, 4), f"doc_id long, owner string, repo string, text_hash long, base_sha256 string, found {_FOUND}")
    found = scratch.write(found.withColumn("row", F.monotonically_increasing_id()), "found")

    one = found.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("c")).select("row", "owner", "repo", "c.*")
    owners = one.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    live = (F.col("owners") < widely) & ((F.col("owners") < 2) | (F.col("repos") < many))
    owners = scratch.write(owners.select("hash", live.alias("live"), "owners", "repos"), "owners")
    judged = one.select("row", "s", "k", "e", "hash").join(small_side(owners, owners.count(), BROADCAST_ROWS), "hash")
    judged = judged.where("k < 3 OR live").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e", "live", "owners", "repos"))).alias("found"))
    judged = scratch.write(judged, "judged")
    some = found.drop("found", "owner", "repo").join(small_side(judged, _spans(judged, "found"), BROADCAST_ROWS), "row", "left")
    some = some.withColumn("found", F.coalesce("found", F.array().cast("array<struct<s:long,k:int,e:long,live:boolean,owners:long,repos:long>>")))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform("found", lambda c: F.concat_ws(":", kinds[c["k"]], c["s"], c["e"])), ",")
    counts = F.array_join(F.transform("found", lambda c: F.concat_ws(":", c["owners"], c["repos"])), ",")
    count = lambda test: F.size(F.filter("found", test)).cast("long")

    def of_kind(k: int) -> Callable:
        return lambda c: c["k"] == k

    return some.select(
        "doc_id", *[count(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)], "base_sha256", spans.alias("spans"), count(lambda c: c["live"]).alias("n_live"), count(lambda c: ~c["live"]).alias("n_example"), counts.alias("owners_repos"), "text_hash", "found"
    )


def _spans(rows: DataFrame, column: str) -> int:
    """Spans in all rows; every row has one at least."""
    return rows.agg(F.sum(F.size(column))).first()[0] or 0


def _redact(texts_at: int, found_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(texts_at).to_pylist(), batch.column(found_at).to_pylist()):
                if not found:
                    out.append(text)
                    continue
                parts, at = [], 0
                for c in found:
                    if c["s"] >= at:
                        parts += [text[at : c["s"]], "[SECRET]" if c["live"] else "[EXAMPLE_SECRET]"]
                    at = max(at, c["e"])
                out.append("".join([*parts, text[at:]]))
            columns = [pa.array(out, pa.string()) if i == texts_at else batch.column(i) for i in range(batch.num_columns) if i != found_at]
            yield pa.RecordBatch.from_arrays(columns, names=[n for i, n in enumerate(batch.schema.names) if i != found_at])

    return run


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every reported span replaced by ``[SECRET]``, or ``[EXAMPLE_SECRET]`` for widely copied values; overlapping spans become one."""
    scratch = Scratch(docs.sparkSession, "redact")
    own = [f"_{uuid.uuid4().hex[:12]}_{c}" for c in ("id", "hash", "found")]
    hits = secrets(docs, id_col=id_col, text_col=text_col, **options).where(F.size("found") > 0)
    hits = hits.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "text_hash", "found"), own)])
    hits = scratch.write(hits.dropDuplicates(own[:2]), "hits")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own[0])) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(own[1]))
    joined = docs.join(small_side(hits, _spans(hits, own[2]), BROADCAST_ROWS), same, "left").select(*docs.columns, own[2])
    return joined.mapInArrow(_redact(docs.columns.index(text_col), len(docs.columns)), docs.schema)
