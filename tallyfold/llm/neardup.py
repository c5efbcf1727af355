"""MinHash near-duplicates through a multi-index Hamming join, confirmed on full shingle sets.

Method
------
1. Every text becomes its set of word shingles (64-bit hashes), a 128-bit
   identity of that set and a signature of 4 m symbols of 16 bits, each the low
   bits of one MinHash. Rows with equal sets form one class from here on.
2. A signature is split into m chunks of four symbols (one long each). Two
   signatures that differ in at most 2 m - 1 symbols have a chunk with at most
   one differing symbol (pigeonhole), so they share one of the 4 m keys "chunk
   without its symbol j". m is the smallest number for which a pair at the
   similarity threshold exceeds 2 m - 1 differing symbols with a probability of
   at most ``miss``.
3. Linear rounds: a bucket's head is one of its classes, first the most central one (in the
   most populous buckets), then the first in another order for each round. A class is
   compared with some heads of its buckets that are in another component, those it
   shares most keys with and those of its smallest buckets; confirmed links give
   components. Only buckets that still hold several components go on to the next round.
4. Rest, without regard to heads: a shingle that no class of another component in an open bucket
   has is a class's own. A class stays in a bucket only if the shingles that are not
   its own could reach the threshold with a partner that has as few own shingles as any
   there (an exact bound); with each class that leaves, more shingles become own, so this
   is done again while it helps. What is left is put into bins by size and share of own
   shingles, and rows outside a bucket's largest component meet rows of other components,
   block by block, in those pairs of bins whose ranges allow the threshold; a pair leaves its
   block only if it is within the signature distance and two exact bounds on the common
   shingles (own ones, and a bit for each shingle) allow the threshold. So no link
   between two components is lost, members of a large group of near copies that are
   linked already do not meet again, and documents that share a passage alone do not meet.

Rows never meet in one task: buckets are joined by key (skewed keys are split by
adaptive execution), sums are pre-aggregated, and intermediate tables live in
the shared folder. The driver plans and keeps every query of a run, so tables are
counted while they are written and steps without pairs are left out.

Defined results: null and empty texts and texts of white space alone have no
shingle and are linked with nothing (``component_id`` is their own id). A row
without id takes part in links; ``component_id`` is the smallest id that is not
null, or null. Repeated rows give repeated result rows. An empty table gives an
empty result. Columns besides id and text are neither read nor returned.
``one_of_each`` keeps rows: of each component that with the smallest id (null last), of
several texts under that id the one with the smallest hash, of equal rows one; every
row whose text has no shingle stays.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm import wordhash as wh
from tallyfold.llm.shared import Scratch, small_side

_SYMBOLS = 4
#: Numbers that give the second and later rounds an order of their own.
_ORDERS = wh.mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)).view(np.int64).tolist()
#: Tables of at most so many narrow rows may be broadcast.
BROADCAST_ROWS = 400_000
#: Bits of one set at most; sets beyond a quarter of it get a looser bound, never a wrong one.
BITS = 1 << 17
#: Rows of a block in which members of one bucket meet.
MEET = 128
#: Linear rounds, heads of each kind that a class is compared with in one, and pairs of one head that meet its set together.
ROUNDS = 2
HEADS = 2
SPREAD = 512
#: Times that classes are taken out of buckets by their own shingles, at most.
PASSES = 3


def chunk_count(percent: int, miss: float) -> int:
    """Chunks m for which a pair of similarity ``percent``/100 differs in 2 m or more of 4 m symbols with a probability of at most ``miss``."""
    p = 1 - percent / 100
    for m in range(2, 64):
        n = _SYMBOLS * m
        tail = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(2 * m, n + 1))
        if tail <= miss:
            return m
    raise ValueError(f"a similarity of {percent} % is too low for this index")


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, row after the last, sorted distinct shingle hashes of each row)."""
    odd = wh.mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    for lo, hi, data, offs in wh.slices(column):
        start, end, row = wh.words(data, offs, wh.WHITE)
        h = wh.word_hashes(data, start, end)[0]
        per_row = np.bincount(row, minlength=hi - lo)
        n = max(0, len(h) - size + 1)
        whole = row[:n] == row[len(row) - n :]
        sums = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            sums += h[k : k + n] * odd[k]
        sums, of = wh.mix(sums[whole]), row[:n][whole]
        cuts = np.searchsorted(of, np.arange(hi - lo + 1))
        first = np.cumsum(per_row) - per_row
        out = []
        for i in range(hi - lo):
            w = per_row[i]
            if 0 < w < size:
                own = h[first[i] : first[i] + w]
                out.append(wh.mix((own * odd[:w]).sum(dtype=np.uint64, keepdims=True) + np.uint64(w)))
            else:
                out.append(np.unique(sums[cuts[i] : cuts[i + 1]]))
        yield lo, hi, out


def _identity(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _bits(s: np.ndarray) -> bytes:
    """A bit for each shingle of a set, at its hash modulo the power of two from 4 to 8 times the set's size, from 64 to ``BITS``."""
    size = min(BITS, max(64, 1 << (4 * max(1, len(s)) - 1).bit_length()))
    out = np.zeros(size, dtype=bool)
    out[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def most_common(x: list[bytes], nx: np.ndarray, y: list[bytes], ny: np.ndarray) -> np.ndarray:
    """For pairs of sets given by bits and size: a bound that the number of common shingles never exceeds."""
    out = np.empty(len(x), dtype=np.int64)
    sizes = np.array([(len(a), len(b)) for a, b in zip(x, y)], dtype=np.int64).reshape(-1, 2)
    for la, lb in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == la) & (sizes[:, 1] == lb))
        a, b = (np.frombuffer(b"".join([v[i] for i in at]), dtype=np.uint64).reshape(len(at), -1) for v in (x, y))
        pa_, pb = (np.bitwise_count(v).sum(1).astype(np.int64) for v in (a, b))
        while a.shape[1] > b.shape[1]:
            a = a[:, : a.shape[1] // 2] | a[:, a.shape[1] // 2 :]
        while b.shape[1] > a.shape[1]:
            b = b[:, : b.shape[1] // 2] | b[:, b.shape[1] // 2 :]
        # a shared bit stands for one common shingle and those of either set beyond one for each of its bits
        fa, fb = (np.bitwise_count(v).sum(1).astype(np.int64) for v in (a, b))
        out[at] = np.bitwise_count(a & b).sum(1).astype(np.int64) + np.minimum(nx[at] - np.minimum(pa_, fa), ny[at] - np.minimum(pb, fb))
    return out


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """(number of sets, m) longs, each of four 16-bit symbols; sets are not empty."""
    k = _SYMBOLS * m
    seeds = wh.mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    at = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), k), dtype=np.uint16)
    for j in range(k):
        v = ((flat ^ seeds[j]) * (seeds[k + j] | np.uint64(1))) >> np.uint64(32)
        out[:, j] = np.minimum.reduceat(v, at) & np.uint64(0xFFFF)
    return out.view(np.int64)


def _sketch(size: int, m: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets in shingle_sets(batch.column(1), size):
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = np.zeros((len(sets), m), dtype=np.int64)
                if full:
                    sig[full] = signatures([sets[i] for i in full], m)
                ids = np.array([_identity(s) for s in sets], dtype=np.int64).reshape(-1, 2)
                kept = [batch.column(k).slice(lo, hi - lo) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig.tolist(), pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "set_hi", "set_lo", "n", "sig"],
                )

    return run


def _full_sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in shingle_sets(batch.column(1), size):
                ids = np.array([_identity(s) for s in sets], dtype=np.int64).reshape(-1, 2)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)), pa.array([_bits(s) for s in sets], pa.binary())],
                    names=["set_hi", "set_lo", "shingles", "bits"],
                )

    return run


def _distance(a: Column, b: Column, m: int) -> Column:
    """Differing 16-bit symbols of two signatures."""
    total = None
    for c in range(m):
        x = a[c].bitwiseXOR(b[c])
        for by in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        n = F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
        total = n if total is None else total + n
    return total


def _keys(classes: DataFrame, m: int) -> DataFrame:
    """(t, key, cid): each chunk without one of its symbols, hashed with the number t = 4 chunk + symbol."""
    without = [F.lit(-1 - (0xFFFF << 16 * j) if j < 3 else (1 << 48) - 1).cast("long") for j in range(_SYMBOLS)]
    keys = [F.xxhash64(F.col("sig")[c].bitwiseAND(without[j]), F.lit(c * _SYMBOLS + j)) for c in range(m) for j in range(_SYMBOLS)]
    return classes.select(F.posexplode(F.array(*keys)).alias("t", "key"), "cid")


def _scattered(x: Column) -> Column:
    """A one-to-one map of longs that spreads the low bits over all."""
    for _ in range(2):
        for shift, by in ((F.shiftleft, 13), (F.shiftrightunsigned, 7), (F.shiftleft, 17)):
            x = x.bitwiseXOR(shift(x, by))
    return x


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, label): the smallest node reachable from each node of ``edges`` (a, b); nodes without edges are not listed.

    An edge offers the smaller label of its ends to both ends and both labels, and labels jump
    to their own label; each round is one table in the shared folder and one shuffle of offers,
    besides the joins with the labels, which are broadcast up to ``BROADCAST_ROWS`` nodes.
    """
    edges = scratch.write(edges.select("a", "b"), f"{name}_edges")
    first = edges.select(F.explode(F.array("a", "b")).alias("v"), F.least("a", "b").alias("label"))
    labels, nodes = scratch.counted(first.groupBy("v").agg(F.min("label").alias("label")), f"{name}_0")

    def looked_up(key: str, found: str) -> DataFrame:
        return small_side(labels.select(F.col("v").alias(key), F.col("label").alias(found)), nodes, BROADCAST_ROWS)

    for turn in range(1, 200):
        ends = edges.join(looked_up("a", "of_a"), "a").join(looked_up("b", "of_b"), "b").where("of_a != of_b")
        offers = ends.select(F.explode(F.array("a", "b", "of_a", "of_b")).alias("v"), F.least("of_a", "of_b").alias("label"), F.lit(None).cast("long").alias("old"))
        jumps = labels.join(looked_up("label", "up"), "label").select("v", F.col("up").alias("label"), F.col("label").alias("old"))
        step = jumps.union(offers).groupBy("v").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        step = step.select("v", "label", (F.col("label") != F.col("old")).alias("moved"))
        step, moved = scratch.counted(step, f"{name}_{turn}", F.count_if("moved"))
        scratch.drop(f"{name}_{turn - 1}")
        labels = step.select("v", "label")
        if not moved:
            scratch.drop(f"{name}_edges")
            return labels
    raise RuntimeError("the components did not settle in 200 rounds")


def _confirmed(pairs: DataFrame, rows: int, sets: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b), ``rows`` of them, whose full sets reach the threshold; the set of a ``b`` in many pairs is dealt out to groups of ``SPREAD`` pairs, and sets in no pair are not shuffled."""
    heads = small_side(*scratch.counted(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("groups")), f"heads_{name}"), BROADCAST_ROWS)
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")).join(heads, "b").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt = pairs.join(heads, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("group"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    met = left.join(small_side(dealt, rows, BROADCAST_ROWS), "a").join(right.select("b", "group", "y"), ["b", "group"])
    return met.select("a", "b", both.alias("k"), (F.size("x") + F.size("y") - both).alias("u")).where(100 * F.col("k") >= percent * F.col("u")).select("a", "b")


def _near_heads(rows: DataFrame, order: Column) -> DataFrame:
    """(t, key, cid, comp, head, head_comp, rows): the rows of keys with more than one component, and the class that comes last by ``order`` in each."""
    heads = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("rows"), F.max_by("cid", order).alias("head"), F.max_by("comp", order).alias("head_comp"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").drop("lo", "hi")
    return rows.select("t", "key", "cid", "comp").join(heads, ["t", "key"])


def _head_pairs(near: DataFrame) -> DataFrame:
    """(a, b): each class with heads of other components, ``HEADS`` that it meets in most keys and as many that it meets in the smallest buckets; the others have later rounds and the last step."""
    met = near.where("comp != head_comp").select(F.col("cid").alias("a"), F.col("head").alias("b"), "rows").repartition("a")
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys"), F.min("rows").alias("rows"))
    most, least = (F.row_number().over(Window.partitionBy("a").orderBy(*by)) for by in ((F.desc("keys"), "b"), ("rows", F.desc("keys"), "b")))
    return met.select("a", "b", most.alias("most"), least.alias("least")).where(F.least("most", "least") <= HEADS).select("a", "b")


def _shrunk(rows: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(t, key, cid, comp, n, alone): ``rows`` without the classes that no row of another component in their bucket can match; ``sizes`` holds (cid, n).

    Sets are not shuffled while the open classes are few enough to broadcast, only their shingles are.
    """
    before = 0
    for turn in range(PASSES):
        open_ = small_side(*scratch.counted(rows.select("cid", "comp").distinct(), f"open{turn}"), BROADCAST_ROWS)
        if turn == 0:  # many rows still: shingles of one class alone are counted without a join
            each = sets.join(open_, "cid", "left_semi").select("cid", F.explode("shingles").alias("s"))
            alone = each.groupBy("s").agg(F.min("cid").alias("cid"), F.max("cid").alias("last")).where("cid = last")
        else:
            each = sets.join(open_, "cid").select("cid", "comp", F.explode("shingles").alias("s"))
            own = each.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo = hi").select("s")
            alone = each.join(own, "s", "left_semi")
        alone = alone.groupBy("cid").agg(F.count(F.lit(1)).alias("alone"))
        members = sizes.join(open_, "cid", "left_semi")
        members = scratch.write(members.join(alone, "cid", "left").select("cid", "n", F.coalesce("alone", F.lit(0)).alias("alone")), f"members{turn}")
        wide = rows.select("t", "key", "cid", "comp").join(members, "cid")
        least = wide.groupBy("key").agg(F.min("alone").alias("least"))
        fit = 100 * (F.col("n") - F.col("alone")) >= percent * (F.col("n") + F.col("least"))
        kept = wide.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")).join(least, "key").where(fit)
        rows, left = scratch.counted(_mixed(kept.select("t", "key", "cid", "comp", "n", "alone")), f"shrunk{turn}")
        scratch.drop(f"open{turn}", f"members{turn}", f"shrunk{turn - 1}")
        if not left or turn and left > 0.8 * before:
            break
        before = left
    return rows


def _binned(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with their bucket's main component and a bin: logarithm of the size (partners are at most one apart) and share of own shingles."""
    sizes = rows.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    size = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    return rows.join(sizes, "key").withColumns({"size": size, "share": F.floor(F.col("alone") * 64 / F.col("n")).cast("int")})


def _open_bins(full: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows by bin of a bucket, and the pairs of bins in which a pair may reach the threshold."""
    bins = full.groupBy("key", "size", "share").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.col("n") - F.col("alone")).alias("most"), F.min("n").alias("from"), F.max("n").alias("to"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    x, y = (bins.select("key", *[F.col(c).alias(f"{c}_{side}") for c in bins.columns if c != "key"]) for side in "xy")
    # common shingles are no one's own: c of n + k - c in the union at least
    ok = (F.abs(F.col("size_x") - F.col("size_y")) <= 1) & ((100 + percent) * F.least("most_x", "most_y") >= percent * (F.col("from_x") + F.col("from_y")))
    ok &= (100 * F.col("to_x") >= percent * F.col("from_y")) & (100 * F.col("to_y") >= percent * F.col("from_x")) & ~((F.col("lo_x") == F.col("hi_y")) & (F.col("hi_x") == F.col("lo_y")))
    return bins.select("key", "size", "share", "rows"), x.join(y, "key").where(ok).select("key", "size_x", "share_x", "size_y", "share_y")


def _met(full: DataFrame, m: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of different components that may reach the threshold, from rows with signatures and bits."""
    bins, allowed = _open_bins(full, percent)
    full = scratch.write(full.join(bins, ["key", "size", "share"]), "full")
    few = _blocks(full.where("comp != main")).select("t", "key", F.col("size").alias("size_x"), F.col("share").alias("share_x"), F.col("members").alias("few"))
    other = _blocks(full).select("key", F.col("size").alias("size_y"), F.col("share").alias("share_y"), "members")
    met = few.join(allowed, ["key", "size_x", "share_x"]).join(other, ["key", "size_y", "share_y"])
    return met.select("t", "few", "members").mapInArrow(_meet(m, percent), "a long, b long").distinct()


def linked(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row per document: doc_id, text_hash, n (shingles), label (a number of its component), component_id."""
    spark = docs.sparkSession
    m = chunk_count(percent, miss)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    sketch = scratch.write(texts.mapInArrow(_sketch(size, m), "doc_id long, text_hash long, set_hi long, set_lo long, n long, sig array<long>"), "sketch")
    classes = sketch.where("n > 0").groupBy("set_hi", "set_lo", "n", "sig").agg(F.min("doc_id").alias("rep"))
    classes = scratch.write(classes.select(_scattered(F.monotonically_increasing_id()).alias("cid"), "*"), "classes")

    # buckets that hold more than one class
    several = _keys(classes, m).groupBy("t", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = small_side(*scratch.counted(several, "several"), BROADCAST_ROWS)
    buckets = scratch.write(_keys(classes, m).join(several, ["t", "key"]), "buckets")
    central = buckets.groupBy("cid").agg(F.sum("rows").alias("weight"))
    inside, many = scratch.counted(central.join(classes, "cid").select("cid", "weight", "rep", "set_hi", "set_lo", "n", "sig"), "inside")

    # full sets of the classes in them
    wanted = inside.select(F.col("rep").alias("doc_id")).distinct()
    near = texts.alias("t").join(small_side(wanted, many, BROADCAST_ROWS).alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    found = near.select("doc_id", "text").mapInArrow(_full_sets(size), "set_hi long, set_lo long, shingles array<long>, bits binary")
    sets = found.join(small_side(inside.select("cid", "set_hi", "set_lo"), many, BROADCAST_ROWS), ["set_hi", "set_lo"]).select("cid", "shingles", "bits")
    sets = scratch.write(sets.dropDuplicates(["cid"]) if repeated(sketch) else sets, "sets")

    info = inside.select("cid", "n", "sig")

    def described(df: DataFrame, name: str) -> DataFrame:
        return df.join(info.select(F.col("cid").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}")), name)

    rows = buckets.join(inside.select("cid", "weight"), "cid").select("t", "key", "cid", F.col("cid").alias("comp"), "weight")
    comp = None

    def joined_up(more: DataFrame, name: str) -> DataFrame:
        """Components of the links so far: those before stand for the links that made them."""
        edges = more if comp is None else more.union(comp.where("v != label").select("v", "label"))
        return components(spark, edges, scratch, name)

    for turn in range(ROUNDS):
        # weights are rows of buckets, 4 m times the number of classes at most
        order = F.shiftleft("weight", 16).bitwiseOR(F.col("cid").bitwiseAND(F.lit(0xFFFF))) if turn == 0 else F.col("cid").bitwiseXOR(F.lit(_ORDERS[turn - 1]))
        near = scratch.write(_near_heads(rows, order), f"near{turn}")
        pairs = described(described(_head_pairs(near), "a"), "b")
        fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        pairs, some = scratch.counted(pairs.where(fit & (_distance(F.col("sig_a"), F.col("sig_b"), m) <= 2 * m - 1)).select("a", "b"), f"pairs{turn}")
        more, found = scratch.counted(_confirmed(pairs, some, sets, percent, scratch, f"{turn}"), f"links{turn}") if some else (None, 0)
        scratch.drop("buckets", "several", f"near{turn - 1}", f"pairs{turn}")
        if found:
            comp = joined_up(more, f"comp{turn}")
        elif comp is None:
            comp = spark.range(0).select(F.col("id").alias("v"), F.col("id").alias("label"))
        rows = near.select("t", "key", "cid").join(comp.withColumnRenamed("v", "cid"), "cid", "left").select("t", "key", "cid", F.coalesce("label", "cid").alias("comp"))
        if not found:
            break

    # buckets that hold more than one component
    rows, left = scratch.counted(_mixed(rows), "mixed")
    if left:
        rows = _shrunk(rows, sets, info.select("cid", "n"), percent, scratch)
        kept = rows.select("cid").distinct().join(info.select("cid", "sig"), "cid").join(sets.select("cid", "bits"), "cid")
        full = scratch.write(_binned(rows, percent), "binned").join(scratch.write(kept, "partners"), "cid")
        pairs, some = scratch.counted(_met(full, m, percent, scratch), "met")
        more, found = scratch.counted(_confirmed(pairs, some, sets, percent, scratch, "last"), "links") if some else (None, 0)
        if found:
            comp = joined_up(more, "last")

    label = F.coalesce("label", "cid")
    classed = scratch.write(classes.select("cid", "set_hi", "set_lo", "rep").join(comp.withColumnRenamed("v", "cid"), "cid", "left").select("set_hi", "set_lo", "rep", label.alias("label")), "classed")
    smallest = classed.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = scratch.write(classed.join(smallest, "label").select("set_hi", "set_lo", "label", "component_id"), "named")
    scratch.keep("sketch", "named")
    out = sketch.select("doc_id", "text_hash", "set_hi", "set_lo", "n").join(named, ["set_hi", "set_lo"], "left")
    return out.select("doc_id", "text_hash", "n", "label", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with ``100 * common >= percent * union`` over their sets of
    ``size``-word shingles are linked; see the module for method and edge cases.
    """
    out = linked(docs, Scratch(docs.sparkSession, "neardup"), id_col=id_col, text_col=text_col, size=size, percent=percent, miss=miss)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, all columns as they are; see the module for repeated and missing ids."""
    scratch = Scratch(docs.sparkSession, "one_of_each")
    rows = scratch.write(linked(docs, scratch, id_col=id_col, text_col=text_col, size=size, percent=percent, miss=miss), "linked")
    scratch.keep("linked")
    mine = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = rows.where((F.col("n") > 0) & ~mine)
    if repeated(rows):
        firsts = rows.where((F.col("n") > 0) & mine).groupBy("label").agg(F.min("text_hash").alias("first"))
        gone = rows.where("n > 0").join(firsts, "label").where(~mine | (F.col("text_hash") != F.col("first")))
        worded = F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        docs = docs.where(~worded).unionByName(docs.where(worded).dropDuplicates([id_col, text_col]))
    own = [f"_{uuid.uuid4().hex[:12]}_{c}" for c in ("id", "hash")]
    gone = small_side(*scratch.counted(gone.select(F.col("doc_id").alias(own[0]), F.col("text_hash").alias(own[1])).distinct(), "gone"), BROADCAST_ROWS)
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own[0])) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(own[1]))
    return docs.join(gone, same, "left_anti")


_MEMBER = ("cid", "comp", "main", "n", "alone", "sig", "bits")


def _blocks(rows: DataFrame) -> DataFrame:
    """(t, key, size, share, members): the rows of each bin of a bucket in blocks of about ``MEET`` rows."""
    block = F.pmod(F.xxhash64("cid"), F.ceil(F.col("rows") / MEET))
    return rows.groupBy("t", "key", "size", "share", block.alias("block")).agg(F.collect_list(F.struct(*_MEMBER)).alias("members")).drop("block")


def _members(column: pa.Array) -> Iterator[dict]:
    """Each row's list of members as arrays by name."""
    offs, flat = column.offsets.to_numpy(), column.values
    arrays = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in ("cid", "comp", "main", "n", "alone")}
    arrays["sig"] = flat.field("sig").flatten().to_numpy().reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), np.int64)
    arrays["bits"] = np.array(flat.field("bits").to_pylist(), dtype=object)
    for lo, hi in zip(offs[:-1] - offs[0], offs[1:] - offs[0]):
        yield {name: v[lo:hi] for name, v in arrays.items()}


def _differing(xor: np.ndarray) -> np.ndarray:
    """Symbols that differ, of the exclusive or of chunks."""
    return (np.ascontiguousarray(xor).view(np.uint16).reshape(*xor.shape, _SYMBOLS) != 0).sum(-1)


def close_pairs(x: dict, y: dict, t: int, m: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): pairs of two blocks of one bucket in different components that may reach the threshold.

    A pair is given in the first bucket it shares only. ``x`` holds rows outside
    the bucket's main component, ``y`` any rows.
    """
    n, k, alone, lone = x["n"][:, None], y["n"], x["alone"][:, None], y["alone"]
    ok = (x["comp"][:, None] != y["comp"]) & ((y["comp"] == y["main"]) | (x["cid"][:, None] < y["cid"]))
    ok &= (100 + percent) * np.minimum(n - alone, k - lone) >= percent * (n + k)
    i, j = np.nonzero(ok)
    if not len(i):
        return i, j
    c, symbol = divmod(t, _SYMBOLS)
    for k in range(c + 1):  # most pairs share an earlier bucket, so chunk by chunk
        differ = _differing(x["sig"][i, k] ^ y["sig"][j, k])
        near = differ > 1 if k < c else (differ == 1) | (differ == 0) & (symbol == 0)
        i, j = i[near], j[near]
    near = _differing(x["sig"][i] ^ y["sig"][j]).sum(1) <= 2 * m - 1
    i, j = i[near], j[near]
    both = most_common(list(x["bits"][i]), x["n"][i], list(y["bits"][j]), y["n"][j])
    near = 100 * both >= percent * (x["n"][i] + y["n"][j] - both)
    return x["cid"][i[near]], y["cid"][j[near]]


def _meet(m: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for t, x, y in zip(at["t"].to_pylist(), _members(at["few"]), _members(at["members"])):
                a, b = close_pairs(x, y, t, m, percent)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of keys with more than one component."""
    several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    return rows.join(several, "key", "left_semi")


def repeated(rows: DataFrame) -> bool:
    """Whether a ``doc_id`` stands in more than one row (nulls count as one id)."""
    return bool(rows.groupBy("doc_id").count().where("count > 1").limit(1).count())
