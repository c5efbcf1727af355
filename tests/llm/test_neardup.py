"""Near-duplicates against all pairs of a small table."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import neardup
from tallyfold.llm.shared import Scratch


def brute(rows, size, percent):
    """doc_id -> (shingles, component) by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(n, seed, words=120, most=9):
    """Copies of one text with a few words changed, dropped or added."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            i, what = rng.randrange(len(w)), rng.randrange(3)
            w[i : i + 1] = [] if what == 0 else [f"c{rng.randrange(10**6)}"] if what == 1 else [w[i], f"c{rng.randrange(10**6)}"]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, size, percent):
    rng = random.Random(size)
    texts = family(150, 1) + family(40, 2, words=30, most=4) + [" ".join(f"u{rng.randrange(300)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += texts[:20] + ["a b", "A B", "a", "", None]
    rng.shuffle(texts)
    rows = list(enumerate(texts, start=10))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_blocks_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEET", 7)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    rows = list(enumerate(family(90, 5) + family(60, 6, most=14)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_tables_are_counted_as_they_are_written(spark, monkeypatch):
    """Each query of its own stays in the driver's memory; one at most is left for counts, whatever the number of rounds."""
    counts, count = [], type(spark.range(1)).count
    monkeypatch.setattr(type(spark.range(1)), "count", lambda df: counts.append(1) or count(df))
    rows = list(enumerate(family(60, 5) + family(40, 6, most=14)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85) and len(counts) <= 1
    scratch = Scratch(spark, "counted")
    table, n = scratch.counted(spark.range(1000).repartition(7), "some")
    assert n == count(table) == 1000 and scratch.counted(table.where("id < 0"), "none")[1] == 0
    assert scratch.counted(table, "odd", F.count_if(F.col("id") % 2 == 1))[1] == 500 and scratch.counted(spark.range(0), "empty", F.count_if(F.col("id") > 0))[1] == 0


def test_odd_rows(odd):
    got = neardup.near_duplicates(odd, size=3, percent=85).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[1]] == [1, 1] and by[2][0].component_id == 1 and not by[2][0].kept
    assert all(by[i][0].n_shingles == 0 and by[i][0].component_id == i and by[i][0].kept for i in (3, 4, 5))
    assert by[6][0].component_id == by[7][0].component_id == 6 and by[6][0].n_shingles == 1
    assert sorted(r.n_shingles for r in by[None]) == [0, 3] and all(r.component_id is None for r in by[None])
    assert by[8][0].n_shingles == 59_999


def test_empty_table(odd):
    got = neardup.near_duplicates(odd.where("false"))
    assert got.count() == 0 and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("most", [1 << 17, 256])
def test_bound_on_common_shingles_holds(monkeypatch, most):
    monkeypatch.setattr(neardup, "BITS", most)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (1, 5, 20, 30, 60, 70, 129, 300)]
    x = [a for a in sets for _ in sets]
    y = [b for _ in sets for b in sets]
    bound = neardup.most_common([neardup._bits(a) for a in x], np.array([len(a) for a in x]), [neardup._bits(b) for b in y], np.array([len(b) for b in y]))
    assert (bound >= [len(np.intersect1d(a, b)) for a, b in zip(x, y)]).all()


def test_pigeonhole_keys_meet_all_pairs_within_the_distance():
    rng = np.random.default_rng(1)
    m = neardup.chunk_count(85, 1e-6)
    a = rng.integers(0, 1 << 16, (200, 4 * m), dtype=np.uint16)
    b = a.copy()
    for row in b:
        at = rng.permutation(4 * m)[: rng.integers(0, 2 * m)]
        row[at] ^= 1 + rng.integers(0, 60_000, len(at)).astype(np.uint16) % 65_535
    differ = (a != b).reshape(200, m, 4).sum(2)
    assert (differ.sum(1) <= 2 * m - 1).all() and (differ.min(1) <= 1).all()


def boilerplate(n, common=100, own=16):
    """Texts that share a passage and nothing else, none of them linked."""
    return [" ".join([f"c{k}" for k in range(common)] + [f"o{i}x{k}" for k in range(own)]) for i in range(n)]


def counted(spark, monkeypatch, texts, size=3, percent=85):
    """(components by id, pairs of rows that meet in blocks, pairs whose sets are compared)."""
    met, sets = [], []
    blocks, confirm = neardup._met, neardup._confirmed

    def watch(full, m, percent, scratch):
        allowed = neardup._open_bins(full, percent)[1].collect()
        every, few = ({(r.key, r["size"], r["share"]): r["count"] for r in rows.groupBy("key", "size", "share").count().collect()} for rows in (full, full.where("comp != main")))
        met.append(sum(few.get((r.key, r.size_x, r.share_x), 0) * every[r.key, r.size_y, r.share_y] for r in allowed))
        return blocks(full, m, percent, scratch)

    def confirmed(pairs, *rest):
        sets.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(neardup, "_met", watch)
    monkeypatch.setattr(neardup, "_confirmed", confirmed)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()}
    monkeypatch.undo()
    return got, sum(met), sum(sets)


def test_documents_that_share_a_passage_alone_do_not_meet(spark, monkeypatch):
    for n in (150, 300):
        got, met, sets = counted(spark, monkeypatch, boilerplate(n))
        assert got == {i: i for i in range(n)} and met <= n and sets <= 2 * neardup.ROUNDS * neardup.HEADS * n
    twice = [t for t in boilerplate(120) for t in (t, t + " end")]
    got, met, _ = counted(spark, monkeypatch, twice)
    assert got == {i: i - i % 2 for i in range(240)} and met <= 20 * 240


def test_pairs_of_a_family_grow_with_its_size(spark, monkeypatch):
    seen = {}
    for n in (100, 200, 400):
        got, _, seen[n] = counted(spark, monkeypatch, family(n, 3, words=150, most=5))
        assert set(got.values()) == {0}
    assert seen[400] <= 3 * neardup.ROUNDS * neardup.HEADS * 400 and seen[400] <= 6 * seen[100]


def test_one_of_each_keeps_one_row_of_each_component(spark):
    a, b, c = family(1, 1)[0], family(1, 2)[0], family(1, 4)[0]
    rows = [(2, a, "x"), (5, a + " more", "x"), (5, b, "y"), (5, b, "y"), (None, c, "z"), (None, c + " more", "z"), (7, None, "n"), (7, None, "n"), (8, " ", "n"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    kept = neardup.one_of_each(docs, size=5, percent=80)
    assert kept.columns == docs.columns
    got = kept.collect()
    texts = sorted([(r.doc_id is None, r.doc_id or 0, r.text or "") for r in got])
    assert [t for t in texts if t[0]] in ([(True, 0, c)], [(True, 0, c + " more")])
    assert [t for t in texts if not t[0]] == [(False, 2, a), (False, 5, b), (False, 7, ""), (False, 7, ""), (False, 8, " ")]
    two = spark.createDataFrame([(3, a), (3, a + " more")], "doc_id long, text string")
    assert neardup.one_of_each(two).count() == 1 and neardup.one_of_each(two.where("false")).count() == 0


def test_hashing_words_holds_little_of_a_batch():
    """Sketches and full sets of 8 MB of texts need under 60 MB in a worker, whatever the size of the Arrow batch."""
    rng = random.Random(9)
    texts = pa.array([" ".join(f"w{rng.randrange(9999)}" for _ in range(330)) for _ in range(4000)])
    ids = pa.array(range(len(texts)))
    m = neardup.chunk_count(80, 1e-6)
    for run, columns in ((neardup._sketch(5, m), [ids, texts, ids]), (neardup._full_sets(5), [ids, texts])):
        tracemalloc.start()
        rows = sum(len(b) for b in run(iter([pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "text_hash"][: len(columns)])])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == len(texts) and most < 60e6
