"""Decontamination against a search of all windows."""

import hashlib
import random
import re

import duckdb
import pytest

from tallyfold.llm import decontam, registry


def brute(text, items, window=10):
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        size = min(window, len(p))
        for k in range(len(p) - size + 1 if size else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == p[k : k + size]:
                    hit |= set(range(i, i + size))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def table(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(6)] + ["É", "x9", "Z"]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(str(i), some(rng.choice([3, 4, 8, 10, 12, 14]))) for i in range(12)] + [("12", "solo"), ("13", None), ("14", "..."), ("3", some(11))]
    ends = ["", " Solo.", *["\n" + t for _, t in items if t]]
    docs = [(i, some(rng.randrange(0, 80)) + rng.choice(ends) if i % 9 else None) for i in range(80)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_equals_brute_force(spark, block_bytes):
    docs, items, d, b = table(spark)
    got = decontam.contamination(d, b, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == {i: brute(t, items) for i, t in docs}
    kept = {r.doc_id for r in decontam.remove_contaminated(d, b, block_bytes=block_bytes).collect()}
    assert kept == {i for i, t in docs if not brute(t, items)[4]}


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(decontam, "_PIECE", 50)
    rng = random.Random(8)
    text = " ".join(rng.choice("ABCD") * rng.randrange(1, 4) for _ in range(900))
    items = [(str(i), text[k : k + rng.choice([9, 40, 70])]) for i, k in enumerate(range(0, 1500, 133))]
    n, spans, found = decontam.scan(text.encode(), decontam.Searches([([i], t) for i, t in items], 10))
    covered = {i for s, e in spans for i in range(s, e)}
    assert (n, len(covered), len(found)) == brute(text, items)[:3]


def test_tables_take_little_memory():
    import tracemalloc

    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(50_000)]
    items = [([str(i)], " ".join(rng.choice(vocab) for _ in range(200))) for i in range(600)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    searches = decontam.Searches(items, 10)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size > 1_000_000 and held < 25 * size and peak < 60 * size
    assert decontam.scan(("x " + items[5][1] + " y").encode(), searches)[1:] == ([(1, 201)], ["5"])


def test_equal_items_and_shared_passages(spark):
    rng = random.Random(5)
    shared = " ".join(f"s{rng.randrange(9)}" for _ in range(14))
    items = [(str(i), shared + f" own{i} tail") for i in range(40)] + [(f"e{i}", shared) for i in range(60)]
    docs = [(1, "a " + shared + " b"), (2, shared + " own7 tail"), (3, "nothing")]
    b = spark.createDataFrame(items, "item_id string, text string")
    for block_bytes in (8 << 20, 300):
        got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), b, block_bytes=block_bytes).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == {i: brute(t, items) for i, t in docs}


def test_odd_rows_and_empty_tables(spark, odd):
    items = spark.createDataFrame([("a", "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, "one two")], "item_id string, text string")
    got = decontam.contamination(odd, items).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.contaminated} == {1, 2, 6, 7} and all(r.n_words == 0 for r in got if r.doc_id in (3, 4, 5))
    assert decontam.contamination(odd, items.where("false")).where("contaminated").count() == 0
    assert decontam.contamination(odd.where("false"), items).count() == 0
    assert decontam.remove_contaminated(odd, items).columns == odd.columns


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = registry.queries()["op3_decontamination"](spark, sf_dir)
    want = con.sql(registry.oracle_sql()["op3_decontamination"]).df()
    a = got.toPandas()[sorted(got.columns)].sort_values("doc_id").reset_index(drop=True)
    assert a.equals(want[sorted(want.columns)].sort_values("doc_id").reset_index(drop=True).astype(a.dtypes.to_dict()))
