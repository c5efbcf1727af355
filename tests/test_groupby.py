"""The group operator against pandas on the same frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tallyfold
from tallyfold.functions import AGGREGATES
from tallyfold.operators.groupby import GroupedFrame, groupby_agg
from tallyfold.operators.validate import supports
from tallyfold.sources.frames import from_pandas, to_series

MAX = np.finfo(np.float64).max


def expected(pdf, by, target, agg, sort=True, **options):
    return getattr(pdf.groupby(by, sort=sort)[target], agg)(**options)


def frame(rows=4000, seed=42, keys=(("k1", 20), ("k2", 7), ("k3", 3))):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({k: rng.integers(-n, n, rows) for k, n in keys})
    value = rng.random(rows) * 100
    value[rng.random(rows) < 0.1] = np.nan
    value[pdf["k1"] == 3] = np.nan
    value[(pdf["k1"] == 5) & (rng.random(rows) < 0.2)] = np.inf
    pdf["v"], pdf["n"] = value, rng.integers(-1000, 1000, rows)
    return pdf


@pytest.fixture(scope="module")
def mixed(spark):
    pdf = frame()
    return pdf, from_pandas(spark, pdf).repartition(5).cache()


@pytest.mark.parametrize("agg", AGGREGATES)
@pytest.mark.parametrize("by", ["k1", ["k1"], ["k1", "k2"], ["k1", "k2", "k3"]])
def test_sorted_against_pandas(mixed, agg, by):
    pdf, df = mixed
    for target in ("v", "n"):
        with np.errstate(all="ignore"):
            want = expected(pdf, by if isinstance(by, str) or len(by) > 1 else by[0], target, agg)
        got = to_series(groupby_agg(df, by, target, agg), target)
        pd.testing.assert_series_equal(got, want, rtol=1e-10)


@pytest.mark.parametrize("agg", AGGREGATES)
def test_first_seen_order(mixed, agg):
    pdf, df = mixed
    for by in ("k1", ["k2", "k3"]):
        with np.errstate(all="ignore"):
            want = expected(pdf, by, "v", agg, sort=False)
        pd.testing.assert_series_equal(to_series(groupby_agg(df, by, "v", agg, sort=False, order_by="rid"), "v"), want, rtol=1e-10)


def test_first_seen_order_counts_missing_values(spark):
    nan = float("nan")
    pdf = pd.DataFrame({"key": [30, 10, 30, 20, 10, 40], "val": [nan, 6.0, 1.5, nan, 2.0, 7.0]})
    df = from_pandas(spark, pdf).repartition(4)
    want = {"std": [nan, np.sqrt(8.0), nan, nan], "var": [nan, 8.0, nan, nan], "median": [1.5, 4.0, nan, 7.0], "sum": [1.5, 8.0, 0.0, 7.0]}
    for agg, values in want.items():
        got = to_series(groupby_agg(df, "key", "val", agg, sort=False, order_by="rid"), "val")
        assert list(got.index) == [30, 10, 20, 40]
        np.testing.assert_array_equal(got.to_numpy(), values)


INNER = ["_out", "_part", "_to", "_n", "_value", "_target", "_target0", "_row", "_rows", "_first_seen", "_ok", "_total", "_here", "_before", "_lo", "_hi", "_key0", "_key1", "_k0", "_same0", "_out0", "a.b"]


@pytest.mark.parametrize("names", [INNER[i : i + 2] for i in range(0, len(INNER), 2)], ids="-".join)
def test_keys_may_have_any_name(spark, names):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({names[0]: rng.integers(0, 4, 60), names[1]: rng.integers(0, 3, 60), "v": rng.integers(1, 9, 60)})
    df = from_pandas(spark, pdf, row="rid").repartition(3)
    want = lambda agg, sort=True: expected(pdf, names, "v", agg, sort=sort)
    for agg in ("sum", "median", "prod", "std"):
        pd.testing.assert_series_equal(to_series(groupby_agg(df, names, "v", agg), "v"), want(agg), rtol=1e-10)
    pd.testing.assert_series_equal(to_series(groupby_agg(df, names, "v", "median", max_group_rows=0), "v"), want("median"))
    pd.testing.assert_series_equal(to_series(groupby_agg(df, names, "v", "max", sort=False, order_by="rid"), "v"), want("max", False))
    if "." not in names[1]:
        got = GroupedFrame(df, names).agg({"v": ["sum", "prod", "median"]})
        assert got.columns == [*names, "v_sum", "v_prod", "v_median"]
        for agg in ("sum", "prod", "median"):
            np.testing.assert_array_equal(got.toPandas()[f"v_{agg}"].to_numpy(), want(agg).to_numpy())
        moved = GroupedFrame(df, names)["v"].transform("sum").toPandas().sort_values("rid")
        np.testing.assert_array_equal(moved["v_sum"].to_numpy(), pdf.groupby(names)["v"].transform("sum").to_numpy())


def test_integer_sum_and_product_wrap(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 20, 3000), "v": rng.integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64)})
    pdf.loc[pdf["k"] == 3, "v"] = 2**62
    pdf.loc[pdf["k"] == 4, "v"] = np.where(np.arange((pdf["k"] == 4).sum()) % 2, 2**62, -(2**62))
    df = from_pandas(spark, pdf).repartition(6)
    for agg in ("sum", "prod"):
        pd.testing.assert_series_equal(to_series(groupby_agg(df, "k", "v", agg), "v"), expected(pdf, "k", "v", agg))
    exact = pdf.groupby("k")["v"].agg(lambda s: float(sum(map(int, s)) / len(s)))
    np.testing.assert_allclose(to_series(groupby_agg(df, "k", "v", "mean"), "v").to_numpy(), exact.to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("pair,want", [((MAX, MAX), math.inf), ((1e308, 1e308), math.inf), ((-MAX, -MAX), -math.inf), ((-1e308, -1e308), -math.inf), ((MAX, -MAX), 0.0), ((MAX, 0.0), MAX / 2)])
def test_median_overflows(spark, pair, want):
    pdf = pd.DataFrame({"key": [2, 1, 1, 2], "val": [1.0, *pair, 1.0]})
    for limit in (10, 0):
        assert groupby_agg(from_pandas(spark, pdf), "key", "val", "median", max_group_rows=limit).first()["val"] == want


def test_median_by_rank_equals_the_sorted_array(mixed):
    pdf, df = mixed
    for target in ("v", "n"):
        for by in ("k1", ["k1", "k2"]):
            pd.testing.assert_series_equal(to_series(groupby_agg(df, by, target, "median", max_group_rows=0), target), expected(pdf, by, target, "median"))


def test_strict_order_is_bitwise_the_same_for_any_partitioning(spark):
    n = 6000
    v = np.array([1e16, 1.0, -1e16, 0.25])[np.arange(n) % 4] + np.arange(n) % 7
    v[::97] = np.nan
    pdf = pd.DataFrame({"k": np.arange(n) % 57, "v": v, "f": 1 + (np.arange(n) % 11 - 5) / 50})
    df = from_pandas(spark, pdf)
    for agg, target in (("sum", "v"), ("mean", "v"), ("prod", "f"), ("var", "v"), ("std", "v")):
        runs = [to_series(groupby_agg(df.repartition(p), "k", target, agg, strict_order=True, order_by="rid"), target).to_numpy().tobytes() for p in (1, 3, 7)]
        assert len(set(runs)) == 1
    want = expected(pdf, "k", "f", "prod")
    assert runs and to_series(groupby_agg(df.repartition(5), "k", "f", "prod", strict_order=True, order_by="rid"), "f").to_numpy().tobytes() == want.to_numpy().tobytes()
    with pytest.raises(ValueError):
        groupby_agg(df, "k", "v", "sum", strict_order=True, order_by="rid", max_group_rows=5)


def test_product_specials(spark):
    nan, inf = float("nan"), float("inf")
    pairs = [(nan, nan), (nan, 2.0), (inf, 0.0), (-inf, 0.0), (-0.0, 2.0), (0.0, -2.0), (1e308, 1e308), (1e-308, 1e-308)]
    pdf = pd.DataFrame([(k, v) for k, p in enumerate(pairs) for v in p], columns=["k", "v"])
    for strict in (False, True):
        got = to_series(groupby_agg(from_pandas(spark, pdf).repartition(3), "k", "v", "prod", strict_order=strict, order_by="rid"), "v").to_numpy()
        want = expected(pdf, "k", "v", "prod").to_numpy()
        np.testing.assert_array_equal(got, want)
        np.testing.assert_array_equal(np.signbit(got[4:6]), np.signbit(want[4:6]))


def test_infinities(spark):
    inf = float("inf")
    pdf = pd.DataFrame({"k": [1, 1, 2, 2, 3, 3, 4, 4], "v": [inf, inf, -inf, -inf, 1.0, 2.0, inf, -inf]})
    for agg in AGGREGATES:
        with np.errstate(all="ignore"):
            want = expected(pdf, "k", "v", agg)
        pd.testing.assert_series_equal(to_series(groupby_agg(from_pandas(spark, pdf), "k", "v", agg), "v"), want, rtol=1e-10)


def test_options_against_pandas(mixed):
    pdf, df = mixed
    for agg in ("sum", "prod"):
        for n in (0, 1, 5, 60):
            with np.errstate(all="ignore"):
                want = expected(pdf, ["k1", "k2"], "v", agg, min_count=n)
            pd.testing.assert_series_equal(to_series(groupby_agg(df, ["k1", "k2"], "v", agg, min_count=n), "v"), want, rtol=1e-10)
    finite = pdf.assign(v=pdf["v"].replace(np.inf, np.nan))
    clean = df.withColumn("v", F.when(F.abs("v") < 1e300, F.col("v")))
    for agg in ("std", "var"):
        for ddof in (0, 1, 2):
            pd.testing.assert_series_equal(to_series(groupby_agg(clean, ["k1", "k2"], "v", agg, ddof=ddof), "v"), expected(finite, ["k1", "k2"], "v", agg, ddof=ddof), rtol=1e-9)
    got = to_series(groupby_agg(df, ["k1", "k2"], "v", "sum", skipna=False), "v")
    with np.errstate(all="ignore"):
        want = pdf.groupby(["k1", "k2"])["v"].agg(lambda s: s.sum(skipna=False))
    pd.testing.assert_series_equal(got, want, rtol=1e-10)


@pytest.mark.parametrize("keys", [2, 3, 4, 5, 10])
def test_many_keys(spark, keys):
    rng = np.random.default_rng(keys)
    pdf = pd.DataFrame({f"k{i}": rng.integers(-2, 2, 800) for i in range(keys)} | {"v": rng.random(800)})
    by = list(pdf.columns[:-1])
    pd.testing.assert_series_equal(to_series(groupby_agg(from_pandas(spark, pdf), by, "v", "mean"), "v"), expected(pdf, by, "v", "mean"), rtol=1e-10)


def test_extreme_keys_keep_type_and_order(spark):
    pdf = pd.DataFrame({"a": np.array([2**62, -(2**62), 0, 2**32, 2**32 - 1, -1], np.int64), "b": np.arange(6, dtype=np.int32), "v": np.arange(6.0)})
    df = from_pandas(spark, pdf)
    got = groupby_agg(df, ["b", "a"], "v", "sum")
    assert dict(got.dtypes) == {"b": "int", "a": "bigint", "v": "double"}
    pd.testing.assert_series_equal(to_series(groupby_agg(df, "a", "v", "sum"), "v"), expected(pdf, "a", "v", "sum"))
    empty = groupby_agg(df.where("false"), ["b", "a"], "v", "count")
    assert dict(empty.dtypes) == {"b": "int", "a": "bigint", "v": "bigint"} and empty.count() == 0


def test_missing_keys(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0), (2, None), (None, 4.0)], "k int, v double")
    assert {r.k: r.v for r in groupby_agg(df, "k", "v", "sum").collect()} == {1: 1.0, 2: 0.0}
    assert {r.k: r.v for r in groupby_agg(df, "k", "v", "sum", dropna=False).collect()} == {1: 1.0, None: 6.0, 2: 0.0}
    wide = df.withColumn("v", F.col("v").cast("long"))
    assert {r.k: r.v for r in groupby_agg(wide, "k", "v", "prod", dropna=False).collect()} == {1: 1, None: 8, 2: 1}
    floats = spark.createDataFrame([(0.0, 1.0), (-0.0, 2.0), (float("nan"), 3.0)], "k double, v double")
    assert [(r.k, r.v) for r in groupby_agg(floats, "k", "v", "sum").collect()] == [(0.0, 3.0)]


def test_other_types(spark):
    pdf = pd.DataFrame({"k": ["b", "a", "b", "a"], "s": ["x", "y", "z", "w"], "b": [True, False, True, True], "t": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-04", "2024-01-04"])})
    df = from_pandas(spark, pdf).repartition(3)
    for agg in ("min", "max", "count"):
        for c in ("s", "b", "t"):
            assert [r[c] for r in groupby_agg(df, "k", c, agg).collect()] == list(expected(pdf, "k", c, agg))
    assert [r.s for r in groupby_agg(df, "k", "s", "sum", order_by="rid").collect()] == ["yw", "xz"]
    for agg in ("sum", "prod", "mean", "median", "std", "var"):
        np.testing.assert_allclose([r.b for r in groupby_agg(df, "k", "b", agg).collect()], expected(pdf.assign(b=pdf["b"].astype(int)), "k", "b", agg).astype(float))
    for agg in ("mean", "median"):
        assert [pd.Timestamp(r.t) for r in groupby_agg(df, "k", "t", agg).collect()] == list(expected(pdf, "k", "t", agg))
    assert [r.t.total_seconds() for r in groupby_agg(df, "k", "t", "std").collect()] == pytest.approx([x.total_seconds() for x in expected(pdf, "k", "t", "std")])
    u = from_pandas(spark, pd.DataFrame({"k": np.array([1, 1, 2], np.uint64), "v": np.array([2**64 - 1, 1, 5], np.uint64)}))
    assert [int(r.v) for r in groupby_agg(u, "k", "v", "max").collect()] == [2**64 - 1, 5]


def test_mean_of_times_exact_or_as_a_double(spark):
    """33 of 67 parts of a microsecond: 0.4925 is below a half, but not as a double of 1e14, whose last place is 1/64."""
    df = spark.sql("SELECT 1 AS k, timestamp_micros(1700000000000000 + if(id < 33, 1, 0)) AS t FROM range(67)")
    micros = lambda **o: groupby_agg(df, "k", "t", "mean", **o).select(F.unix_micros("t")).first()[0]
    assert micros() == 1700000000000000 and micros(time_origin=1600000000000000) == 1700000000000001


def test_integer_mean_is_rounded_once(spark):
    values = [2**62 + 1, 2**62 + 2, 2**62 - 7, 3, -(2**40) - 5, 2**53 + 1, 1]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, None), (3, -7), (3, -8)], "k long, v long")
    got = to_series(groupby_agg(df, "k", "v", "mean"), "v")
    assert got[1] == sum(values) / len(values) and math.isnan(got[2]) and got[3] == -7.5


def test_errors(mixed):
    _, df = mixed
    with pytest.raises(ValueError):
        groupby_agg(df, "k1", "v", "mode")
    with pytest.raises(ValueError):
        groupby_agg(df, [], "v", "sum")
    with pytest.raises(KeyError):
        groupby_agg(df, "nope", "v", "sum")
    with pytest.raises(KeyError):
        groupby_agg(df, "k1", "nope", "sum")
    many = df.select("v", *[F.col("k1").alias(f"k{i}") for i in range(11)])
    with pytest.raises(ValueError):
        groupby_agg(many, [f"k{i}" for i in range(11)], "v", "sum")
    assert GroupedFrame(many, [f"k{i}" for i in range(11)])["v"].sum().count() > 0
    text = df.select("k1", F.lit("x").alias("s"), F.current_timestamp().alias("t"))
    for agg in ("mean", "median", "prod", "std", "var"):
        with pytest.raises(TypeError):
            groupby_agg(text, "k1", "s", agg)
    with pytest.raises(TypeError):
        groupby_agg(text, "k1", "t", "sum")
    with pytest.raises(ValueError):
        groupby_agg(df.select("k1", "v", F.col("n").alias("v")), "k1", "v", "sum")
    with pytest.raises(ValueError):
        groupby_agg(df, "k1", "v", "sum", sort=False)


def test_fluent_frame(mixed):
    pdf, df = mixed
    g = GroupedFrame(df, ["k2", "k3"])
    assert g.ngroups() == pdf.groupby(["k2", "k3"]).ngroups
    out = g.agg({"n": ["sum", "median", "prod"], "v": "count"}).toPandas()
    want = pdf.groupby(["k2", "k3"]).agg(n_sum=("n", "sum"), n_median=("n", "median"), n_prod=("n", "prod"), v=("v", "count")).reset_index()
    pd.testing.assert_frame_equal(out, want)
    both = g[["n", "v"]].max().toPandas()
    assert list(both.columns) == ["k2", "k3", "n", "v"]
    t = GroupedFrame(df, "k1")["n"].transform("sum").select("rid", "n_sum").toPandas().sort_values("rid")
    np.testing.assert_array_equal(t["n_sum"], pdf.groupby("k1")["n"].transform("sum"))
    applied = g.apply(lambda x: x.head(1)[["k2", "k3"]], "k2 long, k3 long")
    assert applied.count() == g.ngroups() == g.size().count()
    assert supports(df, ["k1", "k2"], "v", "sum") and not supports(df.withColumn("k1", F.col("k1").cast("string")), "k1", "v", "sum")


def test_attach_is_idempotent(mixed):
    _, df = mixed
    tallyfold.attach(), tallyfold.attach()
    assert tallyfold.is_attached() and df.grouped("k1")["v"].sum().count() > 0
    tallyfold.detach(), tallyfold.detach()
    assert not tallyfold.is_attached()


def test_plan_is_partial_pruned_and_single_shuffle(spark, sf_dir):
    from tallyfold.plans.report import explain, profile

    df = groupby_agg(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", "l_quantity", "sum", sort=None)
    text = explain(df)
    assert "partial_sum" in text and text.count("Exchange (") <= 2 and "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in text
    found = profile(df)
    assert found["final_groups"] == df.count() and found["partial_groups"] >= found["final_groups"]


def test_row_order_of_files(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pdf = df.toPandas()
    got = groupby_agg(df, "l_suppkey", "l_quantity", "sum", sort=False).toPandas()
    assert list(got["l_suppkey"]) == list(pdf["l_suppkey"].drop_duplicates())
    df.limit(500).repartition(3).write.parquet(str(tmp_path / "parts"))
    many = spark.read.parquet(str(tmp_path / "parts"))
    assert groupby_agg(many, "l_suppkey", "l_quantity", "count", sort=False).count() == many.select("l_suppkey").distinct().count()


def test_key_names_may_be_those_used_inside(spark):
    pdf = pd.DataFrame({"value": [1, 1, 2, 2], "n": [1, 1, 1, 1], "part": [0, 0, 0, 0], "v": [3, 5, 7, 9]})
    df = from_pandas(spark, pdf)
    keys = ["value", "n", "part"]
    for agg, limit in (("prod", 10), ("median", 10), ("median", 0), ("sum", 10)):
        got = to_series(groupby_agg(df, keys, "v", agg, max_group_rows=limit), "v")
        pd.testing.assert_series_equal(got, expected(pdf, keys, "v", agg))
