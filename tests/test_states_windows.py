"""Edges, bins, windows: small fixtures that each pin one rule."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patternlake.functions import features
from patternlake.functions.states import bin_index, fit_edges, item, itemize, select_channels, with_states
from patternlake.operators import windows


def edges_of(spark, values, **kw):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return fit_edges(df, ["x"], **kw).first()["x"]


def test_quantile_edges_like_numpy(spark):
    v = np.random.default_rng(0).normal(size=101)
    assert np.allclose(edges_of(spark, v.tolist()), np.quantile(v, [0, 1 / 3, 2 / 3, 1]))


def test_constant_channel(spark):
    assert edges_of(spark, [4.0, 4.0]) == [3.5, 4.5]
    assert edges_of(spark, [4.0, 4.0], method="width") == [3.5, 4.5]


def test_repeated_edges_make_fewer_bins(spark):
    assert len(edges_of(spark, [1.0] * 8 + [2.0, 3.0])) == 2


def test_nulls_and_sketch(spark):
    assert edges_of(spark, [None, 1.0, 2.0, 3.0, 4.0]) == [1.0, 2.0, 3.0, 4.0]
    assert edges_of(spark, [1.0, 2.0, 3.0, 4.0], accuracy=1000)[0] == 1.0


@pytest.mark.parametrize(("value", "state"), [(0.5, 0), (1.0, 0), (2.0, 1), (2.5, 1), (3.0, 2), (4.0, 2), (9.0, 2), (None, None)])
def test_bin_index(spark, value, state):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(bin_index(F.col("v"), F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0])))).first()[0] == state


def test_items(spark):
    df = spark.createDataFrame([(1, None, 0)], "a int, b int, c int")
    got = df.select(itemize([item("a [K]", F.col("a")), item("b", F.col("b")), item("a", F.col("a")), item("c", F.col("c"))])).first()[0]
    assert got == ["a=1", "c=0"]  # null: no item; equal names: one item; the unit goes


def test_edges_by_group(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(4)] + [("b", float(10 * i)) for i in range(4)], "g string, x double")
    out = with_states(df, fit_edges(df, ["x"], by=["g"]), ["x"], ["g"])
    assert [r["x"] for r in out.orderBy("g").collect()].count(2) == 4


@pytest.mark.parametrize(("held", "sketch", "n"), [(100_000, 10_000, 1), (100_000, 10_000, 30_000), (300, 100, 30_000)])
def test_exact_edges_like_numpy(spark, monkeypatch, held, sketch, n):
    """Normal, tied, heavy-tailed and spiked channels; also where bounds must be narrowed first."""
    from patternlake.functions import states

    monkeypatch.setattr(states, "COUNTED", -1)  # by sketches
    monkeypatch.setattr(states, "HELD", held)
    monkeypatch.setattr(states, "SKETCH", sketch)
    rng = np.random.default_rng(n)
    frame = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": rng.zipf(1.5, n).astype(float), "d": np.where(rng.random(n) < 0.4, 3.0, rng.random(n))})
    got = states.exact_edges(spark.createDataFrame(frame).repartition(3), list("abcd"), 4)
    for c in "abcd":
        want = np.unique(np.quantile(frame[c], np.arange(5) / 4))
        assert np.allclose(got[c], want if len(want) > 1 else [want[0] - 0.5, want[0] + 0.5], rtol=1e-12)


def test_edges_of_nothing(spark):
    df = spark.createDataFrame([(None, float("nan"), 1.0)], "a double, b double, c double")
    e = fit_edges(df, ["a", "b", "c"])
    assert tuple(e.first()) == (None, None, [0.5, 1.5])
    assert tuple(with_states(df, e, ["a", "b", "c"]).first()) == (None, None, 0)


def test_select_channels(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 1.0, -5.0), (9.0, 1.1, 0.0)], "a double, b double, c double")
    assert [r["channel"] for r in select_channels(df, ["a", "b", "c"]).collect()] == ["a", "c"]


@pytest.mark.parametrize(("n", "size", "hop"), [(86, 30, 15), (29, 30, 15), (30, 30, 15), (45, 15, 7), (10, 3, 3), (7, 2, 5), (0, 3, 1)])
def test_count_windows(spark, n, size, hop):
    df = spark.createDataFrame([("u", i, float(i)) for i in range(n)], "u string, i int, x double")
    got = windows.count_windows(df, ["u"], ["i"], size, hop, [F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("n")])
    want = [(k, s, s + size - 1, size) for k, s in enumerate(range(0, n - size + 1, hop))]
    assert sorted((r["win"], r["lo"], r["hi"], r["n"]) for r in got.collect()) == want


def test_window_transactions_label_and_null(spark):
    df = spark.createDataFrame([("u", i, float(i), None, int(i == 3)) for i in range(6)], "u string, i int, x double, y double, label int")
    out = windows.window_transactions(df, ["u"], ["i"], ["x", "y"], fit_edges(df.withColumn("y", F.lit(1.0)), ["x", "y"]), 2, 2, "label").orderBy("win").collect()
    assert [r["label"] for r in out] == [0, 1, 0]
    assert all(len(r["items"]) == 1 for r in out)


def test_tail_segments_guard_prefixes(spark):
    df = spark.createDataFrame([("u", i) for i in range(1, 21)], "u string, c int")
    assert windows.tail_label(df, ["u"], "c").agg(F.sum("label")).first()[0] == 3
    w = df.withColumn("w", F.col("c") - 1)
    assert [r["count"] for r in windows.segments(w, ["u"], "w").groupBy("segment").count().orderBy("segment").collect()] == [4] * 5
    assert {r["part"]: r["count"] for r in windows.guard_split(w, "w", 10, 2).groupBy("part").count().collect()} == {"fit": 8, "test": 8}
    got = {r["fraction"]: r["count"] for r in windows.prefixes(df, [F.col("c")], [0.01, 0.125, 1.0]).groupBy("fraction").count().collect()}
    assert got == {0.01: 1, 0.125: 2, 1.0: 20}


@pytest.mark.parametrize("by", [None, ["g"]])
def test_position(spark, by):
    rows = [("a" if i % 3 else "b", (i * 7) % 101) for i in range(101)]
    got = windows.position(spark.createDataFrame(rows, "g string, x int").repartition(5), [*(by or []), "x"], by).collect()
    groups = {g: sorted(x for k, x in rows if k == g) for g in "ab"} if by else {None: sorted(x for _, x in rows)}
    assert all(groups[r["g"] if by else None][r["seq"]] == r["x"] for r in got) and len(got) == 101
    assert windows.position(spark.createDataFrame([], "g string, x int"), ["x"]).collect() == []


def test_long_units_give_the_same_windows(spark):
    df = spark.createDataFrame([("uv"[i % 2], (i * 37) % 83, float(i)) for i in range(83)], "u string, i int, x double").repartition(4)
    aggs = [F.sum("x").alias("x"), F.min("i").alias("i"), F.count("*").alias("n")]
    plain, spread = (sorted(map(tuple, windows.count_windows(df, ["u"], ["i"], 10, 4, aggs, k).collect())) for k in (False, True))
    assert plain == spread and len(plain) > 10


def test_shared_folders(spark, tmp_path):
    from patternlake import session

    kept = getattr(spark.sparkContext, "_patternlake_paths", [])
    spark.sparkContext._patternlake_paths = []
    df = session.cut(spark.range(3), "gone")
    assert df.count() == 3 and session.clear_shared(spark) == 1 and session.clear_shared(spark) == 0
    spark.sparkContext._patternlake_paths = kept

    class Cluster:
        master = "spark://host:7077"

    class Small:
        master = "local-cluster[2,1,1024]"

    class Remote:
        sparkContext = Cluster()

        class conf:
            get = staticmethod(lambda key, default: default)

    for context in (Cluster(), Small()):
        Remote.sparkContext = context
        with pytest.raises(ValueError, match="share"):
            session.shared_path(Remote(), "x")


def test_carry_forward(spark):
    df = spark.createDataFrame([(0, None), (1, 5), (2, None), (3, 7)], "n int, v int")
    assert [r["o"] for r in windows.carry_forward(df, ["n"], "v", "o").orderBy("n").collect()] == [None, 5, 5, 7]


@pytest.mark.parametrize("unit", [None, ["u"]])
def test_carry_forward_over_ranges(spark, unit):
    """Values go on over ranges without any, in units of any size, null being one."""
    rng = np.random.default_rng(2)
    rows = [([None, "a", "b"][k % 3 if k < 30 else 1], k, int(rng.integers(9)) if rng.random() < 0.02 or k == 40 else None) for k in range(400)]
    got = windows.carry_forward(spark.createDataFrame(rows, "u string, n int, v int").repartition(7), ["n"], "v", "o", unit).collect()
    want, last = {}, {}
    for u, n, v in rows:
        key = u if unit else 0
        last[key] = v if v is not None else last.get(key)
        want[n] = last[key]
    assert {r["n"]: r["o"] for r in got} == want and len(got) == 400
    assert windows.carry_forward(spark.createDataFrame([], "u string, n int, v int"), ["n"], "v", "o", unit).collect() == []


def test_units_that_are_null(spark):
    """A null unit is a unit: in life shares, segments and numbering by ranges."""
    df = spark.createDataFrame([(u, k) for u in (None, "a") for k in range(20)], "u string, k int")
    assert {r["u"]: r["n"] for r in windows.tail_label(df, ["u"], "k").groupBy("u").agg(F.sum("label").alias("n")).collect()} == {None: 3, "a": 3}
    assert windows.segments(df, ["u"], "k").groupBy("segment").count().where("count = 8").count() == 5
    aggs = [F.sum("k").alias("k"), F.count("*").alias("n")]
    plain, spread = (sorted(map(str, windows.count_windows(df, ["u"], ["k"], 5, 3, aggs, how).collect())) for how in (False, True))
    assert plain == spread and len(plain) == 12


def test_edges_where_the_sketch_is_wrong(spark, monkeypatch):
    """A rank outside of the sketch's bounds is counted instead; no error."""
    from patternlake.functions import states

    df = spark.createDataFrame([(float(x),) for x in np.random.default_rng(6).normal(size=500)], "x double")
    want = states.exact_edges(df, ["x"], 3)
    monkeypatch.setattr(states, "COUNTED", -1)
    monkeypatch.setattr(states, "_ranked", lambda *a: None)
    assert states.exact_edges(df, ["x"], 3) == want


def test_features_like_pandas(spark):
    v = [1.0, 2.0, 2.5, 9.0, -1.0, 0.0, 3.0]
    row = spark.createDataFrame([(x,) for x in v], "x double").agg(features.rms("x"), features.kurtosis_unbiased("x"), features.peak_to_peak("x")).first()
    assert np.allclose(row, [np.sqrt(np.mean(np.square(v))), pd.Series(v).kurt(), 10.0])
    few = spark.createDataFrame([(1.0,), (2.0,)], "x double").agg(features.kurtosis_unbiased("x")).first()
    assert few[0] is None


def test_counted_edges_are_the_sketched_ones(spark, monkeypatch):
    """Counting by value and bounding by sketches give the same edges, with ties, nulls, NaN and channels without values."""
    from patternlake.functions import states

    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(0, 5)), float(rng.normal()), None, 2.0, float("nan") if k % 3 else float(k)) for k in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    counted = states.exact_edges(df, ["a", "b", "c", "d", "e"], 4)
    monkeypatch.setattr(states, "COUNTED", -1)
    assert counted == states.exact_edges(df, ["a", "b", "c", "d", "e"], 4)
    values = np.array([r[1] for r in rows])
    assert np.allclose(counted["b"], np.quantile(values, [0, 0.25, 0.5, 0.75, 1])) and counted["c"] is None and counted["d"] == [1.5, 2.5]
