"""Readers, writers, online states and streams."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternlake.functions import text
from patternlake.operators import online
from patternlake.sources import readers, writers
from patternlake.streaming import states


def test_sensor_csv(spark, tmp_path):
    for name, rows in (("10.csv", "2020-01-01 00:00:02;2;1\n2020-01-01 00:00:01;1;0\n"), ("2.csv", "2020-01-01 00:00:00;5;0\n")):
        p = tmp_path / "valve" / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("datetime;x;anomaly\n" + rows)
    df = readers.sensor_csv(spark, str(tmp_path), "datetime timestamp, x double, anomaly int", "datetime", "anomaly", ["datetime"])
    assert [(r["run_id"], r["seq"], r["x"], r["label"]) for r in df.orderBy("run_id", "seq").collect()] == [("10.csv", 0, 1.0, 0), ("10.csv", 1, 2.0, 1), ("2.csv", 0, 5.0, 0)]
    assert [r["x"] for r in readers.raw_concat(df).orderBy("seq").collect()] == [1.0, 2.0, 5.0]
    spec = spark.createDataFrame([("valve", "2.csv", "leak")], "grp string, run_id string, cls string")
    assert [r["cls"] for r in readers.with_classes(df, spec).collect()] == ["leak"]


def test_turbofan(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 1  0.5 0.1 100 1.0 2.0  \n1 2 0.5 0.1 100 1.5 x\n\n")
    df = readers.turbofan(spark, str(tmp_path / "t.txt"), 3, 3).orderBy("cycle").collect()
    assert (df[0]["unit"], df[0]["op3"], df[0]["s2"], df[0]["s3"]) == (1, 100.0, 2.0, None)
    assert df[1]["s2"] is None


def test_transactions_text(spark, tmp_path):
    (tmp_path / "t").write_text("3 1 1 -2\n\n 5 x\n9")
    rows = lambda **kw: sorted(r["items"] for r in readers.transactions_text(spark, str(tmp_path / "t"), **kw).collect())
    assert rows() == [[], [1, 3], [5], [9]]  # the last line counts without a line end
    assert rows(keep_empty=False, shift=-1) == [[0, 2], [4], [8]]
    df = spark.createDataFrame([([3, 1, 1],), ([],)], "items array<int>")
    writers.transactions_text(df, str(tmp_path / "o"))
    assert sorted(r["items"] for r in readers.transactions_text(spark, str(tmp_path / "o")).collect()) == [[], [1, 3]]


def test_results_round_trip(spark, tmp_path):
    sets = spark.createDataFrame([([1, 4], 7), ([2], 9)], "items array<int>, support long")
    writers.results_text(sets, 10, str(tmp_path / "r"))
    back = readers.results_text(spark.read.text(str(tmp_path / "r")))
    assert {tuple(r["items"]): r["support"] for r in back.collect()} == {(1, 4): 7, (2,): 9}
    (tmp_path / "s.txt").write_text("head\nStage 1: x\n1th: 1 { 2 } support: 0.9 frequency: 9\nStage 2\n1th: 2 { 4 1 } support: 0.7 frequency: 7\n")
    got = readers.stage_results_text(readers.numbered_lines(spark, str(tmp_path / "s.txt"))).collect()
    assert sorted((r["stage"], r["items"], r["support"]) for r in got) == [(1, [2], 9), (2, [1, 4], 7)]
    for w in (lambda p: writers.sets_semicolon(sets, p), lambda p: writers.sets_ratio(sets, 10, p)):
        w(str(tmp_path / "w"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "w")).collect()) == ["1 4 (0.7)", "2 (0.9)"]


def test_fixed_decimals(spark):
    """640ths have seven decimals that end in 5: printf goes by their binary value."""
    x = F.col("id") / 640
    got = spark.range(640).select(x.alias("x"), text.fixed(x, 6).alias("line")).collect()
    assert [r["line"] for r in got] == [f"{r['x']:.6f}" for r in got]
    assert spark.range(1).select(text.fixed(F.lit(0.0853625), 6), text.fixed(F.lit(1.0), 6), text.fixed(F.lit(1234.5), 1)).first()[:] == ("0.085362", "1.000000", "1234.5")


def test_dictionary_labels_checksums(spark, tmp_path):
    words = spark.createDataFrame([("a=0", 1), ("b=1", 2)], "item string, item_id int")
    writers.dictionary_json(words, str(tmp_path / "d"))
    assert sorted(tuple(r) for r in readers.dictionary_json(spark, str(tmp_path / "d")).collect()) == [("a=0", 1), ("b=1", 2)]
    (tmp_path / "l.json").write_text(json.dumps(["0", "1"]))
    assert [tuple(r) for r in readers.labels_json(spark, str(tmp_path / "l.json")).collect()] == [(0, "0"), (1, "1")]
    assert readers.checksums(spark, str(tmp_path / "l.json")).first()["bytes"] == 10
    assert readers.settings("# c\nA = 'x'\nB=2") == {"A": "x", "B": "2"}


def test_run_log(spark):
    lines = spark.createDataFrame([("a", "counting: 12.5 ms"), ("a", "MATCH"), ("a", "x"), ("b", "sort = 3 ms"), ("b", "MISMATCH")], "file string, value string")
    assert sorted(tuple(r) for r in readers.run_log(lines).collect()) == [("a", "counting", 12.5, True), ("b", "sort", 3.0, False)]


def test_log_appends_once(spark, tmp_path):
    rows = spark.createDataFrame([("m", "lib", "1", "g", "t", "r"), ("m", "lib", "1", "g", "t", "r"), ("m", "lib", "2", "g", "t", "__ERROR__")], readers.CALLS)
    path = str(tmp_path / "log")
    assert writers.append_new(rows, path, ["model", "cond", "case_key"]) == 2
    assert writers.append_new(rows, path, ["model", "cond", "case_key"]) == 0
    assert readers.call_log(spark, path).count() == 1


def mat(name, values, packed):
    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", 1, len(values))) + element(1, name.encode()) + element(9, np.array(values, "<f8").tobytes())
    whole = element(14, body)
    if packed:
        z = zlib.compress(whole)
        whole = struct.pack("<II", 15, len(z)) + z
    return b"MATLAB 5.0".ljust(124) + b"\x00\x01IM" + whole


@pytest.mark.parametrize("packed", [False, True])
def test_signals(spark, tmp_path, packed):
    (tmp_path / "a.mat").write_bytes(mat("X097_DE_time", [1.0, 2.5], packed))
    (tmp_path / "bad.mat").write_bytes(b"nothing")
    got = readers.signals(spark, str(tmp_path)).collect()
    assert [(r["file"], r["channel"], r["samples"]) for r in got] == [("a.mat", "X097_DE_time", [1.0, 2.5])]


ONE = np.zeros(1, np.int64)


def fed(values, bins, mode="textbook"):
    m = online.Quantiles(1, bins, mode)
    for v in values:
        m.add(ONE, np.array([[float(v)]]))
    return m


def test_textbook_markers_converge():
    x = np.random.default_rng(0).normal(size=5000)
    assert np.allclose(fed(x, 3).values(ONE)[0, 0], np.quantile(x, [1 / 3, 2 / 3]), atol=0.05)
    assert fed([], 2).values(ONE).ravel().tolist() == [0.0] and fed([3.0], 2).values(ONE).ravel().tolist() == [3.0]


def test_published_example():
    """The twenty observations of the P-square paper; its median ends at 4.44."""
    x = [0.02, 0.15, 0.74, 3.39, 0.83, 22.37, 10.15, 15.43, 38.62, 15.92, 34.60, 10.28, 1.47, 0.40, 0.05, 11.39, 0.27, 0.42, 0.09, 11.37]
    assert abs(fed(x, 2).values(ONE)[0, 0, 0] - 4.44) < 0.01


def test_shifted_markers_step_by_step():
    m = fed([5, 1, 4, 2, 3], 2, "shifted")
    assert m.place[0, 0, 0].tolist() == [0.0, 2.0, 3.0, 4.0, 4.0] and m.values(ONE)[0, 0, 0] == 3.0
    m.add(ONE, np.array([[0.0]]))  # lowest: all places advance by one
    assert m.place[0, 0, 0].tolist() == [1.0, 3.0, 4.0, 5.0, 5.0] and m.height[0, 0, 0, 0] == 0.0


@pytest.mark.parametrize("bins", [2, 3, 5])
def test_close_edges_are_pushed_apart(bins):
    e = fed([2.0] * 10, bins).edges(ONE)[0, 0]
    assert len(e) == bins + 1 and (np.diff(e) > 0).all()


@pytest.mark.parametrize("mode", ["textbook", "shifted"])
def test_units_together_are_as_each_alone(mode):
    rng = np.random.default_rng(4)
    rows = {u: rng.normal(size=(rng.integers(3, 60), 2)) for u in range(7)}
    together = online.Windows(2, 8, 4, 3, mode, 7)
    got = []
    for t in range(60):
        units = np.array([u for u in rows if t < len(rows[u])])
        if len(units):
            done, win, states = together.push(units, np.array([rows[u][t] for u in units]))
            got += [(int(units[d]), int(w), *s.tolist()) for d, w, s in zip(done, win, states)]
    want = []
    for u, x in rows.items():
        w = online.Windows(2, 8, 4, 3, mode)
        for row in x:
            kept = online.Windows(2, 8, 4, 3, mode)  # the state passes through plain numbers
            kept.load(w.dump())
            w = kept
            done, win, states = w.push(ONE, row[None, :])
            want += [(u, int(k), *s.tolist()) for k, s in zip(win, states)]
    assert sorted(got) == sorted(want) and got


def test_online_states_batch_equals_stream(spark, tmp_path):
    rows = [("u", i, float((i * 7) % 13), float(i % 5)) for i in range(60)] + [("v", i, float(i % 3), 1.0) for i in range(25)] + [("w", 0, 1.0, None)]
    schema = "unit string, t int, a double, b double"
    df = spark.createDataFrame(rows, schema)
    batch = online.online_states(df, "unit", ["t"], ["a", "b"], 10, 5)
    for k in range(2):
        df.where((F.col("t") >= 30 * k) & (F.col("t") < 30 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = states.stream_states(src, "unit", ["t"], ["a", "b"], 10, 5).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: tuple(r)
    got = sorted(map(key, spark.table("states").collect()))
    assert got == sorted(map(key, batch.collect())) and len(got) == 11 + 4
    shifted = online.online_states(df, "unit", ["t"], ["a", "b"], 10, 5, mode="shifted")
    assert shifted.count() == 15
    with pytest.raises(ValueError, match="gaps"):
        online.online_states(df, "unit", ["t"], ["a"], 5, 6)


def test_units_are_forgotten(spark):
    with pytest.raises(ValueError, match="gaps"):
        states.stream_states(spark.createDataFrame([("u", 0, 1.0)], "unit string, t int, a double"), "unit", ["t"], ["a"], 5, 6)


def test_null_units_and_repeated_orders(spark):
    df = spark.createDataFrame([(None, 0, 1.0)] * 4 + [("u", 0, 2.0)] * 3, "unit string, t int, a double")
    assert sorted(((r["unit"], r["win"]) for r in online.online_states(df, "unit", ["t"], ["a"], 2, 1).collect()), key=repr) == sorted([(None, 0), (None, 1), (None, 2), ("u", 0), ("u", 1)], key=repr)
    assert online.online_states(df.limit(0), "unit", ["t"], ["a"], 2, 1).collect() == []


def test_remine_and_windowed_support(spark, tmp_path):
    """Stages are mined again at each micro-batch; event-time supports close with the watermark."""
    from patternlake.operators import anytime, transactions

    schema = "ts timestamp, items array<string>"
    rows = [(f"2024-01-01 00:{m:02d}:00", x) for m, x in ((0, ["a", "b"]), (1, ["a"]), (2, ["a", "b"]), (7, ["b"]), (30, ["c"]))]
    for k in range(len(rows)):
        spark.createDataFrame([rows[k]], "ts string, items array<string>").selectExpr("cast(ts as timestamp) as ts", "items").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen, mined = [], {}

    def again(batch, k):
        seen.extend(batch.select("items").collect())
        pool = anytime.pools(transactions.compact(spark.createDataFrame(seen, "items array<string>")), 2)
        mined[k] = {(r["stage"], tuple(r["items"]), r["support"]) for r in pool.collect()}

    q = states.remine(stream(), again, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert len(mined) == 5 and mined[4] == {(r["stage"], tuple(r["items"]), r["support"]) for r in anytime.pools(transactions.compact(spark.createDataFrame(seen, "items array<string>")), 2).collect()}
    q = states.windowed_support(stream(), "ts", "5 minutes", "1 minute").writeStream.format("memory").queryName("supports").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"].minute, r["item"], r["support"]) for r in spark.table("supports").collect()}
    assert got == {(0, "a", 3), (0, "b", 2), (5, "b", 1)}
