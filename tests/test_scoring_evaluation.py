"""Scores, selections and statistics."""

import math
import random
import signal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from patternlake.functions import stats, text
from patternlake.operators import evaluation, evidence, scoring


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(["a"], 3, 4, 4, 10), (["b"], 2, 2, 4, 10), (["z"], 0, 0, 4, 10)], "items array<string>, pos long, cnt long, npos long, n long")


def test_lifts_differ(table):
    got = table.select("items", scoring.lift_pos().alias("p"), scoring.lift_ratio().alias("r"), scoring.lift_eps().alias("e"), scoring.lift_table().alias("t"), scoring.lift_rate().alias("c")).collect()
    a, b, z = got
    assert math.isclose(a["p"], 1.875) and math.isclose(a["r"], 4.5) and math.isclose(a["c"], 1.875)
    assert math.isclose(a["t"], 0.751 / (0.167 + 0.001))
    assert b["r"] == math.inf and math.isclose(b["e"], 0.5e9, rel_tol=1e-6) and math.isclose(b["p"], 2.5)
    assert z["p"] is None and z["c"] == 0.0


def test_contingency_and_flags(spark):
    t = spark.createDataFrame([(["a", "b"], 1, 3), (["a"], 0, 5), (["b"], 0, 2)], "items array<string>, label int, weight long")
    s = spark.createDataFrame([(["a"],), (["a", "b"],), (["q"],)], "items array<string>")
    got = {tuple(r["items"]): (r["pos"], r["cnt"], r["npos"], r["n"]) for r in scoring.contingency(s, t).collect()}
    assert got == {("a",): (3, 8, 3, 10), ("a", "b"): (3, 3, 3, 10), ("q",): (0, 0, 3, 10)}
    r = scoring.flag_rates(s.where(F.size("items") == 2), t).first()
    assert (r["coverage"], r["false_rate"]) == (1.0, 0.0)


def test_library_orders_and_cuts(table):
    got = scoring.library(table, k=8, sup=0.1, lift=2.0).orderBy("rank").collect()
    assert [r["items"] for r in got] == [["b"], ["a"]]
    assert scoring.library(table, k=1).count() == 1
    grid = scoring.library_grid(table, [2.0, 5.0], [0.1])
    assert sorted((r["min_lift"], r["rank"]) for r in grid.collect()) == [(2.0, 1), (2.0, 2), (5.0, 1)]
    assert [r["items"] for r in scoring.truth(table, 2, 0.9).collect()] == [["b"]]


def calls(spark):
    ok = '{"diagnosis": " Anomalous", "cited_patterns": ["p1 ", "x"], "reason": ""}'
    rows = [
        ("m", "nolib", "1", "g", "anomalous", "nothing to see"),
        ("m", "lib", "1", "g", "anomalous", "```json\n" + ok + "\n```"),
        ("m", "nolib", "2", "g", "normal", ok),
        ("m", "lib", "2", "g", "normal", '{"diagnosis": "normal", "cited_patterns": ["p1"]}'),
        ("m", "lib", "3", "g", "normal", "__ERROR__ timeout"),
        ("m", "lib", "4", "g", "normal", '{"a": 1} and {"b": 2}'),
        ("m", "lib", "5", "g", "normal", None),
    ]
    return spark.createDataFrame(rows, "model string, cond string, case_key string, grp string, truth string, reply string")


def test_facts_and_faithfulness(spark):
    lib = spark.createDataFrame([("p1",)], "pattern string")
    rows = evaluation.facts(calls(spark), lib)
    got = {(r["cond"], r["case_key"]): (r["parsed"], r["correct"], r["n_cited"], r["n_valid"]) for r in rows.collect()}
    assert got == {("nolib", "1"): (False, False, 0, 0), ("lib", "1"): (True, True, 2, 1), ("nolib", "2"): (True, False, 2, 1), ("lib", "2"): (True, True, 1, 1), ("lib", "4"): (False, False, 0, 0)}
    assert evaluation.facts(calls(spark), lib, unparsed="drop").count() == 3
    f = evaluation.faithfulness(rows.where("cond = 'lib'"), ["model"]).first()
    assert (f["by_citation"], f["by_reply"]) == (2 / 3, 0.5)
    assert evaluation.hallucination(rows, ["model"], F.col("cond") == "nolib").first()["rate"] == 0.5
    p = evaluation.paired(rows, "nolib", "lib", ["model"]).first()
    assert (p["n_paired"], p["b"], p["c"]) == (2, 2, 0)
    assert evaluation.false_positives(rows, ["cond"]).where("cond = 'lib'").first()["fp"] == 1


def test_statistics(spark):
    low, high = stats.wilson(F.lit(161), F.lit(198))
    one = spark.range(1)
    r = one.select(low.alias("l"), high.alias("h"), stats.mcnemar_chi2(F.lit(55), F.lit(9)).alias("x"), stats.mcnemar_chi2(F.lit(0), F.lit(0)).alias("z"), stats.wilson(F.lit(0), F.lit(0))[0].alias("none")).first()
    assert (round(r["l"], 4), round(r["h"], 4), round(r["x"], 3), r["z"], r["none"]) == (0.7531, 0.8613, 31.641, 0.0, None)
    p = one.select(stats.mcnemar_exact_p(F.lit(5), F.lit(1)), stats.mcnemar_exact_p(F.lit(0), F.lit(0)), stats.chi2_p(F.lit(3.841))).first()
    assert math.isclose(p[0], 14 / 64) and p[1] == 1.0 and math.isclose(p[2], 0.05, abs_tol=1e-3)


@pytest.fixture
def minute():
    """Ends a test that takes longer."""

    def late(*_):
        raise TimeoutError("over a minute")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(60)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


def test_exact_test_of_many_pairs(minute):
    """Whole numbers where those are quick; of millions the normal tail with continuity correction, which is near to it then."""
    p = lambda rows: list(stats.mcnemar_exact_p.func(*map(pd.Series, zip(*rows))))
    few = [(b, n - b) for n in (999, 1000, 1001, 1002, 4001) for b in (n // 2, n // 2 - 3, n // 2 + 40, n // 3)]
    want = [min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) for b, c in few]
    assert all(math.isclose(x, y, rel_tol=1e-13) for x, y in zip(p(few), want))
    many = [(1_000_000, 1_002_000), (300_500_000, 300_480_000), (5, 3_000_000_000), (2_000_000, 2_000_000)]
    got = p(many)
    assert all(math.isclose(x, math.erfc((abs(b - c) - 1) / math.sqrt(2 * (b + c))), rel_tol=1e-5) for x, (b, c) in zip(got[:2], many))
    assert got[2:] == [0.0, 1.0]


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert [round(r["p_holm"], 9) for r in stats.holm(df, "p", key=["k"]).orderBy("k").collect()] == [0.03, 0.06, 0.06]


def test_prompt_and_replay(spark):
    df = spark.createDataFrame([("ctx", ["a=1", "b=2"])], "c string, w array<string>")
    lib = F.array(F.struct(F.lit("a=1").alias("pattern"), F.lit(0.5).alias("sup_anom"), F.lit(float("inf")).alias("lift")))
    prompt = df.select(text.render_prompt(F.col("c"), F.col("w"), lib).alias("prompt"))
    said = prompt.first()["prompt"]
    assert "a=1, b=2" in said and "only in anomalous windows" in said
    import pandas as pd

    client = evidence.replay(pd.DataFrame({"prompt": [said], "reply": ["yes"]}))
    assert evidence.call(prompt, client).first()["reply"] == "yes"
    assert evidence.call(prompt.withColumn("prompt", F.lit("?")), client).first()["reply"].startswith("__ERROR__")


def test_controls_and_splits():
    a, b = evidence.split_halves([f"r{i}" for i in range(9)], 7)
    assert len(a) == 4 and not set(a) & set(b) and (a, b) == evidence.split_halves([f"r{i}" for i in range(9)], 7)
    got = evidence.random_patterns(["a", "b", "c", "d", "e"], 1)
    assert len(got) == 8 and all(2 <= len(set(p)) <= 4 for p in got)


def test_random_sets_are_those_of_the_list(spark):
    items = [f"i{k:02d}" for k in range(37)]
    df = spark.createDataFrame([(x,) for x in items[::-1] * 3] + [(None,)], "item string").repartition(5)
    for seed in (1, 42):
        got = {r["draw"]: r["items"] for r in evidence.random_sets(df, seed).collect()}
        assert [got[d] for d in range(8)] == evidence.random_patterns(items, seed)
    assert evidence.random_sets(df.limit(0), 1).collect() == []
    one = evidence.random_sets(df.where("item = 'i03'"), 1).collect()
    assert len(one) == 8 and all(r["items"] == ["i03"] for r in one)


@pytest.mark.parametrize("balanced", [False, True])
def test_drawn_cases_are_those_of_the_generator(spark, balanced):
    """The same cases in the same order as a generator draws from lists, with classes too small for the draw and a null group."""
    rng = random.Random(3)
    rows = [(g, t, k) for k, (g, t) in enumerate((rng.choice(["g1", "g2", "g3"]), rng.choice(["normal", "normal", "anomalous"])) for _ in range(300))]
    rows = [r for r in rows if r[0] != "g3" or r[1] == "normal" or r[2] % 10 == 0] + [(None, "normal", 900), ("g1", "other", 901)]
    df = spark.createDataFrame(rows, "grp string, truth string, case_key long").repartition(6)
    want, r = [], random.Random(7)
    for g in ("g1", "g2", "g3"):
        lists = [sorted(k for a, b, k in rows if (a, b) == (g, t)) for t in ("normal", "anomalous")]
        need = min(20, *map(len, lists)) if balanced else 20
        if balanced:
            r = random.Random(f"{g}|7")
        want += [k for x in lists for k in r.sample(x, min(need, len(x)))]
    got = evidence.draw_cases(df, 20, 7, balanced=balanced).orderBy("pick").collect()
    assert [x["case_key"] for x in got] == want and [x["pick"] for x in got] == list(range(len(want)))
    assert evidence.draw_cases(df.limit(0), 20, 7, balanced=balanced).collect() == []


def test_runs(spark):
    df = spark.createDataFrame([("d", e, float(v)) for e, vs in (("x", (4, 2, 6)), ("y", (1, 1, 4))) for v in vs], "dataset string, engine string, secs double")
    s = evaluation.run_summary(df, ["dataset", "engine"], "secs")
    assert s.where("engine = 'x'").first()["median"] == 4.0
    assert evaluation.speedup(s, ["dataset"], "engine", "x", "y").first()["speedup"] == 4.0


def test_pattern_text(spark):
    r = spark.createDataFrame([(["b", "a"],)], "i array<string>").select(text.pattern_text(F.col("i")).alias("t"))
    assert r.first()["t"] == "a & b"
    assert r.select(text.pattern_items(F.col("t"))).first()[0] == ["a", "b"]
