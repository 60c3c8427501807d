"""Conditional groups, prefix trees and the frontier against brute force."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patternlake.operators import conditional, frontier, itemsets, transactions

BIG = 3_000_000_000


def weighted(seed, n=60, items=9, weights=(1, 2, 5)):
    rng = np.random.default_rng(seed)
    return [(sorted(rng.choice(items, size=rng.integers(0, items - 1), replace=False).tolist()), int(rng.choice(weights))) for _ in range(n)]


def brute(rows, least):
    items, out = sorted({x for r, _ in rows for x in r}), {}
    for k in range(1, len(items) + 1):
        level = {s: n for s in combinations(items, k) if (n := sum(w for r, w in rows if set(s) <= set(r))) >= least}
        out |= level
    return out


def brute_maximal(f):
    return {s: n for s, n in f.items() if not any(set(s) < set(t) for t in f)}


def as_dict(df):
    rows = df.collect()
    out = {tuple(r["items"]): r["support"] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("weights", [(1,), (1, 2, 5), (1, BIG)])
def test_group_miners_like_brute_force(weights):
    for seed in range(25):
        rows, least = weighted(seed, 15, 8, weights), int(np.random.default_rng(seed).integers(1, 12))
        f = brute(rows, least)
        frame = pd.DataFrame({"prefix": [np.array(r, np.int64) for r, _ in rows], "weight": [w for _, w in rows]})
        named = lambda names, sets: {tuple(names[k] for k in conditional.bits(m)): n for m, n in sets if m}
        assert named(*conditional.tree_miner(conditional.fpmax)(frame, least)[:2]) == brute_maximal(f)
        assert named(*conditional.tree_miner(conditional.fpgrowth)(frame, least)[:2]) == f
        names, prefixes, weight = conditional.trimmed(frame, least)
        for wave in (1, 1 << 25):
            assert named(names, frontier.Frontier(frontier.packed(prefixes, len(names)), weight, least, wave).mine()) == brute_maximal(f)


def test_steps_of_the_frontier():
    """Waves of nodes take fewer than a tenth of the steps of one node at a time, for the same sets."""
    rng = np.random.default_rng(1)
    prefixes = [np.flatnonzero(rng.random(24) < 0.5) for _ in range(600)]
    bitmaps, weight = frontier.packed(prefixes, 24), rng.integers(1, 4, 600)
    one, many = frontier.Frontier(bitmaps, weight, 40, wave_bytes=1), frontier.Frontier(bitmaps, weight, 40)
    assert sorted(one.mine()) == sorted(many.mine()) and many.steps * 10 < one.steps and one.wave == 1


@pytest.mark.parametrize("cells", [conditional.GROUP_CELLS, 40, 1])
@pytest.mark.parametrize("inline", [conditional.INLINE_ITEMS, 0])
def test_split_groups(spark, monkeypatch, cells, inline):
    """Groups that are split by their second and later items give the same sets."""
    monkeypatch.setattr(conditional, "INLINE_ITEMS", inline)
    rows = weighted(5)
    t = spark.createDataFrame([(r[::-1] + r[:1], w) for r, w in rows], "items array<int>, weight long")  # unsorted, with an item twice
    f = brute(rows, 12)
    assert as_dict(conditional.maximal_fpmax(t, 12, cells)) == brute_maximal(f)
    assert as_dict(conditional.frequent_conditional(t, 12, cells)) == f
    assert as_dict(frontier.maximal_frontier(t, 12, cells).select("items", "support")) == brute_maximal(f)


def test_groups_are_bounded(spark):
    t = spark.createDataFrame(weighted(6, 200), "items array<int>, weight long")
    rows, _ = conditional.coded(t, 10)
    dealt, split = conditional.groups(rows, 10, 60)
    sizes = dealt.groupBy("head").agg(F.sum(F.size("prefix") + 1).alias("cells"), F.max(F.size("prefix")).alias("longest")).collect()
    assert all(r["cells"] <= 60 or r["longest"] == 0 for r in sizes) and split.count() > 0
    assert dealt.join(split.select(F.col("ids").alias("head")), "head", "left_semi").isEmpty()


@pytest.mark.parametrize("strategy", ["fpmax", "vertical", "fpgrowth"])
def test_large_weights(spark, strategy):
    """A weight is no number of rows."""
    t = spark.createDataFrame([(["a", "b"], BIG), (["b", "c"], BIG), (["b"], 1), ([], BIG)], "items array<string>, weight long")
    assert as_dict(itemsets.mine(t, BIG, "maximal", strategy)) == {("a", "b"): BIG, ("b", "c"): BIG}
    assert as_dict(itemsets.mine(t, 2 * BIG + 1, "maximal", strategy)) == {("b",): 2 * BIG + 1}


def test_frontier_budget(spark):
    t = spark.createDataFrame(weighted(7, 80, 12), "items array<int>, weight long")
    assert {r["complete"] for r in frontier.maximal_frontier(t, 3, wave_bytes=1, max_nodes=1).collect()} <= {False}
    assert {r["complete"] for r in frontier.maximal_frontier(t, 3, max_nodes=10**6).collect()} == {True}


def test_dense_ids(spark):
    t = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), (F.col("id") % 3).alias("y")).repartition(5)
    got = transactions.dense_ids(t, [F.desc("y"), "x"], "n", 1).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 1001)) and [(-r["y"], r["x"]) for r in got] == sorted((-r["y"], r["x"]) for r in got)
    assert transactions.dense_ids(t.limit(0), ["x"], "n").count() == 0


def test_plan_has_no_large_broadcast(spark):
    """No data goes through the driver: nothing is collected into a broadcast but names of items."""
    t = spark.createDataFrame(weighted(5), "items array<int>, weight long")
    plan = conditional.maximal_fpmax(t, 12)._jdf.queryExecution().toString()
    assert "collect_set" not in plan
