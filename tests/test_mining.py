"""Mining: every strategy against brute force, and the rules at thresholds and ties."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternlake.operators import anytime, evaluation, itemsets, transactions


def frame(spark, rows):
    return transactions.compact(spark.createDataFrame([(list(r),) for r in rows], "items array<int>"))


def brute(rows, least):
    rows = [frozenset(r) for r in rows]
    items = sorted(set().union(*rows)) if rows else []
    out = {}
    for k in range(1, len(items) + 1):
        for s in combinations(items, k):
            if (n := sum(set(s) <= r for r in rows)) >= least:
                out[s] = n
    return out


def brute_maximal(f):
    return {s: n for s, n in f.items() if not any(set(s) < set(t) for t in f)}


def brute_closed(f):
    return {s: n for s, n in f.items() if not any(set(s) < set(t) and m == n for t, m in f.items())}


def as_dict(df):
    rows = df.collect()
    out = {tuple(r["items"]): r["support"] for r in rows}
    assert len(out) == len(rows)
    return out


ROWS = [[1, 2, 3], [1, 2], [2, 3], [1, 2, 3]]


@pytest.mark.parametrize("strategy", ["powerset", "levelwise", "fpgrowth", "vertical", "partitioned", "auto"])
def test_one_maximal_set(spark, strategy):
    assert as_dict(itemsets.mine(frame(spark, ROWS), 2, "maximal", strategy)) == {(1, 2, 3): 2}


@pytest.mark.parametrize("seed", [0, 1])
def test_strategies_agree(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [sorted(rng.choice(7, size=rng.integers(1, 6), replace=False).tolist()) for _ in range(40)] + [[]]
    t, f = frame(spark, rows), brute(rows, 6)
    for s in ("powerset", "levelwise", "fpgrowth"):
        assert as_dict(itemsets.mine(t, 6, "frequent", s)) == f
    assert as_dict(itemsets.mine(t, 6, "closed", "powerset")) == brute_closed(f)
    for s in ("powerset", "levelwise", "vertical", "partitioned"):
        assert as_dict(itemsets.mine(t, 6, "maximal", s)) == brute_maximal(f)
    every = itemsets.mine(t, 6, "frequent", "powerset")
    assert evaluation.closure_violations(every).isEmpty()
    assert as_dict(itemsets.count_sets(t, every)) == f


def test_boundary_item_stays(spark):
    rows = [[1]] * 5 + [[2, 3]] * 5
    for s in ("powerset", "vertical"):
        assert as_dict(itemsets.mine(frame(spark, rows), 5, "maximal", s)) == {(1,): 5, (2, 3): 5}


def test_min_count_guards_floats():
    assert transactions.min_count(282, 92 / 282) == 92
    assert transactions.min_count(10, 0.0) == 1
    assert transactions.min_count(10, 0.11) == 2


def test_replication(spark):
    four = transactions.replicate(frame(spark, ROWS), 4).groupBy("items").agg(F.sum("weight").alias("weight"))
    assert as_dict(itemsets.mine(four, 8)) == {(1, 2, 3): 8}


@pytest.mark.parametrize("strategy", ["powerset", "levelwise", "vertical", "partitioned", "fpgrowth"])
def test_empty(spark, strategy):
    assert as_dict(itemsets.mine(frame(spark, []), 1, "maximal", strategy)) == {}


def test_budget_marks_results(spark):
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(12, size=8, replace=False).tolist()) for _ in range(60)]
    got = itemsets.maximal_vertical(frame(spark, rows), 2, max_nodes=1).collect()
    assert all(not r["complete"] for r in got)


@pytest.mark.parametrize("width", [18, 30])
def test_one_wide_transaction_takes_few_nodes(width):
    k = itemsets.Kernel(np.ones((1, width), bool), np.array([5]), 1)
    assert k.mine(list(range(width))) == [(tuple(range(width)), 5)] and k.nodes < 100


def test_kernel_like_brute_force():
    """Any order of roots, all at once or each alone; no set twice."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        m, least = rng.random((int(rng.integers(1, 25)), n)) < rng.choice([0.3, 0.6, 0.85]), int(rng.integers(1, 20))
        w = rng.integers(1, 5, len(m))
        rows = [r for x, k in zip(m, w) for r in [np.flatnonzero(x).tolist()] * k]
        want = brute_maximal(brute(rows, least))
        order = rng.permutation(n).tolist()
        found = itemsets.Kernel(m, w, least).mine(order)
        assert dict(found) == want and len(found) == len(want)
        assert {s: c for r in range(n) for s, c in itemsets.Kernel(m, w, least).mine([r])} == want


def test_cut_search_is_seen_without_sets(spark):
    """A task that was stopped before it found anything still says so."""
    rows = [sorted(np.random.default_rng(k).choice(14, size=9, replace=False).tolist()) for k in range(80)]
    got = itemsets.maximal_vertical(frame(spark, rows), 10, max_nodes=1).collect()
    assert any(r["items"] is None and not r["complete"] for r in got)
    whole = itemsets.maximal_vertical(frame(spark, rows), 10).collect()
    assert all(r["complete"] and r["items"] for r in whole)


def test_candidates(spark):
    sets = lambda *x: spark.createDataFrame([(list(s),) for s in x], "items array<int>")
    got = lambda df: sorted(tuple(r["items"]) for r in df.collect())
    assert got(itemsets.candidates(sets([1], [2], [5]))) == [(1, 2), (1, 5), (2, 5)]
    assert got(itemsets.candidates(sets([1, 2], [1, 3], [2, 3], [2, 4]))) == [(1, 2, 3)]  # {2, 3, 4} lacks {3, 4}
    assert got(itemsets.candidates(sets([1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 3, 4], [2, 3, 5]))) == [(1, 2, 3, 4)]
    assert got(itemsets.candidates(sets([1, 2]).limit(0))) == []


def test_levels_resume_and_are_logged(spark):
    rng = np.random.default_rng(8)
    rows = [sorted(rng.choice(9, size=rng.integers(2, 7), replace=False).tolist()) for _ in range(60)]
    t, f, log = frame(spark, rows), brute(rows, 8), []
    every = itemsets.frequent_levelwise(t, 8, log=log)
    assert as_dict(every) == f
    assert [(size, n) for size, _, n in log] == [(k, sum(len(s) == k for s in f)) for k in range(2, max(map(len, f)) + 2)] and all(c >= n for _, c, n in log)
    for upto in (1, 2):
        assert as_dict(itemsets.frequent_levelwise(t, 8, resume=every.where(F.size("items") <= upto))) == f
    assert as_dict(itemsets.frequent_levelwise(t, 8, resume=every)) == f
    assert as_dict(itemsets.frequent_levelwise(t, 8, resume=every.limit(0))) == {}


def test_powerset_refuses_wide_rows(spark):
    wide = frame(spark, [list(range(itemsets.POWERSET_WIDTH + 1))] * 2)
    with pytest.raises(Exception, match="frequent items"):
        itemsets.frequent_powerset(wide, 1).collect()
    assert as_dict(itemsets.frequent_powerset(frame(spark, [list(range(14))] * 2 + [[1, 2]] * 3), 4)) == {(1,): 5, (2,): 5, (1, 2): 5}  # rare items do not count


def test_stages_of_wide_rows(spark):
    rng = np.random.default_rng(5)
    rows = [sorted(rng.choice(16, size=13, replace=False).tolist()) for _ in range(6)]
    pool = anytime.pools(frame(spark, rows), 3)
    for k, sets in anytime.run(frame(spark, rows), 3, "vertical"):
        assert as_dict(pool.where(F.col("stage") == k).select("items", "support")) == as_dict(sets)


def test_contained_by_the_rarest_item(spark):
    t = frame(spark, [[1, 2, 3], [1, 2], [1], [1, 3], []])
    s = spark.createDataFrame([([2, 1],), ([1],), ([3, 9],), ([1, 3],)], "items array<int>")
    got = sorted((tuple(r["want"]), tuple(r["items"])) for r in itemsets.contained(s, t).collect())
    assert got == sorted([((1, 2), (1, 2, 3)), ((1, 2), (1, 2)), ((1, 3), (1, 2, 3)), ((1, 3), (1, 3))] + [((1,), x) for x in ((1, 2, 3), (1, 2), (1,), (1, 3))])


def test_broadcast_is_checked(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "BROADCAST_BYTES", 1)
    with pytest.raises(ValueError, match="broadcast"):
        itemsets.maximal_vertical(frame(spark, ROWS), 1)
    assert as_dict(itemsets.mine(frame(spark, ROWS), 2, "maximal", "vertical")) == {(1, 2, 3): 2}


def test_reduce_and_profile(spark):
    t = spark.createDataFrame([([1, 2],), ([2],), ([3],), ([],)], "items array<int>")
    assert sorted(r["items"] for r in transactions.reduce(t, 2).collect()) == [[2], [2]]
    r = transactions.reduction(transactions.compact(t), 2).first()
    assert (r["n_txns_before"], r["n_txns_after"], r["n_items_before"], r["n_items_after"], r["n_kinds_gone"]) == (4, 2, 4, 2, 1 - 1 / 3)
    p = transactions.profile(t).first()
    assert (p["min_item"], p["max_item"]) == (1, 3)
    assert (p["n_txns"], p["n_items"], p["min_len"], p["max_len"], p["n_distinct"]) == (4, 4, 0, 2, 3)


def test_dictionary_round_trip(spark):
    t = spark.createDataFrame([(0, ["b", "a"]), (1, ["zz"]), (2, [])], "txn_id int, items array<string>")
    words = transactions.dictionary(t)
    assert [(r["item"], r["item_id"]) for r in words.orderBy("item_id").collect()] == [("a", 1), ("b", 2), ("zz", 3)]
    coded = transactions.encode(t, words)
    assert {r["txn_id"]: r["items"] for r in coded.collect()} == {0: [1, 2], 1: [3], 2: []}
    back = transactions.decode(coded.where("txn_id < 2").select("txn_id", "items"), words)
    assert {r["txn_id"]: r["items"] for r in back.collect()} == {0: ["a", "b"], 1: ["zz"]}


def test_stages_with_ties(spark):
    t = frame(spark, [[1, 2]] * 3 + [[1]] * 2 + [[3, 4]] * 2)
    st = [(r["stage"], r["item"], r["least"]) for r in anytime.stages(t).orderBy("stage").collect()]
    assert st == [(1, 1, 5), (2, 2, 3), (3, 3, 2), (4, 4, 2)]
    pool = anytime.pools(t, 4)
    by = {k: {tuple(r["items"]) for r in pool.where(F.col("stage") == k).collect()} for k in range(1, 5)}
    assert by == {1: {(1,)}, 2: {(1, 2)}, 3: {(1, 2), (3, 4)}, 4: {(1, 2), (3, 4)}}  # tied stages: equal pools
    for k, sets in anytime.run(t, 4, "vertical"):
        assert {tuple(r["items"]) for r in sets.collect()} == by[k]
    assert [(r["pool"], r["cum_pool"]) for r in anytime.cumulative(pool).orderBy("stage").collect()] == [(1, 1), (1, 2), (2, 3), (2, 3)]
    truth = spark.createDataFrame([([3, 4],), ([9],)], "items array<int>")
    cov = anytime.coverage(pool, truth).orderBy("stage").collect()
    assert [r["coverage"] for r in cov] == [0.0, 0.0, 0.5, 0.5]
    assert all(r["monotone"] for r in cov)


def test_identity(spark):
    a = spark.createDataFrame([([1], 3), ([2], 2)], "items array<int>, support long")
    b = spark.createDataFrame([([1], 3), ([3], 2)], "items array<int>, support long")
    r = anytime.identity(a, b).first()
    assert (r["n_mine"], r["n_gold"], r["missing"], r["extra"], r["identical"]) == (2, 2, 1, 1, False)
    assert anytime.identity(a, a).first()["identical"]


def test_largest_and_fingerprint(spark):
    s = spark.createDataFrame([([1, 2], 3), ([3], 9), ([1, 4], 3)], "items array<int>, support long")
    assert [r["items"] for r in itemsets.largest(s, 2).collect()] == [[1, 2], [1, 4]]
    assert evaluation.fingerprint(s).first() == evaluation.fingerprint(s.orderBy(F.desc("support"))).first()


def test_planted(spark):
    t = transactions.compact(transactions.planted(spark, 2000, patterns=3, length=3, noise_items=50, noise=2, share=0.3))
    found = {tuple(r["items"]) for r in itemsets.mine(t, 400, "maximal", "vertical").collect()}
    assert {(1, 2, 3), (4, 5, 6), (7, 8, 9)} <= found


def test_plant(spark):
    """Planted sets join what is there, by the key alone; a null key gets none."""
    df = spark.createDataFrame([(k, ["a"]) for k in range(2000)] + [(None, ["a"])], "k long, items array<string>")
    out = transactions.plant(df, "k", [0.0, 0.25, 1.0], 2).collect()
    have = [r["items"] for r in out if r["k"] is not None]
    assert all(x[0] == "a" and {"plant=2.0", "plant=2.1"} <= set(x) and "plant=0.0" not in x for x in have)
    assert 400 < sum("plant=1.0" in x for x in have) < 600 and all(("plant=1.0" in x) == ("plant=1.1" in x) for x in have)
    assert [r["items"] for r in out if r["k"] is None] == [["a"]]
