"""Tries, the bitmap index and hot items against plain counts."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patternlake.operators import counting

BIG = 3_000_000_000


def rows(seed, n=70, items=8):
    rng = np.random.default_rng(seed)
    return [(sorted(rng.choice(items, size=rng.integers(0, items), replace=False).tolist()), int(rng.choice([1, 2, 7, BIG]))) for _ in range(n)]


def plain(rows, sets):
    return {tuple(sorted(set(s))): sum(w for r, w in rows if set(s) <= set(r)) for s in sets}


def as_dict(df):
    got = df.collect()
    out = {tuple(r["items"]): r["support"] for r in got}
    assert len(out) == len(got)
    return out


SETS = [list(s) for k in (1, 2, 3, 5) for s in combinations(range(8), k)] + [[3, 1], [1, 1, 3], [99], [0, 99], list(range(8))]


@pytest.fixture
def frames(spark):
    data = rows(2)
    t = spark.createDataFrame([(r[::-1] + r[:1], w) for r, w in data], "items array<int>, weight long").repartition(3)
    return data, t, spark.createDataFrame([(s,) for s in SETS], "items array<int>")


@pytest.mark.parametrize("size", [counting.TRIE_SETS, 20])
def test_trie(frames, monkeypatch, size):
    data, t, sets = frames
    monkeypatch.setattr(counting, "WALK_CELLS", 100)
    assert as_dict(counting.count_by_trie(t, sets, size)) == plain(data, SETS)


def test_trie_visits_what_is_there():
    """A branch ends where no transaction of the batch holds its beginning."""
    trie = counting.Trie([["a", "b"], ["a", "b", "c"], ["x", "y"]])
    trie.walk(pa.array([["a", "b"], ["b", "c"], [], None]), np.array([2, 3, 4, 5]))
    assert trie.counts.tolist() == [2, 0, 0] and trie.visits == 4


@pytest.mark.parametrize("wide", [False, True])
def test_bitmap_index(spark, frames, wide):
    data, t, sets = frames
    if wide:  # over many blocks of 64 transactions
        t, data = t.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9)))).drop("k"), data * 9
    index = counting.BitmapIndex.build(t)
    assert as_dict(index.supports(sets)) == plain(data, SETS)
    assert as_dict(counting.BitmapIndex(spark, index.path).supports(sets)) == plain(data, SETS)  # read again later


def test_hot_items(frames):
    data, t, sets = frames
    distinct = t.select(F.array_sort(F.array_distinct("items")).alias("items"), "weight")
    for n in (0, 3, 8):
        hot = counting.hot_items(distinct, n)
        assert as_dict(counting.count_with_hot(distinct, sets, hot)) == plain(data, SETS)
    with pytest.raises(ValueError, match="hot"):
        counting.hot_supports(t, list(range(13)))


def test_hot_items_shuffle_less(spark):
    """What is dealt by item are the rests only, and equal rests once."""
    t = spark.createDataFrame([([0, 1, 2, k % 40 + 3], 1) for k in range(2000)], "items array<int>, weight long")
    hot = counting.hot_items(t, 3)
    assert hot == [0, 1, 2]
    cold = t.select(F.array_except("items", F.array(*map(F.lit, hot))).alias("cold")).distinct().agg(F.sum(F.size("cold"))).first()[0]
    assert cold == 40 and t.agg(F.sum(F.size("items"))).first()[0] == 8000


@pytest.mark.parametrize("count", [counting.count_by_trie, lambda t, s: counting.BitmapIndex.build(t).supports(s), lambda t, s: counting.count_with_hot(t, s, [1])])
def test_empty(spark, frames, count):
    _, t, sets = frames
    assert set(as_dict(count(t.limit(0), sets)).values()) == {0}
    assert as_dict(count(t, sets.limit(0))) == {}
