"""Mining that goes on: falling thresholds and arriving batches, against mining from nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_conditional import as_dict, brute, brute_maximal

from patternlake.operators import anytime, border
from patternlake.streaming.incremental import Incremental


def rows(seed, n=60, items=8):
    rng = np.random.default_rng(seed)
    return [(sorted(rng.choice(items, size=rng.integers(0, items - 1), replace=False).tolist()), int(rng.integers(1, 4))) for _ in range(n)]


def test_each_stage_goes_on(spark, tmp_path):
    data, log = rows(1), []
    t = spark.createDataFrame(data, "items array<int>, weight long")
    b = border.Border(t, f"file://{tmp_path}/b")
    for least in (60, 40, 40, 25, 50, 24):
        assert as_dict(b.descend(least, log)) == brute(data, least)
    counted = b.counted()
    assert counted.count() == counted.select("items").distinct().count()  # no set is counted twice, in no stage
    assert sum(n for *_, n in log) + 8 == counted.count() and [x[0] for x in log] == sorted((x[0] for x in log), reverse=True)
    assert {least for least, *_ in log} <= {60, 40, 25, 24}  # the second 40 and the 50 count nothing
    # what was counted is no more than frequent sets and sets whose every subset is frequent
    f = brute(data, 24)
    assert all(len(s) == 1 or all(s[:k] + s[k + 1 :] in f for k in range(len(s))) for s in as_dict(counted))


def test_resume_after_a_stop(spark, tmp_path, monkeypatch):
    """A run that dies in the middle of a stage leaves its finished steps; the next one counts the others only."""
    data = rows(2)
    t, path = spark.createDataFrame(data, "items array<int>, weight long"), f"file://{tmp_path}/b"
    border.Border(t, path).descend(60)
    real, calls = border.count_by_trie, []

    def fails(base, wanted):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(base, wanted)

    monkeypatch.setattr(border, "count_by_trie", fails)
    with pytest.raises(RuntimeError):
        border.Border(t, path).descend(15)
    monkeypatch.setattr(border, "count_by_trie", real)
    again = border.Border(t, path)
    kept = again.counted().count()
    log = []
    assert as_dict(again.descend(15, log)) == brute(data, 15)
    counted = again.counted()
    assert kept + sum(n for *_, n in log) == counted.count() == counted.select("items").distinct().count() and again.reached() == 15


def test_stages_by_border(spark):
    data = rows(3)
    t = spark.createDataFrame(data, "items array<int>, weight long")
    pool = anytime.pools(t, 3)
    for k, sets in anytime.run(t, 3):
        assert as_dict(sets) == as_dict(pool.where(F.col("stage") == k).select("items", "support"))


def test_batches_like_mining_from_nothing(spark, tmp_path):
    """Five batches, of which one is empty and one shifts what is frequent; a new object over the same folder goes on."""
    rng = np.random.default_rng(4)
    batches = [[sorted(rng.choice(7, size=rng.integers(0, 5), replace=False).tolist()) for _ in range(40)] for _ in range(3)] + [[], [[8, 9, 10]] * 80 + [[8, 9]] * 3]
    path, seen = f"file://{tmp_path}/inc", []
    for number, batch in enumerate(batches):
        inc = Incremental(spark, path, 0.1, "int")  # as after a restart
        inc.apply(spark.createDataFrame([(x,) for x in batch], "items array<int>"), number)
        inc.apply(spark.createDataFrame([([1, 2, 3],)] * 50, "items array<int>"), number)  # delivered once more: nothing happens
        seen += [(x, 1) for x in batch]
        least = max(1, -(-len(seen) // 10))
        want = brute(seen, least)
        assert as_dict(inc.frequent()) == want and as_dict(inc.maximal()) == brute_maximal(want)
        state = inc.state()
        assert state.count() == state.select("items").distinct().count() and len(inc.log) == 1
        assert all(r["support"] == sum(set(r["items"]) <= set(x) for x, _ in seen) for r in state.collect())
    assert inc.log[0][2] > 0
    with pytest.raises(ValueError, match="follow"):
        inc.apply(spark.createDataFrame([], "items array<int>"), 9)


def test_stream(spark, tmp_path):
    """From a folder of files through a stream, with a restart from its checkpoint."""
    data = rows(6, 30)
    for k in range(2):
        spark.createDataFrame([(r,) for r, _ in data], "items array<int>").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        inc = Incremental(spark, f"file://{tmp_path}/state", 0.2, "int")
        stream = spark.readStream.schema("items array<int>").json(str(tmp_path / "in"))
        inc.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
        every = [(r, k + 1) for r, _ in data]
        assert as_dict(inc.frequent()) == brute(every, max(1, -(-len(data) * (k + 1) // 5)))
    assert inc.version() == 1
