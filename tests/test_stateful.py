"""The stateful operator against the batch query: over batches and restarts, from a given state, and after its time to live."""

import time

import numpy as np
import pytest

from patternlake.operators.online import online_states
from patternlake.streaming import stateful

SCHEMA = "unit string, seq long, a double, b double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stateful.use_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


def series(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(u, k, float(rng.normal()), float(rng.exponential())) if rng.random() > 0.05 else (u, k, None, 1.0) for u in ("x", "y", "z") for k in range(n)]


def run(spark, tmp_path, batches, **more):
    """One run of the stream for each batch, each from the checkpoint of the one before."""
    got = []
    for k, rows in enumerate(batches):
        if k and more.get("ttl_ms"):
            time.sleep(2 * more["ttl_ms"] / 1000)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        out = stateful.stream_states(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), "unit", ["seq"], ["a", "b"], 6, 3, **more)
        got += _sink(out, tmp_path, len(rows))
    return sorted(got)


def _sink(out, tmp_path, expected):
    """Rows of one run, which is stopped when it has read what there is: a query with times to live looks for expired state for ever."""
    rows = []
    q = out.writeStream.foreachBatch(lambda df, k: rows.extend(tuple(r) for r in df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
    end = time.monotonic() + 60
    while time.monotonic() < end and q.exception() is None and sum(p["numInputRows"] for p in q.recentProgress) < expected:
        time.sleep(0.2)
    failed = q.exception()
    q.stop()
    assert failed is None
    return rows


def batch(spark, rows, **more):
    return sorted(tuple(r) for r in online_states(spark.createDataFrame(rows, SCHEMA), "unit", ["seq"], ["a", "b"], 6, 3, **more).collect())


@pytest.mark.parametrize("mode", ["textbook", "shifted"])
def test_batches_and_restarts(rocks, tmp_path, mode):
    rows = series(70)
    parts = [[r for r in rows if low <= r[1] < high] for low, high in ((0, 4), (4, 40), (40, 41), (41, 70))]  # the second one makes lists be written anew
    assert run(rocks, tmp_path, parts, mode=mode) == batch(rocks, rows, mode=mode)


def test_given_state(rocks, tmp_path):
    """A stream that begins where a table ended."""
    rows = series(40, 1)
    old, new = [r for r in rows if r[1] < 17], [r for r in rows if r[1] >= 17]
    initial = stateful.state_of(rocks.createDataFrame(old, SCHEMA), "unit", ["seq"], ["a", "b"], 6, 3)
    assert sorted(batch(rocks, old) + run(rocks, tmp_path, [new], initial=initial)) == batch(rocks, rows)


def test_time_to_live(rocks, tmp_path):
    """A unit that was quiet for too long begins anew."""
    rows = series(40, 2)
    parts = [[r for r in rows if r[1] < 20], [r for r in rows if r[1] >= 20]]
    assert run(rocks, tmp_path, parts, ttl_ms=1500) == sorted(batch(rocks, parts[0]) + batch(rocks, parts[1]))
