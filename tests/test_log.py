"""The log with a commit protocol: repeats, writers at once, a crash before the commit."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from patternlake.sources.log import AppendLog

KEY = ["a", "b"]


def frame(spark, keys, v=0):
    return spark.createDataFrame([(int(k), f"b{k % 3}", v) for k in keys], "a long, b string, v int")


def keys(log):
    return sorted(r["a"] for r in log.read().collect())


def test_each_key_once(spark, tmp_path):
    log = AppendLog(spark, f"file://{tmp_path}/log", KEY)
    assert log.read() is None and log.append(frame(spark, [])) == 0 and log.read() is None
    assert log.append(frame(spark, [1, 2, 2, 3])) == 3
    assert log.append(frame(spark, [1, 2, 3], 9)) == 0 and len(log.commits()) == 1
    assert log.append(frame(spark, [3, 4], 9)) == 1
    assert keys(AppendLog(spark, f"file://{tmp_path}/log", KEY)) == [1, 2, 3, 4] and sum(r["v"] for r in log.read().collect()) == 9


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """Both prepare against the same state; the second finds its number taken and drops what the first has brought."""
    path = f"file://{tmp_path}/log"
    one, two = AppendLog(spark, path, KEY), AppendLog(spark, path, KEY)
    real, calls = two._publish, []

    def late(number, commit):
        calls.append(number)
        if len(calls) == 1:
            assert one.append(frame(spark, range(0, 20), 1)) == 20
        return real(number, commit)

    monkeypatch.setattr(two, "_publish", late)
    assert two.append(frame(spark, range(10, 30), 2)) == 10
    assert calls == [0, 1] and keys(one) == list(range(30)) and [c["rows"] for c in one.commits()] == [20, 10]


def test_many_writers(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    with ThreadPoolExecutor(4) as pool:
        added = list(pool.map(lambda k: AppendLog(spark, path, KEY).append(frame(spark, range(5 * k, 5 * k + 10), k)), range(4)))
    log = AppendLog(spark, path, KEY)
    assert sum(added) == 25 and keys(log) == list(range(25))


def test_crash_before_the_commit(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    log = AppendLog(spark, path, KEY)
    log.append(frame(spark, [1]))
    monkeypatch.setattr(log, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        log.append(frame(spark, [2, 3]))
    again = AppendLog(spark, path, KEY)
    assert keys(again) == [1] and again.append(frame(spark, [2, 3])) == 2 and keys(again) == [1, 2, 3]
