"""Signal files through the data source."""

import numpy as np
import pytest

from patternlake.sources import signals
from patternlake.sources.readers import mat_arrays


def test_mat_bytes_round_trip():
    x = {"X1_DE_time": np.array([1.5, -2.0, np.pi]), "n": np.zeros(0)}
    back = mat_arrays(signals.mat_bytes(x))
    assert list(back) == list(x) and all(np.array_equal(back[k], x[k]) for k in x)


@pytest.mark.parametrize("form", ["mat", "npz"])
def test_source(spark, tmp_path, form):
    rows = [(f"f{i}", f"X{c}_DE_time", k, float(i * 100 + c * 10 + k)) for i in range(3) for c in range(2) for k in range(4)] + [("f0", "other", 0, 9.0)]
    path = f"file://{tmp_path}/signals"
    assert signals.write_signals(spark.createDataFrame(rows, "file string, channel string, k int, x double").repartition(4), path, form) == 3
    (tmp_path / "signals" / f"bad.{form}").write_bytes(b"no such file")
    (tmp_path / "signals" / "notes.txt").write_text("left alone")
    df = signals.signals(spark, path)
    assert df.rdd.getNumPartitions() == 4
    got = {(r["file"], r["channel"]): r for r in df.collect()}
    assert {k: r["samples"] for k, r in got.items() if k[1]} == {(f"f{i}.{form}", f"X{c}_DE_time"): [float(i * 100 + c * 10 + k) for k in range(4)] for i in range(3) for c in range(2)}
    bad = got[f"bad.{form}", None]
    assert bad["error"] and bad["samples"] is None and all(r["error"] is None for k, r in got.items() if k[1])
    assert [r["channel"] for r in signals.signals(spark, path, keys="oth").where("error is null").collect()] == ["other"]
