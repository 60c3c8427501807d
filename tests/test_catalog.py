"""Every query with SQL against that SQL, on the smallest tables; and the contract's entry."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from patternlake.plans import catalog, oracle

DIR = os.environ.get("PATTERNLAKE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    cur = con.execute(oracle.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_sets_files_shares(spark, tmp_path):
    """Of 640 rows every odd count is a share whose seventh and last decimal is 5."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * FROM '{DIR}/lineitem.parquet' ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 640) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = c.execute(oracle.oracle_sql()["sets_files"]).fetchall()
    assert sum(int(line.split(";")[1]) % 2 for form, line in want if form == "semicolon") > 20
    assert sorted((r["form"], r["line"]) for r in catalog.queries()["sets_files"](spark, str(tmp_path)).collect()) == sorted(want)


def test_seeded_queries(spark, con):
    """What no SQL draws: the cases and control sets of the tables, with counts by plain Python."""
    import random
    from itertools import product

    rows = {}
    for r in catalog.f.calls(spark, DIR).where("model = 'm0' and cond = 'lib'").collect():
        rows.setdefault((r["grp"], r["truth"]), []).append(r["case_key"])
    draw, want = random.Random(42), []
    for key in product(sorted({g for g, _ in rows}), ("normal", "anomalous")):
        want += draw.sample(sorted(rows.get(key, [])), min(33, len(rows.get(key, []))))
    assert [r["case_key"] for r in catalog.seeded_cases(spark, DIR).orderBy("pick").collect()] == want and want

    txns = [(set(r["items"]), r["label"], r["weight"]) for r in catalog.f.labelled(spark, DIR).collect()]
    sets = catalog.random_control(spark, DIR).collect()
    assert sorted(r["draw"] for r in sets) == list(range(8))
    for r in sets:
        held = [(y, w) for x, y, w in txns if set(r["pattern"].split(" & ")) <= x]
        assert (r["pos"], r["cnt"]) == (sum(w for y, w in held if y == 1), sum(w for _, w in held))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
