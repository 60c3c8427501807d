"""URL rules with aliases, and the archive."""

import base64
import hashlib

import duckdb
import pandas as pd
import pytest

from patternlake.llm import queries, urls, warc

PAGES = "page_id long, url string, html string"
LINK = '<html><head><link rel="canonical" href="{}"></head></html>'
ROWS = [
    (1, "http://a.example.com/x", LINK.format("http://b.net/y")),  # alias of a blocked url
    (2, "http://b.net/y", ""),
    (3, "https://c.example.com/1?q=1#f", LINK.format("//d.example.com/2")),
    (4, "http://d.example.com/2", '<meta http-equiv="refresh" content="0; url=http://e.net/3">'),  # two steps away from a block
    (5, "http://f.example.com/4", LINK.format("http://www.example.net/en/5")),  # allowed by rule
    (6, "http://f.example.com/4#top", '<META HTTP-EQUIV=refresh CONTENT="1;URL=http://g.net/6">'),  # and a block: allow goes first
    (7, "HTTP://X.EXAMPLE.COM/de/", None),
    (8, None, LINK.format("http://b.net/y")),
    (9, "no scheme", ""),
    (10, "x://", ""),
    (11, "http://net", ""),
    (12, "http://example.net/english", ""),
    (13, "http://sub.example.net/en/", ""),
    (14, "http://h.org/fr/", LINK.format("http://z.net/y")),  # its own rule goes before its aliases
    (15, "http://i.example.com?x", LINK.format("/rel")),
    (16, "http://i.example.com/rel", "<p>canonical</p>"),
    (17, "http://u@Host:80/p?q://r", ""),
    (17, "http://u@Host:80/p?q://r", ""),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, PAGES)


def test_judge(pages):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, queries.RULES).collect()}
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "block", 13: "allow", 14: "allow", 15: "allow", 16: "allow", 17: "allow"}
    assert got[7][:3] == ("x.example.com", "/de/", "example.com/de/") and got[8][:3] == ("", "", None) and got[13][2] == "example.net/en/" and got[12][2] == "net/"
    assert got[17][:2] == ("u@host:80", "/p")


def test_judge_like_sql(spark, pages):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(ROWS, columns=["page_id", "url", "html"]))
    cur = con.execute(queries.OP6_SQL)
    cols = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in urls.judge(pages, queries.RULES).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_registered_sql(spark, name):
    """Every query with SQL over its whole table."""
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, cur = queries.queries()[name](spark, folder), con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_many_rules_are_joined(spark, pages, monkeypatch):
    plain = sorted(map(tuple, urls.judge(pages, queries.RULES).collect()), key=repr)
    monkeypatch.setattr(urls, "INLINE", 0)
    assert sorted(map(tuple, urls.judge(pages, queries.RULES).collect()), key=repr) == plain
    assert urls.judge(pages.limit(0), queries.RULES).collect() == []


def test_redirects(spark):
    p = spark.createDataFrame([(1, "http://one.example.com/a", None, "x")], PAGES + ", verdict string")
    r = spark.createDataFrame([("http://one.example.com/a", "http://two.example.com/b"), ("http://three.net/", "http://two.example.com/b"), (None, "x")], "src string, dst string")
    assert urls.judge(p, queries.RULES, r).first()["verdict"] == "block"
    assert urls.judge(p, queries.RULES).first()["verdict"] == "allow"


HTML = ["<p>same</p>", "<p>same</p>", None, "", "é\r\n\r\nWARC/1.1", "<p>same</p>", "x" * 200_000]


def test_archive(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://h/{k}", h, "p") for k, h in enumerate(HTML)], PAGES + ", payload string")
    path = f"file://{tmp_path}/a"
    warc.write_archive(df, path)
    got = {r["page_id"]: tuple(r) for r in warc.summary(spark, path).collect()}
    for k, h in enumerate(HTML):
        body = (h or "").encode()
        last = max(j for j, x in enumerate(HTML) if (x or "") == (h or ""))
        assert got[k] == (k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if k == last else "revisit", None if k == last else last)
    assert warc.payloads(spark, path).count() == 4  # each once
    for r in warc.records(spark, path).collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split(b": ")[1])
        assert block[length:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        assert block[:length] == (b"" if b"WARC-Type: revisit" in head else (HTML[r["page_id"]] or "").encode())


def test_archive_least_and_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "ab"), (2, "u\r\nX: y", "ab"), (None, "u", "ab"), (3, "u", "c"), (3, "u", "c")], PAGES)
    kind = lambda least: sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive(df, least).collect()), key=repr)
    assert kind(0) == sorted([(1, "revisit", 2), (2, "response", None), (None, "revisit", 2), (3, "response", None), (3, "response", None)], key=repr)
    assert {k[1] for k in kind(3)} == {"response"}
    assert warc.archive(df.limit(0)).collect() == []


def test_payloads_are_stored_once(spark, tmp_path):
    """Null and repeated ids with one payload: one stored row for each distinct payload, headers apart, and every record rebuilt."""
    rows = [(None, "a", "same"), (None, "b", "same"), (None, None, "same"), (3, "c", "other"), (3, "c", "other"), (4, "d", "same")]
    path = f"file://{tmp_path}/once"
    warc.write_archive(spark.createDataFrame(rows, PAGES), path)
    stored = spark.read.parquet(f"{path}/payloads").collect()
    assert sorted(bytes(r["payload"]) for r in stored) == [b"other", b"same"] and all(hashlib.sha256(r["payload"]).digest() == bytes(r["address"]) for r in stored)
    assert spark.read.parquet(f"{path}/headers").columns == ["page_id", "header", "address"]
    assert warc.records(spark, path).count() == warc.summary(spark, path).count() == len(rows)


@pytest.mark.parametrize("text", ["", "a", "é" * 1000, "\x00\r\n"])
def test_digests(spark, text):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(text,)], "t string").select(warc.base32_sha1(F.col("t").cast("binary"))).first()[0]
    assert got == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_damage_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    path = f"file://{tmp_path}/b"
    warc.write_archive(spark.createDataFrame([(1, "u", "good")], PAGES), path)
    good = {t: spark.read.parquet(f"{path}/{t}") for t in ("headers", "payloads")}

    def spoiled(name, **changed):
        for t, df in good.items():
            (df.withColumns(changed) if set(changed) & set(df.columns) else df).write.parquet(f"file://{tmp_path}/{name}/{t}")
        return f"file://{tmp_path}/{name}"

    with pytest.raises(Exception, match="damaged payload"):
        warc.records(spark, spoiled("c", payload=F.lit(b"evil"))).collect()
    for k, (old, new) in enumerate((("sha1:", "sha1:A"), ("Length: 4", "Length: 5"))):
        with pytest.raises(Exception, match="damaged record"):
            warc.summary(spark, spoiled(f"d{k}", header=F.replace(F.col("header").cast("string"), F.lit(old), F.lit(new)).cast("binary"))).collect()


RELATIVE = [
    (1, "http://m.example.com/dir/x", '<link rel="canonical" href="y.html">'),  # http://m.example.com/dir/y.html is blocked by its own alias
    (2, "http://m.example.com/dir/y.html", '<link rel=stylesheet href="z.css"><link title="t" rel=\'nofollow canonical\' href=\'http://b.net/\'>'),
    (3, "http://n.example.com/a/b/c?old=1", '<META http-equiv="Refresh" content="3; URL=../up/./d?x=1&amp;y=2">'),
    (4, "http://n.example.com/a/up/d?x=1&y=2", LINK.format("http://c.net/")),
    (5, "http://o.example.com/p/q", LINK.format("?id=3")),
    (6, "http://o.example.com/p/q?id=3", LINK.format("https://D.net")),
    (7, "http://p.example.com", "<!-- " + LINK.format("http://e.net/") + " -->"),  # a comment is no link
    (8, "http://q.example.com/1", LINK.format("http://plain.example.com/") + LINK.format("http://f.net/")),  # both links count
    (9, "http://r.example.com/1", LINK.format("#top") + LINK.format("mailto:x@g.net") + "<!-- open " + LINK.format("http://h.net/")),
    (10, "http://s.example.com/a/", LINK.format("../../../t")),
    (11, "http://s.example.com/t", LINK.format("http://i.net/")),
    (12, "http://t.example.com/1", LINK.format("http&#58;&#x2F;&#X2f;b&period;net/")),  # entities by number and by name
    (13, "http://t.example.com/2", LINK.format("http://plain.example.com/&amp;#58;&#0;&#xD800;&#x1F600;&unknown;&#9999999;")),  # each entity is read once, no character stays as written
    (14, "http://plain.example.com/&#58;&#0;&#xD800;\U0001f600&unknown;&#9999999;", None),
    (15, "http://u.example.com/1", "<BASE target=_top data-href='http://plain.example.com/'><base HREF='http://d.net/a/'><base href='http://plain.example.com/'>" + LINK.format("../b")),  # the first base with a target counts
    (16, "http://u.example.com/dir/2", '<base href="/other/">' + LINK.format("x")),  # a base that is relative itself
    (17, "http://u.example.com/other/x", LINK.format("http://f.net/")),
    (18, "http://v.example.com:80/1", None),
    (19, "http://w.example.com/1", LINK.format("https://V.example.com:443/1")),
    (20, "http://v.example.com:/1", LINK.format("http://g.net:80")),
    (21, "http://v.example.com:8080/1", LINK.format("http://plain.example.com/port")),  # another port is another node
    (22, "http://:80/1", LINK.format("http://h.net/")),  # no host
]


def test_links_of_every_kind(spark):
    rows = spark.createDataFrame(RELATIVE, PAGES)
    got = {r["page_id"]: r["verdict"] for r in urls.judge(rows, queries.RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "block", 9: "allow", 10: "block", 11: "block",
                   12: "block", 13: "allow", 14: "allow", 15: "block", 16: "block", 17: "block", 18: "block", 19: "block", 20: "block", 21: "allow", 22: "allow"}
    alias = {r["page_id"]: r["alias_of"] for r in urls.judge(rows, queries.RULES).collect()}
    assert alias[13] == alias[14] is not None and alias[22] is None
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(RELATIVE, columns=["page_id", "url", "html"]))
    cur = con.execute(queries.OP6_SQL)
    cols = [c[0] for c in cur.description]
    assert sorted((tuple(r[c] for c in cols) for r in urls.judge(rows, queries.RULES).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_native_plans(spark, pages):
    """No Python worker on the way of the url filter and the archive."""
    for df in (urls.judge(pages, queries.RULES), warc.archive(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
