"""URL rules with redirect equivalence. Main path: DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternlake.llm.common import ascii_lower, components, shared_dir, stash

#: Rules up to this many are one expression; more are joined by host suffix.
INLINE = 64


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://`` or for null."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(raw), path


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def decide(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Add rule and own (its verdict) to ``rows`` (host, path); null where none fits.

    A rule ``host/path`` fits its host and all subdomains where the path starts with its own. The longest wins.
    """
    ranked = sorted(rules.items(), key=lambda r: (-len(r[0]), r[0]))
    if len(ranked) <= INLINE:
        rule = own = F.lit(None).cast("string")
        for text, verdict in reversed(ranked):
            host, path = _split(text)
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
            rule, own = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(own)
        return rows.withColumns({"rule": rule, "own": own})
    spark = rows.sparkSession
    table = spark.createDataFrame([(*_split(t), t, v) for t, v in ranked], "rule_host string, rule_path string, r_rule string, r_own string")
    pairs = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    found = pairs.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = found.groupBy("host", "path").agg(F.min(F.struct(-F.length("r_rule"), "r_rule", "r_own")).alias("b"))
    return rows.join(best, ["host", "path"], "left").select(*rows.columns, F.col("b.r_rule").alias("rule"), F.col("b.r_own").alias("own"))


def key(url: Column) -> Column:
    """A url as a node: scheme, fragment and the ports 80 and 443 dropped, host in lower case. Null without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]+[^#]*)", 1)
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), PORT, "")
    tail = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1), r"^(?=\?|$)", "/")
    return F.when(url.rlike(r"(?s)^(?:(?!://).)*://[^/?#]") & (host != ""), F.concat(ascii_lower(host), tail))


PORT = r":(?:80|443)?\z"
#: Named entities that are read in link targets.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "colon": ":", "sol": "/", "period": ".", "quest": "?", "num": "#", "equals": "=", "percnt": "%", "lowbar": "_"}
#: A text as pieces: entities by number, by name, and what stands between.
PIECES = rf"(?s)&#[0-9]{{1,7}};|&#[xX][0-9A-Fa-f]{{1,6}};|&(?:{'|'.join(ENTITIES)});|[^&]+|&"
BASE = r"(?is)<base(\s(?:[^>]*\s)?href\s*=[^>]*)>"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
CANONICAL = r"(?is)<link(\s[^>]*?\brel\s*=\s*(?:\"[^\">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*)>"
HREF = r"(?is)(?:^|\s)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH = r"(?is)<meta(\s[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*)>"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def _href(tag: Column) -> Column:
    return F.trim(F.concat(*[F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)]))


def read_entities(x: Column) -> Column:
    """Text with its entities read, each once; a number that is no character stays as written."""

    def piece(t: Column) -> Column:
        hexed, number = t.rlike("^&#[xX]"), F.regexp_extract(t, "^&#[xX]?(.*);$", 1)
        code = F.conv(number, 16, 10)
        code = F.when(hexed, code).otherwise(number).cast("int")
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        out = F.when(t.rlike("^&#.*;$") & real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for name, char in ENTITIES.items():
            out = out.when(t == f"&{name};", char)
        return out.otherwise(t)

    return F.when(F.instr(x, "&") > 0, F.array_join(F.transform(F.regexp_extract_all(x, F.lit(PIECES), F.lit(0)), piece), "")).otherwise(x)


def _plain(html: Column) -> Column:
    return F.regexp_replace(html, COMMENT, "")


def targets(html: Column) -> Column:
    """All targets of a page's canonical links and meta refreshes, as written but for entities; what stands in comments is no link."""
    plain = _plain(html)
    links = F.transform(F.regexp_extract_all(plain, F.lit(CANONICAL), F.lit(1)), _href)
    metas = F.transform(F.regexp_extract_all(plain, F.lit(REFRESH), F.lit(1)), lambda tag: F.regexp_extract(tag, REFRESH_URL, 1))
    return F.filter(F.transform(F.concat(links, metas), read_entities), lambda x: x != "")


def base(html: Column) -> Column:
    """What the first base element with a href says; empty without one."""
    return read_entities(_href(F.regexp_extract(_plain(html), BASE, 1)))


def resolve(host: Column, path: Column, to: Column) -> Column:
    """``to`` as a whole url, seen from a page at host and path: with a scheme as it is, else from the page's scheme-less place, dot segments removed.

    A target that is only a fragment is the page itself.
    """
    bare = F.regexp_extract(to, r"(?s)^[^?#]*", 0)
    rest = F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)?", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    whole = F.when(bare == "", path).when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    steps = F.split(F.substring(whole, 2, 1 << 30), "/")
    last = F.element_at(steps, -1)
    walked = F.aggregate(
        steps,
        F.lit(""),
        lambda at, x: F.when(x == ".", at).when(x == "..", F.regexp_replace(at, r"/[^/]*\z", "")).otherwise(F.concat(at, F.lit("/"), x)),
    )
    clean = F.concat(walked, F.when(last.isin(".", ".."), "/").otherwise(""))
    local = F.concat(F.lit("http://"), host, clean, rest)
    return F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to)).otherwise(local)


def page_edges(pages: DataFrame, path: str) -> DataFrame:
    """(a, b) as nodes: from each page to wherever its canonical links and meta refreshes point, relative targets resolved as browsers do: from the base element where there is one."""
    hinted = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|refresh"))
    host, place = parts(F.col("url"))
    seen = hinted.select("url", resolve(host, place, base(F.col("html"))).alias("from"), "html")
    host, place = parts(F.col("from"))
    to = seen.select("url", host.alias("host"), place.alias("path"), F.explode(targets(F.col("html"))).alias("to"))
    full = resolve(F.col("host"), F.col("path"), F.col("to"))
    return stash(to.select(key(F.col("url")).alias("a"), key(full).alias("b")), f"{path}/links").where("a is not null and b is not null and a != b")


def judge(pages: DataFrame, rules: dict[str, str], redirects: DataFrame | None = None) -> DataFrame:
    """Judge every url of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, alias_of.

    A url's own longest rule decides. Without one, the url takes the decision of its aliases: the urls that
    redirects (src, dst), canonical links and meta refreshes (all of a page, relative ones resolved, from the base element if it has one) connect with it, over any number of steps. Among them an explicit
    allow goes before any block; with neither, and for null or malformed urls, the verdict is allow. alias_of
    is the smallest node of the component, null without links. Targets count even if no page has them.
    Repeated rows each return; other columns are ignored; null html has no links.
    """
    spark = pages.sparkSession
    path = shared_dir(spark)
    edges = page_edges(pages, path)
    if redirects is not None:
        edges = edges.union(redirects.select(key(F.col("src")), key(F.col("dst"))).toDF("a", "b").where("a is not null and b is not null and a != b"))
    group = components(edges, path)
    # a node is host/path?query: judge it as a url
    host, where = parts(F.concat(F.lit("http://"), F.col("node")))
    judged = decide(group.withColumns({"host": host, "path": where}), rules)
    told = judged.groupBy("root").agg(F.max((F.col("own") == "allow").cast("int")).alias("allow"), F.max((F.col("own") == "block").cast("int")).alias("block"))
    spread = F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block")
    alias = stash(group.join(told, "root").select("node", F.col("root").alias("alias_of"), spread.alias("spread")), f"{path}/alias")
    host, where = parts(F.col("url"))
    own = decide(pages.select("page_id", "url").withColumns({"host": host, "path": where}), rules)
    out = own.withColumn("node", key(F.col("url"))).join(alias, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"), "alias_of")
