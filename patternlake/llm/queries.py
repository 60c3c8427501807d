"""The operators over their whole tables, as registered queries, with SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from patternlake.llm import decontam, fim, kmeans, langid, licenses, neardup, pii, simhash, spans, spencode, tokenbin, urls, warc

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def tokenizer(name: str) -> str:
    """A vocabulary file of the public tokenizers: below $PATTERNLAKE_TOKENIZERS, else as installed."""
    if base := os.environ.get("PATTERNLAKE_TOKENIZERS"):
        return f"{base}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark, sf_dir):
    """Pairs of a document and a benchmark item that it holds."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), tau=4, width=4)


def op5(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages"), RULES)


def url_aliases(spark, sf_dir):
    """op6 over the pages with canonical links and refreshes put in, as LINKED_SQL has them."""
    pages = _table(spark, sf_dir, "pages")
    html = """CASE CAST(page_id % 10 AS INT)
      WHEN 0 THEN concat('<link rel="canonical" href="http://alias.example.org/', page_id div 30, '">')
      WHEN 1 THEN concat('<meta http-equiv="refresh" content="0; url=//hop', page_id div 20, '.example.org/x?a=1&amp;b=2">')
      WHEN 2 THEN concat('<link href=\\'http://hop', page_id div 20, '.example.org/x?a=1&b=2\\' rel=canonical><link rel="canonical" href="http://block', page_id % 3, '.net/">')
      WHEN 3 THEN concat('<link rel="canonical" href="../up/./', page_id % 5, '"><link rel="canonical" href="http://www.example.net/en/', page_id div 100, '">')
      WHEN 4 THEN concat('<!-- <link rel="canonical" href="http://x.net/"> --><link rel="canonical" href="?q=', page_id % 4, '">')
      WHEN 5 THEN concat('<link rel="canonical" href="http://www.example.net/en/', page_id div 100, '">')
      WHEN 7 THEN concat('<base target=x href="http://d.net/deep/er/"><link rel="canonical" href="../page/', page_id div 20, '">')
      WHEN 8 THEN concat('<link rel="canonical" href="http&#58;&sol;/hop', page_id div 20, '.example.org&#x3A;443/x?a=1&#38;b=2">')
      WHEN 9 THEN concat('<link rel="canonical" href="HTTP://D.net:80/deep/page/', page_id div 20, '">') ELSE html END"""
    return urls.judge(pages.select("page_id", "url", F.expr(html).alias("html")), RULES)


def op7(spark, sf_dir):
    return spencode.encode(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), with_arrays=False)


def op8(spark, sf_dir):
    return warc.archive(_table(spark, sf_dir, "pages"), least=0)


def op9(spark, sf_dir):
    return tokenbin.token_files(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op10(spark, sf_dir):
    """Every document with the text that is left, and how many sentences went."""
    return spans.dedup_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), passage=spans.PASSAGE)


def op11(spark, sf_dir):
    """Spans of personal data in every document: those of the base rules and those that boosted trees select."""
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op12(spark, sf_dir):
    return kmeans.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256, seed=2)


def op13(spark, sf_dir):
    """Every document rearranged, and put together again from what was written."""
    out = fim.arrange(_table(spark, sf_dir, "documents"), fim_percent=100, spm_percent=50, seed=7)
    restored = fim.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_decontamination": op1,
        "op2_embedding_neardup": op2,
        "op3_language_id": op3,
        "op4_simhash_neardup": op4,
        "op5_license_scan": op5,
        "op6_url_filter": op6,
        "url_aliases": url_aliases,
        "op7_sentencepiece": op7,
        "op8_warc_archive": op8,
        "op9_token_shards": op9,
        "op10_span_dedup": op10,
        "op11_pii": op11,
        "op12_centroids": op12,
        "op13_fill_in_middle": op13,
        "pipeline": pipeline,
    }


OP2_SQL = """
WITH RECURSIVE g AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a AS node, a AS other FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON r.other = l.a),
low AS (SELECT node, min(other) AS c FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN low ON vec_id = node LEFT JOIN n ON vec_id = n.a
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _split(url: str) -> str:
    rest = f"CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"{_LOWER.format(f"regexp_extract({rest}, '^[^/?#]*')")} AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"


def _key(url: str) -> str:
    rest = f"substr({url}, instr({url}, '://') + 3)"
    tail = f"regexp_extract({rest}, '^[^/?#]*([^#]*)', 1)"
    host = f"regexp_replace(regexp_extract({rest}, '^[^/?#]*'), '{urls.PORT}', '')"
    return f"CASE WHEN contains({url}, '://') AND {host} <> '' THEN {_LOWER.format(host)} || CASE WHEN {tail} = '' OR {tail} LIKE '?%' THEN '/' ELSE '' END || {tail} END"


def _rule(what: int) -> str:
    out = "NULL"
    for text, verdict in sorted(RULES.items(), key=lambda r: (len(r[0]), r[0])):
        host, _, path = text.partition("/")
        out = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{(text, verdict)[what]}' ELSE {out} END"
    return out


def _href(tag: str) -> str:
    groups = " || ".join(f"regexp_extract({tag}, '{urls.HREF.replace("'", "''")}', {k})" for k in (1, 2, 3))
    return f"trim({groups})"


_TAGS = f"""list_concat(
 list_transform(regexp_extract_all(plain, '{urls.CANONICAL.replace("'", "''")}', 1), lambda t: {_href('t')}),
 list_transform(regexp_extract_all(plain, '{urls.REFRESH.replace("'", "''")}', 1), lambda t: regexp_extract(t, '{urls.REFRESH_URL.replace("'", "''")}', 1)))"""


def _entities(x: str) -> str:
    code = "CASE WHEN regexp_matches(p, '^&#[xX].*;$') THEN CAST('0x' || p[4:-2] AS INT) WHEN regexp_matches(p, '^&#.*;$') THEN CAST(p[3:-2] AS INT) END"
    named = " ".join(f"WHEN p = '&{name};' THEN '{char.replace("'", "''")}'" for name, char in urls.ENTITIES.items())
    read = f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}) {named} ELSE p END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{urls.PIECES}'), lambda p: {read}), '')"


def _resolved(name: str, source: str, keep: str) -> str:
    """Steps that end in table ``name``: ``keep`` and full, the url that dst of ``source`` means at its host and path."""
    return rf"""{name}_cut AS (SELECT *, regexp_extract(dst, '(?s)^[^?#]*') AS bare, regexp_extract(dst, '(?s)^[^?#]*(.*)$', 1) AS rest, regexp_extract(path, '(?s)^(.*/)?', 1) AS folder FROM {source}),
{name}_steps AS (SELECT *, string_split(substr(CASE WHEN bare = '' THEN path WHEN starts_with(bare, '/') THEN bare ELSE CASE WHEN folder = '' THEN '/' ELSE folder END || bare END, 2), '/') AS s FROM {name}_cut),
{name}_walked AS (SELECT *, list_reduce(list_prepend('', s), lambda a, x: CASE WHEN x = '.' THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*\z', '') ELSE a || '/' || x END) || CASE WHEN s[-1] IN ('.', '..') THEN '/' ELSE '' END AS clean FROM {name}_steps),
{name} AS (SELECT {keep}, CASE WHEN regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN dst WHEN starts_with(dst, '//') THEN 'http:' || dst ELSE 'http://' || host || clean || rest END AS "full" FROM {name}_walked)"""


def aliases_sql(pages: str) -> str:
    """SQL of ``urls.judge`` over a table or subquery of (page_id, url, html)."""
    return rf"""
WITH RECURSIVE src AS (SELECT * FROM {pages}),
own AS (SELECT *, {_rule(0)} AS rule, {_rule(1)} AS own FROM (SELECT page_id, url, {_key('url')} AS node, {_split('url')} FROM src)),
hint AS (SELECT url, regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g') AS plain, {_split('url')} FROM src WHERE url IS NOT NULL AND html IS NOT NULL),
stated AS (SELECT url, host, path, plain, {_entities('b')} AS dst FROM (SELECT *, {_href(f"regexp_extract(plain, '{urls.BASE}', 1)")} AS b FROM hint)),
{_resolved('based', 'stated', 'url, plain')},
told AS (SELECT url, host, path, {_entities('raw')} AS dst FROM (SELECT url, {_split('"full"')}, unnest({_TAGS}) AS raw FROM based)),
{_resolved('link', "(SELECT * FROM told WHERE dst <> '')", 'url')},
one AS (SELECT {_key('url')} AS a, {_key('"full"')} AS b FROM link),
edge AS (SELECT a, b FROM one WHERE a <> b UNION SELECT b, a FROM one WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON r.other = e.a),
judged AS (SELECT node, other, {_rule(1)} AS own FROM (SELECT node, other, {_split("('http://' || other)")} FROM reach)),
alias AS (SELECT node, min(other) AS alias_of, CASE WHEN bool_or(coalesce(own = 'allow', false)) THEN 'allow' WHEN bool_or(coalesce(own = 'block', false)) THEN 'block' END AS spread FROM judged GROUP BY node)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(own, spread, 'allow') AS verdict, alias_of FROM own LEFT JOIN alias USING (node)
"""


OP6_SQL = aliases_sql("pages")
#: The pages with links of every kind put in: to the next page, to an allowed host, to a blocked one and to nowhere.
LINKED_SQL = aliases_sql("""(SELECT page_id, url, CASE CAST(page_id % 10 AS INT)
 WHEN 0 THEN '<link rel="canonical" href="http://alias.example.org/' || (page_id // 30) || '">'
 WHEN 1 THEN '<meta http-equiv="refresh" content="0; url=//hop' || (page_id // 20) || '.example.org/x?a=1&amp;b=2">'
 WHEN 2 THEN '<link href=''http://hop' || (page_id // 20) || '.example.org/x?a=1&b=2'' rel=canonical><link rel="canonical" href="http://block' || (page_id % 3) || '.net/">'
 WHEN 3 THEN '<link rel="canonical" href="../up/./' || (page_id % 5) || '"><link rel="canonical" href="http://www.example.net/en/' || (page_id // 100) || '">'
 WHEN 4 THEN '<!-- <link rel="canonical" href="http://x.net/"> --><link rel="canonical" href="?q=' || (page_id % 4) || '">'
 WHEN 5 THEN '<link rel="canonical" href="http://www.example.net/en/' || (page_id // 100) || '">'
 WHEN 7 THEN '<base target=x href="http://d.net/deep/er/"><link rel="canonical" href="../page/' || (page_id // 20) || '">'
 WHEN 8 THEN '<link rel="canonical" href="http&#58;&sol;/hop' || (page_id // 20) || '.example.org&#x3A;443/x?a=1&#38;b=2">'
 WHEN 9 THEN '<link rel="canonical" href="HTTP://D.net:80/deep/page/' || (page_id // 20) || '">' ELSE html END AS html FROM pages)""")

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM p WINDOW w AS (PARTITION BY hex)
"""


def _lloyd(rounds: int = 5, k: int = 40) -> str:
    """Lloyd's iterations unrolled: centroids c0 .. c<rounds>, assignments a0 .. a<rounds>. Whole numbers below 2^53 are exact as doubles."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INT) AS c, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v ORDER BY h, q LIMIT {k}))"""]
    dot = "list_inner_product({}.q, {}.q)".format
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v.q, min(struct_pack(d := {dot('v', 'v')} - 2 * {dot('v', 'w')} + {dot('w', 'w')}, c := w.c)) AS best FROM v, c{r} w GROUP BY vec_id, v.q)")
        if r < rounds:
            mean = f"(SELECT c, list(m ORDER BY i) AS q FROM (SELECT best.c AS c, i, floor(sum(q[i]) / count(*)) AS m FROM a{r}, range(1, 65) t(i) GROUP BY ALL) GROUP BY c)"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.q, o.q) AS q FROM c{r} o LEFT JOIN {mean} n USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(w.q, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} w ON best.c = w.c
"""


OP12_SQL = _lloyd()

OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
  WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_neardup": OP2_SQL, "op6_url_filter": OP6_SQL, "url_aliases": LINKED_SQL, "op8_warc_archive": OP8_SQL, "op12_centroids": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
