"""Personal data, centroid clustering and fill-in-middle against plain versions."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternlake.llm import fim, kmeans, pii

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, n long, output string"

# -------------------------------------------------------------- personal data


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    count = lambda m: sum(c in "0123456789" for c in m.group())
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= count(m) <= 19 and luhn(m.group())]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= count(m) <= 15]
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


CARD = "4111111111111111"
TEXTS = [
    None, "", " ", "a@b", "a@b.c", "x a@b.c.d@e.f g", "a@b.c_d@e.f", "a@b.c%d@e.f.@h.i", "@a.b", "a@.b", "é@é.fr jo.é@x.fr", "😀 a@b.co 😀 1.2.3.4",
    "1.2.3.4.5.6.7.8", "1.2.3.400.5.6.7.8", "01.002.3.255", "1.2.3.256", "12.34.56", "1..2.3.4", f"{CARD} {CARD}", f"x{CARD}x", "4111-1111 1111-1111", "4111  1111 1111 1111", "4111-1111-1111-1112",
    "+1 (279) 555-0216", "+1 279 555 0216 1.2.3.4", "+12", "++1234567890", "+1(((((2345678901", "+123456789012345", "+1234567890123456", "+1 234 567 890 - ", f"+{CARD}", "0" * 15, "0" * 16,
    f"mail a.b@c.de,{CARD};+49 (30) 1234-5678 10.0.0.1", "line\na@b.c\n1.2.3.4\n", "a@b.c " * 700,
]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize("trained", [False, True])
def test_base_spans_like_plain_search(spark, model, trained):
    rows = [(k, t, k, "x") for k, t in enumerate(TEXTS)] + [(None, TEXTS[4], 0, None), (4, TEXTS[4], 0, None)]
    got = pii.find(spark.createDataFrame(rows, DOCS), model if trained else None).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base_spans(TEXTS[4 if r["doc_id"] is None else r["doc_id"]] or "")
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in want) for k in range(4)], r
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
        assert not want or set(listed(want).split(",")) <= set(r["spans"].split(","))
        assert trained or r["spans"] == listed(want)


def test_long_runs(spark):
    """Runs of a hundred thousand characters take neither recursion nor a square of their length."""
    texts = ["1" * 100_000, "a" * 100_000, "+" + "1 " * 50_000, "a." * 50_000 + "@", "1-" * 50_000, "9." * 50_000]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), None).collect()
    assert {r["doc_id"]: (r["n_ip"], r["n_email"] + r["n_card"] + r["n_phone"]) for r in got} == {k: (12_500 if k == 5 else 0, 0) for k in range(6)}


def test_whole_table(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pii.find(docs, model).collect()
    assert len(got) == len(texts) and all(r["base_sha256"] == hashlib.sha256(listed(base_spans(texts[r["doc_id"]] or "")).encode()).hexdigest() for r in got)
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got) > 50 and sum(r["n_added"] for r in got) <= 3


def test_trees_select(model, spark):
    """Other ways of writing are found, look-alikes are not; what overlaps goes to the more probable."""
    texts = {1: "write to jo.doe (at) mail5.example dot com soon", 2: "host 152[.]143[.]123[.]131 is down", 3: "host 952[.]143[.]123[.]131 is down", 4: "card 4111.1111.1111.1111 here", 5: "card 4111.1111.1111.1112 here", 6: "we met at noon and left"}
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    kinds = {k: [s.split(":")[0] for s in v.split(",") if s] for k, v in got.items()}
    assert kinds[1] == ["email"] and kinds[2] == ["ip"] and kinds[4] == ["card"] and not kinds[3] and not kinds[5] and not kinds[6]


def test_every_proposal_counts(spark):
    """Training sees all labelled proposals, more than the 20,000 of a sample: eight of each address, in few distinct features."""
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to x"), letters, F.lit("@b.org soon")).alias("text"))
    rows = pii.labelled(docs).groupBy("kind", "y").agg(F.sum("n").alias("n"), F.count("*").alias("groups")).collect()
    assert {(r["kind"], r["y"]): r["n"] for r in rows} == {("email", 1.0): 36_000, ("email", 0.0): 12_000}
    assert sum(r["groups"] for r in rows) < 500


def test_expression_is_the_fitted_ensemble(spark):
    """Trees as expressions give what the library's own transform gives."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = spark.range(300).select(F.array(F.rand(1), F.rand(2)).alias("f")).withColumn("label", (F.col("f")[0] + F.col("f")[1] > 1).cast("double"))
    rows = spark.createDataFrame(rows.collect(), rows.schema).withColumn("features", array_to_vector("f"))
    fitted = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(rows)
    m = pii.Model([pii._nested(t._java_obj.rootNode()) for t in fitted.trees], list(fitted.treeWeights), 2.0, 0.0, {})
    out = fitted.transform(rows).select(vector_to_array("probability")[1].alias("p"), m.probability(F.col("f")).alias("q")).collect()
    assert all(math.isclose(r["p"], r["q"], rel_tol=1e-9) for r in out)


def test_redact_and_empty(spark):
    docs = spark.createDataFrame([(1, "a@b.c and 1.2.3.4!"), (2, None), (3, "none")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs, None).collect()} == {1: "[email] and [ip]!", 2: None, 3: "none"}
    none = docs.limit(0)
    assert pii.train(none) is None and pii.find(none, None).count() == 0


# ----------------------------------------------------------------- clustering


def plain_lloyd(rows, k, rounds, dim, scale=256, seed=2):
    q = {}
    for i, e in rows:
        if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e):
            q[i] = [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in e]
    order = sorted(q, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    c = [q[i] for i in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, w in enumerate(c))
    for _ in range(rounds):
        own = {i: near(v)[1] for i, v in q.items()}
        for n in range(len(c)):
            mine = [q[i] for i in q if own[i] == n]
            if mine:
                c[n] = [sum(x) // len(mine) for x in zip(*mine)]
    last = {i: near(v) for i, v in q.items()}
    total = lambda n: sum(d for d, m in last.values() if n in (None, m))
    fits = lambda v: v if v < 2**63 else None
    return {i: (n, fits(d), fits(total(n)), fits(total(None)), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, (d, n) in last.items()}


def cases():
    rng = np.random.default_rng(3)
    yield "plain", [(i, rng.normal(size=4).tolist()) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0, None, 0.0, 0.0]), (104, [math.nan] * 4), (105, [math.inf, 0.0, 0.0, 0.0]), (106, [0.0] * 4), (107, [0.0] * 4)]
    yield "odd", odd + [(i, rng.integers(-2, 2, 4).astype(float).tolist()) for i in range(30)]
    yield "large", [(i, (rng.normal(size=4) * 10.0 ** float(rng.integers(0, 12))).tolist()) for i in range(60)]
    yield "beyond", [(i, (rng.normal(size=4) * 10.0 ** float(rng.choice([0, 5, 8, 30, 306]))).tolist()) for i in range(40)]
    yield "few", [(1, [1.0, 2.0, 3.0, 4.0])]
    yield "none", [(1, None)]


@pytest.mark.parametrize("name,rows", list(cases()), ids=[n for n, _ in cases()])
def test_clusters_like_whole_numbers(spark, name, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("distance", F.lit("x")).repartition(3)
    got = {r["vec_id"]: tuple(r)[1:] for r in kmeans.cluster(table, k=5, rounds=3, dim=4).collect()}
    assert got == plain_lloyd(rows, 5, 3, 4)


def test_guard_of_products():
    """Just below the bound float64 is exact; the classes beyond take whole numbers."""
    top = kmeans.Nearest([[0] * 64], 1).bounds[0] - 1
    near = kmeans.Nearest([[-top] * 64, [top] * 64], 1)
    assert near.level.tolist() == [0, 0] and near.assign(np.full((1, 64), top - 1.0))[1].tolist() == [64]
    assert kmeans.Nearest([[2**23] * 64, [2**40] * 64], 1).level.tolist() == [1, 2]


# ------------------------------------------------------------- fill in middle


def plain_fim(doc_id, text, seed=7, fim_percent=100, spm_percent=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    spm = h4 % 100 < spm_percent
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


FIM = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "é\nü😀\n\nz", "x<P>y", "<S>", "tail <\n<\n", "p<\nS>\nM", "\x00\n\x00", "\r\n\x85 \n", "ab\n" * 5000, "q" * 9000 + "\n" + "r" * 9000, "é" * 3000 + "\n" + "ü\n" * 3000]


@pytest.mark.parametrize("chunk", [1, 7, 4096])
@pytest.mark.parametrize("percents", [(100, 50), (60, 0)])
def test_fim_like_lines(spark, chunk, percents):
    rows = [(k, FIM[k % len(FIM)], 1, "x") for k in range(5 * len(FIM))] + [(None, "a\nb\n", 1, None), (3, FIM[3], 1, None)]
    out = fim.arrange(spark.createDataFrame(rows, DOCS), *percents, chunk=chunk)
    got = [tuple(r) for r in out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()]
    want = [(i, *plain_fim(i, t, 7, *percents), t or "") for i, t, _, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_fim_empty(spark):
    assert fim.arrange(spark.createDataFrame([], DOCS)).count() == 0
