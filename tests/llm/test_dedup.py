"""SimHash, embeddings and spans against brute force, with nulls, ties, repeats and clashing columns."""

import random

import numpy as np
import pytest
from brute import fingerprint as plain_fingerprint
from brute import groups, simhash as plain_simhash, spans as plain_spans, vectors as plain_vectors

from patternlake.llm import neardup, simhash, spans
from patternlake.llm.common import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def words(rng, n):
    return [rng.choice(["alpha", "Beta", "gamma", "délta", "eps"]) + str(rng.randrange(300)) for _ in range(n)]


@pytest.fixture(scope="module")
def near_docs():
    rng = random.Random(5)
    docs = []
    for _ in range(12):
        base = words(rng, 400)
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "changed"
            docs.append((len(docs), " ".join(w)))
    extra = ["", None, " \t\n", "one", "One", "two words", "a b c", "a b c d"]
    return docs + [(1000 + k, t) for k, t in enumerate(extra)]


@pytest.mark.parametrize("text", [None, "", "  ", "A", "a b c", "a  b\tc\nd E", "x\u00a0y z\u2003w v", "ÀB cd " * 50, "w " * 200_000])
def test_fingerprint(text):
    if text and len(text) > 100_000:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint("w " * 8)
    else:
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_ring_loses_nothing():
    rng = np.random.default_rng(0)
    for segments in (5, 6, 7, 8):
        x = np.zeros(4000, np.uint64)
        for _ in range(4):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        assert (np.bitwise_count(x) <= 4).all() and simhash.ring(x, 4, segments).all()
    far = rng.integers(0, 2**63, 4000).astype(np.uint64)
    assert simhash.ring(far, 4, 6).mean() < 0.01


def test_near_duplicates(spark, near_docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in near_docs], DOCS + ", fp string, component_id int")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == plain_simhash(near_docs)


@pytest.mark.parametrize("segments", [5, 6, 7])
def test_links_of_dense_group(spark, monkeypatch, segments):
    """A group far over the limits: blocks, and no more links than a forest in each."""
    rng = random.Random(1)
    center = rng.getrandbits(64)
    fps = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)})
    signed = [f - (f >> 63 << 64) for f in fps]
    monkeypatch.setattr(simhash, "BLOCK", 64)
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, segments).collect()
    want = groups(signed, [(a, b) for k, (a, x) in enumerate(zip(signed, fps)) for b, y in zip(signed[k + 1 :], fps[k + 1 :]) if (x ^ y).bit_count() <= 4])
    assert groups(signed, [(r["a"], r["b"]) for r in edges]) == want
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4 for r in edges)


def test_simhash_ids(spark):
    df = spark.createDataFrame([(None, "same words in here"), (None, "quite other words"), (5, "same words in here"), (5, "same words in here")], DOCS)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 5, False), (None, None, False), (5, 5, True), (5, 5, True)], key=repr)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_components(spark, tmp_path):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 60)]
    rng.shuffle(chain)
    edges = chain + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 200)] + [(500, k) for k in range(501, 540)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/x").collect()}
    nodes = sorted({x for e in edges for x in e if x is not None})
    want = groups(nodes, [(a, b) for a, b in edges if a is not None])
    assert all(got.get(n, n) == want[n] for n in nodes)
    assert components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}/y").collect() == []


def embedding_rows():
    rng = np.random.default_rng(4)
    rows = []
    for label in range(3):
        for _ in range(120):
            rows.append((len(rows), rng.normal(size=16).tolist(), label))
        for _ in range(6):
            base = rng.normal(size=16)
            rows += [(len(rows) + k, (base + rng.normal(size=16) * 0.05).tolist(), label) for k in range(8)]
    base = rng.normal(size=16)
    rows += [(len(rows) + k, (base * (k + 1)).tolist(), 0) for k in range(80)]  # a hot group: lists saturate
    rows += [(len(rows) + k, base.tolist(), 0) for k in range(5)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8, [1e300] * 16, [-0.0] + [1e300] * 15]
    rows += [(n + k, e, 1) for k, e in enumerate(odd)]
    return rows + [(n + 50, base.tolist(), None), (n + 51, base.tolist(), 2)]


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 32)
    rows = embedding_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    want = plain_vectors([(i, e, label) for i, e, label in rows if not (e and any(x is not None and abs(x) > 1e200 for x in e))])
    assert {i: got[i] for i in want} == want
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_embeddings_of_floats_repeats_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [2.0, 0.01], 1), (4, [0.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, embedding array<float>, label int, rid string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (4, 0, 4, True)], key=repr)


def test_embedding_recall_on_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df, threshold=0.6, floor=0.2, k=20).collect()}
    want = plain_vectors(rows, 0.6)
    links = sum(n for n, _ in want.values())
    assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.9 * links and all(got[i][0] <= want[i][0] for i in want)


def test_embeddings_where_the_search_finds_no_link(spark, monkeypatch):
    """Whatever the search misses, the exact step finds."""
    monkeypatch.setattr(neardup, "BLOCK", 32)
    monkeypatch.setattr(neardup, "_nearest", lambda rid, *more: (rid[:0], rid[:0], np.empty(0)))
    rng = np.random.default_rng(9)
    cone = rng.normal(size=8)
    rows = [(k, (cone + rng.normal(size=8) * 0.12).tolist(), 0) for k in range(150)] + [(200 + k, rng.normal(size=8).tolist(), 1) for k in range(40)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = plain_vectors(rows)
    assert got == want and max(n for n, _ in want.values()) > 10


def _joined(spark, path, rows, roots, **how):
    """Brute-force components over given roots, and those of the exact step."""
    vecs = neardup.stash(neardup.vectors_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), f"{path}/vecs")
    at = {r["low"]: r["rid"] for r in vecs.collect()}
    given = spark.createDataFrame([(at[i], at[r]) for i, r in roots.items()] or [(-1, -1)], "rid long, root long")
    got = [(r["u"], r["v"]) for r in neardup.exact_joins(vecs, given, 0.98, path, **how).collect()]
    back = {v: k for k, v in at.items()}
    return groups(at, [(back[u], back[v]) for u, v in got] + list(roots.items())), got


@pytest.mark.parametrize("dim,small,most,cell", [(3, 24, 6, 64), (6, 40, 16, 1 << 21), (16, 32, 64, 16 * 40)])
def test_exact_step_alone_finds_every_link(spark, monkeypatch, tmp_path, dim, small, most, cell):
    """Without any search: cells of pivots, cells in cells, and blocks of what does not part give the brute-force components."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "CELL", cell)
    rng = np.random.default_rng(dim)
    rows = [(k, rng.normal(size=dim).tolist(), k % 2) for k in range(500)]
    for k in range(0, 500, 5):  # lone pairs at the very border
        x, y = np.array(rows[k][1]), rng.normal(size=dim)
        y -= y @ x / (x @ x) * x
        z = 0.9803 * x / np.linalg.norm(x) + np.sqrt(1 - 0.9803**2) * y / np.linalg.norm(y)
        rows.append((1000 + k, (3 * z).tolist(), k % 2))
    cone = rng.normal(size=dim)
    rows += [(2000 + k, (cone + rng.normal(size=dim) * 0.13).tolist(), 0) for k in range(150)]
    found, _ = _joined(spark, str(tmp_path), rows, {}, small=small, most=most, levels=2)
    want = plain_vectors(rows)
    assert found == groups(found, [(i, c) for i, (_, c) in want.items()])


def test_exact_step_looks_between_components_only(spark, monkeypatch, tmp_path):
    """A dense component in one cell meets what else the cell holds, not itself; a label of one component is not read."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "CELL", 64)
    rng = np.random.default_rng(3)
    base = np.eye(4)[0]
    rows = [(k, (base + rng.normal(size=4) * 0.004).tolist(), 0) for k in range(300)]
    rows += [(400 + k, (base + np.eye(4)[1] * 0.18 * (k + 1)).tolist(), 0) for k in range(4)] + [(500 + k, rng.normal(size=4).tolist(), 0) for k in range(9)]
    rows += [(600 + k, (base * (k + 1) + np.eye(4)[2] * 0.01 * k).tolist(), 1) for k in range(100)]
    roots = {k: 0 for k in range(300)} | {600 + k: 600 for k in range(100)}
    seen = []
    joins = neardup._block_pairs
    monkeypatch.setattr(neardup, "_block_pairs", lambda r: seen.append(joins(r)) or seen[-1])
    found, got = _joined(spark, str(tmp_path), rows, roots, small=32, most=8, levels=1)
    assert found == groups(found, [(i, c) for i, (_, c) in plain_vectors(rows).items()]) and 0 < len(got) < 50
    runs = [{r["root"] for r in rs} for rs in _runs_of(seen[-1])]
    assert runs and all(len(r) > 1 for r in runs)


def _runs_of(rows):
    by = {}
    for r in rows.collect():
        by.setdefault(r["key"], []).append(r)
    return by.values()


def test_equal_cosines_give_no_more_than_k():
    """A slice of vectors that are all as near to each other: k for each, and pairs that join them all."""
    x = np.full((256, 3), 1.0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u, v, _ = neardup._nearest(np.arange(256), x, 10, 0.7, 0.98)
    assert len(u) <= 256 * 11 and set(groups(range(256), list(zip(u.tolist(), v.tolist()))).values()) == {0}
    u, v, _ = neardup._nearest(np.arange(256), x, 10, 0.7, 2.0)
    assert len(u) == 2560


def test_hot_cells_are_parted_anew(spark, monkeypatch):
    """One cone in one cell of every tree: the pairs that are compared differ from draw to draw."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(k, (base + rng.normal(size=8) * 1e-3).tolist(), 0) for k in range(120)]
    vecs = neardup.vectors_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).cache()
    a, b = ({(r["u"], r["v"]) for r in neardup.start(vecs, 1, 10**6, 200, 0.7, seed).collect()} for seed in (0, 1))
    assert a and len(a - b) > len(a) / 2


PASSAGE = "The first sentence of a passage that comes back. Then a second one follows it here. And a third closes the passage now."


def span_docs():
    rng = random.Random(3)
    own = lambda k: " ".join(words(rng, k)) + "."
    docs = [(i, f"{own(9)} {own(8)} {PASSAGE} {own(7)}\n\n{own(6)} {own(9)}") for i in range(5)]
    docs += [(10, PASSAGE), (11, PASSAGE.upper().replace(" ", "  ")), (12, " ".join([PASSAGE] * 3)), (13, None), (14, ""), (15, "\n\n"), (16, "of. " * 40), (17, own(30)), (18, "Short. One. Two.")]
    return docs


def test_spans(spark):
    docs = span_docs()
    df = spark.createDataFrame([(t, i, "r", [1]) for i, t in docs], "text string, doc_id long, rid string, gone array<int>")
    rows = spans.dedup_spans(df).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    want = plain_spans(docs)
    assert {i: t or "" for i, t in got.items()} == want
    assert got[13] is None and PASSAGE in got[0] and PASSAGE not in got[3] and got[17] == dict(docs)[17]
    assert all(r["rid"] == "r" and r["gone"] == [1] for r in rows)
    assert {r["doc_id"] for r in rows if r["n_removed"]} == {i for i, t in docs if (t or "") != want[i]}


def test_spans_of_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = spans.dedup_spans(spark.createDataFrame(docs, DOCS)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == plain_spans(docs)


def test_spans_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (2, PASSAGE)], DOCS)
    got = sorted(((r["doc_id"], r["text"]) for r in spans.dedup_spans(df).collect()), key=repr)
    assert got == sorted([(1, ""), (1, ""), (None, PASSAGE), (2, "")], key=repr)  # null sorts first
    assert spans.dedup_spans(df.limit(0)).collect() == []


def test_sentences_join_again():
    for text in ("", "a", "a. b", "a.\n\nb! c?  d", "\n\nx", ". . .", "a. "):
        assert "".join(s + g for s, g in spans.sentences(text)) == text


def test_passages_without_sentence_ends(spark):
    """51 words or more that stand earlier never stay whole, wherever sentences end; what stands once stays."""
    rng = random.Random(8)
    shared, count = " ".join(words(rng, 51)), iter(range(10**6))
    own = lambda n: " ".join(f"own{next(count)}" for _ in range(n))
    docs = [(k, f"{own(20 + k)}\t{shared.upper() if k % 2 else shared} {own(30)}") for k in range(8)] + [(20, own(14)), (22, own(60)), (30, own(3) + " " + own(80))]
    docs += [(i + 1, t) for i, t in docs if i in (20, 22)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in spans.dedup_spans(spark.createDataFrame(docs, DOCS), passage=51).collect()}
    low = {i: " ".join(t.lower().split()) for i, (t, _) in got.items()}
    assert got[0] == (docs[0][1], 0) and got[30] == (dict(docs)[30], 0) and got[20][1] == got[22][1] == 0
    assert got[21] == ("", 1) and got[23] == ("", 1)
    for k in range(1, 8):
        w = low[k].split()
        assert " ".join(shared.lower().split()) not in low[k] and got[k][1] == 1
        assert [x for x in w if x.startswith("own")] == [x for x in docs[k][1].lower().split() if x.startswith("own")]


def test_spans_keep_columns_of_any_name(spark):
    text = "One two three four five six. Seven eight nine ten eleven twelve thirteen. "
    names = ["doc_id", "text", "__rid", "__RID_", "__id", "__gone", "rid", "first", "n_removed"]
    for key in (1, "a"):
        docs = spark.createDataFrame([(key, text, "u", "v", 1.5, "w", [1], 2, "x"), (key * 2, text, None, None, None, None, None, None, None)], f"doc_id {'string' if key == 'a' else 'long'}, text string, __rid string, __RID_ string, __id double, __gone string, rid array<int>, first int, n_removed string")
        got = {r["doc_id"]: r for r in spans.dedup_spans(docs, passage=51).collect()}
        assert got[key]["__rid"] == "u" and got[key]["__id"] == 1.5 and got[key]["rid"] == [1] and got[key]["n_removed"] == 0 and got[key].__fields__ == [*names[:-1], "n_removed"]
        assert got[key * 2]["text"] == "" and got[key * 2]["n_removed"] == 2
