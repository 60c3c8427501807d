"""The stages, against plain versions one after the other."""

import hashlib

import public_tokenizers
from brute import dedup, leaks, simhash

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import sentencepiece

    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language_stage", "neardup_stage", "span_stage", "benchmark_stage", "encode_stage"]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    left = [(i, dict(left)[i]) for i, (_, c) in simhash(left).items() if c == i]
    new = dedup(left)
    left = [(i, new[i]) for i, t in left if new[i] == t or new[i].strip()]
    gone = {d for d, _ in leaks(left, bench)}
    left = [(i, t) for i, t in left if i not in gone]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: hashlib.sha256(",".join(map(str, lib.encode(t))).encode()).hexdigest() for i, t in left}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in rows} == want and len(rows) == len(want)


def test_stages_with_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "Some text of words that stays here.", "en", "s", 3), (1, "Some text of words that stays here.", "en", "s", 3), (2, None, None, None, None), (3, "", "en", None, 0), (4, "12 34", "en", "s", 5), (None, "Another text with letters in it.", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert sorted((r["doc_id"] for r in docs.collect()), key=repr) == [1, None]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_rows_with_null_or_repeated_ids(spark):
    """What is decided of one row touches no other row of its id."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(2).collect()
    texts = ["Rivers carry gravel down from quiet hills every spring.", "Nobody expected the old clock to ring at noon.", "Seven boats lay on the beach while gulls cried."]
    rows = [(None, texts[0]), (None, texts[1]), (None, "12 34"), (None, None), (None, item[0]["text"]), (5, texts[2]), (5, "56"), (5, item[1]["text"] + " More."), (5, texts[2])]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr) == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2])], key=repr)
