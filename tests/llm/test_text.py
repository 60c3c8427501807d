"""Decontamination, language ID, license scans, encoders and token files."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import leaks as plain_leaks
from brute import language, lcs, license_labels, licensing
from pyspark.sql import functions as F

from patternlake.llm import decontam, langid, licenses, spencode, tokenbin

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "a b", " lead", "trail ", "two  spaces", "▁mark", "line\nbreak\n\n\tx", "naïve Straße ÀÉ", "日本語 text", "Σας İx ŉ", "e\u0301 x", "it's DON'T x'sa !!'s 12a3", "a<|endoftext|>b", "<s> </s> <unk>", "\x00 \x1f\x85x", "×÷ª «x» µ²", "word " * 3000]


# ------------------------------------------------------------ decontamination


def test_language_samples_take_from_all_rows():
    assert langid._equal_shares(["a" * 10, "b" * 3, "c" * 10], 13) == "aaaaa bbb ccccc"
    assert langid._equal_shares(["ab", "cd"], 40) == "ab cd" and langid._equal_shares([], 5) == ""


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(0, 90)), rng.integers(0, 6, rng.integers(0, 90))
        assert decontam.common(a, b) == lcs(a.tolist(), b.tolist())


def test_leaks_like_brute_force(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert got == plain_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()]) and got


def paraphrase_case():
    rng = np.random.default_rng(7)
    noise = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n))
    item = noise(30) + ". " + "the answer is forty two exactly."
    w = item.split()
    swapped = " ".join(x if k % 4 or k > 29 else "other" for k, x in enumerate(w))  # a quarter of the question replaced, the answer kept
    spoiled = " ".join(x if k % 4 and k < 30 else "other" for k, x in enumerate(w))  # as much kept, but no answer
    docs = [(0, noise(100) + " " + item + " " + noise(100)), (1, noise(70) + " " + swapped + " " + noise(10)), (2, noise(200)), (3, None), (4, ""), (5, "?? !! ..."), (6, spoiled), (7, item.upper().replace(" ", " - "))]
    return docs, [(10, item), (11, None), (12, ""), (13, "..."), (14, noise(3))]


def test_paraphrases_and_answers(spark):
    docs, bench = paraphrase_case()
    d = spark.createDataFrame([(i, t, "q") for i, t in docs], DOCS + ", words string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b).collect()}
    assert got == plain_leaks(docs, bench) == {(0, 10), (1, 10), (7, 10)}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b, block_items=1).collect()} == got
    assert decontam.leaks(d.limit(0), b).collect() == [] and decontam.leaks(d, b.limit(0)).collect() == []


def test_repeated_words_and_planted_paraphrases(spark):
    """What decides is the subsequence: words that repeat count as often as they stand, and replaced words are borne up to the limit."""
    rng = np.random.default_rng(11)
    noise = lambda n: [f"v{rng.integers(60 if common else 3000)}" for common in rng.random(n) < 0.35]
    bench = [(0, " ".join(["ja"] * 44 + [f"u{k}" for k in range(8)]))] + [(k, " ".join(noise(20 + k)) + ". " + " ".join(noise(6)) + ".") for k in range(1, 40)]
    docs = [(0, " ".join(noise(50) + ["ja"] * 46 + noise(50)))]
    for k, (_, text) in enumerate(bench[1:], 1):
        w = text.split()
        for share in (0.1, 0.18, 0.3, 0.45):
            kept = [x if rng.random() > share else f"r{rng.integers(9999)}" for x in w]
            docs.append((len(docs), " ".join(noise(int(rng.integers(0, 200))) + kept + noise(40))))
    docs += [(1000, docs[1][1]), (1000, docs[1][1]), (None, docs[1][1]), (1001, "v1 " * 30_000 + bench[5][1])]
    found = decontam.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")).select("doc_id", "item_id").collect()
    want = plain_leaks(docs, bench)
    got = {tuple(r) for r in found}
    assert (0, 0) in got and (1001, 5) in got and len(want) > 60
    # brute force also takes regions that barely touch the copy, where chance words of the text before complete an answer
    assert got <= want and len(want - got) <= 0.05 * len(want)
    assert len([r for r in found if r["doc_id"] == 1000]) == 2 * len({r["item_id"] for r in found if r["doc_id"] == 1000})


def test_passes_do_not_grow_with_blocks(spark, monkeypatch):
    """Ten blocks of items are sketched and searched in one pass each, with the result of one block and of a pass for each block."""
    rng = np.random.default_rng(5)
    noise = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 20_000, n))
    bench = [(k, noise(20 + k % 60)) for k in range(400)]
    docs = [(k, noise(30 + k) + " " + bench[7 * k][1] + " " + noise(50)) for k in range(50)] + [(99, noise(400)), (100, None)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")
    passes, plain = [], decontam.sketches
    monkeypatch.setattr(decontam, "sketches", lambda words, blocks, rank: passes.append(len(blocks)) or plain(words, blocks, rank))

    def run(**how):
        passes.clear()
        found = decontam.leaks(d, b, **how)
        scans = found._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
        return {(r["doc_id"], r["item_id"]) for r in found.collect()}, scans, list(passes)

    want = {(k, 7 * k) for k in range(50)}
    got, scans, blocks = run(block_items=40)
    assert got == want and scans == 1 and len(blocks) == 1 and blocks[0] >= 10
    got, scans, blocks = run()
    assert got == want and scans == 1 and len(blocks) == 1 and blocks[0] <= 4
    got, scans, blocks = run(block_items=100, held=1)
    assert got == want and scans == len(blocks) >= 4 and set(blocks) == {1}


def test_copies_of_long_items(spark):
    """Items of many passages are found wherever a copy stands, and no less than without a candidate search."""
    rng = np.random.default_rng(3)
    noise = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 30_000, n))
    bench = [(k, noise(n)) for k, n in enumerate((64, 65, 500, 1000, 2000))]
    docs = [(k, noise(40 + 9 * k) + " " + x + " " + noise(60)) for k, x in bench] + [(9, noise(900))]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string"), block_items=16).collect()}
    assert got == {(k, k) for k, _ in bench}


# ---------------------------------------------------------------- language ID


def test_many_languages(spark):
    """Forty-eight languages of three scripts, in families whose words differ by endings and habits of spelling only: held-out documents come out right."""
    rng = np.random.default_rng(9)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x3B1, 0x3CA)))]
    rows = []
    for family in range(12):
        letters = list(scripts[family % 3])
        stems = ["".join(rng.choice(letters, int(n))) for n in rng.integers(2, 6, 150)]
        for branch in range(4):
            ends = ["".join(rng.choice(letters, int(n))) for n in rng.integers(1, 3, 8)]
            words = [s + ends[int(k)] for s, k in zip(stems, rng.integers(0, 8, len(stems)))]
            often = rng.permutation(np.arange(1, len(words) + 1) ** -0.8)
            rows += [(len(rows) + k, " ".join(rng.choice(words, 60, p=often / often.sum())), f"f{family:02d}.{branch}", "s") for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = langid.train(docs)
    assert len(m.langs) == 48
    got = langid.identify(docs, m).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_automaton_has_all_substrings():
    s = np.random.default_rng(1).integers(0, 3, 60).tolist()
    t = langid.suffix_automaton(s, 3)

    def has(x):
        at = 0
        for c in x:
            at = t[at, c]
            if at < 0:
                return False
        return True

    subs = {tuple(s[i:j]) for i in range(60) for j in range(i + 1, min(61, i + 7))}
    assert all(has(x) for x in subs)
    assert not any(has(x) for x in [(a, b, c, d, e, f) for a in range(3) for b in range(3) for c in range(3) for d in range(3) for e in range(3) for f in range(3)] if x not in subs)


def test_phrases_like_greedy_parse():
    samples = {"a": "abracadabra banana cabana", "b": "xylophone zebra quartz"}
    m = langid.Model(samples)
    look = m.lookup()
    texts = ["banana", "zebra banana quartz", "", "q", "cab " * 700]
    code, sizes = langid.symbols(texts, look)
    got = langid.phrases(code, sizes, m.table, m.roots)

    def greedy(x, sample):
        sample, n = tuple(sample), 0
        for k in range(0, len(x), langid.STRETCH):
            part, at = tuple(x[k : k + langid.STRETCH]), 0
            while at < len(part):
                size = 1
                while at + size < len(part) and any(sample[i : i + size + 1] == part[at : at + size + 1] for i in range(len(sample) - size)):
                    size += 1
                at, n = at + size, n + 1
        return n

    at = 0
    for t, (text, size) in enumerate(zip(texts, sizes)):
        x = code[at : at + size].tolist()
        at += size
        for j, lang in enumerate(m.langs):
            assert got[t, j] == greedy(x, langid.symbols([samples[lang]], look)[0].tolist()), (text, lang)


def test_predictions_like_greedy_parse():
    """Choice and score over several scripts, with more letters than the table has columns."""
    rng = np.random.default_rng(5)
    word = lambda base, n, k: " ".join("".join(chr(base + int(x)) for x in rng.zipf(1.4, 5) % n) for _ in range(k))
    samples = {"zh": word(0x4E00, 900, 300), "ru": word(0x430, 32, 300), "en": word(97, 26, 300), "ja": word(0x3041, 80, 300), "de": word(97, 24, 200) + " äöü ß"}
    m = langid.Model(samples)
    assert len(m.classes) > langid.COLUMNS and m.rare is not None
    texts = [t[:200] for t in samples.values()] + [samples["zh"][:50] + samples["ru"][:80], "龘龘 ab", "", None, "12", "ß", samples["en"] * 2, " a "]
    for text, (lang, score) in zip(texts, langid.predict(texts, m, m.lookup())):
        want = language(text, samples)
        assert lang == want[0] and abs(score - want[1]) < 1e-12, text
    alike = langid.Model({"b": "same words", "a": "same words"})
    assert langid.predict(["same words"], alike, alike.lookup()) == [("a", 0.0)]


def test_repeated_rows_of_a_language(spark):
    rows = [(1, "the cat sat on the mat", "en")] * 3 + [(2, "le chat est sur la table", "fr")]
    df = spark.createDataFrame(rows, DOCS + ", lang string")
    assert sorted(r["lang_pred"] for r in langid.identify(df, langid.train(df)).collect()) == ["en", "en", "en", "fr"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("acc")).first()
    assert r["n"] > 100 and r["acc"] >= 0.98
    assert got.where("score < 0 or score > 1").isEmpty()
    assert {r["doc_id"] for r in got.where("held_out").collect()} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_language_odd_cases(spark):
    train = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, None, "de"), (None, "x", "es"), (4, "the", None)], DOCS + ", lang string")
    m = langid.train(train)
    assert m.langs == ["en", "fr"]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate([None, "", "123 !?", "the mat", "la table", "ß", "e" * 5000])] + [(None, "the cat", 1)], DOCS + ", score int")
    got = {r["doc_id"]: (r["lang_pred"], r["held_out"]) for r in langid.identify(rows, m).collect()}
    assert [got[i][0] for i in range(5)] == ["und", "und", "und", "en", "fr"] and got[None] == ("en", False)
    assert got[5][0] in m.langs
    none = langid.train(train.limit(0))
    assert {r["lang_pred"] for r in langid.identify(rows, none).collect()} == {"und"}
    assert langid.identify(rows.limit(0), m).collect() == []


# -------------------------------------------------------------- license scans


def test_base_phrases(spark):
    texts = [None, "", "CC-BY and cc by; CC\nBY", "All rights reserved. all  RIGHTS_reserved", "GNU General Public License", "ccby cc. by", "İ all rights reserved", "über cc by", "x " * 40_000 + "cc by"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs).collect()}
    assert got == {k: licensing(t) for k, t in enumerate(texts)}
    real = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(real).collect()}
    assert got == {r["doc_id"]: licensing(r["text"]) for r in real.collect()}
    assert licenses.scan(real.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("licensed under the Apache License 2.0", ""),  # mandatory wording is missing
        ("Released under the MIT License.", "mit"),
        ("under the 3 clause BSD license", "bsd"),
        ("Creative Commons Attribution 4.0 International License", "cc-by"),
        ("Copyright (c) 2020 Some One, All rights reserved", "proprietary,reserved"),
        ("GNU Lesser General Public License version 3", "gpl"),
        ("under the mit and license", ""),
    ],
)
def test_templates(text, labels):
    assert licenses.Scanner(licenses.BASE, licenses.TEMPLATES).scan(text)[5] == labels


ALL = [(label, m) for some in (licenses.TEMPLATES, licenses.NOTICES) for label, ms in some.items() for m in ms]


def filled(markup, optional):
    """A text of the template, with or without its optional regions."""
    t = re.sub(r"\{\{\d+\}\}", "Jane", markup)
    while "[[" in t:
        t = re.sub(r"\[\[([^\[\]]*)\]\]", r"\1" if optional else "", t)
    return t


def test_notices_like_brute_force():
    """Whole notices with and without optional regions, broken ones, and notices one after the other."""
    s, texts = licenses.Scanner(licenses.BASE, licenses.TEMPLATES, licenses.NOTICES), [None, "", "x", "cc by all rights reserved"]
    for label, m in ALL:
        for optional in (False, True):
            t = filled(m, optional)
            w = t.split()
            assert label in s.scan(f"Before. {t} After.")[5].split(",")
            texts += [t, " ".join([*w[: len(w) // 2], "changed", *w[len(w) // 2 :]]), " ".join(w[:-1]), f"{t} {t}", t.upper()]
    for t in texts:
        assert s.scan(t)[5:] == license_labels(t, ALL), t


def test_scan_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = [filled(m, k % 2) for k, (_, m) in enumerate(ALL)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(None, lines[0]), (None, lines[0]), (-1, " ".join(lines))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS + ", labels string")
    got = sorted(((r["doc_id"], r["labels"], r["score"], r["n_templates"]) for r in licenses.scan(df).collect()), key=repr)
    assert got == sorted(((i, *license_labels(t, ALL)) for i, t in rows), key=repr)


def test_template_markup():
    t = licenses.Template("x", "a [[b [[c]]]] {{2}} d")
    assert [t.match(s.split(), 0) for s in ("a d", "a b d", "a b c d", "a c d", "a q r d", "a q r s d", "a b q r d e", "a")] == [2, 3, 4, 3, 4, -1, 5, -1]
    for bad in ("[[a", "a]]", "[[a]]", "{{2}} a"):
        with pytest.raises(ValueError):
            licenses.Template("x", bad)


# ------------------------------------------------------------------- encoders


def test_pieces_like_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = ODD + real
    rows = spencode.encode(spark.createDataFrame(list(enumerate(texts)), DOCS), PIECES).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = lib.encode(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["covered"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_spans_hold_the_pieces():
    e = spencode.Encoder(PIECES)
    for text in [t for t in ODD if t]:
        raw, ids = text.encode(), e.ids(text)
        s = e.spans(text, ids)
        normal, source = e.normal(raw)
        size = e.size[ids]
        end = np.cumsum(size)
        assert (np.column_stack([source[end - size], source[end]]) == s).all()
        assert b"".join(raw[a:b] for a, b in s.tolist()) == raw


def test_offsets_like_library(spark, tmp_path):
    """Offsets of a model without and of one with a character map."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    import sentencepiece

    m = pb.ModelProto.FromString(open(PIECES, "rb").read())
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    m.normalizer_spec.precompiled_charsmap = pb.ModelProto.FromString(rules.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    m.normalizer_spec.remove_extra_whitespaces = True
    mapped = tmp_path / "mapped.model"
    mapped.write_bytes(m.SerializeToString())
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    for file in (PIECES, str(mapped)):
        e = spencode.Encoder(file)
        assert bool(e.normal.map.list) == (file != PIECES)
        for text in [t for t in ODD if t] + ["ＡＢＣ　x", "①ﬁ  Å", " ab  c ", "㍿ Ⅷ"] + [t for t in real if t]:
            ids = e.ids(text)
            assert ids.tolist() == e.lib.encode(text)
            if not any(p.type == 6 for p in (m.pieces[i] for i in ids)):  # the library gives a character's bytes to the last of its byte pieces
                assert e.spans(text, ids).tolist() == e._library_spans(text).tolist()
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "")], DOCS)
    assert sorted(r["n_tokens"] for r in spencode.encode(df, PIECES).collect()) == [0, 2, 2] and spencode.encode(df.limit(0), PIECES).collect() == []


def test_character_map_like_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    for rule in ("nmt_nfkc", "nfkc_cf"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = pb.ModelProto.FromString(lib.serialized_model_proto()).normalizer_spec
        own = spencode.Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        for text in [t for t in ODD if t is not None and len(t) < 1000] + ["ＡＢＣ　x", "①ﬁ  Å", "ｶﾞ x", "　\t\n", "a\u200bb", "㍿ Ⅷ"]:
            got, source = own(text.encode())
            assert got.decode() == lib.normalize(text), (rule, text)
            assert len(source) == len(got) + 1 and (np.diff(source) >= 0).all()


def test_words_like_library(spark):
    enc = tokenbin.WordEncoder(WORDS)
    assert enc.simple
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in [t for t in ODD if t is not None] + real:
        assert enc.ids(text).tolist() == enc.lib.encode(text, add_special_tokens=False).ids


def test_words_of_many_texts(monkeypatch):
    """Texts encoded together have the library's ids, each alone, and what repeats in them is looked up once."""
    enc = tokenbin.WordEncoder(WORDS)
    marks = ["it's we'll 'tis ''s x's' a.b c, d! (e) f-g 1,234 \u00c0\u00df\u00ff \u00dcber,\u00fc", " \t lead and trail \r\n", "", "<|endoftext|> a", "a\u2028b", "'", "a'", "a''s", "A1 1A a1,"]
    texts = [t for t in ODD if t is not None] + marks + ["over and over, " * 2000]
    asked = []
    real = enc._known
    monkeypatch.setattr(enc, "_known", lambda names: asked.append(list(names)) or real(names))
    for _ in range(2):
        assert [x.tolist() for x in enc.many(texts)] == [enc.lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == 2 and all(len(a) == len(set(a)) for a in asked)
    assert enc.many([]) == [] and [x.tolist() for x in enc.many([""])] == [[]]
    for most in (1, 10, 1 << 23):
        assert [t for some in tokenbin._slices([None, *texts], most) for t in some] == ["", *texts]


def test_grammar_round_trip():
    rng = np.random.default_rng(0)
    for base in (300, 70_000):
        docs = [rng.zipf(1.4, n) % 290 for n in (0, 1, 2, 5000, 3, 9000)] + [np.full(999, 7)]
        sizes = np.array([len(x) for x in docs])
        blob = tokenbin.pack(np.concatenate(docs).astype(np.uint32), sizes, base)
        s = tokenbin.Shard(blob)
        assert len(s) == len(docs) and len(s.rules)
        assert len(s.seq) < sizes.sum()
        for k, x in enumerate(docs):
            assert s.document(k).tolist() == x.tolist()
            assert s.slice(k, 3, 40).tolist() == x[3:40].tolist()
            assert s.slice(k, 0, 10**9).tolist() == x.tolist()
        assert (s.all() == np.concatenate(docs)).all()
        for r, n in zip(range(len(s.rules)), s.length.tolist()):
            assert len(s.expand(np.array([base + r]))) == n
    with pytest.raises(ValueError):
        tokenbin.Shard(b"nothing at all, and long enough to be read")


def test_no_pair_is_left():
    """Re-Pair goes on until no pair occurs twice within documents, runs of one symbol and long repeats included."""
    rng = np.random.default_rng(3)
    text = rng.zipf(1.5, 4000) % 280
    docs = [text, text, text[100:900], np.full(3001, 7), np.arange(200) % 2, rng.zipf(1.3, 9000) % 280, np.array([], int), np.array([5])]
    ids, sizes = np.concatenate(docs).astype(np.uint32), np.array([len(x) for x in docs])
    for least in (2, 5):
        seq, count, rules = tokenbin.compress(ids, sizes, 300, least)
        pairs = {}
        for part in np.split(seq, np.cumsum(count)[:-1]):
            part, at = part.tolist(), 0
            while at + 1 < len(part):
                p = (part[at], part[at + 1])
                pairs[p] = pairs.get(p, 0) + 1
                at += 2 if len(part) > at + 2 and part[at] == part[at + 1] == part[at + 2] else 1
        assert max(pairs.values(), default=0) < least
        assert (tokenbin.Expansion(rules, 300)(seq) == ids).all() and count[6] == 0
        s = tokenbin.Shard(tokenbin.pack(ids, sizes, 300, least))
        assert all((s.document(k) == x).all() for k, x in enumerate(docs))


def test_token_files(spark):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(10 * k, t, k) for k, t in enumerate(texts)], DOCS + ", start int")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenbin.token_files(df, WORDS).collect()}
    lib, at, want = tokenbin.WordEncoder(WORDS).lib, 0, {}
    for k, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[10 * k] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want


def test_token_files_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (1, "zz")], DOCS)
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in tokenbin.token_files(df, WORDS).collect() if r["doc_id"])
    null = [r for r in tokenbin.token_files(df, WORDS).collect() if r["doc_id"] is None]
    assert len(rows) == 3 and null[0]["start"] == 0
    assert rows[0][0] == null[0]["n_tokens"] and all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:]))
    assert tokenbin.token_files(df.limit(0), WORDS).collect() == []
