"""Substring deduplication by sliding sentence spans."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternlake.llm.common import partitions

_GAP = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"\S+")

#: Words of a passage that may not repeat.
PASSAGE = 51


def sentences(text: str) -> list[tuple[str, str]]:
    """(sentence, the gap behind it), which joined give ``text`` again: sentences end at . ! or ? before white space, and at line ends."""
    out, at = [], 0
    for m in _GAP.finditer(text):
        out.append((text[at : m.start()], m.group()))
        at = m.end()
    if at < len(text):
        out.append((text[at:], ""))
    return out


def runs(text: str, least: int, words: int) -> tuple[list[bytes], list[int], list[int]]:
    """(128-bit hash, first, end) of the run that begins at each sentence: the shortest of at least ``least`` sentences and ``words`` words.

    Sentences without words are no part of runs; case and white space do not count. A run that the text's end cuts short is none.
    """
    digest = xxhash.xxh3_128_digest
    marks, size, at = [], [], []
    for k, s in enumerate(_GAP.split(text)):
        if w := s.lower().split():
            marks.append(digest(" ".join(w)))
            size.append(len(w))
            at.append(k)
    hashes, first, end = [], [], []
    j = total = 0
    n = len(marks)
    for i in range(n):
        while j < n and (j - i < least or total < words):
            total += size[j]
            j += 1
        if j - i < least or total < words:
            break
        hashes.append(digest(b"".join(marks[i:j])))
        first.append(at[i])
        end.append(at[j - 1] + 1)
        total -= size[i]
    return hashes, first, end


def _numbers(words: list[str], known: dict[str, int]) -> list[int]:
    """64-bit hashes of words; ``known`` keeps them."""
    if len(known) > 800_000:
        known.clear()
    try:
        return [known[w] for w in words]
    except KeyError:
        pass
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return [known[w] for w in words]


def anchors(numbers: np.ndarray, sizes: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, 128-bit hashes as two columns) of word runs chosen by content, of texts one behind the other.

    Runs have about half of ``passage`` words; of the runs in any ``passage`` words the one with the least hash is chosen (winnowing). So equal
    stretches of ``passage`` words share a run, and chosen runs next to each other leave no word between them.
    """
    width = (passage + 1) // 2
    reach = passage - width + 1
    n = len(numbers)
    if n < passage:
        return np.empty(0, np.int64), np.empty((0, 2), np.uint64)
    both = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)])
        total = np.cumsum(np.r_[np.uint64(0), numbers * up[:-1]])
        h = (total[width:] - total[:-width]) * down[: n - width + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        both.append(h ^ (h >> np.uint64(29)))
    last = np.repeat(np.cumsum(sizes), sizes)  # where each word's text ends
    begin = np.flatnonzero(np.arange(n) + passage <= last)
    bits = np.uint64(n.bit_length())
    least = both[0] >> bits << bits | np.arange(len(both[0]), dtype=np.uint64)  # the place in the low bits: of equal hashes the first
    span = 1
    while 2 * span <= reach:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    at = np.unique(least[begin] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at, np.stack([both[0][at], both[1][at]], axis=1)


#: Repeating spans that a task remembers; beyond them each batch sends its first.
HOT = 100_000
#: Added to first and end of a span that counts words and not sentences.
WORD = 1 << 30


def passages(texts: list[str | None], passage: int, words: int, known: dict[str, int]) -> tuple[list[bytes], list[int], list[int], list[int]]:
    """(hash, text, first, end) of the ``anchors`` of texts, and of texts of a single sentence with ``words`` words or more as a whole."""
    split = [(t or "").lower().split() for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    numbers = np.array(_numbers([w for x in split for w in x], known), np.uint64)
    at, mark = anchors(numbers, sizes, passage)
    begin = np.cumsum(sizes) - sizes
    row = np.searchsorted(np.cumsum(sizes), at, "right")
    first = at - begin[row] + WORD
    marks, owner, end = [m.tobytes() for m in mark], row.tolist(), (first + (passage + 1) // 2).tolist()
    first = first.tolist()
    for k, x in enumerate(split):
        if len(x) >= words and not _GAP.search(texts[k].strip()):
            marks.append(xxhash.xxh3_128_digest("\n".join(["whole", *x])))
            owner.append(k)
            first.append(WORD)
            end.append(WORD + len(x))
    return marks, owner, first, end


def repeats_first(m: np.ndarray, rid: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows at the same place as the first of their hash: the same document's row again."""
    new = np.r_[True, (m[1:] != m[:-1]).any(axis=1)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
    return (rid == rid[head]) & (first == first[head])


def repeated(docs: DataFrame, least: int = 2, words: int = 12, passage: int = 0) -> DataFrame:
    """(doc_id, rid, first, end): every span of sentences that is not the first of its kind; with ``passage`` also spans of words, from WORD on.

    The first is the one with the smallest (doc_id, rid, first), null ids before all; rid is a hash of doc_id and text,
    so rows that are the same in both count as one document; doc_id may be of any type that sorts. A task keeps only the
    first of each hash of a batch for the join of all, and of hashes that repeated in a batch only what comes before all it sent; others are known to repeat.
    So a span that a third of all rows share reaches the join about once for each task. What reaches it is read in order, never gathered.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def after_hot(known, m, ids, rid, first, order, hot):
        """Mark in ``known`` also what follows a span that this task sent before; spans that repeat within a batch are remembered."""
        place = lambda k: ((x := ids[int(order[k])].as_py()) is not None, x, int(rid[order[k]]), int(first[order[k]]))
        begins = np.flatnonzero(~known)
        repeats = begins[np.r_[known[1:], False][begins]]
        if hot:
            keys = np.sort(np.fromiter((x for x, _ in hot), np.int64, len(hot)))
            at = np.minimum(np.searchsorted(keys, m[begins, 0]), len(keys) - 1)
            begins = begins[keys[at] == m[begins, 0]]
            for k, x in zip(begins.tolist(), map(tuple, m[begins].tolist())):
                if x in hot:
                    if hot[x] < place(k):
                        known[k] = True
                    else:
                        hot[x] = place(k)
        if len(hot) < HOT:
            for k, x in zip(repeats.tolist(), map(tuple, m[repeats].tolist())):
                if x not in hot:
                    hot[x] = place(k)

    def cut(batches):
        known_words: dict[str, int] = {}
        hot: dict[tuple, tuple] = {}
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                marks, owner, first, end = [], [], [], []
                texts = part.column(2).to_pylist()
                for row, text in enumerate(texts):
                    h, f, e = runs(text or "", least, words)
                    marks += h
                    owner += [row] * len(h)
                    first += f
                    end += e
                if passage:
                    for all_of, new in zip((marks, owner, first, end), passages(texts, passage, words, known_words)):
                        all_of += new
                if not marks:
                    continue
                mark = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                owner, first, end = np.array(owner), np.array(first, np.int32), np.array(end, np.int32)
                ids = part.column(0).take(pa.array(owner))
                rid = part.column(1).to_numpy(zero_copy_only=False)[owner]
                key = pc.rank(part.column(0), null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)[owner]
                order = np.lexsort((first, rid, key, mark[:, 1], mark[:, 0]))
                m = mark[order]
                known = np.r_[False, (m[1:] == m[:-1]).all(axis=1)] & ~repeats_first(m, rid[order], first[order])
                after_hot(known, m, ids, rid, first, order, hot)
                yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(m[:, 0]), pa.array(m[:, 1]), ids.take(pa.array(order)), pa.array(rid[order]), pa.array(first[order]), pa.array(end[order])], names)

    def later(batches):
        """Of rows in order of hash and place, those that follow one of their hash at another place, and those known to."""
        before = (None,) * 5
        for b in batches:
            if not b.num_rows:
                continue
            known, x, y, rid, first = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4, 5))
            same = np.r_[before[:3] == (x[0], y[0], bool(known[0])), (x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (known[1:] == known[:-1])]
            head = np.maximum.accumulate(np.where(same, -1, np.arange(len(x))))  # -1: the run began in an earlier batch
            own = np.where(head < 0, (rid == before[3]) & (first == before[4]), (rid == rid[head]) & (first == first[head]))
            h = head[-1]
            before = (x[-1], y[-1], bool(known[-1]), *(before[3:] if h < 0 else (rid[h], first[h])))
            hit = pa.array(known | (same & ~own))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(hit) for k in (3, 4, 5, 6)], names[3:])

    names = ["known", "x", "y", "doc_id", "rid", "first", "end"]
    found = _keyed(docs).select("doc_id", "rid", "text").mapInArrow(cut, f"known boolean, x long, y long, doc_id {kind}, rid long, first int, end int")
    dealt = found.repartition(partitions(docs.sparkSession), F.when(F.col("known"), F.xxhash64("rid", "first")).otherwise(F.col("x")))
    return dealt.sortWithinPartitions("known", "x", "y", "doc_id", "rid", "first").mapInArrow(later, f"doc_id {kind}, rid long, first int, end int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("rid", F.xxhash64("doc_id", "text"))


def without(text: str, gone: list[int]) -> tuple[str, int, int]:
    """(text without the sentences that spans cover, how many those are, how many there were). gone: first, end, first, end, ..."""
    parts = sentences(text)
    stretches = [(f - WORD, e - WORD) for f, e in zip(gone[::2], gone[1::2]) if f >= WORD]
    gone = [x for f, e in zip(gone[::2], gone[1::2]) if f < WORD for x in (f, e)]
    drop = np.zeros(len(parts) + 1, np.int64)
    for f, e in zip(gone[::2], gone[1::2]):
        drop[f] += 1
        drop[min(e, len(parts))] -= 1
    cover = np.cumsum(drop)[:-1] > 0
    if stretches and not cover.all():
        return _without_words(text, parts, cover, stretches)
    return "".join([s + g for (s, g), c in zip(parts, cover.tolist()) if not c]), int(cover.sum()), len(parts)


def _without_words(text: str, parts: list[tuple[str, str]], cover: np.ndarray, stretches: list[tuple[int, int]]) -> tuple[str, int, int]:
    """As ``without``, for ``cover`` of sentences and stretches of words; a sentence counts that loses a word."""
    begin = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    gone = np.zeros(len(text) + 1, np.int64)
    for a, e in stretches:
        gone[begin[a]] += 1
        gone[begin[e]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    at, n = 0, 0
    for (s, g), c in zip(parts, cover.tolist()):
        n += bool(c or gone[at : at + len(s)].any())
        gone[at : at + len(s) + len(g)] |= c
        at += len(s) + len(g)
    cut = [0, *(np.flatnonzero(gone[1:] != gone[:-1]) + 1).tolist(), len(text)]
    return "".join(text[a:e] for a, e in zip(cut, cut[1:]) if not gone[a]), n, len(parts)


def dedup_spans(docs: DataFrame, least: int = 2, words: int = 12, passage: int = 0) -> DataFrame:
    """Every row of ``docs`` with the text left after removal, and n_removed (sentences).

    A run is the shortest of at least ``least`` consecutive sentences that has ``words`` words or more; each sentence that lies in a
    run whose hash stands earlier in the corpus, or earlier in its own text, is removed with the gap behind it.
    With ``passage``, no stretch of that many words that stands earlier stays whole either, wherever sentences end: runs of half as many words, chosen
    by content so that each such stretch holds one, are removed where they repeat, and so are texts of one sentence with ``words`` words that repeat whole.
    Texts without such a run return as they are, null as null; a text that repeats whole becomes empty. Rows equal in doc_id and text count as one document and share one
    result, so both stay. Other columns are kept, whatever their names; n_removed replaces a column of that name.
    """
    gone = repeated(docs, least, words, passage).groupBy("doc_id", "rid").agg(F.flatten(F.collect_list(F.array("first", "end"))).alias("gone"))  # at most a text's runs
    gone = gone.select(F.col("rid").alias("__rid"), F.col("doc_id").alias("__id"), F.col("gone").alias("__gone"))
    own = "__rid" + "_" * max([len(c) for c in docs.columns])  # longer than any column's name, so no other's
    rows = docs.drop("n_removed").withColumn(own, F.xxhash64("doc_id", "text")).alias("d")
    joined = rows.join(gone.alias("g"), (F.col(f"d.{own}") == F.col("g.__rid")) & F.col("d.doc_id").eqNullSafe(F.col("g.__id")), "left")
    keep = [c for c in docs.columns if c != "n_removed"]

    def run(batches):
        for b in batches:
            spans = b.column(b.num_columns - 1)
            texts, removed = b.column(keep.index("text")).to_pylist(), [0] * b.num_rows
            for k, gone in enumerate(spans.to_pylist()):
                if gone:
                    texts[k], removed[k], _ = without(texts[k], gone)
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(i) for i, c in enumerate(keep)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.int64())], [*keep, "n_removed"])

    schema = docs.select(keep).schema.add("n_removed", "long")
    return joined.select(*[F.col(f"d.`{c}`") for c in keep], F.col("g.__gone").alias(own)).mapInArrow(run, schema)
