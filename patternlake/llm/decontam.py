"""Benchmark decontamination by latent semantic retrieval, then subsequence and answer checks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternlake.llm.common import partitions, shared_dir, stash

#: Words of half a passage: passages are two halves, one beginning at each half.
HALF = 32
#: Slots of the corpus-wide document frequencies.
SLOTS = 1 << 17
#: Passages that every corpus is taken to have besides its own when the share of passages with a word is estimated.
PRIOR = 4000


class Words:
    """Texts as 32-bit hashes of words, in bytes: lower case, without marks at either end; what has only marks is no word.

    Words with equal hashes count as one word. Of an item's words and a passage's some 10,000 pairs meet, so about one
    passage in 400,000 has one word too many in common with an item.
    """

    def __init__(self, keep: int = 800_000):
        self.known: dict[str, bytes] = {}
        self.keep = keep

    def raw(self, text: str | None) -> bytes:
        parts, known = (text or "").lower().split(), self.known
        try:
            return b"".join([known[c] for c in parts])
        except KeyError:
            pass
        if len(known) > self.keep:
            known.clear()
        for c in parts:
            if c not in known:
                known[c] = word_hash(c)
        return b"".join([known[c] for c in parts])

    def __call__(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), np.uint32)


def word_hash(chunk: str) -> bytes:
    if not chunk[0].isalnum() or not chunk[-1].isalnum():
        at = [k for k, c in enumerate(chunk) if c.isalnum()]
        if not at:
            return b""
        chunk = chunk[at[0] : at[-1] + 1]
    return (xxhash.xxh64_intdigest(chunk.encode("utf-8", "replace")) & 0xFFFFFFFF).to_bytes(4, "little")


_WORDS = Words()


def _rows(batch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of all rows in a row, and how many each has."""
    col = batch.column(column)
    raw = col.to_pylist()
    sizes = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
    return np.frombuffer(b"".join(raw), np.uint32), sizes


def _halves(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each half passage, where it begins among all words)."""
    n = -(-sizes // HALF)
    row = np.repeat(np.arange(len(sizes)), n)
    first = np.cumsum(sizes) - sizes
    return row, first[row] + HALF * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))


def _merged(words: DataFrame) -> DataFrame:
    """``words`` with some splits read by one task, so that the vectors that tasks add up to number as the cores, not as the splits."""
    return words.coalesce(4 * words.sparkSession.sparkContext.defaultParallelism)


def _sums(df: DataFrame, kind) -> dict[int, np.ndarray]:
    """Add up rows (k, v): v is a vector in bytes, as long as all of that k; per k on the executors, first in groups. Returns the sum of each k."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(v, kind)
                total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "v"])

    n, groups = partitions(df.sparkSession), max(1, round(df.sparkSession.sparkContext.defaultParallelism ** 0.5))
    if groups > 4:  # a tree of two levels
        df = df.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups))).repartition(n, "k", "g").select("k", "v").mapInArrow(add, "k long, v binary")
    rows = df.repartition(n, "k").mapInArrow(add, "k long, v binary").collect()  # one row for each k
    return {r["k"]: np.frombuffer(r["v"], kind) for r in rows}


def frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """(in how many passages of HALF words each slot occurs, passages), over all rows."""
    width = SLOTS // 16

    def count(batches):
        total, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            w, sizes = _rows(b, 1)
            row, begin = _halves(sizes)
            n += len(row)
            if len(w):
                of = np.zeros(len(w), np.int64)
                of[begin[1:]] = 1
                pair = np.cumsum(of) * SLOTS + (w % SLOTS)
                pair.sort()
                pair = pair[np.r_[True, pair[1:] != pair[:-1]]]
                total += np.bincount(pair % SLOTS, minlength=SLOTS)
        v = [total[k * width : (k + 1) * width].tobytes() for k in range(16)] + [np.full(width, n).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(17), pa.int64()), pa.array(v, pa.binary())], ["k", "v"])

    got = _sums(_merged(words).mapInArrow(count, "k long, v binary"), np.int64)
    return (np.concatenate([got[k] for k in range(16)]), int(got[16][0])) if got else (np.zeros(SLOTS, np.int64), 0)


def pieces(w: np.ndarray) -> list[np.ndarray]:
    """An item as passages like those of documents, the last one whole too."""
    return [w[a : a + 2 * HALF] for a in [*range(0, len(w) - 2 * HALF, HALF), max(0, len(w) - 2 * HALF)]]


def bounded(items: list[tuple], most: int) -> list[list[tuple]]:
    """Items in blocks of at most ``most`` passages; an item with more is a block of its own."""
    out, held = [], most + 1
    for x in items:
        n = len(pieces(x[1]))
        if held + n > most:
            out.append([])
            held = 0
        out[-1].append(x)
        held += n
    return out


class Block:
    """A block of benchmark items: their vocabulary, weights and latent vectors."""

    def __init__(self, items: list[tuple], idf: np.ndarray, floor: float, common: np.ndarray | None = None, own: int = 8):
        """``common``: slots without weight, but for the ``own`` rarest words of each passage of an item, so that none is without words."""
        self.ids = [i for i, _, _ in items]
        self.words = [w for _, w, _ in items]
        self.answers = [a for _, _, a in items]
        self.parts = [(i, p) for i, w in enumerate(self.words) for p in pieces(w)]
        self.item = [i for i, _ in self.parts]
        weight = idf.astype(np.float32)
        if common is not None:
            rare = [np.unique(w)[np.argsort(-idf[np.unique(w) % SLOTS], kind="stable")[:own]] for _, w in self.parts]
            common = common.copy()
            common[np.concatenate(rare) % SLOTS] = False
            weight[common] = 0
        self.idf = weight
        self.vocab = np.unique(np.concatenate(self.words))
        self.vocab = self.vocab[weight[self.vocab % SLOTS] > 0]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.vocab & 0xFFFFF] = True
        self.least = np.array([min(floor, 2 * floor * (len(w) / (2 * HALF)) ** 0.5) for _, w in self.parts], np.float32)

    def rows(self, rank: int) -> int:
        """Rows of its sketch, and most directions of its latent space."""
        return min(rank, 64 + len(self.parts))

    def held(self, rank: int) -> int:
        """Bytes of its basis and tables, and about those of its sketch."""
        return 4 * self.rows(rank) * (len(self.vocab) + len(self.parts)) + self.idf.nbytes + self.seen.nbytes

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of words of the vocabulary, their numbers)."""
        at = np.flatnonzero(self.seen[w & 0xFFFFF])
        k = np.minimum(np.searchsorted(self.vocab, w[at]), len(self.vocab) - 1)
        same = self.vocab[k] == w[at]
        return at[same], k[same]

    def query(self) -> np.ndarray:
        """TF-IDF rows of the items' passages over the vocabulary, of length 1."""
        q = np.zeros((len(self.parts), len(self.vocab)), np.float32)
        for i, (_, w) in enumerate(self.parts):
            w = w[self.idf[w % SLOTS] > 0]
            np.add.at(q[i], np.searchsorted(self.vocab, w), self.idf[w % SLOTS])
        return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)

    def fit(self, sketch: np.ndarray, rank: int) -> None:
        """Right singular vectors of corpus sketch and items together, the items with as much weight as the corpus."""
        q = self.query()
        both = np.vstack([sketch * (np.linalg.norm(q) / max(float(np.linalg.norm(sketch)), 1e-9)), q]).astype(np.float32)
        values, left = np.linalg.eigh(both @ both.T)
        top = np.argsort(-values)[: self.rows(rank)]
        top = top[values[top] > max(values.max(), 0) * 1e-7]
        basis = both.T @ (left[:, top] / np.sqrt(values[top]))
        self.weighted = (basis * self.idf[self.vocab % SLOTS][:, None]).astype(np.float32)
        z = q @ basis
        self.latent = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).T.astype(np.float32)


def grouped(blocks: Iterable[Block], rank: int, held: int) -> Iterator[list[Block]]:
    """Blocks that are searched in one pass: together of at most ``held`` bytes; a block with more stands alone."""
    group, n = [], 0
    for block in blocks:
        size = block.held(rank)
        if group and n + size > held:
            yield group
            group, n = [], 0
        group.append(block)
        n += size
    if group:
        yield group


def sketches(words: DataFrame, blocks: list[Block], rank: int) -> list[np.ndarray]:
    """For each block a random sketch of all TF-IDF passages over its vocabulary, all in one pass: every passage is added, with a random sign, to one of the rows.

    Its singular vectors approximate those of the whole matrix, and its size does not depend on the corpus.
    """
    shipped = words.sparkSession.sparkContext.broadcast(blocks)
    size = [b.rows(rank) for b in blocks]
    begins = np.cumsum([0, *size]).tolist()

    def run(batches):
        total = [np.zeros(n * len(m.vocab), np.float32) for n, m in zip(size, shipped.value)]
        for b in batches:
            w, sizes = _rows(b, 1)
            if not len(w):
                continue
            row, begin = _halves(sizes)
            # a passage's row and sign come from its words, so they are the same on every run
            mix = np.bitwise_xor.reduceat(w, begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            sign = 1 - 2 * (mix >> np.uint64(63)).astype(np.int64)
            for i, m in enumerate(shipped.value):
                at, k = m.find(w)
                if not len(at):
                    continue
                norm = np.sqrt(np.maximum(np.add.reduceat(m.idf[w % SLOTS] ** 2, begin), 1e-9))
                part = np.searchsorted(begin, at, "right") - 1
                to = (mix >> np.uint64(40)).astype(np.int64) % size[i]
                total[i] += np.bincount(to[part] * len(m.vocab) + k, (m.idf[w[at] % SLOTS] * sign[part] / norm[part]), minlength=len(total[i]))
        for i, t in enumerate(total):
            v = t.reshape(size[i], -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(begins[i], begins[i + 1]), pa.int64()), pa.array([x.tobytes() for x in v], pa.binary())], ["k", "v"])

    got = _sums(_merged(words).mapInArrow(run, "k long, v binary"), np.float32)
    none = lambda m: np.zeros(len(m.vocab), np.float32)
    return [np.stack([got.get(k, none(m)) for k in range(a, a + n)]) for m, a, n in zip(blocks, begins, size)]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits."""
    place: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := place.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def at_most(times: dict[int, int], region: list[int], need: float) -> bool:
    """Whether ``region`` holds ``need`` of an item's words, each as often as it has it at most: a bound of their common subsequence."""
    left = dict(times)
    n = 0
    for x in region:
        if left.get(x):
            left[x] -= 1
            n += 1
    return n >= need


def search(words: DataFrame, blocks: list[Block], near: float, loose: float, answer: float) -> DataFrame:
    """(doc_id, item, cosine, lcs, answer, start) of every pair that passes the checks; all passages against all items of the blocks, which are numbered one after the other."""
    shipped = words.sparkSession.sparkContext.broadcast(blocks)

    def run(batches):
        begins = np.cumsum([0, *(len(m.ids) for m in shipped.value)]).tolist()
        counted: dict[int, Counter] = {}  # of items that were met
        for b in batches:
            for k in range(0, b.num_rows, 400):
                part = b.slice(k, 400)
                best: dict[tuple[int, int], tuple] = {}
                w, sizes = _rows(part, 1)
                for m, first_item in zip(shipped.value, begins) if len(w) else ():
                    for row, item, start, cos in _candidates(m, w, sizes):
                        number = first_item + item
                        if number not in counted:
                            counted[number] = Counter(m.words[item].tolist())
                        x, size = m.words[item], len(m.words[item])
                        first = int(sizes[:row].sum()) if row else 0
                        lo, hi = max(first, start - size), min(first + int(sizes[row]), start + 2 * HALF + size)
                        region = w[lo:hi]
                        if not at_most(counted[number], region.tolist(), loose * size):
                            continue
                        share = common(x, region) / size
                        if share < loose:
                            continue
                        told = common(m.answers[item], region) / max(1, len(m.answers[item]))
                        if share >= near or told >= answer:
                            new = (share, told, cos, start - first)
                            if new > best.get((row, number), ()):
                                best[row, number] = new
                if best:
                    rows = pa.array([r for r, _ in best])
                    cols = [pa.array([v[c] for v in best.values()], pa.float64()) for c in (2, 0, 1)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array([i for _, i in best], pa.int64()), *cols, pa.array([v[3] for v in best.values()], pa.int64())], ["doc_id", "item", "cosine", "lcs", "answer", "start"])

    kind = words.schema["doc_id"].dataType.simpleString()
    return words.mapInArrow(run, f"doc_id {kind}, item long, cosine double, lcs double, answer double, start long")


def _row_sums(table: np.ndarray, rows: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of ``table``'s rows over stretches of ``rows`` that begin at ``cut``: the first of all stretches, then the second of all that have one, and so on."""
    size = np.diff(np.r_[cut, len(rows)])
    order = np.argsort(-size, kind="stable")
    begin, size = cut[order], size[order]
    total = np.zeros((len(cut), table.shape[1]), table.dtype)
    for j in range(int(size[0])):
        n = int(np.searchsorted(-size, -j))
        total[:n] += table[rows[begin[:n] + j]]
    out = np.empty_like(total)
    out[order] = total
    return out


def _candidates(m: Block, w: np.ndarray, sizes: np.ndarray):
    """(row, item, first word, cosine) of passages whose latent cosine with an item is high enough.

    The cosine divides by the passage's whole norm. It can't be more than the share of that norm that lies in the
    vocabulary, so passages below every item's least cosine are left out before the product, without loss.
    """
    row, begin = _halves(sizes)
    every = np.add.reduceat(m.idf[w % SLOTS] ** 2, begin)
    at, k = m.find(w)
    if not len(at):
        return
    half = np.searchsorted(begin, at, "right") - 1
    inside = np.bincount(half, m.idf[w[at] % SLOTS], minlength=len(begin))  # of repeated words the sum, so at least the length
    same = np.r_[row[1:] == row[:-1], False]
    follow = lambda x: x + np.where(same, np.r_[x[1:], 0], 0)
    norm = np.sqrt(np.maximum(follow(every), 1e-9))
    # squares of what lies inside, repeats counted as one long word
    order = np.lexsort((k, half))
    h, kk, ww = half[order], k[order], m.idf[w[at[order]] % SLOTS]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (kk[1:] != kk[:-1])])
    tf = np.add.reduceat(ww, new)
    length = np.sqrt(np.bincount(h[new], tf**2, minlength=len(begin)))
    bound = follow(length) / norm  # the length of a sum is at most the sum of lengths
    worth = np.flatnonzero((bound >= m.least.min()) & (follow(inside) > 0))
    if not len(worth):
        return
    need = np.zeros(len(begin) + 1, bool)
    need[worth] = True
    need[worth[same[worth]] + 1] = True
    use = need[half]
    at, k, half = at[use], k[use], half[use]
    for lo in range(0, len(worth), 4096):
        some = worth[lo : lo + 4096]
        a, z = np.searchsorted(half, some[0]), np.searchsorted(half, some[-1] + 1, "right")
        hs, inv = np.unique(half[a:z], return_inverse=True)
        if not len(hs):
            continue
        cut = np.flatnonzero(np.r_[True, inv[1:] != inv[:-1]])
        latent = np.zeros((len(hs) + 1, m.weighted.shape[1]), np.float32)
        latent[:-1] = _row_sums(m.weighted, k[a:z], cut)
        find = lambda x: np.where((i := np.minimum(np.searchsorted(hs, x), len(hs) - 1)) >= 0, np.where(hs[i] == x, i, len(hs)), len(hs))
        both = latent[find(some)] + np.where(same[some][:, None], latent[find(some + 1)], 0)
        cos = (both @ m.latent) / norm[some][:, None]
        p, piece = np.nonzero(cos >= m.least[None, :])
        high: dict[tuple[int, int], float] = {}
        for x, i, c in zip(p.tolist(), piece.tolist(), cos[p, piece].tolist()):
            high[x, m.item[i]] = max(c, high.get((x, m.item[i]), c))
        for (x, i), c in high.items():
            yield int(row[some[x]]), i, int(begin[some[x]]), min(1.0, c)


def answer_of(text: str, words: Words) -> np.ndarray:
    """What stands for an item's answer: its last sentence of three words or more, else all of it."""
    from patternlake.llm.spans import sentences

    for s, _ in reversed(sentences(text)):
        if len(got := words(s)) >= 3:
            return got
    return words(text)


def leaks(docs: DataFrame, bench: DataFrame, near: float = 0.8, loose: float = 0.6, answer: float = 0.8, floor: float = 0.3, block_items: int = 256, rank: int = 256, max_df: float = 0.05, held: int = 256 << 20) -> DataFrame:
    """Documents that hold a benchmark item: (doc_id, item_id, cosine, lcs, answer, start), one row per pair.

    Passages of 64 words, one beginning every 32, are compared with all items, cut likewise, in a latent space: TF-IDF with
    frequencies of the whole corpus, reduced by a distributed randomised SVD; words whose share of passages, estimated as df / (passages + 4000),
    is over ``max_df`` have no weight there, but for the eight rarest of each passage of an item. Above ``floor`` (less for items of
    under 16 words) the item's longest common subsequence with the passage and its surroundings decides: at
    least ``near`` of the item's words, or ``loose`` and ``answer`` of the words of its last sentence. start is the passage's first word.

    Items are taken in blocks of ``block_items``, and of twice as many passages, each with a latent space of its own; blocks of up to ``held`` bytes in all are
    broadcast together and searched in one pass, so the corpus is read twice for each such group (some 10,000 items of benchmark length by default). Texts are compared whole.
    An item with more passages than a block has is a block of its own. A region that barely touches a copy of an item can be missed where its passages stay below ``floor``, though chance words beside it would complete the answer. Null or empty texts and items without words match nothing. Repeated rows each return, as do
    items that repeat under other ids; null ids are kept. Other columns are ignored.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_WORDS.raw(t) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "words"])

    words = stash(docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, words binary"), f"{path}/words")
    n_items = bench.count()
    item_kind = bench.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, cosine double, lcs double, answer double, start long")
    if not n_items:
        return out
    df, passages = frequencies(words)
    idf = np.log((passages + 1) / (df + 1)) + 0.05
    parts = ceil(n_items / block_items)

    def blocks() -> Iterator[Block]:
        for k in range(parts):
            of = Words()
            rows = bench.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)).select("item_id", "text").distinct().collect()
            items = [(r["item_id"], of(r["text"]), answer_of(r["text"], of)) for r in sorted(rows, key=lambda r: (str(r["item_id"]), r["text"]))]
            for some in bounded([x for x in items if len(x[1])], 2 * block_items):
                yield Block(some, idf, floor, df > max_df * (passages + PRIOR))

    for group in grouped(blocks(), rank, held):
        for block, sketch in zip(group, sketches(words, group, rank)):
            block.fit(sketch, rank)
        names = spark.createDataFrame(list(enumerate(i for block in group for i in block.ids)), f"item long, item_id {item_kind}")
        found = search(words, group, near, loose, answer)
        out = out.union(found.join(F.broadcast(names), "item").select("doc_id", "item_id", "cosine", "lcs", "answer", "start"))
    return out
