"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Symbols of a text are parsed in stretches of this many, each from a fresh phrase.
STRETCH = 1024


#: Letters with a column of their own in the transition table; the transitions by all others are kept in a hash table.
COLUMNS = 62


def automaton(symbols) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``symbols``: of each state a target by symbol. State 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


def suffix_automaton(symbols, size: int) -> np.ndarray:
    """The automaton as a table for symbols below ``size``; -1: no transition."""
    return _table(automaton(symbols), size)


def _table(step: list[dict[int, int]], size: int) -> np.ndarray:
    out = np.full((len(step), size), -1, np.int32)
    for k, moves in enumerate(step):
        for c, to in moves.items():
            if c < size:
                out[k, c] = to
    return out


class Rare:
    """Transitions by symbols beyond the table, in a hash table with open places: one look for most keys, a few more for others."""

    def __init__(self, state: np.ndarray, symbol: np.ndarray, target: np.ndarray):
        n = len(state)
        self.bits = max(4, (2 * n).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.to = np.full(1 << self.bits, -1, np.int32)
        code, rest = state.astype(np.int64) << 21 | symbol, np.arange(n)
        at = self._place(code)
        while len(rest):  # of keys that want one free place the last gets it, the others go one further
            free = self.key[at[rest]] < 0
            self.key[at[rest[free]]] = code[rest[free]]
            rest = rest[self.key[at[rest]] != code[rest]]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
        self.to[at] = target

    def _place(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Targets, -1: none."""
        code = state.astype(np.int64) << 21 | symbol
        at, out = self._place(code), np.full(len(code), -1, np.int32)
        rest = np.arange(len(code))
        while len(rest):
            found = self.key[at[rest]]
            hit = found == code[rest]
            out[rest[hit]] = self.to[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
        return out


class Model:
    """One automaton per language over all letters of the samples. Symbol 0 stands for every run of characters that are no letters, 1 for letters that no sample has."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        seen = Counter(c for t in samples.values() for c in t.lower() if c.isalpha())
        self.classes = {c: k for k, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])), 2)}
        self.size = min(len(self.classes), COLUMNS) + 2
        tables, start = [], 0
        self.roots, self.scale = [], []
        rare = []
        look = self.lookup()
        for lang in self.langs:
            s, _ = symbols([samples[lang]], look)
            step = automaton(s.tolist())
            t = _table(step, self.size)
            tables.append(np.where(t >= 0, t + start, -1).astype(np.int32))
            rare += [(k + start, c, to + start) for k, moves in enumerate(step) for c, to in moves.items() if c >= self.size]
            self.roots.append(start)
            self.scale.append(log2(max(2, len(s))))
            start += len(t)
        tables.append(np.full((1, self.size), -1, np.int32))  # the last state leads nowhere: where an unknown symbol ends
        self.table = np.concatenate(tables)
        self.rare = Rare(*np.array(rare, np.int64).T) if rare else None

    def lookup(self) -> np.ndarray:
        """Class of every code point, kept with the model."""
        if not hasattr(self, "_look"):
            low = np.zeros(0x110000, np.int32)
            for c in range(0x110000):
                if not (0xD800 <= c < 0xE000) and chr(c).isalpha():
                    low[c] = self.classes.get(chr(c).lower()[:1], 1)
            self._look = low
        return self._look


def symbols(texts: list[str], look: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row and how many each has; runs without letters become one 0, none at a text's start."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = look[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)]
    before = np.zeros(len(code), np.int32)
    before[1:] = code[:-1]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.empty(0, np.int64)
    before[first[sizes > 0]] = 0
    keep = (code > 0) | (before > 0)
    total = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], total[first + sizes] - total[first]


def phrases(code: np.ndarray, sizes: np.ndarray, table: np.ndarray, roots: list[int], rare: Rare | None = None) -> np.ndarray:
    """Phrases that each text takes per language, (texts, languages): each phrase is the longest match with the language's sample."""
    alphabet = table.shape[1]
    beyond = code >= alphabet
    some, narrow = bool(beyond.any()), np.where(beyond, 1, code)  # symbol 1 leads nowhere
    of, begin, n = [], [], []
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    parts = -(-sizes // STRETCH)
    of = np.repeat(np.arange(len(sizes)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[of] + k * STRETCH
    n = np.minimum(STRETCH, sizes[of] - k * STRETCH)
    order = np.argsort(-n, kind="stable")
    of, begin, n = of[order], begin[order], n[order]
    flat = table.ravel()
    root = np.array(roots, np.int32)[:, None]
    state = np.repeat(root, len(of), axis=1)
    count = np.ones((len(roots), len(of)), np.int32)
    live = len(of)
    for t in range(int(n[0]) if len(n) else 0):
        while n[live - 1] <= t:
            live -= 1
            if live and n[live - 1] <= t:
                live = int(np.searchsorted(-n, -t, side="left"))
        c = narrow[begin[:live] + t]
        nxt = flat[state[:, :live] * alphabet + c]
        begun = flat[root * alphabet + c]
        if some and rare is not None and len(at := np.flatnonzero(beyond[begin[:live] + t])):
            wide = np.tile(code[begin[at] + t], len(roots))
            nxt[:, at] = rare(state[:, at].ravel(), wide).reshape(len(roots), -1)
            begun[:, at] = rare(np.repeat(root[:, 0], len(at)), wide).reshape(len(roots), -1)
        bad = nxt < 0
        if t:
            count[:, :live] += bad
        nxt = np.where(bad, np.where(begun < 0, len(table) - 1, begun), nxt)
        state[:, :live] = nxt
    out = np.zeros((len(sizes), len(roots)), np.int64)
    np.add.at(out, of, count.T)
    return out


def predict(texts: list[str | None], model: Model, look: np.ndarray) -> list[tuple[str, float]]:
    """(language, score) per text; score is how far the runner-up lies behind, as a share of its phrases."""
    code, sizes = symbols([t or "" for t in texts], look)
    out = [("und", 0.0)] * len(texts)
    has = np.add.reduceat(np.r_[code > 0, False], np.minimum(np.cumsum(sizes) - sizes, len(code))) if len(texts) else []
    some = np.flatnonzero((sizes > 0) & (np.asarray(has) > 0)) if len(texts) else []
    if not len(some) or not model.langs:
        return out
    norm = phrases(code, sizes, model.table, model.roots, model.rare) * np.array(model.scale)[None, :]
    for i in some.tolist():
        row = norm[i]
        best = int(np.argmin(row))  # languages are sorted, so a tie goes to the first by name
        rest = np.delete(row, best)
        score = float((rest.min() - row[best]) / rest.min()) if len(rest) else 1.0
        out[i] = (model.langs[best], score)
    return out


def held_out(col) -> object:
    return F.crc32(col.cast("string").cast("binary")) % 5 == 0


def _equal_shares(texts: list[str], most: int) -> str:
    """The texts joined, cut to ``most`` characters in all: each gives an equal stretch, and what short ones leave goes to the others."""
    left, take = most, [0] * len(texts)
    for k, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        take[i] = min(len(texts[i]), left // (len(texts) - k))
        left -= take[i]
    return " ".join(t[:n] for t, n in zip(texts, take))


def train(docs: DataFrame, train_docs: int = 48, train_chars: int = 40_000, total_chars: int = 400_000) -> Model:
    """Fit on a bounded sample: per language the ``train_docs`` labelled documents with the lowest hash of their id,
    of their texts ``train_chars`` characters (fewer with many languages: ``total_chars`` over all), an equal stretch of each document.

    Every letter of the sample has a symbol of its own, whatever the script; letters that no sample has share one. Rows with null text, lang or doc_id and those whose crc32(doc_id) mod 5 is 0 are never used.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("doc_id", "lang").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= train_docs)
    # bounded: train_docs rows per language
    rows = usable.select("doc_id", "lang", F.substring("text", 1, train_chars).alias("text")).join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "rank", "text").collect()
    langs = sorted({r["lang"] for r in rows})
    most = min(train_chars, total_chars // max(1, len(langs)))
    parts: dict[str, list] = {k: [] for k in langs}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"], r["text"])):
        parts[r["lang"]].append(r["text"])
    return Model({k: _equal_shares(v, most) for k, v in parts.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``; only text decides.

    Null text, or one without a letter: ``und`` with score 0. A null doc_id is not held out. Whole texts are
    parsed in stretches of 1024 symbols. Ties go to the first language by name. Repeated rows each return.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by total_chars of the sample

    def run(batches):
        m = shipped.value
        look = m.lookup()
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            out, at = [], 0
            while at < len(texts):  # about 2M characters at a time
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= 2_000_000):
                    chars += len(texts[end] or "")
                    end += 1
                out += predict(texts[at:end], m, look)
                at = end
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return got.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")

