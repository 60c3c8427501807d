"""Token ids in grammar-compressed binary shards (Re-Pair), with random access by document."""

from __future__ import annotations

import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patternlake.llm.common import partitions, shared_dir

MAGIC = b"PLRP2\0"
#: Characters for which lower case, composition and white space are the same for Python and the tokenizer.
_SIMPLE = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")


class WordEncoder:
    """Encodes as the tokenizers library does, whole texts, without special tokens being added.

    The tokenizer splits at white space before it merges, so a text's ids are those of its words one after
    the other. The library's model encodes each distinct word once; at most ``keep`` are kept. Texts with
    characters outside ASCII and Latin-1 letters, or with text of a special token, go through the library whole, and so does
    every text of a tokenizer of another make.
    """

    def __init__(self, file: str, keep: int = 600_000):
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.simple = (
            (spec["normalizer"] or {}).get("normalizers") == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
            and [x.get("type") for x in split] == ["Split", "ByteLevel"]
            and split[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
            and split[0]["behavior"] == "Removed"
            and split[0]["invert"]
            and not split[1]["add_prefix_space"]
            and not split[1]["use_regex"]
            and spec["model"]["type"] == "BPE"
        )
        self.piece = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-zà-öø-ÿß0-9]+").findall
        self.kind = np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = np.dtype(self.kind).char
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.keep = keep
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in shown]
        self.bytes = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. What stands between white space is looked up once for all ``texts``; a text's ids are then gathered by its chunks' numbers."""
        out: list = [None] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if not self.simple or not _SIMPLE.fullmatch(text) or any(s in text for s in self.special):
                out[k] = np.array(self.lib.encode(text, add_special_tokens=False).ids, self.kind)
            else:
                plain.append(k)
        if not plain:
            return out
        parts = pc.ascii_split_whitespace(pc.utf8_lower(pa.array([texts[k] for k in plain], pa.string())))
        coded = parts.values.dictionary_encode()
        known = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        length = np.fromiter(map(len, known), np.int64, len(known)) // self.kind().itemsize
        which = coded.indices.to_numpy()
        n = length[which]
        end = np.r_[0, np.cumsum(n)]
        at = np.repeat((np.cumsum(length) - length)[which] - end[:-1], n)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(known), self.kind)[at]
        cut = end[parts.offsets.to_numpy()].tolist()
        for k, i, j in zip(plain, cut, cut[1:]):
            out[k] = ids[i:j]
        return out

    def _known(self, names: list[str]) -> list[bytes]:
        """Ids of each chunk, as bytes."""
        chunks, words, piece, tokenize = self.chunks, self.words, self.piece, self.lib.model.tokenize
        if len(chunks) > self.keep:
            chunks.clear()
        if len(words) > self.keep:
            words.clear()
        for c in names:
            if c not in chunks:
                # most are a word, or a word and a mark; the pattern says the same
                found = [c] if c.isalpha() else [c[:-1], c[-1]] if c[:-1].isalpha() and not c[-1].isalnum() else piece(c)
                for w in found:
                    if w not in words:
                        raw = w if w.isascii() else "".join([self.bytes[x] for x in w.encode()])
                        words[w] = array(self.code, [t.id for t in tokenize(raw)]).tobytes()
                chunks[c] = words[found[0]] if len(found) == 1 else b"".join([words[w] for w in found])
        return [chunks[c] for c in names]


_KEPT: dict[str, WordEncoder] = {}


def _slices(texts: list[str | None], most: int = 1 << 23):
    """Texts (null: empty) in lists of about ``most`` characters, whole."""
    some, size = [], 0
    for t in texts:
        some.append(t or "")
        size += len(some[-1])
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def word_encoder(file: str) -> WordEncoder:
    if file not in _KEPT:
        _KEPT[file] = WordEncoder(file)
    return _KEPT[file]


def compress(ids: np.ndarray, sizes: np.ndarray, base: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, symbols of each document, rules), until no pair occurs ``least`` times.

    Each round replaces many pairs by new symbols from ``base`` on: the most frequent first where places overlap, of equally
    frequent ones by a hash, so that a long repeated stretch halves in each round. Of a run of one symbol every
    other place counts. Pairs never reach over a document's end, so each document is decoded alone. A pair of two old symbols can't become more frequent,
    so places whose pair was too rare once are not looked at again.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    at = np.flatnonzero(~last).astype(np.int32)
    rules: list[np.ndarray] = []
    made = 0
    while len(at):
        at, skipped = _alternate(at, seq)
        width = np.uint64((base + made).bit_length())
        code, place, times = _sorted_pairs(at, seq, width)
        often = times >= least
        if not often.any():
            break
        place = place[np.repeat(often, times)]
        pair, times = code[np.cumsum(times) - times][often], times[often]
        rarity = np.uint64(len(seq)) - times.astype(np.uint64)
        order = np.argsort(rarity << np.uint64(24) | pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40))
        rank_of = np.empty(len(pair), np.int32)
        rank_of[order] = np.arange(len(pair), dtype=np.int32)
        mine = np.repeat(rank_of, times)
        rank = np.full(len(seq) + 2, len(pair), np.int32)  # rank[k + 1] belongs to place k
        rank[place + 1] = mine
        free = (mine < rank[place]) & (mine <= rank[place + 2])
        take, which = place[free], mine[free]
        kept = np.bincount(which, minlength=len(pair)) >= least  # the others lost their places to pairs that go first
        use = kept[which]
        take, which = take[use], which[use]
        chosen = pair[order[kept]]
        rules.append(np.stack([chosen >> width, chosen & ((np.uint64(1) << width) - np.uint64(1))], axis=1).astype(np.uint32))
        number = np.cumsum(kept, dtype=np.uint32) + np.uint32(base + made - 1)
        made += len(chosen)
        look = np.zeros(len(seq) + 1, bool)  # the last entry takes what lies before the first place
        for some in (place, skipped, take, take - 1):
            look[some] = True
        seq[take] = number[which]
        last[take] = last[take + 1]
        stay = np.ones(len(seq), bool)
        stay[take + 1] = False
        seq, last, look = seq[stay], last[stay], look[:-1][stay]
        at = np.flatnonzero(look & ~last).astype(np.int32)
    count = np.zeros(len(sizes), np.int64)
    count[sizes > 0] = np.diff(np.r_[-1, np.flatnonzero(last)])
    return seq, count, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def _alternate(at: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places that count, places left out): within a run of one symbol every other place is left out."""
    twin = np.flatnonzero(seq[at] == seq[at + 1])
    if not len(twin):
        return at, at[:0]
    t = at[twin]
    begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1] + 1])
    odd = (np.arange(len(t)) - np.repeat(begin, np.diff(np.r_[begin, len(t)]))) % 2 == 1
    keep = np.ones(len(at), bool)
    keep[twin[odd]] = False
    return at[keep], t[odd]


def _sorted_pairs(at: np.ndarray, seq: np.ndarray, width: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs as codes, sorted; their places; how often each distinct pair occurs). Code and place share a word where they fit, which sorts fastest."""
    room = np.uint64(len(seq).bit_length())
    code = seq[at].astype(np.uint64)
    code <<= width
    code |= seq[at + 1]
    if 2 * width + room <= 64:
        code <<= room
        code |= at.view(np.uint32)
        code.sort()
        place = (code & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int32)
        code >>= room
    else:
        order = np.argsort(code, kind="stable")
        code, place = code[order], at[order]
    return code, place, np.diff(np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)]), len(code)])


class Expansion:
    """What each symbol stands for, laid out once for a shard."""

    def __init__(self, rules: np.ndarray, base: int):
        n = base + len(rules)
        self.length, self.start = np.ones(n, np.int64), np.arange(n, dtype=np.int64)
        levels, done = [], base
        while done < n:  # a stretch of rules whose parts are all known: one for each round of the compression
            new = rules[done - base :]
            ready = int(np.argmax(np.r_[(new >= done).any(axis=1), True]))
            if not ready:
                raise ValueError("damaged rules")
            self.length[done : done + ready] = self.length[new[:ready]].sum(axis=1)
            levels.append((done, done + ready))
            done += ready
        self.start[base:] = base + np.cumsum(self.length[base:]) - self.length[base:]
        self.flat = np.empty(base + int(self.length[base:].sum()), np.uint32)
        self.flat[:base] = np.arange(base)
        for a, z in levels:
            part = self(rules[a - base : z - base].ravel())
            self.flat[self.start[a] : self.start[a] + len(part)] = part

    def __call__(self, seq: np.ndarray) -> np.ndarray:
        """The ids that ``seq`` stands for."""
        n = self.length[seq]
        end = np.cumsum(n)
        if not len(end):
            return np.empty(0, np.uint32)
        at = np.repeat(self.start[seq] - (end - n), n)
        at += np.arange(int(end[-1]))
        return self.flat[at]


def _pack_symbols(x: np.ndarray, high: int) -> bytes:
    """Symbols in 16 + ``high`` bits: the low halves, then the high bits packed."""
    low = x.astype("<u2").tobytes()
    return low + np.packbits((x[:, None] >> np.arange(16, 16 + high, dtype=np.uint32)) & 1 == 1).tobytes() if high else low


def pack(ids: np.ndarray, sizes: np.ndarray, base: int, least: int = 2) -> bytes:
    """One shard. Layout, little-endian: magic; base, rules, documents, symbols, long rules (32 bits each), bits over 16 in a symbol (8 bits);
    the rules' parts; their expansion lengths in a byte each, 255 for those of 255 and more, which follow in 32 bits; tokens and symbols of each document; the symbols.
    """
    seq, count, rules = compress(ids, sizes, base, least)
    length = Expansion(rules, base).length[base:]
    high = max(0, (base + len(rules) - 1).bit_length() - 16)
    long = length[length >= 255]
    head = MAGIC + struct.pack("<IIIIIB", base, len(rules), len(sizes), len(seq), len(long), high)
    parts = [head, _pack_symbols(rules.ravel(), high), np.minimum(length, 255).astype("u1").tobytes(), long.astype("<u4").tobytes()]
    return b"".join([*parts, sizes.astype("<u4").tobytes(), count.astype("<u4").tobytes(), _pack_symbols(seq, high)])


class Shard:
    """Reads a shard: a document or a stretch of one without expanding the rest."""

    def __init__(self, blob: bytes):
        if blob[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.base, r, d, s, n_long, high = struct.unpack_from("<IIIIIB", blob, len(MAGIC))
        at = len(MAGIC) + 21

        def take(n, kind):
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        def symbols(n):
            low = take(n, "<u2").astype(np.uint32)
            if high:
                bits = np.unpackbits(take(-(-n * high // 8), "u1"), count=n * high).reshape(n, high)
                low |= (bits.astype(np.uint32) << np.arange(16, 16 + high, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
            return low

        self.rules = symbols(2 * r).reshape(r, 2)
        self.length = take(r, "u1").astype(np.int64)
        self.length[self.length == 255] = take(n_long, "<u4")
        self.sizes = take(d, "<u4")
        self.count = take(d, "<u4")
        self.seq = symbols(s)
        self.expand = Expansion(self.rules, self.base)
        self.first = np.r_[0, np.cumsum(self.count.astype(np.int64))]
        if self.first[-1] != s or (self.expand.length[self.base :] != self.length).any():
            raise ValueError("damaged shard")

    def __len__(self) -> int:
        return len(self.sizes)

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.seq[self.first[k] : self.first[k + 1]])

    def all(self) -> np.ndarray:
        return self.expand(self.seq)

    def slice(self, k: int, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` of document ``k``, expanding only the symbols that hold them."""
        seq = self.seq[self.first[k] : self.first[k + 1]]
        size = self.expand.length[seq]
        stop = np.cumsum(size)
        begin, end = max(0, begin), min(end, int(self.sizes[k]))
        if begin >= end:
            return np.empty(0, np.uint32)
        i, j = np.searchsorted(stop, begin, "right"), np.searchsorted(stop, end, "left") + 1
        skip = begin - (stop[i] - size[i])
        return self.expand(seq[i:j])[skip : skip + end - begin]


def write_shards(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 2, shard_tokens: int = 1 << 20, parts: int | None = None) -> None:
    """Encode each text (null: empty), append ``end_id`` and write shards of about ``shard_tokens`` ids in ascending doc_id order.

    Documents are dealt by ranges of (doc_id, hash of text), so many rows with one doc_id are spread; null ids
    come first. Each task streams through its range and holds one shard. A row of the table at ``path`` is a shard:
    part and shard (its place), first (ids before it in its part), tokens, doc_ids and blob.
    """
    n = parts or partitions(docs.sparkSession)

    def run(batches):
        enc, part = word_encoder(tokenizer_file), TaskContext.get().partitionId()
        base = max(enc.lib.get_vocab_size(), end_id + 1)
        tail = np.array([end_id], enc.kind)
        ids, arrays, total, first, shard = [], [], 0, 0, 0

        def close():
            nonlocal ids, arrays, total, first, shard
            sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
            blob = pack(np.concatenate(arrays), sizes, base)
            out = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([shard]), pa.array([first]), pa.array([total]), pa.array([ids], pa.list_(kind)), pa.array([blob], pa.binary())], names)
            first, shard, ids, arrays, total = first + total, shard + 1, [], [], 0
            return out

        for b in batches:
            kind = b.schema.field(0).type
            each = (a for some in _slices(b.column(1).to_pylist()) for a in enc.many(some))
            for i, a in zip(b.column(0).to_pylist(), each):
                a = np.concatenate([a, tail])
                ids.append(i)
                arrays.append(a)
                total += len(a)
                if total >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    names = ["part", "shard", "first", "tokens", "doc_ids", "blob"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    dealt.select("doc_id", "text").mapInArrow(run, f"part long, shard long, first long, tokens long, doc_ids array<{kind}>, blob binary").write.mode("overwrite").option("compression", "lz4").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the shards at ``path``.

    start counts the ids of all documents before; the totals of parts (as many as tasks wrote) are summed in order.
    """
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    totals = shards.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = totals.select(F.col("part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches):
        for b in batches:
            ids, start, size, crc = [], [], [], []
            for k in range(b.num_rows):
                s = Shard(b.column(2)[k].as_py())
                raw = s.all().astype("<u4").tobytes()
                sizes = s.sizes.astype(np.int64)
                end = np.cumsum(sizes)
                view = memoryview(raw)
                ids += b.column(1)[k].as_py()
                start += (end - sizes + b.column(0)[k].as_py()).tolist()
                size += sizes.tolist()
                crc += [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(1).type.value_type), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row per part: bounded by the number of tasks that wrote
    rows = shards.join(F.broadcast(before), "part").select((F.col("first") + F.col("before")).alias("start"), "doc_ids", "blob")
    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards in the cluster's shared folder and read them back; see write_shards and read_shards.

    Rows with equal doc_id follow each other by text. Every row returns; an empty table gives an empty result.
    """
    path = f"{shared_dir(docs.sparkSession)}/tokens"
    write_shards(docs, tokenizer_file, path, end_id)
    return read_shards(docs.sparkSession, path)
