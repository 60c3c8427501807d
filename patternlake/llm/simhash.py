"""SimHash near-duplicates with exact pigeonring filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternlake.llm.common import components, partitions, shared_dir, stash

SEED = 42
#: Runs of one key up to this length are compared by shifting, longer ones by search from row to row.
SHORT = 24
#: A longer run is cut into blocks of this many rows; every pair of blocks is one piece of work.
BLOCK = 16384


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of ``text`` (UTF-8), unsigned. No words, or null: 0."""
    words = (text or b"").lower().split()  # bytes: lower() changes A-Z only, split() takes 09-0D and 20
    n = len(words) - width + 1
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if n <= 1:
        return int.from_bytes(digest(joined, SEED), "big")
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    begin = end - size + 1
    raw = b"".join([digest(joined[i:j], SEED) for i, j in zip(begin[:n].tolist(), end[width - 1 :].tolist())])
    ones = np.zeros(64, np.int64)
    rows = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for k in range(0, n, 65536):  # bounded memory for very long texts
        ones += np.unpackbits(rows[k : k + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()]
            fp = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def bounds(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment of the ring."""
    width = [64 // segments + (k < 64 % segments) for k in range(segments)]
    return [(sum(width[:k]), w) for k, w in enumerate(width)]


def ring(x: np.ndarray, tau: int, segments: int) -> np.ndarray:
    """Pigeonring: whether, from some segment on, every chain keeps within its share of ``tau``.

    If at most ``tau`` bits differ over all segments of the ring, a start exists from which each chain of l
    consecutive segments differs in at most l * tau / segments bits, so no true pair is lost.
    """
    diff = [np.bitwise_count((x >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int16) for s, w in bounds(segments)]
    found = np.zeros(x.shape, bool)
    for start in range(segments):
        ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.int16)
        for k in range(segments):
            total = total + diff[(start + k) % segments]
            ok &= total * segments <= (k + 1) * tau
        found |= ok
    return found


def linked(x: np.ndarray, tau: int, segments: int) -> np.ndarray:
    """Which XORs have at most ``tau`` bits: the ring first, the full count for what it leaves."""
    out = ring(x, tau, segments)
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count(x[at]) <= tau
    return out


def forest(fp: np.ndarray, tau: int, segments: int) -> list[tuple[int, int]]:
    """Index pairs that connect what is linked within ``fp``, at most one fewer than its size.

    Rows that are reached leave the search, so a dense group costs little more than its size.
    """
    rest, out = np.arange(len(fp)), []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            u = todo.pop()
            hit = linked(fp[rest] ^ fp[u], tau, segments)
            near = rest[hit]
            if len(near):
                out += [(u, v) for v in near.tolist()]
                todo += near.tolist()
                rest = rest[~hit]
    return out


def _pairs(key: np.ndarray, fp: np.ndarray, tau: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal key (sorted)."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cut, len(key)])
    a, b = [], []
    for s, n in zip(cut[size > SHORT].tolist(), size[size > SHORT].tolist()):
        if got := forest(fp[s : s + n], tau, segments):
            i, j = np.array(got).T
            a.append(fp[s + i])
            b.append(fp[s + j])
    short = np.repeat(size <= SHORT, size)
    for k in range(1, min(SHORT, int(size.max(initial=1)))):
        at = np.flatnonzero(short[:-k] & (key[:-k] == key[k:]))
        if not len(at):
            break
        at = at[linked(fp[at] ^ fp[at + k], tau, segments)]
        a.append(fp[at])
        b.append(fp[at + k])
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(fps: DataFrame, tau: int = 4, segments: int = 6) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join everything within ``tau`` bits.

    Of ``segments`` ring segments at least ``segments - tau`` are equal, so each choice of that many is a
    join key; within a key the pigeonring check and then the full Hamming distance decide. Keys shared by
    more than BLOCK fingerprints are split into pairs of blocks. Links inside a group are returned as a
    spanning forest, never as all pairs. Exact for any number of segments over ``tau``; more segments give
    longer keys for larger inputs.
    """
    if segments <= tau:
        raise ValueError("segments must be over tau")
    at, same = bounds(segments), segments - tau
    keys = []
    for n, chosen in enumerate(combinations(range(segments), same)):
        mask = sum(((1 << at[k][1]) - 1) << at[k][0] for k in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(n).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.c", "k.bits")
    # counted by partial sums and joined back, so a key that many share is split by the skew join
    shared = rows.groupBy("c", "bits").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(shared, ["c", "bits"])
    nb = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), nb).cast("int")
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    rows = rows.withColumn("nb", nb).withColumn("own", own).select("fp", "c", "bits", spread.alias("t"))
    rows = rows.select("fp", F.xxhash64("c", "bits", "t.i", "t.j").alias("key"))

    def run(batches):
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            key = np.r_[key, b.column(1).to_numpy(zero_copy_only=False)]
            fp = np.r_[fp, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]
            end = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last run may go on
            if end:
                x, y = _pairs(key[:end], fp[:end], tau, segments)
                key, fp = key[end:], fp[end:]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])
        if len(key):
            x, y = _pairs(key, fp, tau, segments)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    # a clash of the mixed key only adds candidates: the distance decides
    return rows.repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, tau: int = 4, width: int = 4, segments: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for each row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal fingerprints
    belong together; component_id is the smallest doc_id reachable over links of at most ``tau`` bits, null
    only if every doc_id of the component is null. kept: doc_id is component_id; never for a null doc_id. Repeated rows each return. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    marked = stash(with_fingerprints(docs, width), f"{path}/fp")
    classes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), f"{path}/classes")
    if segments is None:
        n = classes.count()
        segments = 6 if n < 1 << 24 else 7 if n < 1 << 30 else 8
    roots = components(links(classes.select("fp"), tau, segments), path).toDF("fp", "root")
    member = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = stash(member, f"{path}/member")
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    of = member.join(lowest, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
