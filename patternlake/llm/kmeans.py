"""Centroid clustering in whole numbers: exact distances through float64 matrix products, exact sums through treeAggregate."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternlake.llm.common import shared_dir, stash

#: Vectors in one block of the written table.
BLOCK = 2048
LONG_MAX = 2**63 - 1


def quantized(x: np.ndarray, scale: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """floor(scale * x) as float64, exact; rows that leave float64 are zero there and whole numbers in the dict."""
    with np.errstate(over="ignore"):
        q = np.floor(scale * x)
    far = np.flatnonzero(~np.isfinite(q).all(axis=1))
    exact = {int(r): [whole(v, scale) for v in x[r].tolist()] for r in far}
    q[far] = 0.0
    return q, exact


def whole(v: float, scale: int) -> int:
    """floor(scale * v) of a finite number; one whose product overflows is a whole number itself."""
    product = scale * v
    return math.floor(product) if math.isfinite(product) else int(v) * scale


class Nearest:
    """Squared Euclidean distances |x|^2 - 2 x.c + |c|^2 to fixed centroids of whole numbers, without rounding.

    Vectors and centroids fall into three classes by their largest component m: where dim * (m_x + m_c)^2 is sure to stay below 2^53, every number
    that the expansion meets is exact in float64, in whatever order BLAS adds; below 2^63 the same is done in int64; what lies beyond takes Python's integers.
    """

    def __init__(self, centroids: list[list[int]], scale: int):
        self.rows, self.scale, dim = centroids, scale, max(1, len(centroids[0]) if centroids else 1)
        self.bounds = (math.isqrt(2**53 // dim) // 2, math.isqrt(2**63 // dim) // 2)
        self.level = np.array([self._level(max(map(abs, c), default=0)) for c in centroids], int)
        small = [c if lv < 2 else [0] * len(c) for c, lv in zip(centroids, self.level)]
        self.ints = np.array(small, np.int64).reshape(len(centroids), -1)
        self.floats = self.ints.astype(np.float64)

    def _level(self, m: int) -> int:
        return 0 if m < self.bounds[0] else 1 if m < self.bounds[1] else 2

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """(number of the nearest centroid, smaller ones first; its distance; the vectors in whole numbers as float64 or, by row, as integers)."""
        q, exact = quantized(x, self.scale)
        top = np.abs(q).max(axis=1, initial=0.0)
        rows = np.where(top < self.bounds[0], 0, np.where(top < self.bounds[1], 1, 2))
        rows[list(exact)] = 2
        exact |= {int(r): [int(v) for v in q[r].tolist()] for r in np.flatnonzero(rows == 2) if int(r) not in exact}
        d = np.empty((len(q), len(self.rows)), object if exact or (self.level == 2).any() else np.int64)
        for a in np.unique(rows).tolist():
            own = np.flatnonzero(rows == a)
            for b in np.unique(self.level).tolist():
                cols = np.flatnonzero(self.level == b)
                d[np.ix_(own, cols)] = self._distances(q, exact, own, cols, max(a, b))
        best = d.argmin(axis=1)
        return best, d[np.arange(len(q)), best], q, exact

    def _distances(self, q: np.ndarray, exact: dict, own: np.ndarray, cols: np.ndarray, level: int) -> np.ndarray:
        if level < 2:
            x, c = (q[own], self.floats[cols]) if level == 0 else (q[own].astype(np.int64), self.ints[cols])
            return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
        x = np.array([exact[r] if r in exact else [int(v) for v in q[r].tolist()] for r in own.tolist()], object)
        out = np.empty((len(own), len(cols)), object)
        for k, c in enumerate(cols.tolist()):
            apart = x - np.array(self.rows[c], object)
            out[:, k] = (apart * apart).sum(axis=1)
        return out

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vectors, componentwise sums, summed distance) of each centroid, as Python integers."""
        best, d, q, exact = self.assign(x)
        k = len(self.rows)
        near = np.ones(len(q), bool)
        near[list(exact)] = False
        hot = np.zeros((k, len(q)))
        hot[best, np.arange(len(q))] = near
        sums = (hot @ np.where(near[:, None], q, 0.0)).astype(np.int64).astype(object)  # below BLOCK * 2^28
        for r, v in exact.items():
            sums[best[r]] += np.array(v, object)
        spread = np.zeros(k, object)
        np.add.at(spread, best, d.astype(object))
        return np.bincount(best, minlength=k).astype(object), sums, spread


def _decode(data: bytes, wide: bool, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float64 if wide else np.float32).astype(np.float64).reshape(-1, dim)


def blocks(vectors: DataFrame, dim: int, size: int = BLOCK) -> DataFrame:
    """(ids, data, wide): the vectors of ``vectors`` (vec_id, e) in blocks of one matrix each, in 4 bytes a component where that is exact, else in 8."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    wide = bool((x.astype(np.float32) != x).any())
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                data = (x if wide else x.astype(np.float32)).tobytes()
                yield pa.RecordBatch.from_arrays([ids, pa.array([data], pa.binary()), pa.array([wide])], ["ids", "data", "wide"])

    return vectors.select("vec_id", "e").mapInArrow(run, f"ids array<{kind}>, data binary, wide boolean")


def _plus(a, b):
    return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b))


def _total(table: DataFrame, near: Nearest, dim: int):
    """Sums over all blocks: a task adds up its own, then tasks are added in a tree; what travels is as large as the centroids."""
    shipped = table.sparkSession.sparkContext.broadcast(near)  # k centroids

    def add(acc, row):
        return _plus(acc, shipped.value.sums(_decode(row["data"], row["wide"], dim)))

    return table.select("data", "wide").rdd.treeAggregate(None, add, _plus)


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """Lloyd's iterations over ``table`` (vec_id, embedding), in whole numbers: the same on every run, whatever the partitions.

    Vectors of exactly ``dim`` components, none null or non-finite, take part, as floor(scale * x); others are left out. Centroids start as the k vectors with smallest
    SHA-256 of ``seed:vec_id`` (a null id hashes as the empty string; equal hashes by vector), fewer if there are fewer vectors, and none for an empty table, which
    returns no row. Each round assigns every vector to the nearest centroid (ties: the smaller number) and replaces every non-empty centroid by the floor of its
    vectors' mean; empty ones stay. Repeated rows count each. Other columns are ignored.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256. A distance or sum beyond a long is null; the centroids stay exact.
    The vectors are written to the shared folder in blocks, once; every round reads those, and only counts and sums of the k centroids reach the driver.
    """
    kind = table.schema["vec_id"].dataType.simpleString()
    e = F.col("embedding").cast("array<double>")
    good = F.col("embedding").isNotNull() & (F.size("embedding") == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = table.where(good).select("vec_id", e.alias("e"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    written = stash(blocks(kept, dim), f"{shared_dir(table.sparkSession)}/blocks")
    first = kept.select(order.alias("o"), "e").orderBy("o", "e").limit(k).collect()  # k vectors
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return table.sparkSession.createDataFrame([], schema)
    centroids = [[whole(v, scale) for v in r["e"]] for r in first]
    for _ in range(rounds):
        n, sums, _ = _total(written, Nearest(centroids, scale), dim)
        centroids = [[int(s) // int(n[c]) for s in sums[c]] if n[c] else centroids[c] for c in range(len(centroids))]
    near = Nearest(centroids, scale)
    spread = [int(s) for s in _total(written, near, dim)[2]]
    fits = lambda v: v if v <= LONG_MAX else None
    inertia, each = fits(sum(spread)), [fits(s) for s in spread]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches):
        for b in batches:
            for ids, data, wide in zip(b.column(0), b.column(1), b.column(2)):
                best, d, _, _ = near.assign(_decode(data.as_py(), wide.as_py(), dim))
                picks = best.tolist()
                columns = [pa.array(picks, pa.int32()), pa.array([fits(int(v)) for v in d.tolist()], pa.int64()), pa.array([each[c] for c in picks], pa.int64())]
                columns += [pa.array([inertia] * len(picks), pa.int64()), pa.array([digest[c] for c in picks], pa.string())]
                yield pa.RecordBatch.from_arrays([ids.values, *columns], names)

    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return written.mapInArrow(run, schema)
