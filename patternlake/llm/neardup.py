"""Near-duplicate vectors by NN-descent."""

from __future__ import annotations

import logging
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patternlake.llm.common import components, partitions, shared_dir, stash

#: Rows compared with each other at once; larger groups are cut into blocks.
BLOCK = 1024
#: Numbers that the vectors of a cell may hold; larger cells are split.
CELL = 1 << 21

log = logging.getLogger(__name__)


def vectors_of(table: DataFrame) -> DataFrame:
    """(rid, grp, label, dim, low, n, e): each distinct usable vector of a label. low: smallest vec_id; n: how many rows have it.

    rid numbers the vectors: it holds for the table that is written from this, not for a second evaluation.
    """
    fine = F.col("embedding").isNotNull() & F.col("label").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = table.where(fine).where(finite & some).select("vec_id", "label", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double"))).alias("e"))
    same = rows.groupBy("label", "e").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    return same.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64("label", F.size("e")).alias("grp"), "label", F.size("e").alias("dim"), "low", "n", "e")


def _unit(rows) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)  # flatten() keeps to a slice


def _by_run(batches, key: int):
    """Batches cut where column ``key`` (sorted) changes; each yields whole runs."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
        b = t.to_batches()[0] if t.num_rows else b
        k = b.column(key).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        end = int(np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[-1])
        if end:
            yield from _runs(b.slice(0, end), k[:end])
        rest = b.slice(end)
    if rest is not None and rest.num_rows:
        yield from _runs(rest, rest.column(key).to_numpy(zero_copy_only=False))


def _runs(b, k):
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(k)]):
        if e - s > 1:
            yield b.slice(s, e - s)


def _nearest(rid: np.ndarray, x: np.ndarray, k: int, floor: float, link: float):
    """Each row's ``k`` nearest among ``x`` with at least ``floor``, as (u, v, cosine).

    Where a row has more links than that (``link`` and over), pairs that connect all that is linked here are added, at most one for each row.
    """
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(k, len(s) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    u, v = np.repeat(np.arange(len(s)), k), near.ravel()
    fine = s[u, v] >= floor
    u, v = u[fine], v[fine]
    hit = s >= link
    if hit.sum(axis=1).max() > k:
        a, b = _forest(hit)
        u, v = np.r_[u, a], np.r_[v, b]
    return rid[u], rid[v], s[u, v]


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect each component of a symmetric matrix of links."""
    left, a, b = np.ones(len(hit), bool), [], []
    for i in range(len(hit)):
        todo = [i] if left[i] else []
        left[i] = False
        while todo:
            u = todo.pop()
            near = np.flatnonzero(hit[u] & left)
            left[near] = False
            a += [u] * len(near)
            b += near.tolist()
            todo += near.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _edges(found) -> pa.RecordBatch:
    u, v, c = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(c, pa.float64())], ["u", "v", "c"])


def _compare(rows: DataFrame, k: int, floor: float, link: float) -> DataFrame:
    """(u, v, c) of the nearest within each run of ``key`` of rows (key, rid, e, place), 256 by place at a time."""

    def run(batches):
        found, held = [], 0
        for b in _by_run(batches, 0):
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                if part.num_rows > 1:
                    x = _unit(_matrix(part.column(2)))
                    found.append(_nearest(part.column(1).to_numpy(zero_copy_only=False), x, k, floor, link))
                    held += len(found[-1][0])
            if held > 50_000:
                yield _edges(found)
                found, held = [], 0
        if found:
            yield _edges(found)

    n = partitions(rows.sparkSession)
    return rows.select("key", "rid", "e", "place").repartition(n, "key").sortWithinPartitions("key", "place", "rid").select("key", "rid", "e").mapInArrow(run, "u long, v long, c double")


def start(vecs: DataFrame, trees: int, leaf: int, k: int, floor: float, seed: int, link: float = 2.0) -> DataFrame:
    """First neighbour lists: cells of random hyperplanes, as many as give about ``leaf`` vectors each, over ``trees`` draws."""
    size = vecs.groupBy("grp").agg(F.count("*").alias("in_grp"))
    rows = vecs.join(size, "grp").select("rid", "grp", "dim", F.greatest(F.lit(0), F.ceil(F.log2(F.col("in_grp") / leaf))).cast("int").alias("bits"), "e")

    def cells(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims, bits, grp = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 1))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                part = b.take(pa.array(at))
                x = _unit(_matrix(part.column(4)))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((trees, 25, d))
                for t in range(trees):
                    y = x @ planes[d][t].T
                    nb = np.minimum(bits[at], 24)
                    code = ((y[:, :24] > 0) << np.arange(24)).sum(axis=1) & ((1 << nb) - 1)
                    with np.errstate(over="ignore"):
                        key = (grp[at] * np.int64(1_000_003) + np.int64(t)) * np.int64(0x1F123BB5) + code
                    yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0), part.column(4), pa.array(y[:, 24])], ["key", "rid", "e", "place"])

    coded = rows.mapInArrow(cells, "key long, rid long, e array<double>, place double")
    hot = coded.groupBy("key").agg(F.count("*").alias("m")).where(f"m > {4 * BLOCK}")
    salted = coded.join(hot, "key", "left").withColumn("key", F.when(F.col("m").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("rid", "key", F.lit(seed)), F.ceil(F.col("m") / BLOCK)))))
    return _compare(salted, k, floor, link)


def lists(edges: DataFrame, k: int, threshold: float, room: int) -> DataFrame:
    """(u, v, c, r): the ``k`` best neighbours of each vector by rank r; a list that is full of links is enlarged to ``room`` of them."""
    both = edges.select("u", "v", "c").union(edges.select("v", "u", "c")).groupBy("u", "v").agg(F.max("c").alias("c"))
    w = Window.partitionBy("u").orderBy(F.desc("c"), "v")
    return both.withColumn("r", F.row_number().over(w)).where((F.col("r") <= room) & ((F.col("r") <= k) | (F.col("c") >= threshold)))


def refine(graph: DataFrame, vecs: DataFrame, k: int, floor: float, link: float, salt: int = 0) -> DataFrame:
    """One round: the neighbours of each vector, in either direction, are compared with each other; long lists are parted anew for each ``salt``."""
    near = graph.select(F.col("u").alias("w"), F.col("v").alias("rid")).union(graph.select(F.col("v"), F.col("u"))).union(graph.select("u", "u")).distinct()
    size = near.groupBy("w").agg(F.count("*").alias("m"))
    near = near.join(size, "w").where("m > 2").select("rid", F.xxhash64("w", F.pmod(F.xxhash64("rid", "w", F.lit(salt)), F.ceil(F.col("m") / 128))).alias("key"))
    return _compare(near.join(vecs.select("rid", "e"), "rid").withColumn("place", F.col("rid").cast("double")), k, floor, link)


def _blocks(n) -> F.Column:
    """Into how many blocks a group of ``n`` rows is cut: of at most BLOCK rows, and a group of over 128 into up to twelve even so, to spread it."""
    return F.greatest(F.ceil(n / BLOCK), F.least(F.ceil(n / 128), F.lit(12))).cast("int")


def count_links(member: DataFrame, threshold: float) -> DataFrame:
    """(rid, links): for each vector of member (rid, root, n, e) the rows of its component within the threshold, itself not counted.

    Every pair of a component is looked at, in blocks; what leaves a block is a count for each vector.
    """
    size = member.groupBy("root").agg(_blocks(F.count("*")).alias("nb"))
    rows = member.join(size, "root").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    rows = rows.select("rid", "root", "n", "e", "own", pair.alias("p")).select(F.xxhash64("root", "p.i", "p.j").alias("key"), "rid", "n", "e", (F.col("own") == F.col("p.i")).alias("left"), (F.col("p.i") == F.col("p.j")).alias("same"))

    def run(batches):
        for b in _by_run(batches, 0):
            rid, n, left = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 4))
            x = _unit(_matrix(b.column(3)))
            out = np.zeros(len(rid), np.int64)
            if b.column(5)[0].as_py():
                for s in range(0, len(x), BLOCK):
                    hit = x[s : s + BLOCK] @ x.T >= threshold
                    hit[np.arange(len(hit)), s + np.arange(len(hit))] = False
                    out[s : s + BLOCK] = hit @ n
            else:
                i, j = np.flatnonzero(left), np.flatnonzero(~left)
                for s in range(0, len(i), BLOCK):
                    a = i[s : s + BLOCK]
                    hit = x[a] @ x[j].T >= threshold
                    out[a] += hit @ n[j]
                    out[j] += n[a] @ hit
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(out)], ["rid", "links"])

    counted = rows.repartition(partitions(member.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "rid long, links long")
    return counted.groupBy("rid").agg(F.sum("links").alias("links"))


def audit(vecs: DataFrame, roots: DataFrame, threshold: float, sample: int = 256) -> DataFrame:
    """(grp, share, low) of each label with links: the mean and the least share, of ``sample`` vectors, of a vector's links that end in its component.

    Each drawn vector is compared with all of its label, whose rows are dealt in blocks, and counts once, however many links it has.
    """
    full = vecs.select("rid", "grp", "e").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    size = vecs.groupBy("grp").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("nb"))
    drawn = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("rid"), "rid")) <= sample  # as good as drawn
    some = vecs.select("grp", "rid").withColumn("in", drawn).where("in").drop("in")
    some = full.join(some.select("rid"), "rid").join(size, "grp").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("asks", F.lit(True))
    rows = full.join(size, "grp").withColumn("blk", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int")).withColumn("asks", F.lit(False))
    cols = ["rid", "grp", "root", "e", "asks"]
    both = some.union(rows.select(some.columns)).select(F.xxhash64("grp", "blk").alias("key"), *cols)

    def run(batches):
        for b in _by_run(batches, 0):
            rid, grp, root, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 5))
            x = _unit(_matrix(b.column(4)))
            i, j = np.flatnonzero(asks), np.flatnonzero(~asks)
            hit = (x[i] @ x[j].T >= threshold) & (rid[i][:, None] != rid[j][None, :])
            inside = hit & (root[i][:, None] == root[j][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(grp[i]), pa.array(rid[i]), pa.array(hit.sum(axis=1)), pa.array(inside.sum(axis=1))], ["grp", "rid", "n", "hit"])

    counted = both.repartition(partitions(vecs.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "grp long, rid long, n long, hit long")
    each = counted.groupBy("grp", "rid").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).where("n > 0").select("grp", (F.col("hit") / F.col("n")).alias("share"))
    return each.groupBy("grp").agg(F.avg("share").alias("share"), F.min("share").alias("low"))


def _joins(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of roots that connect what ``hit`` links and is not yet in one component: a forest."""
    names, at = np.unique(np.r_[a, b], return_inverse=True)
    up = at[: len(a)], at[len(a) :]
    root, out = np.arange(len(names)), []
    for i in np.flatnonzero(hit.any(axis=1)):
        mine = root[up[0][i]]
        for other in np.unique(root[up[1][hit[i]]]):
            if other != mine:
                out.append((int(names[mine]), int(names[other])))
                root[root == other] = mine
    return out


def _pivots(x: np.ndarray, apart: float) -> np.ndarray:
    """Places of rows, from the first on, of which no two have a cosine of ``apart`` or more."""
    near, kept = x @ x.T, []
    for i in range(len(x)):
        if not kept or near[i, kept].max() < apart:
            kept.append(i)
    return np.array(kept)


class _Borders:
    """Pivots of a node, and for rows: the nearest pivot and all whose border with it lies within half the linking angle.

    Two vectors that link are at most the linking angle apart. If their nearest pivots differ, the arc between them crosses the border of
    these two, so one of them lies within half the angle of it and goes to the other's pivot. Hence they meet at a pivot that is the nearest of one.
    """

    def __init__(self, sample: np.ndarray, threshold: float):
        self.at = sample[_pivots(sample, 2 * threshold**2 - 1)]
        self.width = np.sqrt((1 - threshold) / 2) * np.sqrt(np.maximum(0, 2 - 2 * self.at @ self.at.T)) + 1e-9
        copies = sum(self.of(sample[s : s + 256])[0].sum() for s in range(0, len(sample), 256)) / len(sample)
        self.stuck = len(self.at) < 2 or copies > len(self.at) / 4

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x @ self.at.T
        best = s.argmax(axis=1)
        return s.max(axis=1, keepdims=True) - s <= self.width[best], best


def _deal(rows: DataFrame, size: DataFrame, level: int, threshold: float, most: int) -> DataFrame:
    """Rows of the nodes in ``size`` sent to the cells of pivots drawn from their node.

    A row keeps in ``miss`` the levels at which it came to a cell that is not its nearest pivot's. Where pivots do not part a node
    (one direction, or borders near to everything), its rows stay together as ``stuck``. A node is dealt by as many tasks as it has
    65,536 rows, each with the same pivots.
    """
    big = rows.join(size.select("node", "m"), "node")
    step = F.ceil(F.col("m") / F.least(F.lit(most), F.greatest(F.lit(16), F.ceil(F.col("m") / 96))))
    salts = F.ceil(F.col("m") / 65536).cast("int")
    cols = ["node", "miss", "rid", "root", "e"]
    drawn = big.where(F.pmod(F.xxhash64("rid", "node", F.lit(level)), step) == 0).select(*cols, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("row"))
    both = drawn.union(big.select(*cols, F.pmod(F.xxhash64("rid"), salts).cast("int").alias("salt"), F.lit(1).alias("row")))
    both = both.select(F.xxhash64("node", "salt").alias("key"), "row", *cols)

    def run(batches):
        key, sample, borders = None, [], None
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(k)]):
                if k[s] != key:
                    key, sample, borders = k[s], [], None
                part = b.slice(s, e - s)
                first = int((part.column(1).to_numpy(zero_copy_only=False) == 0).sum())
                if first:
                    sample.append(_unit(_matrix(part.column(6).slice(0, first))))
                for at in range(first, part.num_rows, 1024):
                    rest = part.slice(at, 1024)
                    x = _unit(_matrix(rest.column(6)))
                    borders = borders or _Borders(np.concatenate(sample or [x[:1]]), threshold)
                    yield from cells(rest, x, borders)

    def cells(b, x, borders):
        miss = b.column(3).to_numpy(zero_copy_only=False)
        if borders.stuck:
            i, j, best = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        else:
            go, best = borders.of(x)
            i, j = np.nonzero(go)
        told = miss[i] | np.where(j == best[i], 0, 1 << level)
        for s in range(0, len(i), 8192):
            c = b.take(pa.array(i[s : s + 8192]))
            stuck = pa.array(np.full(c.num_rows, borders.stuck))
            yield pa.RecordBatch.from_arrays([c.column(2), pa.array(j[s : s + 8192]), pa.array(told[s : s + 8192]), c.column(4), c.column(5), c.column(6), stuck], ["node", "cell", "miss", "rid", "root", "e", "stuck"])

    n = partitions(rows.sparkSession)
    dealt = both.repartition(n, "key").sortWithinPartitions("key", "row", "rid").mapInArrow(run, "node long, cell long, miss long, rid long, root long, e array<double>, stuck boolean")
    return dealt.select(F.xxhash64("node", "cell", F.lit(level)).alias("node"), "miss", "rid", "root", "e", "stuck")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """(key, miss, root, e, side) for nodes too large for a task: pairs of blocks, but none of two blocks of one component.

    A component with more rows than a block has blocks of its own, so a dense one meets only what else its node holds.
    """
    room = F.greatest(F.lit(BLOCK), F.floor(F.lit(CELL) / (2 * F.col("dim"))))
    per = rows.groupBy("node", "root").agg(F.count("*").alias("c"), F.max(F.size("e")).alias("dim"))
    large = F.col("c") > room
    per = per.select("node", "root", "c", room.alias("room"), large.alias("large"), F.when(large, F.col("root")).otherwise(0).alias("own"))
    block = per.groupBy("node", "large", "own").agg(F.ceil(F.sum("c") / F.max("room")).cast("int").alias("nb"))
    name = F.xxhash64("node", "large", "own", "at").alias("block")
    each = block.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("node", "large", "own", name)
    i, j = each.toDF("node", "large_i", "own_i", "i"), each.toDF("node", "large_j", "own_j", "j")
    alike = F.col("large_i") & F.col("large_j") & (F.col("own_i") == F.col("own_j"))
    pairs = i.join(j, "node").where(F.col("i") <= F.col("j")).where(~alike).select("i", "j")
    placed = rows.join(per.select("node", "root", "large", "own"), ["node", "root"]).join(block, ["node", "large", "own"])
    placed = placed.withColumn("at", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int")).select(name, "miss", "root", "e")
    key, same = F.xxhash64("i", "j").alias("key"), F.col("i") == F.col("j")
    left = placed.join(pairs, F.col("block") == F.col("i")).select(key, "miss", "root", "e", F.when(same, 0).otherwise(1).alias("side"))
    return left.union(placed.join(pairs.where(~same), F.col("block") == F.col("j")).select(key, "miss", "root", "e", F.lit(2).alias("side")))


def _meet(rows: DataFrame, threshold: float) -> DataFrame:
    """(u, v): pairs of roots that links join within runs of ``key`` of rows (key, miss, root, e, side)."""

    def run(batches):
        for b in _by_run(batches, 0):
            miss, root, side = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 4))
            if root.min() == root.max():
                continue
            x, out = _unit(_matrix(b.column(3))), []
            kind = miss * 4 + side
            names = np.unique(kind).tolist()
            for p in names:
                for q in names[names.index(p) :]:
                    if (p >> 2) & (q >> 2) or (p & 3 and p & 3 == q & 3):
                        continue  # they meet at a nearest pivot elsewhere, or in another pair of blocks
                    a, c = np.flatnonzero(kind == p), np.flatnonzero(kind == q)
                    step = max(16, min(BLOCK, (1 << 22) // len(c)))
                    for s in range(0, len(a), step):
                        i = a[s : s + step]
                        hit = (x[i] @ x[c].T >= threshold) & (root[i][:, None] != root[c][None, :])
                        if hit.any():
                            out += _joins(hit, root[i], root[c])
            if out:
                u, v = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def exact_joins(vecs: DataFrame, roots: DataFrame, threshold: float, path: str, small: int | None = None, most: int = 2048, levels: int = 4) -> DataFrame:
    """(u, v): pairs of roots whose components a link joins; no link between two components is left out.

    A label of over ``small`` vectors is dealt to cells of up to ``most`` pivots (see _Borders), full cells to pivots of their own,
    up to ``levels`` times; what does not part is compared in pairs of blocks. Cells of one component are done without a look.
    """
    rows = vecs.join(roots, "rid", "left").select(F.col("grp").alias("node"), F.lit(0).cast("long").alias("miss"), "rid", F.coalesce("root", "rid").alias("root"), "e", F.lit(False).alias("stuck"))
    small, out = small or 8 * BLOCK, None  # comparing that many takes less than dealing them
    for level in count():
        size = rows.groupBy("node").agg(F.count("*").alias("m"), F.max(F.size("e")).alias("dim"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("stuck").alias("stuck")).where("lo < hi")
        room = F.lit(small) if level == 0 else F.greatest(F.lit(small), F.floor(F.lit(CELL) / F.col("dim")))
        size = stash(size.select("node", "m", (F.col("m") > room).alias("full"), (F.col("stuck") | F.lit(level >= levels)).alias("last")), f"{path}/nodes{level}")
        fits = rows.drop("stuck").join(size.where("not full").select("node"), "node").select(F.col("node").alias("key"), "miss", "root", "e", F.lit(0).alias("side"))
        if size.where("full and last").limit(1).count():
            fits = fits.union(_block_pairs(rows.drop("stuck").join(size.where("full and last").select("node"), "node")))
        met = stash(_meet(fits, threshold), f"{path}/met{level}")
        out = met if out is None else out.union(met)
        more = size.where("full and not last")
        if not more.limit(1).count():
            return out
        rows = stash(_deal(rows.drop("stuck"), more, level, threshold, most), f"{path}/dealt{level}")


def near_duplicates(table: DataFrame, threshold: float = 0.98, k: int = 10, trees: int = 8, leaf: int = 48, floor: float = 0.7, attempts: int = 3, recall: float = 0.98, settled: float = 0.001) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``table`` (vec_id, embedding, label).

    Vectors of one label (and one length) link at a cosine of ``threshold``, in double precision. Equal vectors stand for each other.
    NN-descent finds the graph: lists from random cells, then neighbours of neighbours until a round
    adds less than a share of ``settled`` to the links in them; lists that are full of links double, up to eight times ``k``. All links found join components, also those that no list has room for; within a component every pair is
    counted exactly, so a full list loses nothing. Recall is audited against brute force for up to 256 vectors
    of each label, as the mean of their shares; while a label is below ``recall`` the search goes on from new cells,
    up to ``attempts``; the figures are logged. Then vectors of different components are compared wherever they could link
    (``exact_joins``), so no link is lost.

    Null labels and vectors that are null, empty, zero or not finite in a place link with nothing: n_links 0 and
    their own component. Repeated rows link with each other. A null vec_id returns its row, is never smallest and never kept.
    """
    spark, path = table.sparkSession, shared_dir(table.sparkSession)
    vecs = stash(vectors_of(table), f"{path}/vecs")
    edges = sure = None

    def add(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        new = stash(found, f"{path}/{name}")
        links = new.where(F.col("c") >= threshold).select("u", "v")
        return (new, links) if edges is None else (edges.unionByName(new), sure.unionByName(links))

    for attempt in range(attempts):
        edges, sure = add(start(vecs, trees, leaf, k, floor, attempt, threshold), f"start{attempt}")
        linked = 0
        for r in count():
            graph = stash(lists(edges, k, threshold, k << min(r + 1, 3)), f"{path}/lists{attempt}.{r}")
            now = graph.where((F.col("c") >= threshold) & (F.col("r") <= k)).count()
            if r and now <= linked * (1 + settled):  # grows, and not without end: lists are bounded
                break
            linked = now
            edges = graph.drop("r")
            edges, sure = add(refine(graph, vecs, k, floor, threshold, 1000 * attempt + r), f"found{attempt}.{r}")
        roots = components(sure, f"{path}/cc{attempt}", "u", "v").toDF("rid", "root")
        seen = stash(audit(vecs, roots, threshold), f"{path}/audit{attempt}")
        short = seen.agg(F.min("share").alias("share"), F.sum((F.col("low") < 1).cast("int")).alias("n")).first()
        log.info("NN-descent, attempt %s: least recall of a label %s; labels with a vector that lacks a link: %s", attempt, short["share"], short["n"])
        if short["share"] is None or short["share"] >= recall:
            break
    joins = stash(exact_joins(vecs, roots, threshold, path), f"{path}/joins")
    if joins.limit(1).count():
        known = vecs.select("rid").join(roots.withColumn("linked", F.lit(True)), "rid", "left").select("rid", F.coalesce("root", "rid").alias("root"), "linked")
        higher = components(joins, f"{path}/higher", "u", "v").toDF("root", "top")
        roots = known.join(higher, "root", "left").where("linked or top is not null").select("rid", F.coalesce("top", "root").alias("root"))
    member = stash(vecs.join(roots, "rid"), f"{path}/member")
    counts = count_links(member, threshold)
    info = vecs.select("rid", "label", "e", "low", "n").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    lowest = info.groupBy("root").agg(F.min("low").alias("component_id"))
    per = info.join(lowest, "root").join(counts, "rid", "left").select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    per = stash(per.withColumn("h", F.xxhash64("label", "e")), f"{path}/per")
    same = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    rows = table.select("vec_id", "label", same.alias("e")).withColumn("h", F.xxhash64("label", "e"))
    out = rows.join(per, ["h", "label", "e"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
