"""Frequent, closed and maximal itemsets. All strategies return the same sets: (items, support), items sorted."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternlake.operators.conditional import frequent_conditional, maximal_fpmax
from patternlake.operators.counting import count_by_trie
from patternlake.operators.frontier import maximal_frontier
from patternlake.operators.transactions import item_support, reduce
from patternlake.session import cut

#: Widest transaction whose subsets are listed outright.
POWERSET_WIDTH = 12
#: Most memory, in bytes, that a worker may take for the broadcast matrix of distinct transactions and its products; see matrix_bytes.
BROADCAST_BYTES = 512 << 20


def subsets(col, sizes: int | None = None):
    """All non-empty subsets of a sorted array of up to 20 items, or those of one size, as expression."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(col)) - 1)
    if sizes is not None:
        masks = F.filter(masks, lambda m: F.bit_count(m) == sizes)
    return F.transform(masks, lambda m: F.filter(col, lambda x, i: F.getbit(m, i) == 1))


def frequent_powerset(txns: DataFrame, least: int) -> DataFrame:
    """For narrow rows: list each distinct transaction's subsets and count them. ``txns`` is (items, weight).

    A transaction with more than POWERSET_WIDTH frequent items ends the job with an error: that is a case for another strategy.
    """
    found = reduce(txns, least, weight="weight").groupBy("items").agg(F.sum("weight").alias("weight"))
    wide = F.raise_error(F.lit(f"a transaction has over {POWERSET_WIDTH} frequent items; use levelwise, fpgrowth or vertical")).cast(found.schema["items"].dataType)
    found = found.withColumn("items", F.when(F.size("items") <= POWERSET_WIDTH, F.col("items")).otherwise(wide))
    each = found.select(F.explode(subsets(F.col("items"))).alias("items"), "weight")
    return each.groupBy("items").agg(F.sum("weight").cast("long").alias("support")).where(F.col("support") >= least)


def candidates(level: DataFrame) -> DataFrame:
    """(items): sets of one item more whose every subset of the level's size is in ``level``, before anything is counted.

    Two sets that are equal but for their last item are joined on what they share; of each result the other subsets are looked up in the level.
    """
    half = level.select(F.slice("items", F.lit(1), F.size("items") - 1).alias("head"), F.element_at("items", -1).alias("last"))
    other = half.select("head", F.col("last").alias("next"))
    joined = half.join(other, "head").where(F.col("next") > F.col("last")).select(F.concat("head", F.array("last", "next")).alias("items"))
    # the two joined sets are in the level; what lacks one of the items before the last two has to be, too
    subset = F.transform(F.sequence(F.lit(0), F.size("items") - 3), lambda k: F.filter("items", lambda x, i: i != k))
    parts = joined.where(F.size("items") > 2).select("items", F.explode(subset).alias("part"))
    missing = parts.join(level.select(F.col("items").alias("part")), "part", "left_anti").select("items").distinct()
    return joined.join(missing, "items", "left_anti")


def frequent_levelwise(txns: DataFrame, least: int, log: list | None = None, resume: DataFrame | None = None) -> DataFrame:
    """For wide, sparse rows: candidates of each size are made from the frequent sets of the size before, then counted, until there are none.

    A level is one pass of a candidate trie over the distinct transactions and a shuffle of counts (see counting.count_by_trie); occurrences never leave their task. Each level is written to
    the shared folder. ``log`` gets (size, candidates, frequent) of each level. ``resume`` takes the sets (items, support) of all levels an earlier run had ended, and goes on behind them.
    """
    base = cut(reduce(txns, least, weight="weight").groupBy("items").agg(F.sum("weight").alias("weight")), "base")
    if resume is None:
        frequent = item_support(base, weight="weight").where(F.col("support") >= least).select(F.array("item").alias("items"), "support")
        out, size = cut(frequent, "level1"), 1
        level = out
    else:
        out = cut(resume.select("items", F.col("support").cast("long").alias("support")), "resumed")
        size = out.agg(F.max(F.size("items"))).first()[0] or 0
        level = out.where(F.size("items") == size)
    while size and not level.isEmpty():
        wanted = cut(candidates(level), f"candidates{size + 1}")
        level = cut(count_by_trie(base, wanted).where(F.col("support") >= least), f"level{size + 1}")
        size += 1
        if log is not None:
            log.append((size, wanted.count(), level.count()))
        out = out.unionByName(level)
    return out


def contained(sets: DataFrame, txns: DataFrame, items: str = "items", support: DataFrame | None = None) -> DataFrame:
    """``txns`` with ``want``: one row for each of ``sets`` (items) that a transaction holds.

    Joined on each set's rarest item, so that an item which most transactions have is a key only of sets that have no other; the rest of the
    set is tested then. ``support`` (item, support) spares a count.
    """
    own = sets.select(F.array_sort("items").alias("want")).distinct()
    support = support if support is not None else txns.select(F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count("*").alias("support"))
    each = own.select("want", F.explode("want").alias("item")).join(support.select("item", "support"), "item", "left")
    keyed = each.groupBy("want").agg(F.min(F.struct(F.coalesce("support", F.lit(0)).alias("n"), "item")).alias("r")).select("want", F.col("r.item").alias("__key"))
    dealt = txns.withColumn("__key", F.explode(F.array_distinct(items)))
    return dealt.join(keyed, "__key").where(F.size(F.array_except("want", items)) == 0).drop("__key")


def frequent_fpgrowth(txns: DataFrame, least: int) -> DataFrame:
    """Parallel FP-growth of Spark's library, over unweighted (items)."""
    from pyspark.ml.fpm import FPGrowth

    n = txns.count()
    if not n:
        return txns.select("items", F.lit(0).cast("long").alias("support"))
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n)).fit(txns.select(F.array_distinct("items").alias("items")))
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))


def maximal(frequent: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sets without a frequent superset. ``frequent`` must be complete, so a superset of one item more is enough to look for:
    an equi-join with the sets that lack one item, not a comparison of all pairs."""
    by = by or []
    smaller = frequent.where(F.size("items") > 1).select(*by, F.explode(F.transform("items", lambda x: F.filter("items", lambda y: y != x))).alias("items")).distinct()
    return frequent.join(smaller, [*by, "items"], "left_anti")


def closed(frequent: DataFrame) -> DataFrame:
    """Sets without a superset of equal support."""
    smaller = frequent.where(F.size("items") > 1).select(F.explode(F.transform("items", lambda x: F.filter("items", lambda y: y != x))).alias("items"), "support").distinct()
    return frequent.join(smaller, ["items", "support"], "left_anti")


def largest(sets: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest sets; ties by support, then by items."""
    return sets.orderBy(F.desc(F.size("items")), F.desc("support"), "items").limit(n)


@dataclass
class Kernel:
    """Search for maximal sets over a matrix of distinct transactions (rows, bool) and items (columns, rare ones first).

    A set is reached from its rarest item by adding more frequent ones, so roots are independent. It is
    maximal if no item at all extends it, so nothing has to be compared between roots. A node is left out with all below it
    where it cannot lead to a maximal set that is new: an item before it is in all of its rows, or what it could still grow to lies in a set that was found, or is
    frequent as a whole. Items that all rows of a node have join it at once. One matrix product gives the supports of all children of a node.
    """

    matrix: np.ndarray
    weight: np.ndarray
    least: int
    max_nodes: int | None = None
    budget_s: float | None = None
    nodes: int = 0
    complete: bool = True
    found: list = field(default_factory=list)

    def mine(self, roots: list[int]) -> list[tuple[tuple[int, ...], int]]:
        began, everything = time.monotonic(), np.arange(self.matrix.shape[1])
        masks: list[int] = []
        for r in roots:
            rows = np.flatnonzero(self.matrix[:, r])
            todo = [((int(r),), rows, everything[everything > r])]
            while todo:
                if (self.max_nodes and self.nodes >= self.max_nodes) or (self.budget_s and time.monotonic() - began > self.budget_s):
                    self.complete = False
                    return self.found
                self.nodes += 1
                todo += self._visit(*todo.pop(), masks)
        return self.found

    def _visit(self, head: tuple[int, ...], rows: np.ndarray, tail: np.ndarray, masks: list[int]) -> list:
        """Children of a node that are worth a visit; a maximal set is noted."""
        part, weight = self.matrix[rows], self.weight[rows]
        total = int(weight.sum())
        if total < self.least:
            return []
        support = weight @ part
        inside = np.zeros(self.matrix.shape[1], bool)
        inside[list(head)] = True
        later = np.zeros(self.matrix.shape[1], bool)
        later[tail] = True
        full = (support == total) & ~inside
        if (full & ~later).any():
            return []  # whatever is found here, that item extends it
        inside |= full
        grow = np.flatnonzero(later & ~full & (support >= self.least))
        if not len(grow):
            if not ((support >= self.least) & ~inside).any():
                self._note(inside, total, masks)
            return []
        best = _mask(np.flatnonzero(inside)) | _mask(grow)
        if any(best & m == best for m in masks[-64:]):  # those found last are the likely ones
            return []
        grow = grow[np.argsort(support[grow], kind="stable")]
        whole = part[:, grow].all(axis=1)
        if (n := int(weight[whole].sum())) >= self.least:
            held = inside.copy()
            held[grow] = True
            if not (((weight[whole] @ part[whole]) >= self.least) & ~held).any():
                self._note(held, n, masks)
            return []
        head = tuple(np.flatnonzero(inside).tolist())
        out = [((*head, int(x)), rows[part[:, x]], grow[k + 1 :]) for k, x in enumerate(grow)]
        return out  # the last, with the most frequent item, is visited first

    def _note(self, inside: np.ndarray, support: int, masks: list[int]) -> None:
        items = np.flatnonzero(inside)
        self.found.append((tuple(items.tolist()), support))
        masks.append(_mask(items))


def _mask(items: np.ndarray) -> int:
    out = 0
    for x in items.tolist():
        out |= 1 << x
    return out


def matrix_bytes(n_txns: int, n_items: int) -> int:
    """What a worker takes for a matrix: a byte for each cell, its part below a node once more, and a product in eight-byte numbers."""
    return n_txns * n_items * (1 + 1 + 8)


def _kept(txns: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(distinct transactions of frequent items, their items with number ``id`` by support, how many of each)."""
    kept = cut(reduce(txns, least, weight="weight").groupBy("items").agg(F.sum("weight").cast("long").alias("weight")), "kept")
    names = cut(item_support(kept, weight="weight").select("item", "support"), "names")
    return kept, names, kept.count(), names.count()


def maximal_vertical(txns: DataFrame, least: int, max_nodes: int | None = None, budget_s: float | None = None) -> DataFrame:
    """Maximal sets by depth-first search over a broadcast matrix, one task for some roots each: (items, support, complete).

    ``txns`` is (items, weight), distinct. What a worker would hold is computed before anything is collected: over BROADCAST_BYTES use
    maximal_partitioned. With a node or time budget for each task, complete tells whether its search ended; a task that was
    cut short returns a row with null items besides, so that this is seen even if it had found nothing.
    """
    kept, names, n, m = _kept(txns, least)
    if matrix_bytes(n, m) > BROADCAST_BYTES:
        raise ValueError(f"{matrix_bytes(n, m)} bytes in each worker are too many to broadcast; use maximal_partitioned")
    return _vertical(kept, names, least, max_nodes, budget_s)


def _vertical(kept: DataFrame, names: DataFrame, least: int, max_nodes: int | None = None, budget_s: float | None = None) -> DataFrame:
    spark = kept.sparkSession
    kind = kept.schema["items"].dataType.elementType.simpleString()
    schema = f"items array<{kind}>, support long, complete boolean"
    order = [r["item"] for r in names.orderBy("support", "item").select("item").collect()]  # as many as the checked matrix has columns
    if not order:
        return spark.createDataFrame([], schema)
    # numbers instead of items leave the executors
    ids = F.broadcast(spark.createDataFrame([(x, k) for k, x in enumerate(order)], f"item {kind}, id int"))
    rows = kept.select(F.monotonically_increasing_id().alias("row"), "items", "weight").select("row", "weight", F.explode("items").alias("item"))
    coded = rows.join(ids, "item").groupBy("row", "weight").agg(F.collect_list("id").alias("ids")).select("weight", "ids").toPandas()
    matrix = np.zeros((len(coded), len(order)), bool)
    matrix[np.repeat(np.arange(len(coded)), [len(x) for x in coded["ids"]]), np.concatenate(list(coded["ids"]))] = True
    shipped = spark.sparkContext.broadcast((matrix, coded["weight"].to_numpy(np.int64), order))

    def run(frames):
        m, w, n = shipped.value
        for f in frames:
            k = Kernel(m, w, least, max_nodes, budget_s)
            sets = k.mine(sorted(f["id"].tolist(), reverse=True))
            lists, counts = _lists(sets, n), [c for _, c in sets]
            if not k.complete:
                lists, counts = pd.concat([lists, pd.Series([None], dtype=object)], ignore_index=True), [*counts, 0]
            yield pd.DataFrame({"items": lists, "support": pd.Series(counts, dtype="int64"), "complete": pd.Series([k.complete] * len(counts), dtype=bool)})

    roots = spark.range(len(order)).repartition(min(len(order), 4 * spark.sparkContext.defaultParallelism), F.xxhash64("id"))
    return roots.mapInPandas(run, schema)


def _lists(sets: list, names: list) -> pd.Series:
    return pd.Series([sorted(names[i] for i in s) for s, _ in sets], dtype=object)


def _matrix(frame: pd.DataFrame, names: list) -> tuple[np.ndarray, np.ndarray]:
    at = {x: k for k, x in enumerate(names)}
    matrix = np.zeros((len(frame), len(names)), bool)
    for row, items in enumerate(frame["items"]):
        matrix[row, [at[x] for x in items]] = True
    return matrix, frame["weight"].to_numpy(np.int64)


def count_sets(txns: DataFrame, sets: DataFrame) -> DataFrame:
    """(items, support) of arbitrary sets over (items, weight)."""
    own = sets.select(F.array_sort("items").alias("want")).distinct()
    got = contained(own.select(F.col("want").alias("items")), txns.select("items", "weight")).groupBy("want").agg(F.sum("weight").cast("long").alias("support"))
    return own.join(got, "want", "left").select(F.col("want").alias("items"), F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def maximal_partitioned(txns: DataFrame, least: int, parts: int | None = None) -> DataFrame:
    """For matrices too large to send: each part's own maximal sets, at its share of ``least``, are candidates that are counted
    globally; those below ``least`` give way to their subsets, each counted once, until all that is left is frequent.

    A globally frequent set is frequent, at its share, in at least one part, so none is missed. Parts are as many as keep each below BROADCAST_BYTES.
    """
    kept, _, n, m = _kept(txns, least)
    return _partitioned(kept, least, n, m, parts)


def _partitioned(kept: DataFrame, least: int, n_txns: int, n_items: int, parts: int | None = None) -> DataFrame:
    total = kept.agg(F.sum("weight")).first()[0]
    kind = kept.schema["items"].dataType.elementType.simpleString()
    if not total:
        return kept.select("items", F.col("weight").alias("support"))
    n = parts or max(2, min(n_txns, 2 * kept.sparkSession.sparkContext.defaultParallelism), -(-matrix_bytes(n_txns, n_items) // BROADCAST_BYTES))

    def local(frames):
        whole = pd.concat(list(frames) or [pd.DataFrame({"items": [], "weight": []})])
        if len(whole):
            support: dict = {}
            for items, w in zip(whole["items"], whole["weight"]):
                for x in items:
                    support[x] = support.get(x, 0) + w
            names = sorted(support, key=lambda x: (support[x], x))
            matrix, weight = _matrix(whole, names)
            share = max(1, int(np.ceil(least * weight.sum() / total - 1e-9)))
            sets = Kernel(matrix, weight, share).mine(list(range(len(names) - 1, -1, -1)))
            yield pd.DataFrame({"items": _lists(sets, names)})

    todo = cut(kept.repartition(n, F.xxhash64("items")).mapInPandas(local, f"items array<{kind}>").distinct(), "todo")
    known = done = None
    while True:
        counted = cut(count_sets(kept, todo), "counted")
        known = counted if known is None else known.unionByName(counted)
        good = counted.where(F.col("support") >= least)
        done = good if done is None else done.unionByName(good)
        bad = counted.where((F.col("support") < least) & (F.size("items") > 1))
        smaller = bad.select(F.explode(F.transform("items", lambda x: F.filter("items", lambda y: y != x))).alias("items")).distinct()
        todo = cut(smaller.join(known, "items", "left_anti"), "todo")
        if todo.isEmpty():
            break
    return without_subsets(cut(done, "frequent"))


def without_subsets(sets: DataFrame) -> DataFrame:
    """Drop sets that lie in another of the list; for lists that are not complete. Joined on a set's rarest item."""
    hit = contained(sets, sets.select(F.col("items").alias("big")), "big")
    inside = hit.where(F.size("want") < F.size("big")).select(F.col("want").alias("items")).distinct()
    return sets.join(inside, "items", "left_anti")


def mine(txns: DataFrame, least: int, kind: str = "maximal", strategy: str = "auto") -> DataFrame:
    """(items, support) of ``kind`` frequent, closed or maximal sets over (items, weight); the strategy never changes the result."""
    if strategy == "auto":
        width = txns.agg(F.max(F.size("items"))).first()[0] or 0
        strategy = "powerset" if width <= POWERSET_WIDTH else "fpgrowth" if kind != "maximal" else "fpmax"
    only = {"vertical": maximal_frontier, "fpmax": maximal_fpmax, "partitioned": maximal_partitioned}
    if strategy in only:
        if kind != "maximal":
            raise ValueError(f"{strategy} finds maximal sets only")
        return only[strategy](txns, least).select("items", "support")
    found = {"powerset": frequent_powerset, "levelwise": frequent_levelwise, "fpgrowth": frequent_conditional}[strategy](txns, least)
    return {"frequent": lambda x: x, "closed": closed, "maximal": maximal}[kind](found)
