"""Mining by conditional groups: a transaction goes to the group of each of its frequent items, with the items that are more frequent, and groups are mined apart.

Items are numbers here, 0 for the most frequent. Group i holds every transaction with item i, cut to the items below i, so all sets whose rarest item is i have their
full counts in it. Equal prefixes are counted once, before and after the shuffle. A group over ``GROUP_CELLS`` is split by its second item, then by its third, and so on; what a task
holds is one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternlake.operators.transactions import dense_ids, item_support
from patternlake.session import cut

#: Most cells (items of distinct prefixes) that one group may have; larger ones are split.
GROUP_CELLS = 500_000
#: Up to so many frequent items are looked up in a list within each row; more are joined.
INLINE_ITEMS = 256


def coded(txns: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((ids, weight) of distinct transactions of frequent items, sorted, empty ones left out; (item, support, id) with 0 for the most frequent)."""
    base = cut(txns.select("items", F.col("weight").cast("long").alias("weight")), "base")
    frequent = item_support(base, weight="weight").where(F.col("support") >= least)
    few = frequent.limit(INLINE_ITEMS + 1).collect()
    if len(few) <= INLINE_ITEMS:
        ranked = [(r["item"], r["support"], k) for k, r in enumerate(sorted(few, key=lambda r: (-r["support"], r["item"])))]
        names = base.sparkSession.createDataFrame(ranked, f"item {base.schema['items'].dataType.elementType.simpleString()}, support long, id int")
        known = names.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "item"))), lambda x: x["item"]).alias("__known"))
        at = F.filter(F.transform("items", lambda x: F.coalesce(F.array_position(F.col("__known"), x), F.lit(0))), lambda k: k > 0)
        rows = base.crossJoin(F.broadcast(known)).select(F.array_sort(F.array_distinct(F.transform(at, lambda k: (k - 1).cast("int")))).alias("ids"), "weight")
    else:
        names = cut(dense_ids(frequent, [F.desc("support"), "item"], "id"), "names")
        each = base.withColumn("row", F.monotonically_increasing_id()).select("row", "weight", F.explode(F.array_distinct("items")).alias("item"))
        rows = each.join(names, "item").groupBy("row", "weight").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return cut(rows.where(F.size("ids") > 0).groupBy("ids").agg(F.sum("weight").alias("weight")), "coded"), names


def named(sets: DataFrame, names: DataFrame) -> DataFrame:
    """Sets of numbers as (items, support), items sorted."""
    each = sets.select("ids", "support", F.explode("ids").alias("id"))
    return each.join(names.select("id", "item"), "id").groupBy("ids", "support").agg(F.array_sort(F.collect_list("item")).alias("items")).select("items", "support")


def groups(rows: DataFrame, least: int, cells: int = GROUP_CELLS) -> tuple[DataFrame, DataFrame | None]:
    """((head, prefix, weight), (ids, support) of heads that were split): the groups of coded transactions, none over ``cells`` unless its prefixes have no item to split by.

    ``head`` lists the items that all of a group's transactions hold besides the prefix, rarest first.
    """
    at = F.explode(F.sequence(F.lit(0), F.size("ids") - 1)).alias("k")
    dealt = rows.select("ids", "weight", at).select(F.array(F.get("ids", F.col("k"))).alias("head"), F.slice("ids", F.lit(1), F.col("k")).alias("prefix"), "weight")
    ready, split = None, None
    while True:
        dealt = cut(dealt.groupBy("head", "prefix").agg(F.sum("weight").alias("weight")), "groups")
        sizes = dealt.groupBy("head").agg(F.sum(F.size("prefix") + 1).alias("cells"), F.max(F.size("prefix")).alias("longest"), F.sum("weight").alias("support"))
        sizes = sizes.where((F.col("cells") > cells) & (F.col("longest") > 0)).select("head", "support")
        if sizes.isEmpty():
            return (dealt if ready is None else ready.unionByName(dealt)), split
        heavy = cut(sizes, "heavy")
        light = dealt.join(heavy, "head", "left_anti")
        ready = light if ready is None else ready.unionByName(light)
        own = heavy.select(F.col("head").alias("ids"), "support")
        split = own if split is None else split.unionByName(own)
        big = dealt.join(heavy.select("head"), "head").where(F.size("prefix") > 0)
        big = big.select("head", "prefix", "weight", F.explode(F.sequence(F.lit(0), F.size("prefix") - 1)).alias("k"))
        big = big.select(F.concat("head", F.array(F.get("prefix", F.col("k")))).alias("head"), F.slice("prefix", F.lit(1), F.col("k")).alias("prefix"), "weight")
        enough = big.groupBy("head").agg(F.sum("weight").alias("n")).where(F.col("n") >= least).select("head")
        dealt = big.join(enough, "head")


class PrefixTree:
    """Weighted transactions that share their beginnings. Items are numbers, in rising order along every path."""

    def __init__(self):
        self.item, self.parent, self.count = [-1], [0], [0]
        self.child: dict[tuple[int, int], int] = {}
        self.nodes: dict[int, list[int]] = {}

    def add(self, items, weight: int) -> None:
        at = 0
        for x in items:
            to = self.child.get((at, x))
            if to is None:
                to = self.child[at, x] = len(self.item)
                self.item.append(x)
                self.parent.append(at)
                self.count.append(0)
                self.nodes.setdefault(x, []).append(to)
            self.count[to] += weight
            at = to

    def support(self, x: int) -> int:
        return sum(self.count[n] for n in self.nodes[x])

    def line(self) -> list[int] | None:
        """All items, if the tree is one path."""
        return sorted(self.nodes) if all(len(n) == 1 for n in self.nodes.values()) and len(self.child) == len({p for p, _ in self.child}) else None

    def under(self, x: int, least: int) -> PrefixTree:
        """Tree of what stands before ``x``, cut to the items that are frequent together with it."""
        paths, counts = [], {}
        for n in self.nodes[x]:
            weight, path, at = self.count[n], [], self.parent[n]
            while at:
                y = self.item[at]
                path.append(y)
                counts[y] = counts.get(y, 0) + weight
                at = self.parent[at]
            paths.append((path, weight))
        out = PrefixTree()
        for path, weight in paths:
            out.add([y for y in reversed(path) if counts[y] >= least], weight)
        return out


class MaximalTree:
    """Sets that were found, as a prefix tree whose nodes are listed by item; a node is known by the mask of its path."""

    def __init__(self):
        self.nodes: dict[int, set[int]] = {}
        self.sets: list[tuple[int, int]] = []

    def add(self, mask: int, support: int) -> None:
        for x in bits(mask):
            self.nodes.setdefault(x, set()).add(mask & ((2 << x) - 1))
        self.sets.append((mask, support))

    def covers(self, mask: int) -> bool:
        """Whether a set lies in one that was found. All its items stand on the path to a node of its rarest one."""
        return not mask or any(mask & m == mask for m in self.nodes.get(mask.bit_length() - 1, ()))


def _mask(items) -> int:
    out = 0
    for x in items:
        out |= 1 << int(x)
    return out


def bits(mask: int) -> list[int]:
    """Places of the ones of a mask, rising."""
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def fpmax(tree: PrefixTree, support: int, least: int) -> list[tuple[int, int]]:
    """(mask, support) of the maximal sets of a tree whose items are all frequent; the empty set, with ``support``, if it has none.

    Rare items come first: then no later set holds an earlier one, and a branch is left out if its head with all that could join it lies in a set that was found.
    """
    found = MaximalTree()
    todo: list[tuple[PrefixTree, int | None, int]] = [(tree, None, 0)]
    while todo:
        source, x, head = todo.pop()
        here, n = (source, support) if x is None else (source.under(x, least), source.support(x))
        head |= 0 if x is None else 1 << x
        whole = head | _mask(here.nodes)
        if not whole:
            return [(0, support)]
        if found.covers(whole):
            continue
        line = here.line()
        if line is None:
            todo += [(here, y, head) for y in sorted(here.nodes)]  # the rarest is taken off first
        else:
            found.add(whole, here.count[here.nodes[line[-1]][0]] if line else n)
    return found.sets


def fpgrowth(tree: PrefixTree, support: int, least: int) -> Iterator[tuple[int, int]]:
    """(mask, support) of all frequent sets of a tree whose items are all frequent, the empty set first."""
    yield 0, support
    todo = [(tree, x, 0) for x in tree.nodes]
    while todo:
        source, x, head = todo.pop()
        head |= 1 << x
        yield head, source.support(x)
        here = source.under(x, least)
        todo += [(here, y, head) for y in here.nodes]


def trimmed(frame: pd.DataFrame, least: int) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """(items that are frequent in a group, rising; its prefixes in places of that list; weights)."""
    weight, sizes = frame["weight"].to_numpy(np.int64), np.array([len(p) for p in frame["prefix"]])
    flat = np.concatenate([np.asarray(p, np.int64) for p in frame["prefix"]]) if sizes.sum() else np.zeros(0, np.int64)
    items, at = np.unique(flat, return_inverse=True)
    support = np.zeros(len(items), np.int64)
    np.add.at(support, at, np.repeat(weight, sizes))
    place = np.where(support >= least, np.cumsum(support >= least) - 1, -1)[at] if len(items) else at
    parts = np.split(place, np.cumsum(sizes)[:-1])
    return items[support >= least].tolist(), [p[p >= 0] for p in parts], weight


def tree_miner(search: Callable) -> Callable:
    """A miner of one group through its prefix tree, by ``fpmax`` or ``fpgrowth``."""

    def run(frame: pd.DataFrame, least: int):
        names, prefixes, weight = trimmed(frame, least)
        tree = PrefixTree()
        for p, w in zip(prefixes, weight.tolist()):
            tree.add(p.tolist(), w)
        return names, search(tree, int(weight.sum()), least), True

    return run


def mined(dealt: DataFrame, least: int, miner: Callable, tasks: int) -> DataFrame:
    """(ids, support, complete): what ``miner`` finds in each group, ids rising, in ``tasks`` tasks. A search that was cut short returns a row with null ids besides."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame["head"].iloc[0].tolist()
        if int(frame["weight"].sum()) < least:
            return pd.DataFrame({"ids": [], "support": [], "complete": []})
        names, sets, complete = miner(frame, least)
        rows = [([names[k] for k in bits(m)] + head[::-1], n, complete) for m, n in sets] + ([] if complete else [(None, 0, False)])
        return pd.DataFrame(rows, columns=["ids", "support", "complete"])

    return dealt.repartition(tasks, "head").groupBy("head").applyInPandas(run, "ids array<int>, support long, complete boolean")


def clear_subsets(sets: DataFrame) -> DataFrame:
    """Drop sets of numbers that lie in another of the list, equal ones kept once. Joined on a set's rarest item: its largest number."""
    sets = cut(sets.select("ids", "support").distinct(), "found")
    small = sets.select(F.col("ids").alias("want"), F.element_at("ids", -1).alias("key"))
    large = sets.where(F.size("ids") > 1).select(F.col("ids").alias("big"), F.explode("ids").alias("key"))
    hit = large.join(small, "key").where((F.size("want") < F.size("big")) & (F.size(F.array_except("want", "big")) == 0))
    return sets.join(hit.select(F.col("want").alias("ids")).distinct(), "ids", "left_anti")


def _found(txns: DataFrame, least: int, miner: Callable, cells: int) -> tuple[DataFrame, DataFrame]:
    rows, names = coded(txns, least)
    dealt, split = groups(rows, least, cells)
    most = max(4 * dealt.sparkSession.sparkContext.defaultParallelism, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = mined(dealt, least, miner, most if split is not None else max(1, min(most, names.count())))
    if split is not None:
        found = found.unionByName(split.select(F.array_sort("ids").alias("ids"), "support", F.lit(True).alias("complete")))
    return found, names


def maximal_fpmax(txns: DataFrame, least: int, cells: int = GROUP_CELLS) -> DataFrame:
    """(items, support) of the maximal sets over (items, weight): a prefix tree and a tree of maximal sets for each group, then sets of different groups are cleared against each other.

    No frequent set is listed that is not maximal in its group, no data is broadcast, and a weight costs what a row costs, however large it is.
    """
    found, names = _found(txns, least, tree_miner(fpmax), cells)
    return named(clear_subsets(found), names)


def frequent_conditional(txns: DataFrame, least: int, cells: int = GROUP_CELLS) -> DataFrame:
    """(items, support) of all frequent sets over (items, weight), each found in the one group of its rarest item."""
    found, names = _found(txns, least, tree_miner(fpgrowth), cells)
    return named(found, names)
