"""Supports of given sets: by a trie that walks the transactions, by a written bitmap index that does without them, and with hot items looked up."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.operators.transactions import dense_ids, item_support
from patternlake.session import cut, shared_path

#: Most sets that one trie holds; more are sliced in their order, which is by first item.
TRIE_SETS = 200_000
#: Most cells of the table of rows and items that a walk holds at a time.
WALK_CELLS = 64 << 20
#: Most hot items: all their subsets are counted.
HOT_ITEMS = 12


class Trie:
    """Sets of items as a prefix tree. A batch of transactions goes down together: a node has the rows that hold its whole path."""

    def __init__(self, sets: list[list]):
        self.items = pa.array(sorted({x for s in sets for x in s}))
        at = {x: k for k, x in enumerate(self.items.to_pylist())}
        self.child: list[dict[int, int]] = [{}]
        self.end: list[int] = [-1]
        for n, s in enumerate(sets):
            node = 0
            for k in sorted(at[x] for x in s):
                if k not in self.child[node]:
                    self.child[node][k] = len(self.child)
                    self.child.append({})
                    self.end.append(-1)
                node = self.child[node][k]
            self.end[node] = n
        self.counts = np.zeros(len(sets), np.int64)
        self.visits = 0

    def walk(self, items: pa.ListArray, weight: np.ndarray) -> None:
        """Add the transactions of a batch to the counts."""
        step = max(64, WALK_CELLS // max(1, len(self.items)))
        for low in range(0, len(items), step):
            part = items.slice(low, step)
            place = pc.index_in(part.flatten(), value_set=self.items)
            row = pc.list_parent_indices(part).to_numpy(zero_copy_only=False)
            known = place.is_valid().to_numpy(zero_copy_only=False)
            has = np.zeros((len(self.items), len(part)), bool)
            has[place.fill_null(0).to_numpy(zero_copy_only=False)[known], row[known]] = True
            self._down(has, weight[low : low + step])

    def _down(self, has: np.ndarray, weight: np.ndarray) -> None:
        todo = [(0, np.arange(len(weight)))]
        while todo:
            node, rows = todo.pop()
            for k, to in self.child[node].items():
                own = rows[has[k, rows]]
                self.visits += 1
                if len(own):
                    if self.end[to] >= 0:
                        self.counts[self.end[to]] += weight[own].sum()
                    if self.child[to]:
                        todo.append((to, own))


def _walked(txns: DataFrame, sets: list[list]) -> DataFrame:
    """(items, support): partial counts of each task, of the sets it met."""
    shipped = txns.sparkSession.sparkContext.broadcast(sets)  # TRIE_SETS at most
    kind = txns.schema["items"].dataType.elementType.simpleString()

    def run(batches):
        trie, form = Trie(shipped.value), None
        for b in batches:
            form = b.column(0).type
            trie.walk(b.column(0), b.column(1).to_numpy(zero_copy_only=False))
        met = np.flatnonzero(trie.counts).tolist()
        if not met:
            return
        lists = pa.array([shipped.value[k] for k in met], form)
        yield pa.RecordBatch.from_arrays([lists, pa.array(trie.counts[met], pa.int64())], ["items", "support"])

    return txns.select("items", F.col("weight").cast("long").alias("weight")).mapInArrow(run, f"items array<{kind}>, support long")


def count_by_trie(txns: DataFrame, sets: DataFrame, slice_sets: int = TRIE_SETS) -> DataFrame:
    """(items, support) of ``sets`` (items) over (items, weight): each task walks a trie of the sets once over its transactions and sends one partial count for each set it met.

    What is shuffled is at most tasks times sets, never an occurrence. Over ``slice_sets`` the sets are numbered in their order, which is by first item, and sent out in slices, each of which
    reads the transactions once; the driver holds one slice at a time.
    """
    own = sets.select(F.array_sort(F.array_distinct("items")).alias("items")).distinct()
    few = own.limit(slice_sets + 1).collect()
    if len(few) <= slice_sets:
        zero = txns.sparkSession.createDataFrame([(r["items"], 0) for r in few], f"items {own.schema['items'].dataType.simpleString()}, support long")
        every = _walked(txns, [r["items"] for r in few]).unionByName(zero) if few else zero
        return every.groupBy("items").agg(F.sum("support").alias("support"))
    own = cut(dense_ids(own, ["items"], "sid"), "sets")
    every = own.select("items", F.lit(0).cast("long").alias("support"))
    for low in range(0, own.count(), slice_sets):
        part = own.where(F.col("sid").between(low, low + slice_sets - 1)).select("items").collect()  # slice_sets rows
        every = every.unionByName(_walked(txns, [r["items"] for r in part]))
    return every.groupBy("items").agg(F.sum("support").alias("support"))


@dataclass(frozen=True)
class BitmapIndex:
    """A written vertical index: ``items`` has a 64-bit word for each item and block of 64 transactions that the item occurs in, ``weights`` the weights of each block as words by binary place."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(txns: DataFrame, path: str | None = None) -> BitmapIndex:
        """Write the index of (items, weight). Transactions are numbered within their partitions, so there is no global order; words are made by partial bit_or before the shuffle."""
        path = path or shared_path(txns.sparkSession, "bitmaps")
        rows = cut(txns.select(F.array_distinct("items").alias("items"), F.col("weight").cast("long").alias("weight")).where(F.size("items") > 0).withColumn("id", F.monotonically_increasing_id()), "numbered")
        bit = F.expr("shiftleft(1L, CAST(id & 63 AS INT))")
        block = F.shiftright("id", 6).alias("block")
        each = rows.select(F.explode("items").alias("item"), block, bit.alias("bit"))
        words = each.groupBy("item", "block").agg(F.bit_or("bit").alias("bits"))
        words.repartitionByRange("item", "block").sortWithinPartitions("item", "block").write.parquet(f"{path}/items")
        places = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda p: F.getbit("weight", p) == 1)
        planes = rows.select(F.explode(places).alias("place"), block, bit.alias("bit")).groupBy("block", "place").agg(F.bit_or("bit").alias("bits"))
        planes.write.parquet(f"{path}/weights")
        return BitmapIndex(txns.sparkSession, path)

    def supports(self, sets: DataFrame) -> DataFrame:
        """(items, support) of any ``sets`` (items), from the index alone: words of a set's items are joined by block and ANDed, then weighed by population count."""
        own = cut(dense_ids(sets.select(F.array_sort(F.array_distinct("items")).alias("items")).distinct(), ["items"], "sid"), "sets")
        words = self.spark.read.parquet(f"{self.path}/items").join(own.select("sid", F.size("items").alias("size"), F.explode("items").alias("item")), "item")
        shared = words.groupBy("sid", "size", "block").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n")).where((F.col("n") == F.col("size")) & (F.col("bits") != 0))
        heavy = shared.join(self.spark.read.parquet(f"{self.path}/weights").select("block", "place", F.col("bits").alias("own")), "block")
        found = heavy.groupBy("sid").agg(F.sum(F.expr("bit_count(bits & own) * shiftleft(1L, place)")).alias("support"))
        return own.join(found, "sid", "left").select("items", F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def hot_items(txns: DataFrame, n: int = HOT_ITEMS) -> list:
    """The ``n`` items with the largest supports, ties by item."""
    return [r["item"] for r in item_support(txns, weight="weight").orderBy(F.desc("support"), "item").limit(n).collect()]


def _hot_mask(items, hot: list):
    return sum((F.when(F.array_contains(items, x), F.lit(1 << k)).otherwise(0) for k, x in enumerate(hot)), F.lit(0))


def hot_supports(txns: DataFrame, hot: list) -> DataFrame:
    """(mask, support) of all subsets of ``hot``: transactions are counted by which hot items they hold, at most 2^n rows, and each such row counts for its subsets."""
    if len(hot) > HOT_ITEMS:
        raise ValueError(f"over {HOT_ITEMS} hot items")
    by = txns.groupBy(_hot_mask("items", hot).alias("held")).agg(F.sum("weight").alias("weight"))
    every = by.select(F.explode(F.filter(F.sequence(F.lit(0), F.lit((1 << len(hot)) - 1)), lambda m: m.bitwiseAND(F.col("held")) == m)).alias("mask"), "weight")
    return every.groupBy("mask").agg(F.sum("weight").cast("long").alias("support"))


def count_with_hot(txns: DataFrame, sets: DataFrame, hot: list) -> DataFrame:
    """(items, support) of ``sets`` (items) over (items, weight), with the subsets of ``hot`` counted once and looked up.

    Of a mixed set only the rest is looked for in transactions, by its rarest item; equal rests are looked for once, and places are counted by the hot items that stand there. Hot items, which
    most transactions have, are never a key and never listed.
    """
    from patternlake.operators.itemsets import contained

    known = F.array(*[F.lit(x) for x in hot]) if hot else F.array().cast(sets.schema["items"].dataType)
    own = sets.select(F.array_sort(F.array_distinct("items")).alias("items")).distinct().withColumn("mask", _hot_mask("items", hot)).withColumn("rest", F.array_except("items", known))
    own = cut(own, "sets")
    pure = own.where(F.size("rest") == 0).join(hot_supports(txns, hot), "mask", "left").select("items", "support")
    cold = txns.select(F.array_except("items", known).alias("cold"), _hot_mask("items", hot).alias("held"), "weight").where(F.size("cold") > 0)
    cold = cold.groupBy("cold", "held").agg(F.sum("weight").alias("weight"))
    mixed = own.where(F.size("rest") > 0)
    places = contained(mixed.select(F.col("rest").alias("items")), cold, "cold").groupBy("want", "held").agg(F.sum("weight").alias("weight"))
    met = mixed.join(places, F.col("rest") == F.col("want")).where(F.col("mask").bitwiseAND(F.col("held")) == F.col("mask")).groupBy("items").agg(F.sum("weight").alias("support"))
    every = pure.unionByName(mixed.select("items").join(met, "items", "left"))
    return every.select("items", F.coalesce("support", F.lit(0)).cast("long").alias("support"))
