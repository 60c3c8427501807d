"""Frequent sets that are kept up to date over micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.operators.border import children, exists, extensions
from patternlake.operators.counting import count_by_trie
from patternlake.operators.itemsets import maximal
from patternlake.operators.transactions import item_support, min_count
from patternlake.session import cut


class Incremental:
    """Sets counted so far, with their supports over all batches: the frequent ones and the border below them.

    A batch is counted for the known sets alone. Only where a set becomes frequent that was not before are new sets made, and those are counted over all batches, which are kept as
    distinct transactions. Batches and versions are tables with a success mark below ``path``: a batch that was applied is not applied again, one that was interrupted is done anew, so a
    stream may restart from its checkpoint. ``log`` has (batch, sets counted in the batch, sets counted over everything).
    """

    def __init__(self, spark: SparkSession, path: str, share: float, kind: str = "string"):
        self.spark, self.path, self.share, self.kind = spark, path, share, kind
        self.log: list[tuple[int, int, int]] = []

    def version(self) -> int:
        """The last batch that was applied, -1 if none was."""
        done = [int(n.removeprefix("version")) for n in children(self.spark, self.path) if n.startswith("version") and exists(self.spark, f"{self.path}/{n}")]
        return max(done, default=-1)

    def state(self) -> DataFrame:
        """(items, support, frequent) of all known sets after the last batch."""
        if self.version() < 0:
            return self.spark.createDataFrame([], f"items array<{self.kind}>, support long, frequent boolean")
        return self.spark.read.parquet(f"{self.path}/version{self.version():06d}")

    def transactions(self) -> DataFrame:
        """(items, weight): distinct transactions of each applied batch."""
        return self.spark.read.parquet(*[f"{self.path}/batch{k:06d}" for k in range(self.version() + 1)])

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take in the transactions (items) of batch ``number``; numbers rise by one from 0."""
        last = self.version()
        if number <= last:
            return
        if number != last + 1:
            raise ValueError(f"batch {number} does not follow {last}")
        here = f"{self.path}/batch{number:06d}"
        batch.groupBy(F.array_sort(F.array_distinct("items")).alias("items")).agg(F.count("*").alias("weight")).write.mode("overwrite").parquet(here)
        own = self.spark.read.parquet(here)
        every = own if last < 0 else self.transactions().unionByName(own)
        least = min_count(every.agg(F.sum("weight")).first()[0] or 0, self.share)
        before = self.state()
        singles = item_support(own, weight="weight").select(F.array("item").alias("items"), F.col("support").alias("more"))
        longer = count_by_trie(own, before.where(F.size("items") > 1).select("items")).withColumnRenamed("support", "more")
        known = before.join(singles.unionByName(longer), "items", "full").select("items", (F.coalesce("support", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("support"), F.coalesce("frequent", F.lit(False)).alias("was"))
        known = cut(known, "known")
        new, anew = known.where((F.col("support") >= least) & ~F.col("was")).select("items"), 0
        while not new.isEmpty():
            found = cut(count_by_trie(every, extensions(new, known.where(F.col("support") >= least).select("items"), known)), "found")
            n = found.count()
            anew += n
            new = found.where(F.col("support") >= least).select("items")
            if not n:
                break
            known = known.unionByName(found.withColumn("was", F.lit(False)))
        self.log.append((number, before.count(), anew))
        known.select("items", "support", (F.col("support") >= least).alias("frequent")).write.mode("overwrite").parquet(f"{self.path}/version{number:06d}")

    def frequent(self) -> DataFrame:
        """(items, support) of all frequent sets after the last batch."""
        return self.state().where("frequent").select("items", "support")

    def maximal(self) -> DataFrame:
        return maximal(self.frequent())

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Follow a stream of transactions (items); its batches are applied in order, once each."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
