"""Mining that goes on where it stopped: all sets that were ever counted are kept with their supports, frequent ones and those just below the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.operators.counting import count_by_trie
from patternlake.operators.transactions import item_support
from patternlake.session import shared_path

#: Over so many keys pairs of single items are dealt.
SALTS = 16


def parts(sets: DataFrame) -> DataFrame:
    """(items, part, x): each set with each of its items ``x`` taken out."""
    at = sets.select("items", F.posexplode("items").alias("k", "x"))
    return at.select("items", F.concat(F.slice("items", F.lit(1), F.col("k")), F.slice("items", F.col("k") + 2, F.size("items"))).alias("part"), "x")


def extensions(new: DataFrame, frequent: DataFrame, counted: DataFrame) -> DataFrame:
    """(items): sets of one item more that hold a set of ``new``, whose every subset is in ``frequent`` and that are not among ``counted``. All are (items), any sizes together."""
    # sets of one item have the empty part in common, so that key is dealt over SALTS
    salt = F.when(F.size("part") == 0, F.pmod(F.hash("y"), F.lit(SALTS))).otherwise(0)
    other = parts(frequent).select("part", F.col("x").alias("y")).withColumn("salt", salt)
    salts = F.explode(F.when(F.size("part") == 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    grown = parts(new).withColumn("salt", salts).join(other, ["part", "salt"]).where("x != y")
    grown = grown.select(F.array_sort(F.array_append("items", F.col("y"))).alias("items")).distinct().join(counted.select("items"), "items", "left_anti")
    missing = parts(grown).select("items", F.col("part").alias("sub")).join(frequent.select(F.col("items").alias("sub")), "sub", "left_anti").select("items").distinct()
    return grown.join(missing, "items", "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


class Border:
    """Counted sets below a folder: one table for each step of counting, and a mark for each threshold that was reached.

    ``descend`` lowers the threshold. Only sets that reach it and had not reached the one before are expanded, and only what was never counted is counted: a set is in exactly one step. A
    table without its success mark does not count, so what an interrupted run had finished is used and the rest is done again: open the same folder once more.
    """

    def __init__(self, txns: DataFrame, path: str | None = None):
        self.spark, self.path = txns.sparkSession, path or shared_path(txns.sparkSession, "border")
        if not exists(self.spark, f"{self.path}/base"):
            txns.groupBy(F.array_sort(F.array_distinct("items")).alias("items")).agg(F.sum("weight").cast("long").alias("weight")).write.mode("overwrite").parquet(f"{self.path}/base")
        self.base = self.spark.read.parquet(f"{self.path}/base")
        if not exists(self.spark, f"{self.path}/step0000"):
            item_support(self.base, weight="weight").select(F.array("item").alias("items"), "support").write.mode("overwrite").parquet(f"{self.path}/step0000")

    def _steps(self) -> list[str]:
        return [n for n in children(self.spark, self.path) if n.startswith("step") and exists(self.spark, f"{self.path}/{n}")]

    def counted(self) -> DataFrame:
        """(items, support) of every set that was counted so far."""
        return self._read(*self._steps())

    def _read(self, *names: str) -> DataFrame:
        return self.spark.read.schema(f"items {self.base.schema['items'].dataType.simpleString()}, support long").parquet(*[f"{self.path}/{n}" for n in names])

    def reached(self) -> int | None:
        """The lowest threshold that was reached to its end."""
        marks = [int(n.removeprefix("reached")) for n in children(self.spark, self.path) if n.startswith("reached")]
        return min(marks, default=None)

    def descend(self, least: int, log: list | None = None) -> DataFrame:
        """(items, support) of all frequent sets at ``least``. ``log`` gets (least, step, sets counted) of each step of counting; a threshold that lies above one that was reached counts nothing."""
        done = self.reached()
        if done is None or least < done:
            new = self.counted().where(F.col("support") >= least)
            new = new if done is None else new.where(F.col("support") < done)
            while True:
                every = self.counted()
                wanted = extensions(new, every.where(F.col("support") >= least), every)
                name = f"step{len(self._steps()):04d}"
                count_by_trie(self.base, wanted).write.mode("overwrite").parquet(f"{self.path}/{name}")
                found = self._read(name)
                n = found.count()
                if log is not None and n:
                    log.append((least, name, n))
                new = found.where(F.col("support") >= least)
                if not n or new.isEmpty():
                    break
            mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/reached{least}")
            mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(mark)
        return self.counted().where(F.col("support") >= least)

