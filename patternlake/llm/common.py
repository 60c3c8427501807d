"""Shared pieces: tables in the cluster's shared folder and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.session import shared_path


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share; see session.shared_path."""
    return shared_path(spark, "corpus")


def stash(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, path: str, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, as (node, root): root is the smallest node reachable.

    Alternates large-star and small-star steps. Every step is a partial aggregate and an equi-join, so a node
    of any degree is split by the skew join; a root is in the result as its own. Nothing is gathered on the driver but a count and a checksum.
    Each round is written to the shared folder. Nodes without an edge to another node are not in the result.
    Null ends and self loops are ignored; repeated edges count once.
    """
    big, small = F.greatest(a, b), F.least(a, b)
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = stash(clean.select(big.alias("a"), small.alias("b")).distinct(), f"{path}/cc0")
    seen = _mark(e)
    if seen[0] == 0:
        return e.toDF("node", "root")
    for k in range(1, rounds + 1):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        e = stash(joined.union(lowest.toDF("a", "b")).distinct(), f"{path}/cc{k}")
        now = _mark(e)
        if now == seen:
            return e.union(e.select("b", "b").distinct()).toDF("node", "root")
        seen = now
    raise RuntimeError(f"components did not settle within {rounds} rounds")
