"""Threshold-free mining in stages: stage k takes the support of the k-th most frequent item as its threshold."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patternlake.operators.border import Border
from patternlake.operators.itemsets import maximal, mine
from patternlake.operators.transactions import ranked_items
from patternlake.session import cut


def stages(txns: DataFrame, upto: int | None = None) -> DataFrame:
    """(stage, item, least, share): one row per rank. Ties share a threshold, so tied stages have equal pools."""
    n = txns.agg(F.sum("weight").alias("__n"))
    out = ranked_items(txns, weight="weight").crossJoin(F.broadcast(n))
    out = out.select(F.col("rank").alias("stage"), "item", F.col("support").alias("least"), F.try_divide("support", "__n").alias("share"))
    return out if upto is None else out.where(F.col("stage") <= upto)


def pools(txns: DataFrame, upto: int) -> DataFrame:
    """(stage, items, support) of all stages at once: mined once at the last threshold, by the strategy that suits the rows' width, then cut per stage."""
    steps = cut(stages(txns, upto), "stages")
    last = steps.agg(F.min("least")).first()[0]
    if last is None:
        return steps.select("stage", F.array("item").alias("items"), F.col("least").alias("support")).limit(0)
    every = cut(mine(txns, last, "frequent"), "frequent")
    # as many stages as were asked for: a set is listed for each of those whose threshold it reaches
    at = every.crossJoin(F.broadcast(steps.agg(F.sort_array(F.collect_list(F.struct("stage", "least"))).alias("__steps"))))
    reached = F.filter("__steps", lambda s: s["least"] <= F.col("support"))
    at = at.select(F.explode(reached["stage"]).alias("stage"), "items", "support")
    return maximal(at, ["stage"])


def run(txns: DataFrame, upto: int, strategy: str = "border", path: str | None = None, log: list | None = None) -> Iterator[tuple[int, DataFrame]]:
    """Yield (stage, its maximal sets) one after the other; the caller may stop at any boundary. Tied stages are mined once.

    With ``border`` a stage goes on from what the stages before have counted (see border.Border, also for ``log``), and a run over the same ``path`` goes on where another stopped. Any other
    strategy mines each stage from nothing.
    """
    border = Border(txns, path) if strategy == "border" else None
    before, result = None, None
    for r in stages(txns, upto).orderBy("stage").collect():  # upto rows
        if r["least"] != before:
            before = r["least"]
            result = cut(maximal(border.descend(before, log)) if border else mine(txns, before, "maximal", strategy), f"stage{r['stage']}")
        yield r["stage"], result


def first_seen(pool: DataFrame) -> DataFrame:
    """(items, support, stage): each set at its first stage."""
    return pool.groupBy("items").agg(F.max("support").alias("support"), F.min("stage").alias("stage"))


def cumulative(pool: DataFrame) -> DataFrame:
    """(stage, pool, cum_pool): sets of each stage, and distinct sets up to it."""
    sizes = pool.groupBy("stage").agg(F.count("*").alias("pool"))
    new = first_seen(pool).groupBy("stage").agg(F.count("*").alias("new"))
    both = sizes.join(new, "stage", "left")
    return both.select("stage", "pool", F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("stage")).alias("cum_pool"))


def coverage(pool: DataFrame, truth: DataFrame) -> DataFrame:
    """(stage, truth_found, cum_pool, coverage, precision, monotone): truth sets found up to each stage."""
    w = Window.orderBy("stage")
    n = truth.agg(F.count("*").alias("n_truth"))
    hit = first_seen(pool).join(truth.select("items").distinct(), "items", "left_semi").groupBy("stage").agg(F.count("*").alias("hit"))
    out = cumulative(pool).join(hit, "stage", "left").crossJoin(F.broadcast(n))
    out = out.withColumn("truth_found", F.sum(F.coalesce("hit", F.lit(0))).over(w))
    out = out.withColumn("coverage", F.try_divide("truth_found", "n_truth")).withColumn("precision", F.try_divide("truth_found", "cum_pool"))
    monotone = F.coalesce(F.col("truth_found") >= F.lag("truth_found").over(w), F.lit(True))
    return out.select("stage", "truth_found", "cum_pool", "coverage", "precision", monotone.alias("monotone"))


def identity(mine: DataFrame, gold: DataFrame, by: list[str] | None = None, supports: bool = True) -> DataFrame:
    """(by, n_mine, n_gold, missing, extra, identical): set identity in both directions."""
    by, key = by or [], ["items", *(["support"] if supports else [])]
    a = mine.select(*by, *key).distinct().withColumn("__a", F.lit(1))
    b = gold.select(*by, *key).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, [*by, *key], "full_outer")
    out = both.groupBy(*by).agg(F.count("__a").alias("n_mine"), F.count("__b").alias("n_gold"), F.sum(F.col("__a").isNull().cast("long")).alias("missing"), F.sum(F.col("__b").isNull().cast("long")).alias("extra"))
    return out.withColumn("identical", (F.coalesce("missing", F.lit(0)) == 0) & (F.coalesce("extra", F.lit(0)) == 0))
