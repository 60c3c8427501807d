"""Scores of patterns against labels, and selection of libraries. There are several lifts: each has its own name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patternlake.operators.itemsets import contained


def contingency(sets: DataFrame, txns: DataFrame) -> DataFrame:
    """(items, pos, cnt, npos, n): over (items, label 0/1, weight). Containment is an equi-join on the set's rarest item and a test of the rest."""
    compact = txns.groupBy("items", "label").agg(F.sum("weight").alias("weight"))
    total = compact.agg(F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0)).cast("long").alias("npos"), F.sum("weight").cast("long").alias("n"))
    s = sets.select(F.array_sort("items").alias("want")).distinct()
    hit = contained(sets, compact)
    got = hit.groupBy("want").agg(F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0)).cast("long").alias("pos"), F.sum("weight").cast("long").alias("cnt"))
    out = s.select("want").join(got, "want", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("want").alias("items"), zero("pos"), zero("cnt"), zero("npos"), zero("n"))


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def sup_anom() -> Column:
    return _c("pos") / F.greatest(F.lit(1), F.col("npos"))


def sup_norm() -> Column:
    return (_c("cnt") - _c("pos")) / F.greatest(F.lit(1), F.col("n") - F.col("npos"))


def lift_eps() -> Column:
    """Anomalous over normal support, each with a tiny floor."""
    return (sup_anom() + 1e-9) / (sup_norm() + 1e-9)


def lift_table() -> Column:
    """The same with a floor of a thousandth, on supports rounded half even to three places."""
    return (F.bround(sup_anom(), 3) + 1e-3) / (F.bround(sup_norm(), 3) + 1e-3)


def lift_pos() -> Column:
    """Recall over overall support; null for a pattern that never occurs."""
    return F.try_divide(sup_anom() * _c("n"), _c("cnt"))


def lift_rate() -> Column:
    """Recall over overall support, from counts; 0 for a pattern that never occurs."""
    return F.when(F.col("cnt") == 0, 0.0).otherwise(F.try_divide(_c("pos") * _c("n"), _c("npos") * _c("cnt")))


def lift_ratio() -> Column:
    """Anomalous over normal support; infinite without normal windows."""
    return F.when(sup_norm() == 0, float("inf")).otherwise(F.try_divide(sup_anom(), sup_norm()))


def truth(table: DataFrame, least: int = 20, purity: float = 0.95) -> DataFrame:
    """Patterns that occur ``least`` times and nearly only in anomalous windows."""
    return table.where((F.col("cnt") >= least) & (F.try_divide(_c("pos"), _c("cnt")) >= purity))


def top(df: DataFrame, k: int, order: list, by: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows of each group; ``order`` must be total."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def library(table: DataFrame, k: int = 8, sup: float = 0.1, lift: float = 2.0) -> DataFrame:
    """Patterns of enough anomalous support and lift_ratio, by lift, then positives, then items."""
    scored = table.withColumns({"sup_anom": sup_anom(), "sup_norm": sup_norm(), "lift": lift_ratio()})
    good = scored.where((F.col("sup_anom") >= sup) & (F.col("lift") >= lift))
    return top(good, k, [F.desc("lift"), F.desc("pos"), "items"])


def library_grid(table: DataFrame, lifts: list[float], sups: list[float], k: int = 8) -> DataFrame:
    """The library at each cell of a grid of thresholds, by anomalous support."""
    scored = table.dropDuplicates(["items"]).withColumns({"sup_anom": sup_anom(), "lift": lift_ratio()})
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("min_lift"), F.lit(b).alias("min_sup")) for a in lifts for b in sups]))
    grid = scored.withColumn("c", cells).where((F.col("lift") >= F.col("c.min_lift")) & (F.col("sup_anom") >= F.col("c.min_sup")))
    flat = grid.select("c.min_lift", "c.min_sup", "items", "sup_anom", "lift")
    return top(flat, k, [F.desc("sup_anom"), F.desc("lift"), "items"], ["min_lift", "min_sup"])


def class_support(sets: DataFrame, txns: DataFrame, classes: list) -> DataFrame:
    """(items, sup_<class> ...): share of each class's transactions (items, cls, weight) that hold the set."""
    size = txns.groupBy("cls").agg(F.sum("weight").alias("size"))
    hit = contained(sets, txns.groupBy("items", "cls").agg(F.sum("weight").alias("weight")))
    each = hit.groupBy("want", "cls").agg(F.sum("weight").alias("hits")).join(F.broadcast(size), "cls")
    wide = each.groupBy("want").pivot("cls", classes).agg(F.first(F.col("hits") / F.col("size")))
    return wide.select(F.col("want").alias("items"), *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"sup_{c}") for c in classes])


def matched(sets: DataFrame, txns: DataFrame) -> DataFrame:
    """``txns`` (items, ...) with flagged: whether any set is contained. Tested once for each distinct transaction."""
    hit = contained(sets, txns.select("items").distinct()).select("items").distinct().withColumn("__hit", F.lit(True))
    return txns.join(hit, "items", "left").withColumn("flagged", F.col("__hit").isNotNull()).drop("__hit")


def flag_rates(sets: DataFrame, txns: DataFrame) -> DataFrame:
    """(n_anom, n_norm, flagged_anom, flagged_norm, coverage, false_rate) over (items, label, weight)."""
    m = matched(sets, txns)
    w = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("weight"))), F.lit(0)).cast("long")
    pos, neg = F.col("label") == 1, F.col("label") == 0
    out = m.agg(w(pos).alias("n_anom"), w(neg).alias("n_norm"), w(pos & F.col("flagged")).alias("flagged_anom"), w(neg & F.col("flagged")).alias("flagged_norm"))
    return out.withColumn("coverage", F.try_divide("flagged_anom", "n_anom")).withColumn("false_rate", F.try_divide("flagged_norm", "n_norm"))
