"""Dictionaries, profiles and reductions of transactions."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patternlake.session import cut


def min_count(total: int, min_sup: float) -> int:
    """The least count that reaches a share: whole, guarded against float error, at least 1."""
    return max(1, ceil(min_sup * total - 1e-9))


def item_support(txns: DataFrame, items: str = "items", weight: str | None = None) -> DataFrame:
    """(item, support): transactions that hold the item. Partial counts are combined before the shuffle."""
    each = txns.select(F.explode(F.array_distinct(items)).alias("item"), (F.col(weight) if weight else F.lit(1)).alias("w"))
    return each.groupBy("item").agg(F.sum("w").cast("long").alias("support"))


def dense_ids(df: DataFrame, order: list, name: str, first: int = 0) -> DataFrame:
    """``df`` with numbers ``first``, ``first`` + 1, ... in ``order``, as int.

    Rows are sorted by ranges, each range counts its own, and a table of offsets, one row for each range, is added: no list of all rows in one task or on the driver.
    """
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranges = cut(df.orderBy(*order).select("*", F.spark_partition_id().alias("__range"), at.alias("__at")), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = ranges.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return ranges.join(F.broadcast(offsets), "__range").select(*df.columns, (F.col("__offset") + F.col("__at") + first).cast("int").alias(name))


def dictionary(txns: DataFrame, items: str = "items") -> DataFrame:
    """(item, item_id): ids from 1 in the order of items. As many rows as there are items."""
    return dense_ids(txns.select(F.explode(items).alias("item")).distinct(), ["item"], "item_id", 1)


def ranked_items(txns: DataFrame, items: str = "items", weight: str | None = None) -> DataFrame:
    """(item, support, rank): by support, largest first, then by item."""
    return dense_ids(item_support(txns, items, weight), [F.desc("support"), "item"], "rank", 1)


def encode(txns: DataFrame, words: DataFrame, items: str = "items", key: str = "txn_id") -> DataFrame:
    """Replace items by sorted distinct ids; a transaction without known items keeps an empty list."""
    ids = txns.select(key, F.explode(items).alias("item")).join(words, "item").groupBy(key).agg(F.array_sort(F.collect_set("item_id")).alias("__ids"))
    out = txns.join(ids, key, "left").withColumn(items, F.coalesce("__ids", F.array().cast("array<int>")))
    return out.drop("__ids")


def decode(sets: DataFrame, words: DataFrame, items: str = "items") -> DataFrame:
    """Replace ids by items, sorted; ids without an item become their number."""
    keyed = sets.withColumn("__k", F.col(items)).select("__k", F.explode(items).alias("item_id")).distinct()
    named = keyed.join(words, "item_id", "left").groupBy("__k").agg(F.array_sort(F.collect_list(F.coalesce("item", F.col("item_id").cast("string")))).alias("__names"))
    return sets.join(named, sets[items] == named["__k"]).withColumn(items, F.col("__names")).drop("__k", "__names")


def compact(txns: DataFrame, items: str = "items") -> DataFrame:
    """Equal transactions once, with their number as weight: what all counting below works on."""
    return txns.groupBy(F.array_sort(F.array_distinct(items)).alias("items")).agg(F.count("*").alias("weight"))


def reduce(txns: DataFrame, least: int, items: str = "items", weight: str | None = None) -> DataFrame:
    """Drop items below ``least`` and then empty transactions. Shares stay shares of all transactions: keep their number.

    Only the list of frequent items is sent out. It has at most as many as items stand in all transactions, divided by ``least``: for a share
    of the transactions, their mean length divided by that share.
    """
    good = item_support(txns, items, weight).where(F.col("support") >= least).agg(F.collect_set("item").alias("__good"))
    out = txns.crossJoin(F.broadcast(good)).withColumn(items, F.array_sort(F.array_intersect(items, "__good"))).drop("__good")
    return out.where(F.size(items) > 0)


def profile(txns: DataFrame, items: str = "items") -> DataFrame:
    """One row: transactions, items in all, distinct items, shortest, longest and mean length, smallest and largest item."""
    size = F.size(items)
    whole = txns.agg(F.count("*").alias("n_txns"), F.sum(size).cast("long").alias("n_items"), F.min(size).cast("long").alias("min_len"), F.max(size).cast("long").alias("max_len"), F.avg(size).alias("mean_len"), F.min(F.array_min(items)).alias("min_item"), F.max(F.array_max(items)).alias("max_item"))
    kinds = txns.select(F.explode(items).alias("item")).agg(F.countDistinct("item").alias("n_distinct"))
    return whole.crossJoin(kinds)


def reduction(txns: DataFrame, least: int, weight: str = "weight") -> DataFrame:
    """One row: how many transactions, items and item kinds are there before and after ``reduce``, and which share of each goes."""
    after = reduce(txns, least, weight=weight)

    def sizes(df: DataFrame, tag: str) -> DataFrame:
        w = F.col(weight)
        whole = df.agg(F.coalesce(F.sum(w), F.lit(0)).cast("long").alias(f"n_txns_{tag}"), F.coalesce(F.sum(w * F.size("items")), F.lit(0)).cast("long").alias(f"n_items_{tag}"))
        return whole.crossJoin(df.select(F.explode("items").alias("item")).agg(F.count_distinct("item").alias(f"n_kinds_{tag}")))

    both = sizes(txns, "before").crossJoin(sizes(after, "after"))  # one row each
    gone = lambda c: (1 - F.try_divide(f"{c}_after", f"{c}_before")).alias(f"{c}_gone")
    return both.select("*", *[gone(c) for c in ("n_txns", "n_items", "n_kinds")])


def replicate(txns: DataFrame, times: int) -> DataFrame:
    """Every transaction ``times`` times, with copy from 0: supports grow in proportion, maximal sets stay."""
    return txns.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def _roll(*parts) -> Column:
    """28 bits of the MD5 of a text in parts."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 7), 16, 10).cast("long")


def plant(txns: DataFrame, key: str, shares: list[float], length: int = 3, items: str = "items") -> DataFrame:
    """``txns`` with planted sets: set p, the items ``plant=p.0`` .., joins a transaction if the MD5 of ``key:p`` falls into the share shares[p], on every run and in any engine.

    A transaction with a null key gets none.
    """
    own, least = F.col(key).cast("string"), F.array(*[F.lit(round(s * 10_000)) for s in shares])
    hits = F.filter(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda p: _roll(own, F.lit(":"), p.cast("string")) % 10_000 < F.get(least, p))
    names = F.flatten(F.transform(hits, lambda p: F.array(*[F.format_string(f"plant=%d.{k}", p) for k in range(length)])))
    return txns.withColumn(items, F.array_sort(F.array_distinct(F.concat(items, names))))


def planted(spark, n: int, patterns: int = 80, length: int = 5, noise_items: int = 400, noise: int = 6, share: float = 0.1) -> DataFrame:
    """Synthetic transactions (txn_id, items) with planted patterns: pattern p holds items p * length + 1 ...; all from MD5, so the same on every run and in any engine."""
    base = patterns * length
    row = spark.range(n).withColumnRenamed("id", "txn_id")
    own = F.col("txn_id").cast("string")
    hits = F.filter(F.sequence(F.lit(0), F.lit(patterns - 1)), lambda p: _roll(own, F.lit(":"), p.cast("string")) % 10_000 < int(share * 10_000))
    real = F.flatten(F.transform(hits, lambda p: F.sequence(p * length + 1, p * length + length)))
    fuzz = F.transform(F.sequence(F.lit(1), F.lit(noise)), lambda k: (_roll(own, F.lit("+"), k.cast("string")) % noise_items + base + 1).cast("int"))
    return row.select("txn_id", F.array_sort(F.array_distinct(F.concat(real, fuzz))).alias("items"))
