"""Windows by row count, segments, prefixes and ranks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patternlake.session import cut


def with_position(df: DataFrame, unit: list[str], order: list[str], long_units: bool = False) -> DataFrame:
    """Add seq (from 0 in each unit by ``order``) and n (rows of the unit).

    A unit's rows are sorted by one task; with ``long_units`` they are numbered by ranges instead, so a unit may be as large as the table.
    """
    if long_units:
        size = df.groupBy(*unit).agg(F.count("*").alias("n"))
        return _with_keyed(position(df, [*unit, *order], unit), size, unit).withColumn("seq", F.col("seq").cast("int"))
    w = Window.partitionBy(*unit)
    return df.withColumn("seq", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))


def _with_keyed(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with what ``small`` has for the same keys; null is a key like any other."""
    named = small.withColumnsRenamed({k: f"__on_{k}" for k in keys})
    return df.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in keys])).drop(*[f"__on_{k}" for k in keys])


def position(df: DataFrame, order: list[str | Column], by: list[str] | None = None, out: str = "seq") -> DataFrame:
    """Add ``out``, the row's place from 0 by ``order`` over the whole table, or over each group of ``by`` (``order`` then begins with it).

    Rows are dealt by ranges of ``order`` and written, so that ranges are counted and numbered apart: no task holds more than its range.
    Rows that are equal in ``order`` are numbered in any order.
    """
    part = ["__part", *(by or [])]
    dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*part).agg(F.count("*").alias("__n"))  # one row for each range and group in it
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part")) - F.col("__n")).drop("__n")
    numbered = dealt.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)
    return _with_keyed(numbered, before, part).withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__before")


def window_ids(size: int, hop: int) -> Column:
    """All windows [k * hop, k * hop + size) that hold row seq of n and end within the unit; empty if none."""
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") - size + 1) / hop).cast("int"))
    last = F.least(F.floor(F.col("seq") / hop), F.floor((F.col("n") - size) / hop)).cast("int")
    return F.when((F.col("n") >= size) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def count_windows(df: DataFrame, unit: list[str], order: list[str], size: int, hop: int, aggs: list[Column], long_units: bool = False) -> DataFrame:
    """Sliding windows of ``size`` rows, one every ``hop``; the rest at a unit's end is dropped, units below ``size`` have none.

    Rows are numbered in their unit, dealt to their windows by arithmetic and aggregated: two shuffles on
    keys that begin with the unit, no self-join. ``long_units``: see with_position.
    """
    dealt = with_position(df, unit, order, long_units).withColumn("win", F.explode(window_ids(size, hop)))
    return dealt.groupBy(*unit, "win").agg(*aggs)


def window_transactions(df: DataFrame, unit: list[str], order: list[str], channels: list[str], edges: DataFrame, size: int = 30, hop: int = 15, label: str | None = None, edges_by: list[str] | None = None, long_units: bool = False) -> DataFrame:
    """(unit, win, items[, label]): each channel's median over the window, as a state; the label is the window's largest. ``long_units``: see with_position."""
    from patternlake.functions.states import item, itemize, with_states

    aggs = [F.median(F.col(c).cast("double")).alias(c) for c in channels] + ([F.max(label).alias("label")] if label else [])
    states = with_states(count_windows(df, unit, order, size, hop, aggs, long_units), edges, channels, edges_by)
    return states.select(*unit, "win", itemize([item(c, F.col(c)) for c in channels]).alias("items"), *(["label"] if label else []))


def _with_last(df: DataFrame, unit: list[str], position: str) -> DataFrame:
    """Add __last, the largest ``position`` of the row's unit: a grouped maximum and a join, so no task holds a unit."""
    return _with_keyed(df, df.groupBy(*unit).agg(F.max(position).alias("__last")), unit)


def tail_label(df: DataFrame, unit: list[str], position: str, fraction: float = 0.15) -> DataFrame:
    """label 1 for the last ``fraction`` of each unit's life."""
    return _with_last(df, unit, position).withColumn("label", (F.col(position) > (1 - fraction) * F.col("__last")).cast("int")).drop("__last")


def segments(df: DataFrame, unit: list[str], position: str, parts: int = 5) -> DataFrame:
    """segment 0 .. parts - 1 by share of the unit's windows (not ntile: shares are cut at fixed places)."""
    share = F.floor(F.col(position) * parts / (F.col("__last") + 1))
    return _with_last(df, unit, position).withColumn("segment", F.least(F.lit(parts - 1), share).cast("int")).drop("__last")


def prefixes(df: DataFrame, order: list[str | Column], fractions: list[float]) -> DataFrame:
    """Rows of each prefix: with ``fraction`` and, for each, the first max(1, round half even(f * n)) rows. Rows are numbered by ranges."""
    whole = df.agg(F.count("*").alias("__n"))
    ranked = position(df, order, out="__i").crossJoin(F.broadcast(whole))  # one row
    grid = F.explode(F.array(*[F.lit(f) for f in fractions]))
    out = ranked.withColumn("fraction", grid).where(F.col("__i") < F.greatest(F.lit(1), F.bround(F.col("fraction") * F.col("__n")).cast("long")))
    return out.drop("__i", "__n")


def guard_split(df: DataFrame, position: str, at: int, guard: int) -> DataFrame:
    """part: ``fit`` before the split, ``test`` behind it; rows within ``guard`` of it are dropped."""
    p = F.col(position)
    return df.withColumn("part", F.when(p < at - guard, "fit").when(p >= at + guard, "test")).where("part is not null")


def carry_forward(df: DataFrame, order: list[str], value: str, out: str, unit: list[str] | None = None) -> DataFrame:
    """The last value that is not null, at or before each row of the table, or of its unit.

    Rows are dealt by ranges of unit and order and written; a range takes over the last value of those before it, so a unit may be as large as the table.
    """
    part = ["__part", *(unit or [])]
    dealt = cut(df.repartitionByRange(*(unit or []), *order).withColumn("__part", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy(*part).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__end"))  # one row for each range and unit in it
    earlier = Window.partitionBy(*(unit or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    taken = ends.select(*part, F.last("__end", ignorenulls=True).over(earlier).alias("__taken"))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _with_keyed(dealt.withColumn(out, own), taken, part).withColumn(out, F.coalesce(out, "__taken")).drop("__part", "__taken")
