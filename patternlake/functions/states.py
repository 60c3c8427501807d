"""Turning channels into discrete states: edges, bins and items."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quantile_points(bins: int) -> list[float]:
    return [k / bins for k in range(bins + 1)]


def _settle(edges: Column) -> Column:
    """Ascending distinct edges; one value alone gets half a unit on either side."""
    e = F.array_distinct(edges)
    return F.when(F.size(e) < 2, F.array(e[0] - 0.5, e[0] + 0.5)).otherwise(e)


#: Accuracy of the first look at a channel's quantiles, and how many values between two bounds are taken to the driver to end the search.
SKETCH, HELD = 10_000, 100_000
#: Channels with up to about so many distinct values are counted by value.
COUNTED = 100_000


def quantile_edges(col: str, bins: int = 3, accuracy: int | None = None) -> Column:
    """Aggregate: edges of equal-frequency bins, nulls left out.

    Exact by default (linear interpolation); that keeps a count of every distinct value of a group in one place. For
    a whole table ``exact_edges`` needs no such place; ``accuracy`` takes the mergeable sketch instead.
    """
    value = F.col(col).cast("double")
    if accuracy is None:
        return _settle(F.percentile(value, F.array(*map(F.lit, quantile_points(bins)))))
    return _settle(F.percentile_approx(value, quantile_points(bins), accuracy))


def exact_edges(df: DataFrame, channels: list[str], bins: int = 3) -> dict[str, list[float] | None]:
    """Exact quantile edges (linear interpolation) of whole channels, nulls and NaN left out; None for a channel without values.

    Channels with few distinct values (COUNTED, as a distinct-count sketch has it) are counted by value, before the shuffle and after, and ranks are looked up in running sums of the counts.
    Of the others a mergeable sketch bounds each wanted rank by two values; one more pass counts what lies outside and takes what lies between.
    On tables so large that this would be too much the bounds are narrowed by further sketches first. No task ever holds more than a
    sketch, HELD values or the distinct values of a counted channel, and rows are never shuffled.
    """
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in channels}
    kinds = df.agg(*[F.approx_count_distinct(v, 0.05).alias(c) for c, v in x.items()]).first()
    few = [c for c in channels if kinds[c] <= COUNTED]
    found = _counted_edges(df, {c: x[c] for c in few}, bins) if few else {}
    rest = [c for c in channels if c not in few]
    found |= _sketched_edges(df, {c: x[c] for c in rest}, bins) if rest else {}
    return {c: found[c] for c in channels}


def _edges(low: float, inner: list[tuple[float, float, float]], high: float) -> list[float]:
    """Edges from the smallest value, (rank, value at its floor, value at its ceiling) of each inner one, and the largest value."""
    edges = [low]
    for at, below, above in inner:
        edges.append(below if below == above else (ceil(at) - at) * below + (at - floor(at)) * above)
    edges = list(dict.fromkeys([*edges, high]))
    return edges if len(edges) > 1 else [edges[0] - 0.5, edges[0] + 0.5]


def _counted_edges(df: DataFrame, x: dict[str, Column], bins: int) -> dict[str, list[float] | None]:
    inner, names = quantile_points(bins)[1:-1], list(x)
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in enumerate(x.values())])).alias("x")).where("x.v is not null")
    counts = each.groupBy("x.k", "x.v").agg(F.count("*").alias("w"))
    own = Window.partitionBy("k")  # the distinct values of a channel: about COUNTED rows
    sums = counts.select("k", "v", F.sum("w").over(own.orderBy("v")).alias("upto"), F.sum("w").over(own).alias("n"))
    at = [F.lit(p) * (F.col("n") - 1) for p in inner]
    looks = [F.min(F.when(F.col("upto") > rank(a), F.col("v"))).alias(f"{rank.__name__}{i}") for i, a in enumerate(at) for rank in (F.floor, F.ceil)]
    out: dict[str, list[float] | None] = dict.fromkeys(names)
    for r in sums.groupBy("k").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("n").alias("n"), *looks).collect():  # a row for each channel
        out[names[r["k"]]] = _edges(r["low"], [(p * (r["n"] - 1), r[f"floor{i}"], r[f"ceil{i}"]) for i, p in enumerate(inner)], r["high"])
    return out


def _sketched_edges(df: DataFrame, x: dict[str, Column], bins: int) -> dict[str, list[float] | None]:
    channels, inner = list(x), quantile_points(bins)[1:-1]
    near = sorted({min(1.0, max(0.0, p + d / SKETCH)) for p in inner for d in (-3, 3)})
    looks = [F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile_approx(v, near, SKETCH).alias("at")).alias(c) for c, v in x.items()]
    seen = df.agg(*looks).first()
    bounds: dict[tuple[str, float], tuple[float, float]] = {}
    for c in channels:
        if seen[c]["n"]:
            for p in inner:
                few = seen[c]["n"] <= SKETCH  # of so few values all are taken
                below = [v for q, v in zip(near, seen[c]["at"]) if q < p and not few]
                above = [v for q, v in zip(near, seen[c]["at"]) if q > p and not few]
                bounds[c, p] = (max(below, default=seen[c]["low"]), min(above, default=seen[c]["high"]))
    while wide := [k for k in bounds if 6 * seen[k[0]]["n"] / SKETCH > HELD]:
        counts = _between(df, x, {k: bounds[k] for k in wide}, lambda v, lo, hi: F.count(F.when((v > lo) & (v < hi), v)))
        wide = [k for k in wide if counts[k]["inside"] > max(HELD, SKETCH)]
        if not wide:
            break
        share = {k: (k[1] * (seen[k[0]]["n"] - 1) - counts[k]["below"]) / counts[k]["inside"] for k in wide}
        row = df.agg(*[F.percentile_approx(F.when((x[c] > bounds[c, p][0]) & (x[c] < bounds[c, p][1]), x[c]), [min(1.0, max(0.0, share[c, p] + d / SKETCH)) for d in (-3, 3)], SKETCH).alias(f"b{k}") for k, (c, p) in enumerate(wide)]).first()
        bounds |= {key: tuple(row[f"b{k}"]) for k, key in enumerate(wide)}
    held = _between(df, x, bounds, lambda v, lo, hi: F.sort_array(F.collect_list(F.when((v > lo) & (v < hi), v)))) if bounds else {}
    out: dict[str, list[float] | None] = {}
    for c in channels:
        if not seen[c]["n"]:
            out[c] = None
            continue
        ranks = [(p, p * (seen[c]["n"] - 1)) for p in inner]
        found = [(at, *(_ranked(held[c, p], bounds[c, p], r) for r in (floor(at), ceil(at)))) for p, at in ranks]
        if any(v is None for _, *pair in found for v in pair):  # a bound of the sketch was wrong by more than its accuracy
            out |= _counted_edges(df, {c: x[c]}, bins)
        else:
            out[c] = _edges(seen[c]["low"], found, seen[c]["high"])
    return out


def _between(df: DataFrame, x: dict[str, Column], bounds: dict, inside) -> dict:
    """For each bound (low, high) of a channel: how many values lie at or below low and at high, and ``inside`` of those between."""
    cols = []
    for k, ((c, _), (lo, hi)) in enumerate(bounds.items()):
        v = x[c]
        cols.append(F.struct(F.count(F.when(v < lo, 1)).alias("less"), F.count(F.when(v <= lo, 1)).alias("below"), F.count(F.when(v == hi, 1)).alias("top"), inside(v, lo, hi).alias("inside")).alias(f"b{k}"))
    row = df.agg(*cols).first()
    return {key: row[f"b{k}"] for k, key in enumerate(bounds)}


def _ranked(counts, bound: tuple[float, float], rank: int) -> float | None:
    """The value of a rank (from 0) that lies within ``bound``; None if it doesn't."""
    if counts["less"] <= rank < counts["below"]:
        return bound[0]
    rank -= counts["below"]
    if 0 <= rank < len(counts["inside"]):
        return counts["inside"][rank]
    if 0 <= rank - len(counts["inside"]) < counts["top"] and bound[1] > bound[0]:
        return bound[1]
    return None


def equal_width_edges(col: str, bins: int = 3) -> Column:
    """Aggregate: edges of bins of equal width from the smallest to the largest value."""
    low, high = F.min(F.col(col).cast("double")), F.max(F.col(col).cast("double"))
    inner = [low + (high - low) * k / bins for k in range(bins)]
    return _settle(F.array(*inner, high))


def bin_index(value: Column, edges: Column) -> Column:
    """Bin of ``value``: the last edge at or below it, held within the edges. A value on an inner edge belongs above; null stays null."""
    below = F.size(F.filter(edges, lambda e: e <= value)) - 1
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(0), F.least(F.size(edges) - 2, below)))


def fixed_bin(value: Column, edges: list[float] | None) -> Column:
    """bin_index for edges that are known: how many inner edges the value reaches, as comparisons that are compiled."""
    if edges is None:
        return F.lit(None).cast("int")
    state = F.lit(0)
    for e in edges[1:-1]:
        state = state + (value >= F.lit(e)).cast("int")
    return F.when(value.isNotNull() & ~F.isnan(value), state)


def item(name: str, state: Column) -> Column:
    """``name=state``, null for a null state; a unit in brackets at the end of a name is dropped."""
    short = name.split(" [")[0]
    return F.when(state.isNotNull(), F.concat(F.lit(f"{short}="), state.cast("string")))


def itemize(items: list[Column]) -> Column:
    """A transaction: the sorted distinct items that are not null."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*items))))


def fit_edges(df: DataFrame, channels: list[str], bins: int = 3, method: str = "quantile", by: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """One row (per group of ``by``): for each channel an array of edges. Exact quantiles of a whole table are found in two passes; see exact_edges."""
    if method == "quantile" and not by and accuracy is None:
        found = exact_edges(df, channels, bins)
        return df.sparkSession.createDataFrame([tuple(found[c] for c in channels)], ", ".join(f"`{c}` array<double>" for c in channels))
    make = (lambda c: quantile_edges(c, bins, accuracy)) if method == "quantile" else (lambda c: equal_width_edges(c, bins))
    return df.groupBy(*(by or [])).agg(*[make(c).alias(c) for c in channels])


def with_states(df: DataFrame, edges: DataFrame, channels: list[str], by: list[str] | None = None) -> DataFrame:
    """Replace each channel by its state. ``edges`` is one row, or one for each group of ``by``."""
    if not by:
        row = edges.select(*channels).first()
        return df.withColumns({c: fixed_bin(F.col(c).cast("double"), row[c]) for c in channels})
    named = edges.select(*by, *[F.col(c).alias(f"__edges_{c}") for c in channels])
    states = {c: bin_index(F.col(c).cast("double"), F.col(f"__edges_{c}")) for c in channels}
    return df.join(named, by).withColumns(states).drop(*[f"__edges_{c}" for c in channels])


def select_channels(df: DataFrame, channels: list[str], quantile: float = 0.4, most: int = 25) -> DataFrame:
    """(position, channel, variance) of channels whose sample variance is over that quantile of all variances, the first ``most`` in column order.

    The table is read once for one row of variances; the rest works on as many rows as there are channels.
    """
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in channels])
    long = row.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("variance")) for c in channels])).alias("position", "x"))
    long = long.select("position", "x.channel", "x.variance")
    limit = long.agg(F.percentile("variance", F.lit(quantile)).alias("limit"))
    return long.crossJoin(limit).where("variance > limit").orderBy("position").limit(most).select("position", "channel", "variance")
