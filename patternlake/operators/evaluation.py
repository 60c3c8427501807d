"""Evaluation of diagnosis logs and of benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternlake.functions.stats import mcnemar_chi2, wilson
from patternlake.functions.text import is_error, normal_diagnosis, parse_reply


def facts(calls: DataFrame, library: DataFrame | None = None, unparsed: str = "wrong") -> DataFrame:
    """One row per call (model, cond, case_key, grp, truth, reply) that is no error: parsed, pred, correct, n_cited, n_valid.

    A reply that can't be parsed counts as wrong, or with unparsed="drop" not at all. ``library`` is
    (pattern); citations are compared after trimming.
    """
    rows = calls.where(~F.coalesce(is_error(F.col("reply")), F.lit(True))).withColumn("__r", parse_reply(F.col("reply")))
    rows = rows.withColumn("parsed", F.col("__r").isNotNull()).withColumn("pred", normal_diagnosis(F.col("__r.diagnosis")))
    rows = rows.withColumn("correct", F.coalesce(F.col("pred") == F.col("truth"), F.lit(False)))
    cited = F.transform(F.coalesce(F.col("__r.cited_patterns"), F.array().cast("array<string>")), lambda c: F.trim(c))
    rows = rows.withColumn("__cited", cited).withColumn("n_cited", F.size("__cited"))
    if library is not None:
        known = library.agg(F.collect_set("pattern").alias("__known"))  # a library is a short list
        rows = rows.crossJoin(F.broadcast(known)).withColumn("n_valid", F.size(F.filter("__cited", lambda c: F.array_contains(F.col("__known"), c)))).drop("__known")
    else:
        rows = rows.withColumn("n_valid", F.lit(0))
    if unparsed == "drop":
        rows = rows.where("parsed")
    return rows.drop("__r", "__cited")


def accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, k (correct), accuracy and its Wilson interval."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.withColumns({"accuracy": F.col("k") / F.col("n"), "low": low, "high": high})


def faithfulness(rows: DataFrame, by: list[str]) -> DataFrame:
    """By citation: valid over all. By reply: share of the replies with citations of which all are valid."""
    some = F.col("n_cited") > 0
    return rows.groupBy(*by).agg(
        F.sum("n_cited").cast("long").alias("cited"),
        F.sum("n_valid").cast("long").alias("valid"),
        (F.sum("n_valid") / F.when(F.sum("n_cited") > 0, F.sum("n_cited"))).alias("by_citation"),
        F.avg(F.when(some, (F.col("n_valid") == F.col("n_cited")).cast("double"))).alias("by_reply"),
    )


def hallucination(rows: DataFrame, by: list[str], without: Column) -> DataFrame:
    """Replies that cite patterns where no library was given."""
    return rows.where(without).groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("n_cited") > 0).cast("long")).alias("hallucinated")).withColumn("rate", F.col("hallucinated") / F.col("n"))


def false_positives(rows: DataFrame, by: list[str], normal: str = "normal") -> DataFrame:
    """Share of truly normal cases that are called otherwise."""
    return rows.where(F.col("truth") == normal).groupBy(*by).agg(F.count("*").alias("n"), F.sum((~F.col("correct")).cast("long")).alias("fp")).withColumn("fpr", F.col("fp") / F.col("n"))


def macro(cells: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Unweighted mean and sample deviation over cells."""
    return cells.groupBy(*by).agg(F.count("*").alias("cells"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def paired(rows: DataFrame, first: str, second: str, by: list[str], key: str = "case_key") -> DataFrame:
    """McNemar counts of two conditions over the cases that both have: b only the second is right, c only the first; one pass, no self-join."""
    side = lambda c: F.max(F.when(F.col("cond") == c, F.col("correct").cast("int")))
    case = rows.where(F.col("cond").isin(first, second)).groupBy(*by, key).agg(side(first).alias("x"), side(second).alias("y"))
    return _discordant(case, by)


def budget_curve(rows: DataFrame, by: list[str], budget: str = "budget") -> DataFrame:
    """Accuracy at each evidence budget, with its gain over budget 0."""
    acc = accuracy(rows, [*by, budget])
    zero = acc.where(F.col(budget) == 0).select(*by, F.col("accuracy").alias("at_zero"))
    joined = acc.join(zero, by, "left") if by else acc.crossJoin(zero)
    return joined.withColumn("gain", F.col("accuracy") - F.col("at_zero"))


def _discordant(cases: DataFrame, by: list[str]) -> DataFrame:
    """McNemar counts of cases (by, x, y) that have both sides."""
    n = lambda cond: F.count(F.when(cond, 1))
    out = cases.where("x is not null and y is not null").groupBy(*by).agg(F.count("*").alias("n_paired"), n((F.col("x") == 0) & (F.col("y") == 1)).alias("b"), n((F.col("x") == 1) & (F.col("y") == 0)).alias("c"))
    return out.withColumn("chi2", mcnemar_chi2(F.col("b"), F.col("c")))


def budget_contrasts(rows: DataFrame, pairs: list[tuple[int, int]], by: list[str], key: str = "case_key", budget: str = "budget") -> DataFrame:
    """(lo, hi, by, n_paired, b, c, chi2): McNemar of each pair of budgets over the cases that have both; one pass for all pairs."""
    right = F.col("correct").cast("int")
    grid = F.explode(F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in pairs])).alias("p")
    dealt = rows.select(*by, key, budget, right.alias("ok"), grid).select("*", "p.lo", "p.hi").where((F.col(budget) == F.col("lo")) | (F.col(budget) == F.col("hi")))
    side = lambda c: F.max(F.when(F.col(budget) == F.col(c), F.col("ok")))
    return _discordant(dealt.groupBy("lo", "hi", *by, key).agg(side("lo").alias("x"), side("hi").alias("y")), ["lo", "hi", *by])


def peak_contrast(rows: DataFrame, by: list[str], key: str = "case_key", budget: str = "budget") -> DataFrame:
    """(by, peak, n_paired, b, c, chi2): McNemar of the budget with the best accuracy (of equal ones the smallest) against budget 0."""
    best = accuracy(rows.where(F.col(budget) > 0), [*by, budget]).groupBy(*by).agg(F.max_by(budget, F.struct("accuracy", -F.col(budget))).alias("peak"))
    side = lambda b: F.max(F.when(F.col(budget) == b, F.col("correct").cast("int")))
    cases = rows.join(F.broadcast(best), by).groupBy(*by, "peak", key).agg(side(F.lit(0)).alias("x"), side(F.col("peak")).alias("y"))
    return _discordant(cases, [*by, "peak"])


def run_summary(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, quartiles and number of repeats."""
    q = lambda p: F.percentile(value, F.lit(p))
    return runs.groupBy(*by).agg(F.count("*").alias("reps"), F.min(value).alias("best"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


def speedup(summary: DataFrame, by: list[str], engine: str, base: str, other: str) -> DataFrame:
    """Medians of two engines side by side, and their ratio."""
    wide = summary.groupBy(*by).pivot(engine, [base, other]).agg(F.first("median"))
    return wide.select(*by, F.col(base).alias("base_median"), F.col(other).alias("other_median"), (F.try_divide(base, other)).alias("speedup"))


def agreement(a: DataFrame, b: DataFrame, key: list[str], value: str, by: list[str]) -> DataFrame:
    """(n, same, agreement) of two tables of states joined on ``key``."""
    both = a.select(*dict.fromkeys([*key, *by]), F.col(value).alias("__a")).join(b.select(*key, F.col(value).alias("__b")), key)
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("__a") == F.col("__b")).cast("long")).alias("same")).withColumn("agreement", F.col("same") / F.col("n"))


def closure_violations(frequent: DataFrame) -> DataFrame:
    """Subsets of one item less that are missing from ``frequent``: none if it is complete."""
    smaller = frequent.where(F.size("items") > 1).select(F.explode(F.transform("items", lambda x: F.filter("items", lambda y: y != x))).alias("items")).distinct()
    return smaller.join(frequent, "items", "left_anti")


def fingerprint(sets: DataFrame) -> DataFrame:
    """One row: an order-free fingerprint of a list of sets. Sums of hashes, so no list is gathered."""
    h = F.xxhash64("items", "support").cast("decimal(38,0)")
    return sets.agg(F.count("*").alias("n"), F.sum(h).alias("fingerprint"))


def validation(mine: DataFrame, gold: DataFrame, times: DataFrame, by: list[str]) -> DataFrame:
    """PASS or FAIL per configuration: same sets (supports not compared), with the median time."""
    from patternlake.operators.anytime import identity

    out = identity(mine, gold, by, supports=False).join(times.groupBy(*by).agg(F.median("secs").alias("median_s")), by, "left")
    return out.withColumn("verdict", F.when(F.col("identical"), "PASS").otherwise("FAIL"))
