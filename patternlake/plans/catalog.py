"""The catalogue: one query for each operator, over the tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.functions import features, stats, text
from patternlake.functions.states import fit_edges, select_channels, with_states
from patternlake.operators import anytime, counting, evaluation, itemsets, online, scoring, transactions, windows
from patternlake.plans import frames as f
from patternlake.plans import roundtrips
from patternlake.session import cut, shared_path
from patternlake.streaming import incremental

#: Supports at which the catalogue mines.
SHARE, BASKET_SHARE, TRUTH_SHARE = 0.05, 0.02, 0.02
STAGES = 8
#: Shares of orders that get planted sets.
PLANTED = [0.005 * (p + 1) for p in range(8)]


def _least(txns: DataFrame, share: float) -> int:
    return transactions.min_count(txns.agg(F.sum("weight")).first()[0] or 0, share)


def _named(sets: DataFrame, *more: str) -> DataFrame:
    return sets.select(text.pattern_text(F.col("items")).alias("pattern"), *more)


# ------------------------------------------------------------------ states


def edges_quantile(spark, d):
    e = f.row_edges(spark, d)
    return e.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("e")) for c in f.ROW_CHANNELS])).alias("x")).select("x.channel", F.posexplode(F.transform("x.e", lambda v: F.round(v, 6))).alias("k", "edge"))


def edges_equal_width(spark, d):
    e = fit_edges(f.table(spark, d, "lineitem"), f.ROW_CHANNELS, method="width")
    return e.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("e")) for c in f.ROW_CHANNELS])).alias("x")).select("x.channel", F.posexplode(F.transform("x.e", lambda v: F.round(v, 6))).alias("k", "edge"))


def bin_histogram(spark, d):
    s = f.row_states(spark, d)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("state")) for c in f.ROW_CHANNELS])).alias("x")
    return s.select(pairs).groupBy("x.channel", "x.state").agg(F.count("*").alias("n"))


def items_rowwise(spark, d):
    return _named(f.row_weights(spark, d), "weight")


def channel_select_variance(spark, d):
    """Of all components of the vectors the 25 first that vary enough."""
    return select_channels(f.wide_sensors(spark, d), [f"d{i}" for i in range(64)]).select("position", "channel", F.round("variance", 9).alias("variance"))


def empty_bins(spark, d):
    """Equal-width bins that hold no row, per channel."""
    e = fit_edges(f.table(spark, d, "lineitem"), f.ROW_CHANNELS, method="width")
    states = with_states(f.table(spark, d, "lineitem").select(*f.ROW_CHANNELS), e, f.ROW_CHANNELS)
    used = states.agg(*[F.count_distinct(c).alias(c) for c in f.ROW_CHANNELS])
    return used.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("used"), (F.lit(3) - F.col(c)).alias("empty")) for c in f.ROW_CHANNELS])).alias("x")).select("x.*")


# ----------------------------------------------------------------- windows


def _medians(size, hop):
    def query(spark, d):
        aggs = [F.round(F.median("value"), 6).alias("value"), F.median("k").alias("k"), F.max("label").alias("label"), F.count("*").alias("n_rows")]
        return windows.count_windows(f.series(spark, d), ["user_id"], ["ts", "event_id"], size, hop, aggs)

    return query


def windows_label_max(spark, d):
    return f.series_windows(spark, d).select("user_id", "win", text.pattern_text(F.col("items")).alias("pattern"), "label")


def raw_concat_windows(spark, d):
    """Windows that cross from series to series: the units of a kind one after the other."""
    s = f.series(spark, d).withColumnRenamed("event_type", "grp").withColumn("run_id", F.col("user_id"))
    return windows.count_windows(s, ["grp"], ["run_id", "ts", "event_id"], 30, 15, [F.round(F.median("value"), 6).alias("value"), F.countDistinct("run_id").alias("n_runs")], long_units=True)


def tail_label_units(spark, d):
    s = windows.with_position(f.series(spark, d).select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).withColumn("cycle", F.col("seq") + 1)
    return windows.tail_label(s, ["user_id"], "cycle").groupBy("user_id").agg(F.sum("label").cast("long").alias("n_tail"), F.count("*").alias("n"))


def signal_features(spark, d):
    """RMS, corrected kurtosis and peak-to-peak of tumbling windows over every component of the vectors."""
    aggs = [F.round(x, 6).alias(n) for n, x in (("rms", features.rms("x")), ("kurt", features.kurtosis_unbiased("x")), ("pp", features.peak_to_peak("x")))]
    return windows.count_windows(f.channels_long(spark, d), ["label", "channel"], ["vec_id"], 16, 16, aggs, long_units=True)


def progress_segments(spark, d):
    w = f.series_windows(spark, d).select("user_id", "win")
    return windows.segments(w, ["user_id"], "win").groupBy("segment").agg(F.count("*").alias("n"))


def time_split_guard(spark, d):
    w = f.series_windows(spark, d).select("user_id", "win")
    return windows.guard_split(w, "win", 3, 1).groupBy("part").agg(F.count("*").alias("n"), F.max("win").alias("last"))


# ------------------------------------------------------------ transactions


def dictionary(spark, d):
    return transactions.dictionary(f.row_weights(spark, d))


def encode_ids(spark, d):
    t = f.row_weights(spark, d).withColumn("txn_id", text.pattern_text(F.col("items")))
    coded = transactions.encode(t, cut(transactions.dictionary(t), "words"))
    return coded.select(F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("ids"), "weight")


def txn_text_roundtrip(spark, d):
    """Write transactions as lines of ids, read them back, count them."""
    from patternlake.sources import readers, writers

    t = f.baskets(spark, d).withColumn("txn_id", text.pattern_text(F.col("items")))
    coded = transactions.encode(t, cut(transactions.dictionary(t), "words"))
    path = shared_path(spark, "txns")
    writers.transactions_text(coded.withColumn("__k", F.explode(F.sequence(F.lit(1), "weight"))), path)
    back = readers.transactions_text(spark, path)
    return back.groupBy(F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("line")).agg(F.count("*").alias("n"))


def txn_profile(spark, d):
    t = f.baskets(spark, d)
    return transactions.profile(t.withColumn("__k", F.explode(F.sequence(F.lit(1), "weight"))))


def reduce_infrequent(spark, d):
    t = cut(f.row_weights(spark, d), "rows")
    out = transactions.reduce(t, _least(t, 0.3), weight="weight")
    return out.groupBy(text.pattern_text(F.col("items")).alias("pattern")).agg(F.sum("weight").alias("weight"))


def reduction_rates(spark, d):
    t = cut(f.baskets(spark, d), "rows")
    return transactions.reduction(t, _least(t, 0.15))


def replicate_invariance(spark, d):
    t = cut(f.row_weights(spark, d), "rows")
    four = transactions.replicate(t, 4).groupBy("items").agg(F.sum("weight").alias("weight"))
    return _named(itemsets.mine(four, 4 * _least(t, SHARE)), "support")


# ------------------------------------------------------------------ mining


def item_support(spark, d):
    return transactions.item_support(f.row_weights(spark, d), weight="weight")


def _mined(frame, share, kind, strategy="powerset"):
    def query(spark, d):
        t = cut(frame(spark, d), "rows")
        return _named(itemsets.mine(t, _least(t, share), kind, strategy), "support")

    return query


def maximal_topn(spark, d):
    t = cut(f.row_weights(spark, d), "rows")
    return _named(itemsets.largest(itemsets.mine(t, _least(t, SHARE)), 10), "support")


def _pairs(t):
    """Pairs of flags and taxes, some of which never stand together."""
    flags = t.select(F.explode("items").alias("i")).where(F.col("i").startswith("flag=") | F.col("i").startswith("l_tax=")).distinct()
    return flags.alias("a").join(flags.alias("b"), F.col("a.i") < F.col("b.i")).select(F.array("a.i", "b.i").alias("items"))


def support_of_sets(spark, d):
    """Supports of given sets, also of some that are not frequent."""
    t = cut(f.row_weights(spark, d), "rows")
    return _named(itemsets.count_sets(t, _pairs(t)), "support")


def support_by_trie(spark, d):
    """The same by a trie that each task walks once."""
    t = cut(f.row_weights(spark, d), "rows")
    return _named(counting.count_by_trie(t, _pairs(t)), "support")


def support_by_index(spark, d):
    """The same from a written bitmap index, without the transactions."""
    t = cut(f.row_weights(spark, d), "rows")
    return _named(counting.BitmapIndex.build(t).supports(_pairs(t)), "support")


def basket_index(spark, d):
    """Supports of all frequent sets of part types from the bitmap index of the baskets."""
    t = cut(f.baskets(spark, d), "rows")
    return _named(counting.BitmapIndex.build(t).supports(itemsets.mine(t, _least(t, BASKET_SHARE), "frequent")), "support")


def support_hot(spark, d):
    """Supports of all frequent sets, with the subsets of the six most frequent items looked up."""
    t = cut(f.row_weights(spark, d), "rows")
    every = itemsets.mine(t, _least(t, SHARE), "frequent")
    return _named(counting.count_with_hot(t, every, counting.hot_items(t, 6)), "support")


def closure_check(spark, d):
    t = cut(f.row_weights(spark, d), "rows")
    every = cut(itemsets.mine(t, _least(t, SHARE), "frequent"), "frequent")
    missing = evaluation.closure_violations(every).agg(F.count("*").alias("missing"))
    return every.agg(F.count("*").alias("n_frequent"), F.sum("support").alias("sum_support"), F.max(F.size("items")).alias("longest")).crossJoin(missing)


def planted_recall(spark, d):
    """Sets planted into the orders in shares around the threshold: how many orders have each, and whether mining finds it."""
    t = cut(transactions.plant(f.basket_rows(spark, d), "l_orderkey", PLANTED).groupBy("items").agg(F.count("*").alias("weight")), "rows")
    want = spark.range(len(PLANTED)).select(F.col("id").cast("int").alias("p"), F.array(*[F.format_string(f"plant=%d.{k}", "id") for k in range(3)]).alias("want"))
    sets = cut(itemsets.mine(t, _least(t, BASKET_SHARE), "maximal", "fpmax"), "sets")
    support = itemsets.count_sets(t, want.select(F.col("want").alias("items"))).select(F.col("items").alias("want"), "support")
    found = itemsets.contained(want.select(F.col("want").alias("items")), sets).select("want").distinct().withColumn("hit", F.lit(True))
    return want.join(support, "want").join(found, "want", "left").select("p", "support", F.coalesce("hit", F.lit(False)).alias("found"))


def random_control(spark, d):
    """Eight sets of two to four items, drawn by a seeded generator from all items, with their true counts."""
    from patternlake.operators import evidence

    t = cut(f.labelled(spark, d), "labelled")
    sets = cut(evidence.random_sets(t.select(F.explode("items").alias("item")), 42), "sets")
    table = scoring.contingency(sets.select("items"), t).withColumns({"sup_anom": scoring.sup_anom(), "lift": scoring.lift_ratio()})
    return _named(sets.join(table, "items"), "draw", "pos", "cnt", "npos", "n", "sup_anom", "lift")


def seeded_cases(spark, d):
    """33 normal and 33 anomalous cases of each group, exactly those that a seeded generator draws from the sorted keys."""
    from patternlake.operators import evidence

    one = f.calls(spark, d).where("model = 'm0' and cond = 'lib'").select("grp", "truth", "case_key")
    return evidence.draw_cases(one, 33, 42).select("pick", "grp", "truth", "case_key")


def sensor_maximal(spark, d):
    """Maximal sets of the multichannel windows."""
    t = cut(f.sensor_windows(spark, d).groupBy("items").agg(F.count("*").alias("weight")), "windows")
    return _named(itemsets.mine(t, _least(t, 0.1), "maximal", "powerset"), "support")


def sensor_maximal_vertical(spark, d):
    t = cut(f.sensor_windows(spark, d).groupBy("items").agg(F.count("*").alias("weight")), "windows")
    return _named(itemsets.mine(t, _least(t, 0.1), "maximal", "vertical"), "support")


def candidate_join(spark, d):
    """Candidates of three items, from the frequent pairs, before anything is counted."""
    t = cut(f.row_weights(spark, d), "rows")
    pairs = itemsets.mine(t, _least(t, SHARE), "frequent").where(F.size("items") == 2)
    return _named(itemsets.candidates(cut(pairs.select("items"), "pairs")))


def levelwise_resumed(spark, d):
    """Levels one and two from a written checkpoint, the others mined on from there."""
    t = cut(f.row_weights(spark, d), "rows")
    least = _least(t, SHARE)
    done = cut(itemsets.mine(t, least, "frequent").where(F.size("items") <= 2), "levels")
    return _named(itemsets.frequent_levelwise(t, least, resume=done), "support")


def result_fingerprint(spark, d):
    """MD5 of the sorted list of maximal sets with their supports; the list is a result, so it is short."""
    t = cut(f.row_weights(spark, d), "rows")
    lines = itemsets.mine(t, _least(t, SHARE)).select(F.concat(text.pattern_text(F.col("items")), F.lit(":"), F.col("support").cast("string")).alias("line"), text.pattern_text(F.col("items")).alias("pattern"))
    sets = F.sort_array(F.collect_list(F.struct("pattern", "line")))
    return lines.agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(sets, lambda x: x["line"]), "\n")).alias("md5"))


# ----------------------------------------------------------------- anytime


def stage_thresholds(spark, d):
    return anytime.stages(f.row_weights(spark, d))


def _pools(spark, d):
    t = cut(f.row_weights(spark, d), "rows")
    return cut(anytime.pools(t, STAGES), "pools")


def stage_pools(spark, d):
    return _named(_pools(spark, d), "stage", "support")


def anytime_border(spark, d):
    """The first four stages, each of which goes on from the sets that the stages before have counted."""
    t = cut(f.row_weights(spark, d), "rows")
    out = None
    for k, sets in anytime.run(t, 4, "border"):
        one = _named(sets.withColumn("stage", F.lit(k)), "stage", "support")
        out = one if out is None else out.unionByName(one)
    return out


def incremental_baskets(spark, d):
    """Frequent sets of part types, kept up to date over five batches of orders."""
    rows = cut(f.basket_rows(spark, d), "rows")
    state = incremental.Incremental(spark, shared_path(spark, "incremental"), BASKET_SHARE)
    for k in range(5):
        state.apply(rows.where(F.col("l_orderkey") % 5 == k).select("items"), k)
    return _named(state.frequent(), "support")


def first_stage(spark, d):
    return _named(anytime.first_seen(_pools(spark, d)), "stage", "support")


def cumulative_pool(spark, d):
    return anytime.cumulative(_pools(spark, d))


def _labelled(spark, d, share=SHARE):
    t = cut(f.labelled(spark, d), "labelled")
    w = t.groupBy("items").agg(F.sum("weight").alias("weight"))
    every = cut(itemsets.mine(w, _least(w, share), "maximal", "powerset"), "sets")
    return t, every


def _table(spark, d, share=SHARE):
    t, sets = _labelled(spark, d, share)
    return scoring.contingency(sets, t)


def _truth(spark, d):
    """Pools of the unlabelled stages and, as truth, the sets of at least two items in the deepest."""
    pool = _pools(spark, d)
    return pool, pool.where((F.col("stage") == STAGES) & (F.size("items") >= 2)).select("items")


def coverage_curve(spark, d):
    return anytime.coverage(*_truth(spark, d))


def prefix_coverage(spark, d):
    """Truth found by a prefix of the last pool, by support."""
    pool, truth = _truth(spark, d)
    last = pool.where(F.col("stage") == STAGES).select("items", "support")
    cuts = windows.prefixes(last, [F.desc("support"), F.col("items")], [0.1, 0.25, 0.5, 1.0])
    hit = cuts.join(truth.withColumn("hit", F.lit(1)), "items", "left")
    out = hit.groupBy("fraction").agg(F.count("*").alias("found"), F.count("hit").alias("truth_found"))
    return out.crossJoin(truth.agg(F.count("*").alias("n_truth"))).withColumn("coverage", F.try_divide("truth_found", "n_truth"))


def identity_gate(spark, d):
    """Each stage mined on its own against the pools that are cut from one run."""
    t = cut(f.row_weights(spark, d), "rows")
    own = None
    for k, sets in anytime.run(t, 4, "vertical"):
        one = sets.withColumn("stage", F.lit(k))
        own = one if own is None else own.unionByName(one)
    return anytime.identity(own, _pools(spark, d).where("stage <= 4"), ["stage"])


# ----------------------------------------------------------------- scoring


def contingency(spark, d):
    return _named(_table(spark, d), "pos", "cnt", "npos", "n")


def _lift(expr):
    def query(spark, d):
        return _named(_table(spark, d).withColumn("lift", expr()), "lift")

    return query


def truth_patterns(spark, d):
    return _named(scoring.truth(_table(spark, d), 20, 0.3), "pos", "cnt")


def truth_top(spark, d):
    """The truth patterns with the most positives."""
    best = scoring.top(scoring.truth(_table(spark, d), 20, 0.3), 10, [F.desc("pos"), "items"])
    return _named(best, "rank", "pos", "cnt")


def minsup_library(spark, d):
    """A library from all frequent sets of two items or more, by rate lift."""
    t = cut(f.labelled(spark, d), "labelled")
    w = cut(t.groupBy("items").agg(F.sum("weight").alias("weight")), "weights")
    sets = itemsets.mine(w, _least(w, SHARE), "frequent").where(F.size("items") >= 2)
    table = scoring.contingency(cut(sets, "sets"), t).withColumn("lift", scoring.lift_rate())
    return _named(scoring.top(table, 8, [F.desc("lift"), F.desc("pos"), "items"]), "rank", "pos", "cnt", "lift")


def class_support_pivot(spark, d):
    t, sets = _labelled(spark, d, 0.1)
    out = scoring.class_support(sets, t, ["A", "N", "R"])
    return _named(out, "sup_A", "sup_N", "sup_R")


def class_topk(spark, d):
    """The two best patterns of each class: enough of its transactions, then by rate lift, then by positives."""
    t, sets = _labelled(spark, d, 0.1)
    out = None
    for c in ("A", "N", "R"):
        one = scoring.contingency(sets, t.withColumn("label", (F.col("cls") == c).cast("int"))).withColumn("cls", F.lit(c))
        out = one if out is None else out.unionByName(one)
    good = out.where(F.col("pos") >= F.greatest(F.lit(2), F.ceil(F.col("npos") * 0.1))).withColumn("lift", scoring.lift_rate())
    return _named(scoring.top(good, 2, [F.desc("lift"), F.desc("pos"), "items"], ["cls"]), "cls", "rank", "pos", "lift")


def discriminative_topk(spark, d):
    t = _table(spark, d).withColumns({"lift": scoring.lift_ratio(), "sup_anom": scoring.sup_anom()}).where("lift >= 1.0 and sup_anom >= 0.05")
    return _named(scoring.top(t, 5, [F.desc("lift"), F.desc("sup_anom"), "items"]), "rank", "lift", "sup_anom")


def library_top8(spark, d):
    return _named(scoring.library(_table(spark, d), 8, 0.05, 0.9), "rank", "pos", "cnt", "sup_anom", "sup_norm", "lift")


def library_grid(spark, d):
    return _named(scoring.library_grid(_table(spark, d), [0.9, 1.0, 1.05], [0.02, 0.05, 0.1]), "min_lift", "min_sup", "rank", "sup_anom", "lift")


def union_coverage(spark, d):
    t, sets = _labelled(spark, d)
    best = scoring.library(scoring.contingency(sets, t), 5, 0.0, 0.0)
    return scoring.flag_rates(best, t).select("n_anom", "flagged_anom", "coverage")


def window_flagging(spark, d):
    """Windows of the series that hold one of the best patterns of their anomalous windows."""
    t = cut(f.series_windows(spark, d).groupBy("items", "label").agg(F.count("*").alias("weight")), "windows")
    w = cut(t.groupBy("items").agg(F.sum("weight").alias("weight")), "weights")
    table = scoring.contingency(itemsets.mine(w, _least(w, SHARE), "frequent", "powerset"), t)
    return scoring.flag_rates(scoring.library(table, 2, 0.0, 0.0), t)


# -------------------------------------------------------------- evaluation


def _facts(spark, d):
    return evaluation.facts(f.calls(spark, d), f.library(spark))


def reply_parse(spark, d):
    return _facts(spark, d).select("model", "cond", "case_key", "parsed", "pred", "correct", "n_cited", "n_valid")


def accuracy_by_condition(spark, d):
    return evaluation.accuracy(_facts(spark, d), ["model", "cond"]).select("model", "cond", "n", "k", "accuracy", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def accuracy_parsed_only(spark, d):
    rows = evaluation.facts(f.calls(spark, d), f.library(spark), unparsed="drop")
    return evaluation.accuracy(rows, ["model", "cond", "grp"]).select("model", "cond", "grp", "n", "k", "accuracy")


def faithfulness(spark, d):
    return evaluation.faithfulness(_facts(spark, d).where("cond = 'lib'"), ["model"])


def hallucination_rate(spark, d):
    return evaluation.hallucination(_facts(spark, d), ["model"], F.col("cond") == "nolib")


def fpr_cells(spark, d):
    return evaluation.false_positives(_facts(spark, d), ["model", "cond", "grp"])


def macro_cells(spark, d):
    cells = evaluation.accuracy(_facts(spark, d), ["model", "cond", "grp"])
    return evaluation.macro(cells, "accuracy", ["model", "cond"]).select("model", "cond", "cells", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def mcnemar_chi2(spark, d):
    return evaluation.paired(_facts(spark, d), "nolib", "lib", ["model"])


def mcnemar_exact(spark, d):
    return mcnemar_chi2(spark, d).select("model", "b", "c", F.round(stats.mcnemar_exact_p(F.col("b"), F.col("c")), 9).alias("p"), F.round(stats.chi2_p(F.col("chi2")), 9).alias("p_chi2"), stats.direction(F.col("b"), F.col("c")).alias("direction"))


def holm_adjust(spark, d):
    """Step-down adjustment of p-values that are made from counts (a hundredth for each discordant pair against)."""
    p = mcnemar_chi2(spark, d).select("model", ((F.col("c") % 7 + 1) / 100.0).alias("p"))
    return stats.holm(p, "p", key=["model"])


def budget_curve(spark, d):
    return evaluation.budget_curve(_facts(spark, d), ["model"]).select("model", "budget", "n", "k", "accuracy", "gain")


def budget_contrasts(spark, d):
    """Paired tests of neighbouring budgets, and of the largest against none."""
    return evaluation.budget_contrasts(_facts(spark, d), [(0, 1), (1, 2), (2, 3), (0, 3)], ["model"])


def budget_peak(spark, d):
    """Paired test of each model's best budget against none."""
    return evaluation.peak_contrast(_facts(spark, d), ["model"])


def class_spec_join(spark, d):
    """Rows mapped to classes by a specification table: orders by their customer's region."""
    spec = f.table(spark, d, "nation").join(f.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("cls"))
    owner = f.table(spark, d, "customer").join(spec, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "cls")
    return f.table(spark, d, "orders").join(owner, F.col("o_custkey") == F.col("c_custkey")).groupBy("cls").agg(F.count("*").alias("n"))


def resume_keys(spark, d):
    """Calls that an interrupted log still lacks: those that ended in an error."""
    from patternlake.operators import evidence

    log = f.calls(spark, d)
    done = log.where(~text.is_error(F.col("reply")))
    return evidence.resume(log, done, ["model", "cond", "case_key"]).select("model", "cond", "case_key")


def citation_membership(spark, d):
    """How often each cited pattern is cited, and whether the library has it."""
    cited = f.calls(spark, d).where(~text.is_error(F.col("reply"))).select(F.explode(text.parse_reply(F.col("reply"))["cited_patterns"]).alias("pattern")).withColumn("pattern", F.trim("pattern"))
    known = f.library(spark).withColumn("known", F.lit(True))
    return cited.groupBy("pattern").agg(F.count("*").alias("n")).join(known, "pattern", "left").select("pattern", "n", F.coalesce("known", F.lit(False)).alias("known"))


def prompt_render(spark, d):
    w = f.series_windows(spark, d)
    lib = F.array(F.struct(F.lit("value=2").alias("pattern"), F.lit(0.25).alias("sup_anom"), F.lit(2.5).alias("lift")), F.struct(F.lit("k=1").alias("pattern"), F.lit(0.125).alias("sup_anom"), F.lit(float("inf")).alias("lift")))
    return w.select("user_id", "win", F.md5(text.render_prompt(F.lit("Pump diagnosis."), F.col("items"), lib)).alias("prompt_md5"))


# ------------------------------------------------------------------- bench


def _runs(spark, d):
    return f.table(spark, d, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("engine"), F.col("o_totalprice").alias("secs"))


def median_iqr(spark, d):
    s = evaluation.run_summary(_runs(spark, d), ["dataset", "engine"], "secs")
    return s.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


def speedup_pivot(spark, d):
    s = evaluation.speedup(evaluation.run_summary(_runs(spark, d), ["dataset", "engine"], "secs"), ["dataset"], "engine", "F", "O")
    return s.select("dataset", *[F.round(c, 6).alias(c) for c in ("base_median", "other_median", "speedup")])


# ---------------------------------------------------------------- stateful


def _online(mode):
    def query(spark, d):
        return online.online_states(f.series(spark, d), "user_id", ["ts", "event_id"], f.SERIES_CHANNELS, 20, 10, mode=mode)

    return query


def online_vs_offline(spark, d):
    """Share of windows, by fifth of each series, whose online state is the offline one."""
    s = f.series(spark, d)
    on = _online("textbook")(spark, d).withColumnRenamed("value", "state").select("user_id", "win", "state")
    medians = windows.count_windows(s, ["user_id"], ["ts", "event_id"], 20, 10, [F.median("value").alias("value")])
    off = with_states(medians, fit_edges(s, ["value"]), ["value"]).withColumnRenamed("value", "state")
    return evaluation.agreement(windows.segments(off, ["user_id"], "win"), on, ["user_id", "win"], "state", ["segment"])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """From rows to scored patterns: edges, states, distinct transactions, maximal sets, counts and lift against the label, in order."""
    return _named(_table(spark, d).withColumn("lift", scoring.lift_pos()), "pos", "cnt", "npos", "n", "lift").orderBy(F.desc("lift"), F.desc("pos"), "pattern")


def queries() -> dict:
    rows, bask = f.row_weights, f.baskets
    plain = [
        edges_quantile, edges_equal_width, bin_histogram, items_rowwise, channel_select_variance, empty_bins,
        windows_label_max, raw_concat_windows, tail_label_units, signal_features, progress_segments, time_split_guard,
        dictionary, encode_ids, txn_text_roundtrip, txn_profile, reduce_infrequent, reduction_rates, replicate_invariance,
        item_support, maximal_topn, support_of_sets, support_by_trie, support_by_index, basket_index, support_hot, sensor_maximal, sensor_maximal_vertical, closure_check, planted_recall, random_control, seeded_cases, candidate_join, levelwise_resumed, result_fingerprint,
        stage_thresholds, stage_pools, anytime_border, incremental_baskets, first_stage, cumulative_pool, coverage_curve, prefix_coverage, identity_gate,
        contingency, truth_patterns, truth_top, minsup_library, class_support_pivot, class_topk, discriminative_topk, library_top8, library_grid, union_coverage, window_flagging,
        reply_parse, accuracy_by_condition, accuracy_parsed_only, faithfulness, hallucination_rate, fpr_cells, macro_cells, mcnemar_chi2, mcnemar_exact, holm_adjust, budget_curve, budget_contrasts, budget_peak, class_spec_join, resume_keys, citation_membership, prompt_render,
        median_iqr, speedup_pivot, online_vs_offline, flagship,
    ]
    made = {
        "count_windows_median": _medians(20, 10), "windows_w15": _medians(15, 7), "windows_w30": _medians(30, 15), "windows_w60": _medians(60, 30),
        "frequent_itemsets": _mined(rows, SHARE, "frequent"), "frequent_levelwise": _mined(rows, SHARE, "frequent", "levelwise"), "frequent_fpgrowth": _mined(rows, SHARE, "frequent", "fpgrowth"),
        "closed_itemsets": _mined(rows, SHARE, "closed"), "maximal_itemsets": _mined(rows, SHARE, "maximal"), "maximal_vertical": _mined(rows, SHARE, "maximal", "vertical"), "maximal_partitioned": _mined(rows, SHARE, "maximal", "partitioned"), "maximal_fpmax": _mined(rows, SHARE, "maximal", "fpmax"),
        "basket_levelwise": _mined(bask, BASKET_SHARE, "frequent", "levelwise"), "basket_fpmax": _mined(bask, BASKET_SHARE, "maximal", "fpmax"), "basket_vertical": _mined(bask, BASKET_SHARE, "maximal", "vertical"),
        "basket_frequent": _mined(bask, BASKET_SHARE, "frequent"), "basket_maximal": _mined(bask, BASKET_SHARE, "maximal"),
        "lift_eps": _lift(scoring.lift_eps), "lift_table": _lift(scoring.lift_table), "lift_pos": _lift(scoring.lift_pos), "lift_rate": _lift(scoring.lift_rate), "lift_ratio": _lift(scoring.lift_ratio),
        "online_states": _online("textbook"), "online_states_shifted": _online("shifted"),
    }
    return {q.__name__: q for q in plain} | made | roundtrips.queries()
