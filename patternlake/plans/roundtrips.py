"""Queries over files: tables are written in each format, read back by its reader, and counted."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from patternlake.functions import text
from patternlake.operators import anytime, evaluation, itemsets, scoring, transactions
from patternlake.plans import frames as f
from patternlake.session import cut, shared_path
from patternlake.sources import readers, signals, writers
from patternlake.sources.log import AppendLog

#: Items of the rows as numbers: small sets for result files.
SHARE = 0.05


def _coded_sets(spark, d):
    """(items as ids, support) of the maximal row sets, the dictionary, and the number of rows."""
    t = cut(f.row_weights(spark, d), "rows")
    total = t.agg(F.sum("weight")).first()[0]
    words = cut(transactions.dictionary(t), "words")
    sets = itemsets.mine(t, transactions.min_count(total, SHARE)).withColumn("txn_id", text.pattern_text(F.col("items")))
    return cut(transactions.encode(sets, words).select("items", "support"), "coded"), words, total


def sensor_files(spark, d):
    """Semicolon files in a folder for each kind, read as runs."""
    path = shared_path(spark, "runs")
    rows = f.series(spark, d).select("ts", "event_id", "value", "label", F.col("event_type").alias("kind"))
    rows.withColumn("ts", F.col("ts").cast("string")).repartition("kind").write.partitionBy("kind").option("sep", ";").csv(path, header=True)
    runs = readers.sensor_csv(spark, path, "ts timestamp, event_id long, value double, anomaly int", "event_id", label="anomaly", drop=["ts"])
    return runs.groupBy(F.regexp_extract("grp", "=(.*)$", 1).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"), F.max("seq").alias("last_seq"), F.round(F.sum("value"), 4).alias("value"), F.sum("label").alias("positives"))


def sensor_runs(spark, d):
    """Several files of 500 ids to a kind, named by number: names sort as strings, and the rows of a kind's files stand one after the other."""
    path = shared_path(spark, "runs")
    rows = f.series(spark, d).select(F.col("event_type").alias("kind"), F.expr("event_id div 500").alias("run"), "event_id", "value")
    rows.groupBy("kind", "run").applyInPandas(partial(_csv_file, path), "run long").write.format("noop").mode("overwrite").save()
    runs = readers.sensor_csv(spark, path, "event_id long, value double", "event_id")
    places = readers.raw_concat(runs).groupBy("grp").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.sum(F.col("seq") * (F.col("event_id") % 97)).alias("places"))
    files = runs.groupBy("grp").agg(F.countDistinct("run_id").alias("runs"))
    return places.join(files, "grp").select(F.col("grp").alias("kind"), "n", "last_seq", "runs", "places")


def _csv_file(path: str, rows):
    """One file of a run, written whole under its name, however often the task runs."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    folder = f"{base}/{rows['kind'].iloc[0]}"
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/{rows['run'].iloc[0]}.csv") as out:
        out.write(rows.sort_values("event_id")[["event_id", "value"]].to_csv(index=False, sep=";").encode())
    return rows[["run"]].head(1)


def turbofan_text(spark, d):
    """Lines of numbers with uneven spaces and no header."""
    path = shared_path(spark, "turbofan")
    line = F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit("  "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_totalprice").cast("string"), F.lit(" \t"), F.length("o_orderstatus").cast("string"), F.lit(" "))
    f.table(spark, d, "orders").select(line.alias("value")).write.text(path)
    back = readers.turbofan(spark, path, settings=1, sensors=2)
    return back.groupBy((F.col("unit") % 20).alias("bucket")).agg(F.count("*").alias("n"), F.sum("cycle").alias("cycles"), F.round(F.sum("op1"), 2).alias("op1"), F.sum("s1").alias("s1"), F.count("s2").alias("s2"))


def labelled_csv(spark, d):
    """Rows that are transactions by themselves."""
    path = shared_path(spark, "rows")
    f.table(spark, d, "lineitem").select(*f.ROW_CHANNELS, "l_returnflag").write.csv(path, header=True)
    back = readers.labelled_rows(spark, path, "quantity double, price double, discount double, tax double, failure string", "failure")
    return back.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"), F.round(F.sum("price"), 2).alias("price"), F.round(F.sum("tax"), 4).alias("tax"))


def telemetry_gz(spark, d):
    """Compressed files with channels that are not known before: numbers but for times and labels of attacks, and the first rows by order."""
    path = shared_path(spark, "telemetry")
    rows = f.series(spark, d).select("event_id", F.col("ts").cast("string").alias("time"), "value", "k", F.col("label").alias("attack"), F.lit("x").alias("note"))
    rows.write.option("compression", "gzip").csv(path, header=True)
    back, channels = readers.telemetry(spark, path, "event_id", rows=1000)
    sums = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("x")) for c in channels])).alias("c")
    return back.select("seq", sums).groupBy("c.channel").agg(F.count("c.x").alias("n"), F.round(F.sum("c.x"), 4).alias("total"), F.max("seq").alias("last_seq"))


def signal_arrays(spark, d):
    """Binary arrays of one file for each label; a damaged file gives no rows."""
    path = shared_path(spark, "signals")
    sums = f.table(spark, d, "embeddings").where("label is not null").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", F.col("embedding")[0].cast("double").alias("x")))).alias("s"))
    lines = sums.select("label", F.array_join(F.transform("s", lambda s: F.format_number(s["x"], 6)), ",").alias("value"))
    lines.repartition("label").write.partitionBy("label").text(path)

    def decode(content: bytes) -> dict:
        import numpy as np

        return {"X_DE_time": np.array([float(x) for x in content.decode().strip().split(",")])}

    got = readers.signals(spark, f"{path}/*", decode=decode)
    return got.select("channel", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def signal_source(spark, d):
    """All components of the vectors as channels of real MAT and NPZ files, each of up to 500 vectors of a label, read back through the data source; and one damaged file of each form."""
    path = shared_path(spark, "signals")
    rows = f.channels_long(spark, d).select(F.concat_ws("_", "label", F.expr("vec_id div 500")).alias("file"), F.format_string("X%02d_DE_time", "channel").alias("channel"), F.col("vec_id").alias("k"), "x")
    rows = cut(rows, "channels")
    for form in signals.FORMS:
        signals.write_signals(rows, f"{path}/{form}", form)
        spark.createDataFrame([(b"damaged",)], "x binary").foreach(partial(_spoil, f"{path}/{form}/damaged.{form}"))
    got = signals.signals(spark, path).withColumn("form", F.element_at(F.split("file", r"\."), -1))
    each = got.select("form", F.coalesce("channel", F.lit("damaged")).alias("channel"), F.explode_outer("samples").alias("x"))
    return each.groupBy("form", "channel").agg(F.count("x").alias("n"), F.round(F.sum("x"), 3).alias("total"))


def _spoil(path: str, row) -> None:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_output_stream(name) as out:
        out.write(row["x"])


def txn_lines(spark, d):
    """Blank lines, repeated and unordered ids, and ids counted from one: kept, dropped and shifted."""
    path = shared_path(spark, "lines")
    size = F.col("l_linenumber") % 3
    line = F.when(size == 0, "").when(size == 1, F.concat_ws(" ", "l_linenumber", (F.col("l_suppkey") % 5).cast("string"), "l_linenumber")).otherwise(F.concat(F.lit("  7 "), (F.col("l_partkey") % 4).cast("string"), F.lit(" ")))
    f.table(spark, d, "lineitem").select(line.alias("value")).write.text(path)
    kinds = {"kept": {}, "dropped": {"keep_empty": False}, "shifted": {"shift": -1}}
    out = None
    for name, how in kinds.items():
        one = readers.transactions_text(spark, path, **how).select(F.lit(name).alias("mode"), F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("line"))
        out = one if out is None else out.union(one)
    return out.groupBy("mode", "line").agg(F.count("*").alias("n"))


def dictionary_file(spark, d):
    """An item dictionary as one JSON object, and labels as a JSON array."""
    path, words = shared_path(spark, "dictionary"), transactions.dictionary(f.row_weights(spark, d))
    writers.dictionary_json(words, path)
    return readers.dictionary_json(spark, path)


def labels_file(spark, d):
    path = shared_path(spark, "labels")
    rows = f.table(spark, d, "region").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"])).alias("value"))
    rows.write.text(path)
    return readers.labels_json(spark, path).select("position", "label")


def txn_labels(spark, d):
    """Labels by transaction."""
    path = shared_path(spark, "labels")
    t = f.table(spark, d, "labels").select(F.col("doc_id").alias("txn_id"), F.col("toxic").alias("label"))
    writers.labels(t, path)
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.sum("txn_id").alias("ids"))


def patterns_file(spark, d):
    """A pattern library as CSV, read as numbers."""
    from patternlake.plans.catalog import library_top8

    path = shared_path(spark, "patterns")
    writers.patterns_csv(library_top8(spark, d).select("pattern", "sup_anom", "lift"), path)
    return readers.library_csv(spark, path)


def summary_file(spark, d):
    path = shared_path(spark, "summary")
    writers.summary_json(f.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), path)
    return spark.read.schema("o_orderstatus string, n long").json(path)


def results_file(spark, d):
    """Result lines under a header, parsed again and decoded by the dictionary."""
    sets, words, total = _coded_sets(spark, d)
    path = shared_path(spark, "results")
    writers.results_text(sets, total, path, {"transactions": total, "items": words.count()})
    lines = spark.read.text(path)
    back = transactions.decode(readers.results_text(lines), words)
    return back.select(text.pattern_text(F.col("items")).alias("pattern"), "support")


def results_header(spark, d):
    """The header of a result file as keys and values."""
    sets, words, total = _coded_sets(spark, d)
    path = shared_path(spark, "results")
    writers.results_text(sets, total, path, {"transactions": total, "items": words.count(), "sets": sets.count()})
    return readers.results_header(spark.read.text(path))


def decoded_file(spark, d):
    """Sets with their items' names as lines."""
    sets, words, _ = _coded_sets(spark, d)
    path = shared_path(spark, "decoded")
    writers.sets_decoded(sets, words, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def stage_file(spark, d):
    """Pools of several stages in one file, each under its header."""
    t = cut(f.row_weights(spark, d), "rows")
    words = cut(transactions.dictionary(t), "words")
    pool = anytime.pools(t, 4).withColumn("txn_id", F.concat_ws("|", "stage", text.pattern_text(F.col("items"))))
    coded = cut(transactions.encode(pool, words).select("stage", "items", "support"), "coded")
    path = shared_path(spark, "stages")
    writers.stage_results_text(coded, t.agg(F.sum("weight")).first()[0], path)
    back = readers.stage_results_text(readers.numbered_lines(spark, path))
    return back.select("stage", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("ids"), "support")


def sets_files(spark, d):
    """The two short forms of a list of sets."""
    sets, _, total = _coded_sets(spark, d)
    a, b = shared_path(spark, "semicolon"), shared_path(spark, "ratio")
    writers.sets_semicolon(sets, a)
    writers.sets_ratio(sets, total, b)
    ratio = F.round(F.regexp_extract("value", r"\(([^)]*)\)", 1).cast("double") * 1e9) / 1e9
    return spark.read.text(a).select(F.lit("semicolon").alias("form"), F.col("value").alias("line")).union(spark.read.text(b).select(F.lit("ratio"), F.concat_ws(" ", F.regexp_extract("value", r"^([^(]*) \(", 1), text.fixed(ratio, 6))))


def append_log(spark, d):
    """Calls are appended to a log once, however often they come."""
    path, calls = shared_path(spark, "log"), f.calls(spark, d)
    counts = [writers.append_new(calls.where(cond), path, ["model", "cond", "case_key"]) for cond in ("model = 'm0'", "model in ('m0', 'm1')", "true", "true")]
    back = spark.read.json(path)
    return back.groupBy("model", "cond").agg(F.count("*").alias("n")).crossJoin(spark.createDataFrame([(sum(counts),)], "appended long"))


def append_log_commits(spark, d):
    """The same through the log with commits, whose readers see whole appends only."""
    log, calls = AppendLog(spark, shared_path(spark, "log"), ["model", "cond", "case_key"]), f.calls(spark, d)
    counts = [log.append(calls.where(cond)) for cond in ("model = 'm0'", "model in ('m0', 'm1')", "true", "true")]
    return log.read().groupBy("model", "cond").agg(F.count("*").alias("n")).crossJoin(spark.createDataFrame([(sum(counts),)], "appended long"))


def call_file(spark, d):
    """A log of calls in JSON lines with broken lines and errors in it."""
    path = shared_path(spark, "calls")
    lines = f.calls(spark, d).select(F.to_json(F.struct("model", "cond", F.col("case_key").cast("string").alias("case_key"), "grp", "truth", "reply")).alias("value"), "case_key")
    lines.select(F.when(F.col("case_key") % 10 == 3, F.substring("value", 1, 20)).otherwise(F.col("value")).alias("value")).write.text(path)
    return readers.call_log(spark, path).groupBy("model", "cond").agg(F.count("*").alias("n"))


def file_checksums(spark, d):
    """Size, MD5 and SHA-256 of a file that was written."""
    path = shared_path(spark, "checks")
    f.table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("value")).coalesce(1).sortWithinPartitions("r_regionkey").select("value").write.text(path)
    return readers.checksums(spark, f"{path}/part-*").select("bytes", "md5", "sha256")


def run_logs(spark, d):
    """Phase times and match flags from run logs."""
    rows = f.table(spark, d, "orders").where("o_orderkey % 50 = 1").select(F.col("o_orderkey").cast("string").alias("file"), "o_totalprice", "o_orderstatus")
    lines = rows.select("file", F.explode(F.array(F.concat(F.lit("counting: "), F.col("o_totalprice").cast("string"), F.lit(" ms")), F.lit("  merge = 1.5 ms (of 3)"), F.lit("no time: soon"), F.when(F.col("o_orderstatus") == "F", "MATCH").otherwise("MISMATCH: 2"))).alias("value"))
    return readers.run_log(lines).groupBy("phase", "ok").agg(F.count("*").alias("n"), F.round(F.sum("ms"), 2).alias("ms"))


def validation_report(spark, d):
    """Sets of two strategies against each other, with the median time of runs: PASS or FAIL for each configuration."""
    t = cut(f.row_weights(spark, d), "rows")
    n = t.agg(F.sum("weight")).first()[0]
    both = [None, None]
    for share in (0.05, 0.2):
        for k, strategy in enumerate(("vertical", "powerset")):
            sets = itemsets.mine(t, transactions.min_count(n, share), "maximal", strategy).withColumn("config", F.lit(f"rows-{share}"))
            both[k] = sets if both[k] is None else both[k].unionByName(sets)
    broken = both[1].where(~((F.col("config") == "rows-0.2") & F.array_contains("items", "status=F")))
    times = f.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "rows-0.05").otherwise("rows-0.2").alias("config"), F.col("o_totalprice").alias("secs"))
    out = evaluation.validation(cut(both[0], "mine"), cut(broken, "gold"), times, ["config"])
    return out.select("config", "n_mine", "n_gold", "missing", "extra", F.round("median_s", 4).alias("median_s"), "verdict")


def queries() -> dict:
    made = [
        sensor_files, sensor_runs, turbofan_text, labelled_csv, telemetry_gz, signal_arrays, signal_source, txn_lines, dictionary_file, labels_file, txn_labels, patterns_file, summary_file, results_file, results_header, decoded_file,
        stage_file, sets_files, append_log, append_log_commits, call_file, file_checksums, run_logs, validation_report,
    ]
    return {q.__name__: q for q in made}
