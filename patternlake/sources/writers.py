"""Writers of transactions, patterns and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transactions_text(txns: DataFrame, path: str, items: str = "items") -> None:
    """A line of ascending distinct ids per transaction."""
    txns.select(F.array_join(F.transform(F.array_sort(F.array_distinct(items)), lambda x: x.cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def dictionary_json(words: DataFrame, path: str) -> None:
    """One JSON object {item: id}; as many entries as there are items."""
    words.coalesce(1).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", "item_id"))))).alias("value")).write.mode("overwrite").text(path)


def labels(txns: DataFrame, path: str) -> None:
    txns.select("txn_id", F.col("label").cast("string").alias("label")).write.mode("overwrite").parquet(path)


def patterns_csv(patterns: DataFrame, path: str) -> None:
    """Pattern rows; arrays become pattern strings."""
    flat = [F.array_join(c, " & ").alias(c) if t.startswith("array") else F.col(c) for c, t in patterns.dtypes]
    patterns.select(*flat).write.mode("overwrite").csv(path, header=True)


def summary_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def _result_lines(sets: DataFrame, total: int, by: list[str] | None = None) -> DataFrame:
    """(by, n, value): numbered result lines of each group, the most frequent first."""
    from patternlake.operators.windows import position

    ids = F.array_join(F.transform("items", lambda x: x.cast("string")), " ")
    numbered = position(sets.select(*(by or []), "items", "support", (-F.col("support")).alias("__s"), ids.alias("__ids")), [*(by or []), "__s", "items"], by)
    line = F.format_string("%dth: %d { %s } support: %s frequency: %d", F.col("seq") + 1, F.size("items"), F.col("__ids"), (F.col("support") / total).cast("string"), F.col("support"))
    return numbered.select(*(by or []), (F.col("seq") + 1).alias("n"), line.alias("value"))


def results_text(sets: DataFrame, total: int, path: str, header: dict | None = None) -> None:
    """Result lines, the most frequent first, under a ``header`` of "key: value" lines; the inverse of readers.results_text."""
    lines = _result_lines(sets, total)
    if header:
        top = sets.sparkSession.createDataFrame([(k - len(header), f"# {name}: {value}") for k, (name, value) in enumerate(header.items())], "n long, value string")
        lines = lines.select("n", "value").union(top)
    lines.repartitionByRange("n").sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def stage_results_text(pools: DataFrame, total: int, path: str) -> None:
    """A file for each stage of (stage, items, support): its header, then its result lines."""
    lines = _result_lines(pools, total, ["stage"])
    heads = pools.select("stage").distinct().select("stage", F.lit(0).cast("long").alias("n"), F.concat(F.lit("=== stage "), F.col("stage").cast("string"), F.lit(" ===")).alias("value"))
    both = lines.select("stage", "n", "value").union(heads).withColumn("file", F.col("stage"))
    both.repartition("file").sortWithinPartitions("file", "n").select("file", "value").write.mode("overwrite").partitionBy("file").text(path)


def sets_decoded(sets: DataFrame, words: DataFrame, path: str) -> None:
    """support<tab>items by name"""
    from patternlake.operators.transactions import decode

    decode(sets, words).select(F.concat_ws("\t", F.col("support").cast("string"), F.array_join("items", ", ")).alias("value")).write.mode("overwrite").text(path)


def sets_semicolon(sets: DataFrame, path: str) -> None:
    """length;support;items"""
    ids = F.array_join(F.transform("items", lambda x: x.cast("string")), " ")
    sets.select(F.concat_ws(";", F.size("items").cast("string"), F.col("support").cast("string"), ids).alias("value")).write.mode("overwrite").text(path)


def sets_ratio(sets: DataFrame, total: int, path: str) -> None:
    """items (share of transactions)"""
    ids = F.array_join(F.transform("items", lambda x: x.cast("string")), " ")
    sets.select(F.concat(ids, F.lit(" ("), (F.col("support") / total).cast("string"), F.lit(")")).alias("value")).write.mode("overwrite").text(path)


def append_new(rows: DataFrame, path: str, key: list[str]) -> int:
    """Append rows whose key the log at ``path`` does not have yet; a repeated call adds nothing. Returns how many were added."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(key)
    try:
        done = spark.read.schema(rows.schema).json(path)
        new = new.join(done.select(*key).distinct(), key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    from patternlake.session import cut

    new = cut(new.select(*rows.columns), "append")
    n = new.count()
    if n:
        new.write.mode("append").json(path)
    return n
