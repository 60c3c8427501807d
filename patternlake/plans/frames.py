"""Frames that the catalogue's queries share, made from the tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.functions.states import fit_edges, item, itemize, with_states
from patternlake.operators.windows import window_transactions

ROW_CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SERIES_CHANNELS = ["value", "k"]
DIMS = [f"d{i}" for i in range(8)]
MODELS = ["m0", "m1", "m2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_edges(spark, sf_dir) -> DataFrame:
    return fit_edges(table(spark, sf_dir, "lineitem"), ROW_CHANNELS)


def row_states(spark, sf_dir) -> DataFrame:
    """lineitem rows with channels as states 0 .. 2."""
    rows = table(spark, sf_dir, "lineitem").select(*ROW_CHANNELS, "l_returnflag", "l_linestatus")
    return with_states(rows, row_edges(spark, sf_dir), ROW_CHANNELS)


def _row_groups(spark, sf_dir, flag: bool) -> DataFrame:
    """(items, label, cls, weight): a row is a transaction of its states and its line status, with its return flag as item unless that is the label.

    Rows are counted by their states first, which are numbers; items are made for the groups only.
    """
    keys = [*ROW_CHANNELS, "l_linestatus", "l_returnflag"]
    groups = row_states(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("weight"))
    states = [item(c, F.col(c)) for c in ROW_CHANNELS] + [item("status", F.col("l_linestatus"))] + ([item("flag", F.col("l_returnflag"))] if flag else [])
    return groups.select(itemize(states).alias("items"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_returnflag").alias("cls"), "weight")


def row_weights(spark, sf_dir) -> DataFrame:
    """Distinct row transactions with their number."""
    return _row_groups(spark, sf_dir, True).groupBy("items").agg(F.sum("weight").alias("weight"))


def labelled(spark, sf_dir) -> DataFrame:
    """(items, label, cls, weight) without the flag item."""
    return _row_groups(spark, sf_dir, False).groupBy("items", "label", "cls").agg(F.sum("weight").alias("weight"))


def basket_rows(spark, sf_dir) -> DataFrame:
    """(l_orderkey, items): distinct part types of each order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("items"))


def baskets(spark, sf_dir) -> DataFrame:
    """(items, weight): distinct sets of part types of the orders."""
    return basket_rows(spark, sf_dir).groupBy("items").agg(F.count("*").alias("weight"))


def series(spark, sf_dir) -> DataFrame:
    """events as one series per user: user_id, ts, event_id, event_type, value, k, label."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), (F.col("event_type") == "error").cast("int").alias("label"))


def series_windows(spark, sf_dir, size: int = 20, hop: int = 10) -> DataFrame:
    s = series(spark, sf_dir)
    return window_transactions(s, ["user_id"], ["ts", "event_id"], SERIES_CHANNELS, fit_edges(s, SERIES_CHANNELS), size, hop, "label")


def sensors(spark, sf_dir) -> DataFrame:
    """embeddings as eight channels, one series for each label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("label", "vec_id", *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(DIMS)])


def channels_long(spark, sf_dir) -> DataFrame:
    """embeddings with a row for each of a vector's components: label, vec_id, channel, x."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    return e.select("label", "vec_id", F.posexplode("embedding").alias("channel", "x")).withColumn("x", F.col("x").cast("double"))


def wide_sensors(spark, sf_dir, channels: int = 64) -> DataFrame:
    """embeddings with every component as a channel."""
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"d{i}") for i in range(channels)])


def sensor_windows(spark, sf_dir, size: int = 10, hop: int = 5) -> DataFrame:
    """(label, win, items): windows over the eight sensor channels, with edges of the whole table."""
    s = sensors(spark, sf_dir)
    return window_transactions(s, ["label"], ["vec_id"], DIMS, fit_edges(s, DIMS), size, hop, long_units=True)


def calls(spark, sf_dir) -> DataFrame:
    """A log of diagnosis calls (model, cond, case_key, grp, truth, reply), made from labels: plain and fenced JSON, prose and errors."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = rows.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(1))))
    truth = F.when(F.col("toxic") == 1, "anomalous").otherwise("normal")
    roll = (F.col("doc_id") * 7 + F.col("m") * 3 + F.col("c") * 5) % 20
    right = roll < 12 + F.col("c") * 4 - F.col("m")
    said = F.when(right, truth).when(F.col("toxic") == 1, "normal").otherwise(" Anomalous")
    cites = F.when(F.col("c") == 0, F.when(roll == 3, '["made up"]').otherwise("[]")).when(roll % 4 == 0, '["p1", "p2 "]').when(roll % 4 == 1, '["p3","other"]').otherwise('["p1"]')
    body = F.concat(F.lit('{"diagnosis": "'), said, F.lit('", "cited_patterns": '), cites, F.lit(', "reason": "r"}'))
    reply = F.when(roll == 19, "__ERROR__ timeout").when(roll == 18, "I can not tell {").when(roll % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rows.select(
        F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"),
        F.when(F.col("c") == 1, "lib").otherwise("nolib").alias("cond"),
        F.col("doc_id").alias("case_key"),
        F.concat(F.lit("g"), F.col("quality").cast("string")).alias("grp"),
        truth.alias("truth"),
        reply.alias("reply"),
        (roll % 4).cast("int").alias("budget"),
    )


def library(spark) -> DataFrame:
    return spark.createDataFrame([("p1",), ("p2",), ("p3",)], "pattern string")
