"""From raw documents to encoded training text: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternlake.llm import decontam, langid, simhash, spans, spencode
from patternlake.llm.common import shared_dir, stash
from patternlake.llm.queries import tokenizer

#: Columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with __row, a hash of doc_id and text: rows equal in both are one, others are not, whether ids repeat or are null."""
    return docs.withColumn("__row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))


def _by_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the row's hash as doc_id."""
    return _rows(docs).select(F.col("__row").alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose hash is not among the ``doc_id`` of ``gone``."""
    return _rows(docs).join(gone.distinct().withColumnRenamed("doc_id", "__gone"), F.col("__row") == F.col("__gone"), "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter."""
    found = langid.identify(_by_row(docs), langid.train(docs))
    return _without(docs, found.where("lang_pred = 'und'").select("doc_id")).select(COLUMNS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component: that with the smallest doc_id, null after all others, then the smallest hash.

    Rows that repeat in doc_id and text count as one; of different texts with one doc_id each is decided by itself.
    """
    kind = docs.schema["doc_id"].dataType
    rows = _rows(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit("0").cast(kind)).alias("id"), F.col("__row").alias("row"))
    found = simhash.near_duplicates(rows.select(order.alias("doc_id"), "text"), tau=4, width=4)
    kept = found.where("kept").select(F.col("doc_id.row").alias("__kept")).distinct()
    left = rows.join(kept, F.col("__row") == F.col("__kept"), "left_semi")
    twice = rows.groupBy("__row").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return (left.dropDuplicates(["__row"]) if twice else left).select(COLUMNS)


def span_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated spans from texts; drops a document of which nothing is left."""
    out = spans.dedup_spans(docs.select(COLUMNS), passage=spans.PASSAGE)
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.col("text")) != ""))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontam.leaks(_by_row(docs), bench).select("doc_id")).select(COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: token ids, digests of ids and of the decoded text."""
    return spencode.encode(docs, tokenizer("piece_bpe_32k.model"), with_arrays=False)


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", neardup_stage),
    ("substring dedup", span_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding", encode_stage),
]

#: Suffix automata, XXH64, latent retrieval and the encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each returns is written to the shared folder and read again."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), f"{path}/stage{k}")
    return docs
