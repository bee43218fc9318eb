"""Corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, source mixing.

Every stage judges rows, not ids: rows that repeat an id, or have none, are documents of their own. The first of several copies is the row of the
smallest id (null last); among rows of one id it is the one with the smallest row key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netweir.llm import decontaminate, linedup, mixing, nearest, queries, toxicity
from netweir.llm.work import stored


#: Row key of a stage's input; no stage returns it.
ROW = "_pipeline_row"


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and the column that names each row, in the order (doc_id, nulls last).

    Ids that are all there and all different are such a column. Otherwise the rows are written once, ranged by id, with a row key.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    # the number before the shuffle deals rows of one id, or of none, over partitions
    place = [F.col("doc_id").asc_nulls_last(), F.col(ROW)]
    ranged = docs.withColumn(ROW, F.monotonically_increasing_id()).repartitionByRange(*place).sortWithinPartitions(*place)
    return stored(ranged.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows"), ROW


def _without(docs: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    gone = rows.select(F.col(key).alias("_gone"))
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return toxicity.drop_toxic(docs, queries.toxicity_labels(spark, sf_dir), ["low_quality", "toxic"])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, up to one word edit if they have five words; one left without a word goes."""
    rows, key = _keyed(docs)
    return linedup.drop_lines(rows, key, exact_words=1).drop(ROW).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8), that of the smallest id."""
    rows, key = _keyed(docs)
    return _without(rows, key, nearest.near_duplicates(rows, key, shingle=5, percent=80).filter("NOT kept"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    rows, key = _keyed(docs)
    return _without(rows, key, decontaminate.decontaminate(rows, benchmark, key).filter("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]

#: The chain's training and the rounding's draws have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
