"""A training-data pipeline over documents: language identification, exact and
near deduplication, mixing to target weights, packing into sequences.

Every stage takes (spark, docs, sf_dir), docs being all that the stage before
kept, and returns a DataFrame. Rows are told apart even where doc_id is null or
repeats (after mixing a document may occur twice, as it is taken twice): a stage
whose operator answers by doc_id then numbers the rows in a written copy. Other
columns than those of documents are dropped by the first stage. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import exact_dedup, jaccard, langid, mixing, packing
from nodeloom.llm.common import few, release, settle, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BYTES = 8.0  #: bits per byte of a text that a language's model explains no better than chance


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the predicted language. Rejects documents without one: null
    texts, those without a letter, and those whose bytes no language's model
    codes shorter than equal chances of all bytes would."""
    release(spark)
    named = langid.identify(docs.select(*COLUMNS), bits=True)
    kept = named.where((F.col("lang_pred") != langid.UND) & (F.col("bits") < BYTES))
    with small_batches(spark):
        return settle(kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars"), "named")


def _numbered(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs and a column that tells its rows apart: doc_id where it is a key,
    otherwise numbers in a written copy."""
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if shared.limit(1).count() == 0:
        return docs, F.col("doc_id")
    return settle(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered"), F.col("_row")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the row with the largest doc_id stays (of
    several such rows, one)."""
    release(spark)
    docs, key = _numbered(docs)
    found = exact_dedup.exact_dedup(docs.select(F.struct("doc_id", key.alias("row")).alias("doc_id"), "text"))
    gone = settle(found.where("not kept").select(F.col("doc_id.row").alias("_key")), "dropped")
    return docs.withColumn("_key", key).join(few(gone), "_key", "left_anti").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest doc_id,
    or, where doc_id is no key, the first one."""
    release(spark)
    docs, key = _numbered(docs)
    found = jaccard.similar(docs.select(key.alias("doc_id"), "text"))
    gone = settle(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_key")), "dropped")
    return docs.withColumn("_key", key).join(few(gone), "_key", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as many times as the mix takes it; documents without words never do."""
    docs, key = _numbered(docs)
    found = mixing.mix(docs.select(key.alias("doc_id"), "text", "source"))
    taken = settle(found.where("taken > 0").select(F.col("doc_id").alias("_key"), (F.col("taken") / F.col("size")).cast("int").alias("_times")), "taken")
    many = docs.withColumn("_key", key).join(few(taken), "_key").withColumn("_time", F.explode(F.sequence(F.lit(1), "_times")))
    return many.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row of docs, with their places in sequences."""
    release(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("mixing", mix), ("best_fit_packing", pack)]

#: Language identification and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
