"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. Stages work on everything their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemodels.llm import decontaminate, packing, quality, simhash, substring
from tablemodels.llm.common import saved
from tablemodels.llm.queries import END_ID, QUALITY_CUT

NEAR_SHINGLE = 3
NEAR_BITS = 2
REPEAT_WINDOW = 35
CAPACITY = 1024


# Rows of whole texts that a worker process gets at once; five stages share the same workers.
BATCH_ROWS = 1000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    return docs.filter(quality.quality_score(F.col("text"), model) >= QUALITY_CUT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents whose fingerprints are tied by few differing bits."""
    return simhash.keep_one(docs, NEAR_SHINGLE, NEAR_BITS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; untouched ones keep their text as it is."""
    cut = substring.remove_repeats(docs, REPEAT_WINDOW)
    changed = F.col("_repeats.n_removed") > 0
    cut = cut.withColumns(
        {
            "text": F.when(changed, F.col("_repeats.kept")).otherwise(F.col("_repeats.text")),
            "n_chars": F.when(changed, F.length("_repeats.kept").cast("long")).otherwise(F.col("n_chars")),
        }
    )
    return cut.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def fill_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs, "byte_bpe_50k.json", END_ID, CAPACITY)


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", fill_sequences),
]

# A fitted field, 64-bit fingerprints and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace("_", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
