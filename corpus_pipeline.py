"""From raw documents to token tables, in stages that each work on what the one before kept.

toxicity         drops documents that the toxicity model rejects
near_duplicates  keeps one document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more
decontamination  drops documents that hold a benchmark item, up to a share of edits
mixing           takes each source up to its target, documents as often as they are taken
tokens           writes token ids as sorted-string tables and reads them back
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewave.llm import decontamination, mixing, simhash, sstable, toxicity
from tidewave.llm.common import fresh_dir, table
from tidewave.llm.queries import tokenizer_path, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sstable.store(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SQL can express neither the model nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written as Parquet to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), fresh_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
