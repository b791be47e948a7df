"""A corpus pipeline of five of the training-data operators, registered as the query `pipeline`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. The mixing stage repeats a document as often as it is
taken; the last stage has a row for each of those.

Defined cases: a null or empty text fails the base rules of the first stage, and so does one of under ten words; a null id
is kept as such and its text is never a near-duplicate of another; of rows with equal ids and texts one stays; a null
source or language is one of its own; texts of any length are used whole; an empty table gives an empty result; other
columns of documents are carried through to the last stage, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldstone.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality
from fieldstone.llm.vocabularies import tokenizer_path
from fieldstone.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs, exact_dedup.new_index(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mixed_sources),
    ("byte_bpe", byte_level_bpe),
]

#: SQL can express neither the shingle links nor the byte-pair merges of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
