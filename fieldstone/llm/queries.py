"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality, sharding, token_counts, token_files, toxicity, warc
from fieldstone.llm.vocabularies import tokenizer_path
from fieldstone.shared import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "severity", "cutoff", "kept")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    read = token_files.with_starts(token_files.checksums(spark, path), spark, path)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents")).drop("copies")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
p AS (SELECT *, CAST(floor(8 * sqrt(sqrt(CAST(size AS DOUBLE)))) AS BIGINT) AS bin, CAST('0x' || substr(k, 1, 8) AS BIGINT) % (SELECT greatest(16, CAST(ceil(count(*) / 1e5) AS BIGINT)) FROM d) AS sub FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM p GROUP BY source),
w AS (SELECT *, [3e0, 1e0, 2e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2e0 * source_size AS cap, 1.5e0 * sum(source_size) OVER () AS total FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, ratio <= (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS alone FROM r),
m AS (SELECT *, bool_and(alone) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stops FROM l),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE weight * ((total - coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT stops THEN weight END) OVER ()) END AS target FROM m),
e AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 16777216 + 0.5) AS BIGINT) ELSE 0 END AS each, CAST('0x' || substr(md5('17:' || coalesce('s' || p.source, 'null')), 1, 6) AS BIGINT) AS off FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST(off + sum(each) OVER (PARTITION BY source ORDER BY bin, sub, size, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM e)
SELECT doc_id, size, source_size, target, ((upto >> 24) - ((upto - each) >> 24)) * size AS taken FROM x
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(_table(spark, sf_dir, "documents"), exact_dedup.new_index(spark))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(warc.derivatives(warc.responses(_table(spark, sf_dir, "pages"))), path)
    found = warc.linked(warc.read_warc(spark, path))
    return found.withColumn("refers_to_ok", F.col("response_id") == F.col("conversion_refers_to")).drop("conversion_refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality_rules": op1_quality_rules, "op2_token_files": op2_token_files, "op3_mixing": op3_mixing, "op4_sharding": op4_sharding, "op5_exact_dedup": op5_exact_dedup, "op6_near_dedup": op6_near_dedup, "op7_byte_bpe": op7_byte_bpe, "op8_token_counts": op8_token_counts, "op9_warc_derivatives": op9_warc_derivatives, "op10_toxicity": op10_toxicity}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op5_exact_dedup": OP5_SQL}
