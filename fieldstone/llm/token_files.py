"""Token-id files: Parquet list columns with delta encoding, controlled row groups and page indexes.

Documents are laid out in ascending id order: one range exchange of the texts, then each partition is encoded and
written as files of bounded size. The id column of a document is a list<int>, stored delta-binary-packed without a
dictionary; ids and counts are plain columns beside it. Row groups and pages are limited in rows and bytes, and the
writer adds column and offset indexes, so a reader of a range of documents or of the metadata alone skips the pages of
all other tokens. The start of a document in the stream of all ids is not stored, as files are written independently;
it is the prefix sum of the counts, two-level over file parts and rows, from the metadata columns alone.

Defined cases: a null text counts as empty and has the end id alone; rows that repeat an id are ordered by text size
and then by row number and are all kept; null ids come first; an empty table gives an empty data set; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldstone.llm.arrow import as_bytes, map_batches
from fieldstone.llm.word_encoder import encoder_of
from fieldstone.shared import written

#: Writer settings of the format.
FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None = 1) -> DataFrame:
    """docs (id, part, seq, text) -> id, part, seq, n_tokens, tokens."""
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        encoder = encoder_of(tokenizer)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = encoder.encode_all([t or b"" for t in as_bytes(batch.column(3))])
            offsets, ids = found.text_ids, found.ids
            if end_id is not None:
                ends = offsets[1:] + np.arange(len(offsets) - 1)
                offsets = np.concatenate([[0], ends + 1])
                with_ends = np.full(offsets[-1], end_id, "<u4")
                inner = np.ones(offsets[-1], bool)
                inner[ends] = False
                with_ends[inner] = ids
                ids = with_ends
            tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view("<i4")))
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets)), tokens], ["id", "part", "seq", "n_tokens", "tokens"])

        return run

    return map_batches(docs.select("id", "part", "seq", "text"), make, "id long, part int, seq long, n_tokens long, tokens array<int>", "text", 8 << 20)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 32 << 20, most_parts: int = 20_000, file_rows: int = 200_000) -> None:
    """Encode all texts and write them to `path` in ascending id order, in parts of about `part_bytes` of text.

    There are at most `most_parts` parts, which grow with the input beyond that; a part is written as files of at most
    `file_rows` documents.
    """
    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    total = ordered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(most_parts, max(1, -(-total // part_bytes)))
    keys = ["id", F.octet_length("text"), "row"]
    placed = ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    numbered = placed.select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), "text")
    encoded(numbered, tokenizer, end_id).write.options(**FORMAT).option("maxRecordsPerFile", file_rows).parquet(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, tokens: bool = True) -> DataFrame:
    """Documents with low <= id < high; with tokens=False the metadata alone. Both bounds reach the page indexes."""
    df = spark.read.schema("id long, part int, seq long, n_tokens long, tokens array<int>").parquet(path)
    if low is not None:
        df = df.filter(F.col("id") >= low)
    if high is not None:
        df = df.filter(F.col("id") < high)
    return df if tokens else df.drop("tokens")


def with_starts(df: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """df (part, seq, n_tokens and more, one row per document of the files at `path`) with start, the ids of all documents before it."""
    sums = written(read_tokens(spark, path, tokens=False).groupBy("part").agg(F.sum("n_tokens").alias("tokens")), "token-parts")
    before = sums.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(before, "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("before")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """id, part, seq, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            at, values = lists.offsets.to_numpy().tolist(), memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<i4")).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["id", "part", "seq", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).mapInArrow(run, "id long, part int, seq long, n_tokens long, ids_crc32 long")
