"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest. A batch of documents is reduced to one row per digest
(partial aggregation before the exchange), anti-joined with the index by sort-merge, and what is new is appended.
The index side of the joins is read bucket by bucket and never shuffled.

Defined cases: a null text counts as empty; rows with equal texts and equal ids are told apart by an internal row
number, so exactly one row of a group stays; a null id sorts after all other ids; an empty table gives an empty
result; other columns are carried through or ignored, whatever they are called.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.shared import shared_path, written

#: Fixed value: the white space that is folded.
SPACE = r"[\x20\x09-\x0D]+"
#: At most this many keys of dropped rows are broadcast (some 100 bytes each); more are joined by sort-merge.
BROADCAST_KEYS = 200_000

_tables: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget() -> None:
    """Take the indexes out of the catalogue when the driver ends; their files stay."""
    for spark, table in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the JVM has gone already
            return


def _quoted(text: str) -> str:
    """A string literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256))


class DigestIndex:
    """A digest table at a path: digest, keep_id (row that holds the text), copies (rows of its first batch), batch.

    Each batch is a partition that is written by one job commit; adding a batch again replaces its partition, so a
    batch that was cut short can simply be added again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, copies BIGINT, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION {_quoted(path)}"
        )
        _tables.append((spark, self.table))
        if self._has_data():
            spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def _has_data(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, but: str | None = None) -> DataFrame:
        """All entries, or those of other batches than `but`."""
        df = self.spark.table(self.table)
        return df if but is None else df.filter(F.col("batch") != but)

    def add(self, groups: DataFrame, batch: str) -> DataFrame:
        """Append the digests of groups (digest, keep_id, copies) that no other batch has; returns the batch's entries."""
        new = groups.hint("merge").join(self.read(but=batch).select("digest"), "digest", "left_anti")
        self._append(new, batch)
        return self.read().filter(F.col("batch") == batch)

    def _append(self, new: DataFrame, batch: str) -> None:
        view = f"v_{uuid.uuid4().hex[:12]}"
        written(new, "digest-new").repartition(self.buckets, "digest").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = {_quoted(batch)}) SELECT digest, keep_id, copies FROM {view}")
        self.spark.catalog.dropTempView(view)
        self.spark.catalog.refreshTable(self.table)


def decide(docs: DataFrame, index: DigestIndex, batch: str = "0", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has id, digest and a row number; groups, one per digest of this batch, has what stays.

    groups: digest, keep_id and keep_row (null if an earlier batch holds the text), copies in this batch.
    """
    rows = written(docs.select(F.col(id_col).cast("bigint").alias("id"), digest_of(F.col(text_col)).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    groups = rows.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("copies")
    ).select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "copies")
    groups = written(groups, "digest-groups")
    index.add(groups.select("digest", "keep_id", "copies"), batch)
    held = index.read(but=batch).select("digest", F.col("keep_id").alias("held_id"), F.lit(True).alias("held"))
    known = groups.hint("merge").join(held, "digest", "left")
    return rows, known.select(
        "digest", F.when(F.col("held"), F.col("held_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(F.col("held").isNull(), F.col("keep_row")).alias("keep_row"), "copies"
    )


def mark_duplicates(docs: DataFrame, index: DigestIndex, batch: str = "0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size (rows of this batch with the text), kept, text_sha256.

    The join of rows with their groups is an ordinary shuffle join of narrow rows, which adaptive execution splits
    when one text has a large share of them.
    """
    rows, groups = decide(docs, index, batch, id_col, text_col)
    return rows.join(written(groups, "digest-decided"), "digest").select(
        F.col("id").alias(id_col), "keep_id", F.col("copies").alias("group_size"), F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, index: DigestIndex, batch: str = "0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns and no other.

    What is dropped is found on narrow rows, by digest and id together, so that a text with many copies does not meet in
    one task; the texts are read once more and only shuffled if the dropped keys are too many to be broadcast. Of rows
    with equal ids and texts the one with the smallest hash of all its columns stays.
    """
    rows, groups = decide(docs, index, batch, id_col, text_col)
    stay = groups.filter(F.col("keep_row").isNotNull()).select("digest", F.col("keep_id").alias("id"), "keep_row")
    same = (rows["digest"] == stay["digest"]) & rows["id"].eqNullSafe(stay["id"])
    gone = rows.join(stay.hint("merge"), same, "left").filter("keep_row IS NULL OR keep_row <> row").select(rows["digest"], rows["id"], F.col("keep_row").isNotNull().alias("again"))
    gone = written(gone.distinct(), "digest-dropped")
    keyed = docs.select(F.struct("*").alias("row"), digest_of(F.col(text_col)).alias("digest"), F.col(id_col).cast("bigint").alias("id"))

    def matched(keys: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge")
        return keyed.join(side, (keyed["digest"] == keys["digest"]) & keyed["id"].eqNullSafe(keys["id"]), how)

    out = matched(gone.select("digest", "id"), "left_anti").select("row")
    again = gone.filter("again").select("digest", "id")
    if not again.isEmpty():
        hashed = F.xxhash64(*[F.col("row")[f.name] for f in docs.schema if "map" not in f.dataType.simpleString()])
        out = out.unionByName(matched(again, "left_semi").groupBy("digest", "id").agg(F.min_by("row", hashed).alias("row")).select("row"))
    return out.select("row.*")


def new_index(spark: SparkSession, path: str | None = None, buckets: int = 64) -> DigestIndex:
    return DigestIndex(spark, path or shared_path(spark, "digest-index"), buckets)
