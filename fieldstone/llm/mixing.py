"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document has an expected number of copies, the ratio of its source's target to its source's size. Within a
source the expected copies are prefix-summed in an order that goes from short to long texts (and by a hash among
texts of like length); one random offset is added; a document is emitted once for each integer that its interval
of the sum crosses. Neighbours in that order have like sizes, so the words taken come near the target, and no
document is taken more often than its expected copies rounded up.

The prefix sum has three levels: a source is cut into classes of like size, a class into bins by a hash of id and text,
of which there are more when there are more rows. Sums over classes and over the bins of a class are taken on small
tables; only the order inside a bin needs a sort, and a bin has some 100 000 rows at most, whatever the sizes and ids
are. Expected copies are whole multiples of 2**-24, so that sums are exact and reruns agree.

Defined cases: a null or empty text has size 0 and takes no words; a null source is a source of its own, last in
order; rows that repeat count as documents of their own; a null id is hashed as empty; of rows with equal ids and texts
any are taken, as many as the sum says; an empty table gives an empty result; other columns are carried through or
ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstone.shared import written

#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Expected copies are counted in this part of a copy.
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS


def word_count(text: Column) -> Column:
    """Number of words of a text; each word is first shrunk to one character, so that memory stays that of the text."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), " \t\n\u000b\f\r", "")).cast("bigint")


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("bigint")


def _placed(docs: DataFrame, row: list[Column], id_col: str, source_col: str, text_col: str, bin_rows: int) -> DataFrame:
    """`row` of each document beside the internal columns of the order within a source."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bins = max(16, -(-docs.count() // bin_rows))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    keyed = docs.select(F.struct(*row).alias("row"), word_count(text).alias("size"), key.alias("key"), F.col(source_col).alias("source"))
    return keyed.withColumns(
        {"class": F.floor(8 * F.sqrt(F.sqrt(F.col("size").cast("double")))).cast("bigint"), "bin": _number(F.substring("key", 1, 8)) % bins, "named": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))}
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes (named, source, source_size), one row per source -> with weight and target.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all sizes; a target stops at `cap`
    times its source's size and the excess goes to the others by weight. Sorted by cap over weight, the sources that
    stop are a prefix, so one pass of sums finds the level.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    level = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", weight).withColumns({"__cap": cap * F.col("source_size"), "__total": share * F.sum("source_size").over(every)})
    df = df.withColumn("__ratio", F.col("__cap") / F.col("weight"))
    df = df.withColumn("__stops", F.col("__ratio") <= (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    df = df.withColumn("__stops", F.min("__stops").over(level.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.col("__total") - F.coalesce(F.sum(F.when(F.col("__stops"), F.col("__cap"))).over(every), F.lit(0.0))
    free = F.sum(F.when(~F.col("__stops"), F.col("weight"))).over(every)
    return df.withColumn("target", F.when(F.col("__stops"), F.col("__cap")).otherwise(F.col("weight") * (left / free))).select("named", "source", "source_size", "weight", "target")


def _counted(placed: DataFrame, seed: int, **law) -> DataFrame:
    """placed with copies and the figures of the source."""
    keys = ["named", "class", "bin"]
    bins = written(placed.groupBy("source", *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-bins")
    classes = bins.groupBy("source", "named", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    targets = source_targets(classes.groupBy("named", "source").agg(F.sum("words").alias("source_size")), **law)
    each = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(0).cast("bigint")
    offset = _number(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "named")), 1, 6))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = classes.withColumn("below", before("named", "class")).select("named", "class", "below").hint("merge").join(
        targets.select("named", "source_size", "target", each.alias("each"), offset.alias("offset")), "named"
    )
    starts = bins.select(*keys, before("named", "class", "bin").alias("within")).hint("merge").join(first, ["named", "class"])
    starts = starts.select(*keys, "source_size", "target", "each", ((F.col("below") + F.col("within")) * F.col("each") + F.col("offset")).alias("start"))
    rank = Window.partitionBy(*keys).orderBy("size", "key").rowsBetween(Window.unboundedPreceding, 0)
    df = placed.drop("source").join(written(starts, "mix-starts").hint("merge"), keys).withColumn("end", F.col("start") + F.sum("each").over(rank))
    return df.withColumn("copies", F.shiftright("end", UNIT_BITS) - F.shiftright(F.col("end") - F.col("each"), UNIT_BITS))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, bin_rows: int = 100_000, **law) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken."""
    narrow = written(_placed(docs, [F.col(id_col).alias("id")], id_col, source_col, text_col, bin_rows), "mix-sizes")
    return _counted(narrow, seed, **law).select(F.col("row.id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, bin_rows: int = 100_000, **law) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with its own columns and no other."""
    out = _counted(_placed(docs, [F.col("*")], id_col, source_col, text_col, bin_rows), seed, **law)
    return out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
