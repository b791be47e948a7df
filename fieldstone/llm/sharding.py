"""Sharding by histogram sort: shards of nearly equal bytes, ranges of one sorted order.

The order is by text hash, then id hash, then row number, so equal texts stand together, yet a group of copies of any
size can be split between shards. The key is a string of 180 bits, of which each round looks at the next ten: bytes and
rows are counted exactly by key prefix, inside the intervals that still hold a splitter, and each splitter moves into
the prefix that its target number of bytes falls in. Splitters whose interval is at most `tolerance` of a shard, or has
a single row, stay where they are. When all are in place, every row knows its range and rows are exchanged once. Row
numbers decide only between rows of equal text and id, which are alike to the shards.

Ranges are finer than shards by `finer`, and a row's slot is its rank inside its range plus the rows of the shard's
ranges before it, so no task sorts a whole shard.

Defined cases: a null text has no bytes and the checksum of the empty text; a null id is hashed as empty; rows that
repeat are placed one by one; a text larger than a shard has one alone, or shares it with its neighbours; fewer rows
than shards leave shards empty; an empty table gives an empty result; other columns are carried through by `shard`,
whatever they are called, and ignored by `assign`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstone.shared import written

BITS = 10
WORDS = 3  # 64-bit words of the key: text hash, id hash, row number


def _digit(r: int) -> Column:
    """The r-th group of BITS of the key, from the left; six groups (60 bits) of each word."""
    word, k = divmod(r, 6)
    return F.shiftrightunsigned(F.col(f"k{word}"), 60 - BITS * (k + 1)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _prefix(r: int) -> list[Column]:
    return [_digit(k) for k in range(r)]


def _keyed(docs: DataFrame, row: list[Column], id_col: str, text_col: str) -> DataFrame:
    """`row` of each document beside its size and key."""
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    mask = F.lit((1 << 60) - 1)
    return docs.select(
        F.struct(*row).alias("row"), (F.octet_length(text).cast("bigint") + 16).alias("size"), F.xxhash64(text).bitwiseAND(mask).alias("k0"),
        F.xxhash64(F.lit("id"), key).bitwiseAND(mask).alias("k1"), F.monotonically_increasing_id().bitwiseAND(mask).alias("k2"),
    )


def find_splitters(keys: DataFrame, ranges: int, tolerance: float = 0.005) -> list[tuple[int, ...]]:
    """Lower key bounds (digits) of ranges 1 to ranges-1, such that ranges have nearly equal bytes.

    Each round collects at most 2**BITS sums for each interval that holds a splitter.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = [total * k / ranges for k in range(1, ranges)]
    slack = tolerance * total / ranges
    placed: dict[int, tuple[int, ...]] = {}
    open_at: dict[tuple[int, ...], tuple[int, list[int]]] = {(): (0, list(range(ranges - 1)))}  # prefix: bytes below it, its splitters
    for r in range(6 * WORDS):
        if not open_at or not total:
            break
        digits = _prefix(r)
        inside = keys
        if r:
            wanted = keys.sparkSession.createDataFrame([(list(p),) for p in open_at], "p array<int>")
            inside = keys.withColumn("q", F.array(*digits)).join(F.broadcast(wanted), F.col("q") == F.col("p"), "left_semi")  # at most ranges-1 rows
        else:
            inside = keys.withColumn("q", F.array().cast("array<int>"))
        sums: dict[tuple[int, ...], dict[int, tuple[int, int]]] = {}
        for row in inside.groupBy("q", _digit(r).alias("d")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect():
            sums.setdefault(tuple(row["q"]), {})[row["d"]] = row["n"], row["rows"]
        following: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        for prefix, (below, splitters) in open_at.items():
            for d, (n, rows) in sorted(sums.get(prefix, {}).items()):
                for s in [s for s in splitters if below <= targets[s] < below + n and s not in placed]:
                    near, far = targets[s] - below, below + n - targets[s]
                    if min(near, far) <= slack or rows == 1 or r == 6 * WORDS - 1:
                        placed[s] = (*prefix, d) if near <= far else (*prefix, d + 1)
                    else:
                        following.setdefault((*prefix, d), (below, []))[1].append(s)
                below += n
        open_at = following
    last = (1 << BITS,)
    return [placed.get(s, last) for s in range(ranges - 1)]


def _packed(splitter: tuple[int, ...]) -> tuple[int, ...]:
    """The splitter as words of a key; a digit of 2**BITS carries over by plain addition."""
    out = 0
    for k in range(6 * WORDS):
        out = (out << BITS) + (splitter[k] if k < len(splitter) else 0)
    words = []
    for w in reversed(range(WORDS)):
        words.append(out >> (60 * w) if w == WORDS - 1 else (out >> (60 * w)) & ((1 << 60) - 1))
    return tuple(words)


def _range_of(splitters: list[tuple[int, ...]]) -> Column:
    """Number of splitters at or below the key, by binary search as nested conditions."""
    bounds = sorted(map(_packed, splitters))

    def reached(b: tuple[int, ...]) -> Column:
        out = F.col(f"k{WORDS - 1}") >= F.lit(b[-1])
        for w in reversed(range(WORDS - 1)):
            out = (F.col(f"k{w}") > F.lit(b[w])) | ((F.col(f"k{w}") == F.lit(b[w])) & out)
        return out

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(reached(bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(bounds)).cast("int")


def assign(docs: DataFrame, shards: int = 40, finer: int = 4, tolerance: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot."""
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    narrow = written(_keyed(docs, [F.col(id_col).alias("id"), crc.alias("crc")], id_col, text_col), "shard-keys")
    placed = narrow.withColumn("range", _range_of(find_splitters(narrow, shards * finer, tolerance)))
    counts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", F.floor(F.col("range") / finer).cast("int"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("range", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # shards * finer rows
    rank = F.row_number().over(Window.partitionBy("range").orderBy("k0", "k1", "k2"))
    return placed.join(F.broadcast(first), "range").select(
        F.col("row.id").alias(id_col), "size", F.col("row.crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("first") + rank - 1).cast("bigint").alias("slot")
    )


def shard(docs: DataFrame, path: str, shards: int = 40, tolerance: float = 0.005, id_col: str = "doc_id", text_col: str = "text", folder: str = "shard") -> str:
    """Write the documents, with their own columns, as one sorted folder per shard under `path`, after one exchange.

    Folders are named by the column `folder`, with underscores after it if the documents have a column of that name;
    the name used is returned.
    """
    while folder.lower() in (c.lower() for c in docs.columns):
        folder += "_"
    narrow = written(_keyed(docs, [F.lit(0).alias("none")], id_col, text_col).drop("row"), "shard-keys")
    number = _range_of(find_splitters(narrow, shards, tolerance))
    placed = _keyed(docs, [F.col("*")], id_col, text_col).withColumn("shard", number)
    sorted_rows = placed.repartition(shards, "shard").sortWithinPartitions("shard", "k0", "k1", "k2")
    sorted_rows.select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
    return folder
