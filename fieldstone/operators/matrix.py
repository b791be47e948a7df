"""Sparse matrices (i, j, v) as frames, unique by (i, j), and what is built from them.

Products are joins on the shared index followed by a grouped sum, whose partial phase runs before the exchange. Catalyst
picks broadcast or sort-merge by size; only `lowrank_trace_atb` asks for a broadcast, of a size that it counts first.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstone.operators.vector import contract, owner
from fieldstone.shared import written

BROADCAST_BYTES = 64 << 20
ROW_BYTES = 48  # of a broadcast row besides its numbers


def scatter_add(entries: DataFrame) -> DataFrame:
    """Sum of the entries of every slot (i, j): assembly."""
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def scatter_vector(entries: DataFrame) -> DataFrame:
    return entries.groupBy("i").agg(F.sum("v").alias("v"))


def scatter_blocks(entries: DataFrame) -> DataFrame:
    """Several blocks in one pass: entries (block, i, j, v)."""
    return entries.groupBy("block", "i", "j").agg(F.sum("v").alias("v"))


def scatter_derived(entries: DataFrame) -> DataFrame:
    """A block and its transpose from one pass over the entries."""
    both = F.array(F.struct(F.lit("A").alias("block"), F.col("i"), F.col("j")), F.struct(F.lit("At").alias("block"), F.col("j").alias("i"), F.col("i").alias("j")))
    return scatter_blocks(entries.select(F.explode(both).alias("e"), "v").select("e.block", "e.i", "e.j", "v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def spmv_transpose(a: DataFrame, x: DataFrame) -> DataFrame:
    return spmv(transpose(a), x)


def spmm(a: DataFrame, x: DataFrame, nvec: int) -> DataFrame:
    """A X for all columns at once: one join and one exchange for the whole multivector."""
    both = a.join(x.select(F.col("i").alias("j"), "x"), "j")
    sums = [F.sum(F.col("v") * F.col("x")[k]) for k in range(nvec)]
    return both.groupBy("i").agg(F.array(*sums).alias("x"))


def spmm_transpose(a: DataFrame, x: DataFrame, nvec: int) -> DataFrame:
    """A^T X."""
    return spmm(transpose(a), x, nvec)


def spmv_levels(a: DataFrame, x: DataFrame) -> DataFrame:
    """A applied at every level of a trajectory."""
    return a.join(x.select("k", F.col("i").alias("j"), F.col("v").alias("w")), "j").groupBy("k", "i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    scaled = lambda m, c: m.select("i", "j", (F.lit(float(c)) * F.col("v")).alias("v"))
    return scatter_add(scaled(a, alpha).unionByName(scaled(b, beta)))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("m"), F.col("j").alias("n"), F.col("v").alias("w"))
    return a.join(right, a["j"] == right["m"]).groupBy("i", F.col("n").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def mat_atb(a: DataFrame, b: DataFrame) -> DataFrame:
    """A^T B: a join on the shared row."""
    left, right = a.select(F.col("i").alias("r"), F.col("j").alias("i"), "v"), b.select(F.col("i").alias("r"), "j", F.col("v").alias("w"))
    return left.join(right, "r").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def matmul3(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """A B C, from the left."""
    return matmul(matmul(a, b), c)


def ptap(a: DataFrame, p: DataFrame) -> DataFrame:
    return mat_atb(p, matmul(a, p))


def diagonal(a: DataFrame) -> DataFrame:
    return a.filter("i = j").select("i", "v")


def trace(a: DataFrame) -> DataFrame:
    return a.filter("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.sum("v").alias("v"))


def lumped_solve(a: DataFrame, b: DataFrame) -> DataFrame:
    """b over the row sums of a; a zero row sum raises."""
    bad = F.raise_error(F.lit("zero entry in the lumped diagonal"))
    return row_sums(a).withColumnRenamed("v", "d").join(b, "i").select("i", (F.col("v") / F.when(F.col("d") == 0, bad.cast("double")).otherwise(F.col("d"))).alias("v"))


def diag_scale(d: DataFrame, a: DataFrame) -> DataFrame:
    """diag(d) A."""
    return a.join(d.withColumnRenamed("v", "w"), "i").select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def set_diagonal(a: DataFrame, ids: DataFrame, value: float) -> DataFrame:
    """A with a_ii = value on the listed rows that have a diagonal entry."""
    hit = a.join(ids.select("i").distinct().withColumn("hit", F.lit(True)), "i", "left")
    return hit.select("i", "j", F.when(F.col("hit") & (F.col("i") == F.col("j")), F.lit(float(value))).otherwise(F.col("v")).alias("v"))


def missing_diagonals(a: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("i").distinct().join(a.filter("i = j").select("i"), "i", "left_anti")


def symmetry_defect(a: DataFrame) -> DataFrame:
    """Largest |a_ij - a_ji|, a missing entry being zero."""
    gap = add(a, transpose(a), 1.0, -1.0)
    return gap.agg(F.coalesce(F.max(F.abs("v")), F.lit(0.0)).alias("defect"))


def row_defect(a: DataFrame) -> DataFrame:
    """What single precision loses of each row's sum."""
    return a.groupBy("i").agg(F.sum(F.col("v") - F.col("v").cast("float").cast("double")).alias("v"))


def operators_equal(a: DataFrame, b: DataFrame, v: DataFrame, tol: float = 1e-13) -> DataFrame:
    """|Av - Bv| <= tol (|Av| + |Bv|): whether a step operator can be used again."""
    p, q = spmv(a, v), spmv(b, v).withColumnRenamed("v", "w")
    both = p.join(q, "i", "full").select(F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("w", F.lit(0.0)).alias("w"))
    norm = lambda c: F.sqrt(F.coalesce(F.sum(c * c), F.lit(0.0)))
    return both.agg((norm(F.col("v") - F.col("w")) <= tol * (norm(F.col("v")) + norm(F.col("w")))).alias("same"))


def pattern(entries: DataFrame) -> DataFrame:
    """Distinct (i, j); structural zeros are kept."""
    return entries.select("i", "j").distinct()


def pattern_csr(entries: DataFrame) -> DataFrame:
    """(i, j, slot): place of every entry in its row, the diagonal first, then by column."""
    order = Window.partitionBy("i").orderBy((F.col("i") != F.col("j")).cast("int"), "j")
    return pattern(entries).withColumn("slot", F.row_number().over(order).cast("bigint") - 1)


def masked_slots(a: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries in a listed row or column."""
    ids = ids.select("i").distinct()
    return a.join(ids, "i", "left_semi").unionByName(a.join(ids, "i", "left_anti").join(ids.select(F.col("i").alias("j")), "j", "left_semi").select(*a.columns))


def slots_of(a: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries of the wanted (i, j); one that is missing raises."""
    found = wanted.join(a.withColumn("hit", F.lit(True)), ["i", "j"], "left")
    return found.select("i", "j", F.when(F.col("hit"), F.col("v")).otherwise(F.raise_error(F.lit("no such slot")).cast("double")).alias("v"))


def eliminate(entries: DataFrame, ess: DataFrame, diag: str = "one") -> DataFrame:
    """Assemble with the rows and columns of essential indices taken out before the sum (one aggregate, no second pass).

    diag: "one" puts 1 on their diagonals, "zero" nothing, "keep" the sum of their own diagonal entries.
    """
    ids = ess.select("i").distinct()
    kept = entries.join(ids, "i", "left_anti").join(ids.select(F.col("i").alias("j")), "j", "left_anti").select("i", "j", "v")
    if diag == "one":
        kept = kept.unionByName(ids.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")))
    elif diag == "keep":
        kept = kept.unionByName(entries.filter("i = j").join(ids, "i", "left_semi").select("i", "j", "v"))
    return scatter_add(kept)


def eliminate_atb(a: DataFrame, ess: DataFrame, diag: str = "one") -> DataFrame:
    """A^T A with essential indices taken out: their columns of A leave before the join, so their products never form."""
    ids = ess.select("i").distinct()
    of = lambda how: a.join(ids.select(F.col("i").alias("j")), "j", how).select("i", "j", "v")
    kept = of("left_anti")
    rest = mat_atb(kept, kept)
    if diag == "one":
        return rest.unionByName(ids.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")))
    if diag == "keep":
        own = of("left_semi").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("v") * F.col("v")).alias("v"))
        return rest.unionByName(own.select("i", F.col("i").alias("j"), "v"))
    return rest


def plan_block(pairs: DataFrame, ess: DataFrame) -> DataFrame:
    """What an assembly needs beside its values: pairs (e, a, b, i, j) with `masked`, true in an essential row or column."""
    ids = ess.select("i").distinct()
    rows = pairs.select("e", "a", "b", "i", "j").join(ids.withColumn("r", F.lit(True)), "i", "left").join(ids.select(F.col("i").alias("j"), F.lit(True).alias("c")), "j", "left")
    return rows.select("e", "a", "b", "i", "j", (F.col("r").isNotNull() | F.col("c").isNotNull()).alias("masked"))


def finish_block(plan: DataFrame, values: DataFrame) -> DataFrame:
    """The matrix of element values (e, a, b, v) under a plan; masked slots stay, as zeros."""
    return plan.join(values, ["e", "a", "b"]).groupBy("i", "j").agg(F.sum(F.when(F.col("masked"), 0.0).otherwise(F.col("v"))).alias("v"))


def pattern_of_tables(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(i, j) that meet in an element, from two dof tables (e, i)."""
    return rows.select("e", "i").join(cols.select("e", F.col("i").alias("j")), "e").select("i", "j").distinct()


def relabelled(graph: DataFrame, true_of: DataFrame) -> DataFrame:
    """A graph (i, j) of local dofs as one of true dofs, true_of (local, i)."""
    rows = graph.join(true_of.select(F.col("local").alias("i"), F.col("i").alias("r")), "i").join(true_of.select(F.col("local").alias("j"), F.col("i").alias("c")), "j")
    return rows.select(F.col("r").alias("i"), F.col("c").alias("j")).distinct()


def to_rows(a: DataFrame) -> DataFrame:
    """(i, cols, vals): compressed rows, columns ascending."""
    return a.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r")).select("i", F.transform("r", lambda s: s["j"]).alias("cols"), F.transform("r", lambda s: s["v"]).alias("vals"))


def from_rows(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.explode(F.arrays_zip("cols", "vals")).alias("r")).select("i", F.col("r.cols").alias("j"), F.col("r.vals").alias("v"))


def single(a: DataFrame) -> DataFrame:
    """The matrix in single precision."""
    return a.select("i", "j", F.col("v").cast("float").alias("v"))


def block_diagonal(a: DataFrame, n: int, parts: int) -> DataFrame:
    """The entries whose row and column have the same owner."""
    return a.filter(owner(F.col("i"), n, parts) == owner(F.col("j"), n, parts))


def apply_essential(v: DataFrame, ess: DataFrame) -> DataFrame:
    """v with the entries of ess (i, value) overwritten."""
    return v.join(ess, "i", "left").select("i", F.coalesce("value", "v").alias("v"))


def zero_essential(v: DataFrame, ess: DataFrame) -> DataFrame:
    return apply_essential(v, ess.select("i", F.lit(0.0).alias("value")))


def homogeneous(ess: DataFrame) -> DataFrame:
    """The same essential set with zero values."""
    return ess.select("i", F.lit(0.0).alias("value"))


def essential_where(vertices: DataFrame, where: Column, value: Column | float = 0.0) -> DataFrame:
    """(i, value) of the vertices (vid, x, y) for which a predicate of the coordinates holds."""
    return vertices.filter(where).select(F.col("vid").alias("i"), (value if isinstance(value, Column) else F.lit(float(value))).alias("value"))


def union_conditions(*conditions: DataFrame) -> DataFrame:
    """Essential sets acting as one; of equal indices the last condition holds."""
    out = None
    for rank, c in enumerate(conditions):
        c = c.select("i", F.struct(F.lit(rank).alias("r"), F.col("value")).alias("s"))
        out = c if out is None else out.unionByName(c)
    return out.groupBy("i").agg(F.max("s").alias("s")).select("i", F.col("s.value").alias("value"))


# Low rank: U diag(d) U^T, U a multivector.


def _scaled(d) -> Column:
    return F.array(*[F.lit(float(a)) for a in d])


def lowrank_apply(u: DataFrame, d, x: DataFrame) -> DataFrame:
    """U diag(d) U^T x as one plan: the inner products are a one-row frame."""
    k = len(d)
    dots = u.join(x, "i").agg(F.array(*[F.coalesce(F.sum(F.col("x")[c] * F.col("v")), F.lit(0.0)) * F.lit(float(d[c])) for c in range(k)]).alias("w"))
    return u.crossJoin(F.broadcast(dots)).select("i", contract(F.col("x"), F.col("w")).alias("v"))  # one row of k numbers


def lowrank_solve(u: DataFrame, d, b: DataFrame) -> DataFrame:
    """Pseudo-inverse on the range: zero eigenvalues are left out."""
    return lowrank_apply(u, [1 / a if a else 0.0 for a in d], b)


def lowrank_diag(u: DataFrame, d) -> DataFrame:
    return u.select("i", contract(F.transform("x", lambda a: a * a), _scaled(d)).alias("v"))


def lowrank_trace(u: DataFrame, d, w: DataFrame | None = None) -> DataFrame:
    """tr(U diag(d) U^T W); W is the identity if none is given."""
    if w is None:
        return lowrank_diag(u, d).agg(F.sum("v").alias("trace"))
    both = spmm(w, u, len(d)).select("i", F.col("x").alias("y")).join(u, "i")
    return both.agg(F.sum(contract(F.zip_with("x", "y", lambda p, q: p * q), _scaled(d))).alias("trace"))


def lowrank_trace_atb(u: DataFrame, d, a: DataFrame, b: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """tr(U diag(d) U^T A^T B) as the sum over rows of (A U) diag(d) (B U), so A^T B is never formed; B is A if none is given.

    Entries of A and B may repeat. They are dealt by row once, as narrow rows, and meet the rows of U that have an entry,
    sent to every executor in as many columns at once as `limit` bytes hold; if they hold none, a few columns at once go
    through joins that Catalyst picks.
    """
    spark, sides = u.sparkSession, [a] if b is None else [a, b]
    met = reduce(DataFrame.union, [m.select(F.col("j").alias("i")) for m in sides]).distinct()
    u = written(u.join(met, "i", "left_semi").select("i", "x"), "lowrank")
    room = (limit // max(1, u.count()) - ROW_BYTES) // 8
    width = min(len(d), room) if room > 0 else 4
    sides = [m.filter(F.col("i").isNotNull()).select("i", "j", "v") for m in sides]
    if room > 0:
        sides = [m.repartition("i") for m in sides]
    if again := width < len(d):
        sides = [m.persist(StorageLevel.DISK_ONLY) for m in sides]
    terms = []
    try:
        for at in range(0, len(d), width):
            n, x = min(width, len(d) - at), u.select("i", F.slice("x", at + 1, width).alias("x"))
            y = [spmm(m, F.broadcast(x) if room > 0 else x, n) for m in sides]  # of counted size
            both = y[0].withColumn("z", F.col("x")) if b is None else y[0].join(y[1].withColumnRenamed("x", "z"), "i")
            sums = both.agg(*[F.sum(F.col("x")[k] * F.col("z")[k]) for k in range(n)]).first()
            terms += [float(c) * s for c, s in zip(d[at : at + n], sums, strict=True) if s is not None]
    finally:
        if again:
            for m in sides:
                m.unpersist()
    return spark.createDataFrame([(sum(terms) if terms else None,)], "trace double")
