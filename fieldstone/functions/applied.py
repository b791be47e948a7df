"""Pointwise and local operators of the applications, as column expressions and bucketed joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstone.shared import written


def kernel_lookup(x: Column, nodes: list[tuple[float, float]], width: float) -> Column:
    """A table (node, value) looked up with Gaussian kernel weights."""
    w = [F.exp(-F.pow((x - node) / width, F.lit(2.0))) for node, _ in nodes]
    return sum((a * v for a, (_, v) in zip(w, nodes, strict=True)), F.lit(0.0)) / sum(w, F.lit(0.0))


def piecewise_class(x: Column, bounds: list[float]) -> Column:
    """Number of bounds at or below x."""
    return sum(((x >= b).cast("int") for b in bounds), F.lit(0))


def layered(r: Column, layers: list[tuple[float, list[float]]]) -> Column:
    """Polynomial of the first layer whose outer radius is beyond r. layers: (outer radius, coefficients from the constant)."""
    out = F.lit(None).cast("double")
    for outer, coefficients in reversed(layers):
        value = sum((c * F.pow(r, F.lit(float(k))) for k, c in enumerate(coefficients)), F.lit(0.0))
        out = value if math.isinf(outer) else F.when(r < outer, value).otherwise(out)
    return out


def options(text: Column) -> Column:
    """"theta=0.5,pmax=3" as a map."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def ricker(t: Column, f0: float, t0: float) -> Column:
    a = F.pow(math.pi * f0 * (t - t0), F.lit(2.0))
    return (1 - 2 * a) * F.exp(-a)


def rate_factor(temperature: Column) -> Column:
    """Rate factor of ice (per Pa^3 s): two Arrhenius laws that meet at 263.15 K, temperature clamped to [200, 273.15] K."""
    t = F.least(F.greatest(temperature, F.lit(200.0)), F.lit(273.15))
    return F.when(t < 263.15, 3.61e-13 * F.exp(-6.0e4 / (8.314 * t))).otherwise(1.73e3 * F.exp(-13.9e4 / (8.314 * t)))


def cut_window(distance: Column, rho: float, alpha: float = 0.5) -> Column:
    """Taper: 1 within alpha rho, a raised cosine to 0 at rho."""
    inner = alpha * rho
    return F.when(distance <= inner, 1.0).when(distance >= rho, 0.0).otherwise(0.5 * (1 + F.cos(math.pi * (distance - inner) / (rho - inner))))


def comb(grid: DataFrame, anchor: dict[str, int], step: int) -> DataFrame:
    """Grid points of a comb: every step-th along each axis, from the anchor on."""
    for axis, a in anchor.items():
        grid = grid.filter((F.col(axis) >= a) & ((F.col(axis) - a) % step == 0))
    return grid


def grid_coarsen(raster: DataFrame, r: int) -> DataFrame:
    """(cx, cy, v): means over r x r blocks of (x, y, v); blocks without a row are absent."""
    return raster.groupBy(F.floor(F.col("x") / r).alias("cx"), F.floor(F.col("y") / r).alias("cy")).agg(F.avg("v").alias("v"))


def fourier_coefficients(series: DataFrame, nsteps: int, nfreq: int) -> DataFrame:
    """(receiver, freq, re, im): the first coefficients of (receiver, n, v), in one grouped sum."""
    rows = series.select("receiver", "n", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nfreq - 1).cast("bigint"))).alias("freq"))
    angle = 2 * math.pi * F.col("freq") * F.col("n") / nsteps
    return rows.groupBy("receiver", "freq").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(-F.col("v") * F.sin(angle)).alias("im"))


def within_reach(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """(i, j, distance) of points (i, x, y) closer than reach: a join on grid cells of that size and their neighbours."""
    cell = lambda c: F.floor(F.col(c) / reach)
    near = lambda c: F.explode(F.array(*[cell(c) + d for d in (-1, 0, 1)]))
    a = left.select("i", "x", "y", near("x").alias("cx")).select("*", near("y").alias("cy"))
    b = right.select(F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("cx"), cell("y").alias("cy"))
    gap = F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2.0)) + F.pow(F.col("y") - F.col("y2"), F.lit(2.0)))
    return a.join(b, ["cx", "cy"]).select("i", "j", gap.alias("distance")).filter(F.col("distance") < reach)


def bilinear(points: DataFrame, table: DataFrame) -> DataFrame:
    """(id, v): a unit-spaced table (x, z, c) at points (id, px, pz): a join on the four corners."""
    fx, fz = F.floor("px"), F.floor("pz")
    corners = F.array(*[F.struct((fx + a).alias("x"), (fz + b).alias("z")) for a in (0, 1) for b in (0, 1)])
    rows = points.select("id", "px", "pz", F.explode(corners).alias("q")).select("id", "px", "pz", "q.x", "q.z")
    weight = (1 - F.abs(F.col("px") - F.col("x"))) * (1 - F.abs(F.col("pz") - F.col("z")))
    return rows.join(table, ["x", "z"]).groupBy("id").agg(F.sum(F.col("c") * weight).alias("v"))


def field_statistics(chain: DataFrame) -> DataFrame:
    """(i, mean, var) of a field (k, i, v) along a chain."""
    return chain.groupBy("i").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("var"))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`, each row's place (from 0) in the order of columns that tell rows apart.

    Rows are dealt by range, numbered inside their part and shifted by the rows of the parts before it, so no task sorts
    them all; only the counts of the parts meet in one place.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_seq", 33)), "ranked")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))  # a row per part
    return placed.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_seq", "_first")


def unique_inverse(df: DataFrame, key: str) -> DataFrame:
    """df with `inverse`, the rank of its key among the distinct keys: ranked once per distinct key and joined back."""
    return df.join(ranked(df.select(key).distinct(), [key], "inverse"), key)


def unique_inverse_rows(pairs: DataFrame) -> DataFrame:
    """pairs (i, j) with `inverse`, the rank of each among the distinct pairs."""
    return pairs.join(ranked(pairs.select("i", "j").distinct(), ["i", "j"], "inverse"), ["i", "j"])


def argsort(df: DataFrame, key: str, index: str) -> DataFrame:
    """(place, index): the stable order of the rows by key."""
    return ranked(df.select(key, index), [key, index], "place").select("place", index)


def first_touch(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, number): distinct keys numbered by their first occurrence in `order`."""
    first = df.groupBy(key).agg(F.min(order).alias("at"))
    return ranked(first, ["at", key], "number").select(key, "number")


def stencil(field: DataFrame, weights: dict[tuple[int, int], float]) -> DataFrame:
    """(x, y, v): a stencil on a lattice field; points beyond the lattice count as zero. One exploded copy per weight."""
    taps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(w)).alias("w")) for (a, b), w in weights.items()])
    moved = field.select("x", "y", "v", F.explode(taps).alias("t")).select((F.col("x") - F.col("t.a")).alias("x"), (F.col("y") - F.col("t.b")).alias("y"), (F.col("v") * F.col("t.w")).alias("v"))
    return moved.groupBy("x", "y").agg(F.sum("v").alias("v")).join(field.select("x", "y"), ["x", "y"], "left_semi")


def highpass(field: DataFrame, weights: dict[tuple[int, int], float]) -> DataFrame:
    """The field less its blur by the stencil."""
    blur = stencil(field, weights).withColumnRenamed("v", "blur")
    return field.join(blur, ["x", "y"]).select("x", "y", (F.col("v") - F.col("blur")).alias("v"))


def survey(nx: int, ny: int, ds: float, dr: float, depth: float, spark) -> DataFrame:
    """(kind, x, y, z): source points ds apart and receivers dr apart over a grid."""
    side = lambda kind, n, m, d: spark.range(n * m).select(F.lit(kind).alias("kind"), ((F.col("id") % n) * d).alias("x"), (F.floor(F.col("id") / n) * d).alias("y"), F.lit(float(depth)).alias("z"))
    return side("source", nx, ny, ds).unionByName(side("receiver", int((nx - 1) * ds / dr) + 1, int((ny - 1) * ds / dr) + 1, dr))


def resample(series: DataFrame, times: DataFrame, dt: float) -> DataFrame:
    """(t, v): cubic Lagrange interpolation of (n, v) sampled at n dt, at times (t) with two samples on either side."""
    at = F.floor(F.col("t") / dt)
    near = times.select("t", (F.col("t") / dt - at).alias("s"), F.explode(F.array(*[F.struct((at + k).alias("n"), F.lit(k).alias("k")) for k in (-1, 0, 1, 2)])).alias("q")).select("t", "s", "q.n", "q.k")
    s = F.col("s")
    weight = F.when(F.col("k") == -1, -s * (s - 1) * (s - 2) / 6).when(F.col("k") == 0, (s + 1) * (s - 1) * (s - 2) / 2).when(F.col("k") == 1, -(s + 1) * s * (s - 2) / 2).otherwise((s + 1) * s * (s - 1) / 6)
    return near.join(series, "n").groupBy("t").agg(F.sum(weight * F.col("v")).alias("v"), F.count(F.lit(1)).alias("c")).filter("c = 4").select("t", "v")


# Impulse responses and lattices.


def comb_products(h: DataFrame, color: DataFrame) -> DataFrame:
    """(i, color, v): a sparse operator (i, j, v) on combs, the sums of unit vectors of one color; color: (j, color)."""
    return h.join(color, "j").groupBy("i", "color").agg(F.sum("v").alias("v"))


def impulse_windows(responses: DataFrame, samples: DataFrame, reach: int) -> DataFrame:
    """(k, a, b, v): the part of its comb's response (color, x, y, v) that lies within `reach` of each sample (k, color, px, py)."""
    a, b = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    both = responses.join(samples, "color").filter((F.abs(a) <= reach) & (F.abs(b) <= reach))
    return both.select("k", a.alias("a"), b.alias("b"), "v")


def _phase(m: int) -> Column:
    return F.cos(2 * math.pi / m * (F.col("f") * F.col("a") + F.col("g") * F.col("b")))


def _with_frequencies(rows: DataFrame, m: int) -> DataFrame:
    every = lambda: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    return rows.withColumn("f", every()).withColumn("g", every())


def kernel_symbol(kernels: DataFrame, m: int) -> DataFrame:
    """(k, f, g, s): the real Fourier symbol of centred kernels (k, a, b, w) on an m x m torus."""
    return _with_frequencies(kernels, m).groupBy("k", "f", "g").agg(F.sum(F.col("w") * _phase(m)).alias("s"))


def sqrt_kernels(kernels: DataFrame, m: int, reach: int) -> DataFrame:
    """(k, a, b, w): kernels whose symbol is the square root of that of `kernels` (negative parts as zero), cut at `reach`."""
    root = kernel_symbol(kernels, m).select("k", "f", "g", F.sqrt(F.greatest("s", F.lit(0.0))).alias("r"))
    around = lambda: F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    rows = root.withColumn("a", around()).withColumn("b", around())
    return rows.groupBy("k", "a", "b").agg((F.sum(F.col("r") * _phase(m)) / m**2).alias("w"))


def blended_convolution(field: DataFrame, kernels: DataFrame, weights: DataFrame) -> DataFrame:
    """(x, y, v): sum over k of weight k at the point times the field convolved with kernel k.

    kernels (k, a, b, w) are a small table; weights (k, x, y, g) say where each holds.
    """
    moved = field.crossJoin(F.broadcast(kernels)).select("k", (F.col("x") + F.col("a")).alias("x"), (F.col("y") + F.col("b")).alias("y"), (F.col("v") * F.col("w")).alias("v"))  # kernels x field rows: a stencil
    sums = moved.groupBy("k", "x", "y").agg(F.sum("v").alias("v"))
    return sums.join(weights, ["k", "x", "y"]).groupBy("x", "y").agg(F.sum(F.col("g") * F.col("v")).alias("v"))


def halo_rows(field: DataFrame, side: int, width: int) -> DataFrame:
    """(bx, by, x, y, v, own): each lattice row in its block of side x side points and in the blocks that it is a halo of."""
    block = lambda c: F.floor(F.col(c) / side)
    near = lambda c: F.array_distinct(F.array(block(c), F.floor((F.col(c) - width) / side), F.floor((F.col(c) + width) / side)))
    rows = field.select("x", "y", "v", F.explode(near("x")).alias("bx"), near("y").alias("_by")).withColumn("by", F.explode("_by")).drop("_by")
    known = field.select(block("x").alias("bx"), block("y").alias("by")).distinct()
    return rows.join(known, ["bx", "by"]).select("bx", "by", "x", "y", "v", ((block("x") == F.col("bx")) & (block("y") == F.col("by"))).alias("own"))


def bilaplacian_stencil(h: float, gamma: float, delta: float) -> list[tuple[int, int, int, float]]:
    """(a, b, c, weight) of the 27 points of (gamma K + delta M) over the lumped mass of trilinear cells of side h."""
    mass, stiff = {-1: 1 / 6, 0: 4 / 6, 1: 1 / 6}, {-1: -1.0 / h**2, 0: 2.0 / h**2, 1: -1.0 / h**2}
    out = []
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            for c in (-1, 0, 1):
                k = stiff[a] * mass[b] * mass[c] + mass[a] * stiff[b] * mass[c] + mass[a] * mass[b] * stiff[c]
                out.append((a, b, c, gamma * k + delta * mass[a] * mass[b] * mass[c]))
    return out


def mollifier(x: Column, y: Column, locations: list[tuple[float, float]], width: float) -> Column:
    """Sum of Gaussian bumps of one width around a list of points."""
    bump = lambda p: F.exp(-((x - p[0]) * (x - p[0]) + (y - p[1]) * (y - p[1])) / (width * width))
    return sum((bump(p) for p in locations), F.lit(0.0))
