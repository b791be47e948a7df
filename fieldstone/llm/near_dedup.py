"""MinHash near-deduplication with an LSH forest.

Every text has the set of its word shingles and a signature of TREES x DEPTH minhashes. Texts with equal sets are one
class, whose representative is the smallest id. Each tree orders the representatives by its own DEPTH minhashes; texts
whose prefixes agree are neighbours in that order.

Depth adapts to the region: beginning at MIN_DEPTH, texts that share a prefix are a node; a node of at most `crowd`
texts gives all its pairs, and a larger one gives the pairs of each text with the node's first, and goes one level
deeper, where small nodes give the pairs of neighbours. A node that is crowded at full depth is dealt into parts by
hash. So the number of these candidates stays in proportion to the number of texts.

Candidates are used in three steps. First every text keeps one of them, the smaller id with the highest estimated
similarity; these links are confirmed on full sets, and give components. Then all candidates between different
components are estimated and confirmed. The estimate drops pairs that are over five standard errors under the
threshold. Last, the nodes that are crowded at MIN_DEPTH and still have more than one component are compared whole, by
their full sets: all pairs of texts of different components, in pairs of blocks that are spread over tasks. So every
pair that shares a node at MIN_DEPTH is compared, unless other links join it or the estimate drops it in a small node;
a pair of similarity 0.8 agrees on four minhashes of a tree with chance 0.41, so that TREES trees miss it with chance
below 0.0003. The last step grows with the square of a node whose texts are not similar to each other; a node of one
component costs nothing there. Components, not pairs, are the result.

Defined cases: an empty or null text has an empty set and is linked with nothing; so is a row with a null id, whose
component is null and which is kept; rows that repeat an id are in the component of their own text, as links join sets
and not ids; an empty table gives an empty result; other columns are ignored or carried through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstone.llm.arrow import as_bytes, map_batches, pieces
from fieldstone.llm.graph import components, joined
from fieldstone.llm.shingles import mix, shingle_sets, similar
from fieldstone.shared import written

TREES, DEPTH, MIN_DEPTH = 16, 8, 4
#: Texts and shingles of a block of a crowded node, about; a task holds two blocks at a time.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: At most this many ids or nodes are broadcast (some 40 bytes each); more are joined by sort-merge.
BROADCAST_IDS = 300_000

_random = np.random.Generator(np.random.Philox(key=20240229))
_factors = _random.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_shifts = _random.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    """TREES x DEPTH minhashes, 16 bits of each, big-endian."""
    least = np.full(TREES * DEPTH, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(shingles), 2048):
        part = shingles[k : k + 2048]
        np.minimum(least, (_factors[:, None] * part + _shifts[:, None]).min(axis=1), out=least)
    return mix(least).astype(">u2").tobytes()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and the text's hash, which tells apart rows that repeat an id."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hash of the text, n_shingles, digest of the set (null if empty), signature."""

    def make():
        import xxhash

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets([t or b"" for t in as_bytes(batch.column(1))], width)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["id", "hash", "n_shingles", "digest", "signature"])

        return run

    return map_batches(keyed(docs, id_col, text_col), make, "id long, hash long, n_shingles long, digest binary, signature binary", "text", 4 << 20)


def forest(reps: DataFrame) -> DataFrame:
    """tree, path (the tree's minhashes as bytes, in sorting order) and id of every representative."""
    paths = F.array(*[F.struct(F.lit(t).alias("tree"), F.expr(f"substring(signature, {2 * DEPTH * t + 1}, {2 * DEPTH})").alias("path")) for t in range(TREES)])
    return reps.select("id", F.explode(paths).alias("p")).select("p.tree", "p.path", "id")


def of_ids(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join of rows with distinct keys; broadcasts the keys only if they are few enough."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys.hint("merge"), on, how)


def candidates(rows: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(near, all, crowded): pairs (a, b) with a < b, each once; near has a bounded number for each text. crowded has the
    tree, node and id of the texts in nodes that are crowded at MIN_DEPTH."""
    near, every, crowds = [], [], None
    for depth in range(MIN_DEPTH, DEPTH + 1):
        keyed = rows.withColumn("node", F.expr(f"substring(path, 1, {2 * depth})"))
        full = written(keyed.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter(F.col("n") > crowd), "crowded-nodes")
        rows = written(of_ids(keyed, full, ["tree", "node"], "inner").select("tree", "path", "id", "n", "first"), "crowded")
        small = of_ids(keyed, full.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node", F.lit(0).alias("part"), "path", "id")
        if depth == DEPTH:
            part = F.pmod(F.xxhash64("tree", "id"), F.ceil(F.col("n") / crowd)).cast("int")
            small = small.unionByName(rows.select("tree", F.col("path").alias("node"), part.alias("part"), "path", "id"))
        near.append(rows.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))
        every.append(near[-1])
        rows = rows.drop("n", "first")
        if crowds is None:
            crowds = rows.select("tree", F.expr(f"substring(path, 1, {2 * depth})").alias("node"), "id")
        groups = small.groupBy("tree", "node", "part").agg(F.array_sort(F.collect_list(F.struct("path", "id"))).alias("m"))
        groups = written(groups.filter("size(m) > 1"), "nodes")
        steps = F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda i: F.struct(F.element_at("m", i)["id"].alias("x"), F.element_at("m", i + 1)["id"].alias("y")))
        pairs = F.expr("flatten(transform(sequence(1, size(m) - 1), i -> transform(slice(m, i + 1, size(m) - i), o -> struct(m[i - 1].id AS x, o.id AS y))))")
        ordered = lambda df: df.select(F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b"))
        near.append(ordered(groups.select(F.explode(steps).alias("p"))))
        if depth == MIN_DEPTH:  # deeper nodes are parts of crowded ones, which within_crowds() compares whole
            every.append(ordered(groups.select(F.explode(pairs).alias("p"))))
        if depth < DEPTH and rows.isEmpty():
            break
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return written(union(near).distinct(), "near"), written(union(every).distinct(), "candidates"), crowds


def estimated(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least that share, with the share as `estimate`."""
    side = lambda name, s: reps.select(F.col("id").alias(name), F.col("signature").alias(s))
    both = pairs.join(side("a", "s"), "a").join(side("b", "t"), "b").select("a", "b", "s", "t")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, TREES * DEPTH) for k in (2, 3))
            share = (s == t).mean(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(share)], ["a", "b", "estimate"]).filter(pa.array(share >= least))

    return both.mapInArrow(run, "a long, b long, estimate double")


def texts_of(nodes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """node (as `id`), text of distinct nodes. nodes: id; reps: node, id, hash; docs: id, text, hash."""
    rows = reps.select("node", "id", "hash").join(nodes.select(F.col("id").alias("node")), "node")
    found = of_ids(docs, written(rows, "pair-ids"), ["id", "hash"], "inner").select(F.col("node").alias("id"), "text")
    return written(found, "pair-texts", compression="zstd")


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets are similar. reps: node, id, hash; docs: id, text, hash."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), reps, docs)
    side = lambda name, t: texts.select(F.col("id").alias(name), F.col("text").alias(t))
    both = pairs.select("a", "b").join(side("b", "u"), "b").join(side("a", "t"), "a").select("a", "b", "t", "u")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "t", 2 << 20):
                left, right = (shingle_sets([t or b"" for t in as_bytes(batch.column(k))], width) for k in (2, 3))
                yes = [similar(x, y, percent) for x, y in zip(left, right, strict=True)]
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return written(both.mapInArrow(run, "a long, b long").distinct(), "links")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by dense products over `step` shingles at a time."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    edges = np.arange(0, len(shared) + step, step)
    sides = []
    for sets in (left, right):
        values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(shared, values)
        hit = np.flatnonzero(shared[np.minimum(col, len(shared) - 1)] == values) if len(shared) else np.empty(0, np.int64)
        hit = hit[np.argsort(col[hit], kind="stable")]
        sides.append((row[hit], col[hit], np.searchsorted(col[hit], edges)))
    out = np.zeros((len(left), len(right)), np.int64)
    for k, start in enumerate(edges[:-1]):
        dense = []
        for sets, (row, col, cut) in zip((left, right), sides, strict=True):
            m = np.zeros((len(sets), step), np.float32)
            m[row[cut[k] : cut[k + 1]], col[cut[k] : cut[k + 1]] - start] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def spanning(links: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    new = np.ones(len(links), bool)
    for root in range(len(links)):
        ahead = [root] if new[root] else []
        new[root] = False
        while ahead:
            i = ahead.pop()
            found = np.flatnonzero(links[i] & new)
            new[found] = False
            ahead.extend(found.tolist())
            yield from ((i, j) for j in found.tolist())


def block_links(parts: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) that join all similar texts of different components in two blocks, or in one. parts: side, id, c, shingles."""
    ids, c = parts["id"].to_numpy(), parts["c"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in parts["shingles"].to_pylist()]
    side, n = parts["side"].to_numpy(), np.array([len(s) for s in sets])
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    y = y if len(y) else x
    # The texts of either side that meet one of another component, of a size that allows a link.
    meets = (c[x][:, None] != c[y]) & (100 * np.minimum(n[x][:, None], n[y]) >= percent * np.maximum(n[x][:, None], n[y]))
    rows, cols = np.flatnonzero(meets.any(axis=1)), np.flatnonzero(meets.any(axis=0))
    links = np.zeros((len(ids), len(ids)), bool)
    if len(rows):
        x, y, meets = x[rows], y[cols], meets[np.ix_(rows, cols)]
        common = common_counts([sets[i] for i in x], [sets[i] for i in y])
        yes = meets & (100 * common >= percent * (n[x][:, None] + n[y] - common))
        links[np.ix_(x, y)] |= yes
        links[np.ix_(y, x)] |= yes.T
    found = list(spanning(links))
    return pa.table({"a": pa.array([min(ids[i], ids[j]) for i, j in found], pa.int64()), "b": pa.array([max(ids[i], ids[j]) for i, j in found], pa.int64())})


def within_crowds(crowds: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links between the components `found` in crowded nodes, by full sets; None if each node is in one component.

    The texts of a node are dealt by hash into blocks: a component of over half a block has blocks of its own, smaller
    ones share blocks. Each pair of blocks is a group, but for two of the same component.
    """
    label = found.select(F.col("node").alias("id"), F.col("component").alias("c"))
    member = crowds.join(label, "id", "left").select("tree", "node", "id", F.coalesce("c", "id").alias("c"))
    mixed = written(member.groupBy("tree", "node").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("tree", "node"), "mixed")
    if mixed.isEmpty():
        return None
    member = member.join(mixed, ["tree", "node"])
    texts = texts_of(member.select("id").distinct(), reps, docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 2 << 20):
                sets = shingle_sets([t or b"" for t in as_bytes(batch.column(1))], width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "shingles"])

    sets = written(texts.mapInArrow(run, "id long, n long, shingles binary").dropDuplicates(["id"]), "crowded-sets", compression="zstd")
    member = written(member.join(sets.select("id", "n"), "id"), "crowded-members")
    blocks = F.ceil(F.greatest(F.sum("k") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    size = written(member.groupBy("tree", "node", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")), "crowded-components")
    size = size.withColumn("own", F.when((F.col("k") > BLOCK // 2) | (F.col("n") > BLOCK_SHINGLES // 2), F.col("c")))
    dealt = size.groupBy("tree", "node", "own").agg(blocks.alias("parts"))
    dealt = size.select("tree", "node", "c", "own").join(dealt.withColumnRenamed("own", "o"), ["tree", "node"]).filter("own <=> o").drop("o")
    part = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("c")).otherwise(F.col("id"))), F.col("parts")).cast("int")
    member = written(member.join(dealt, ["tree", "node", "c"]).select("tree", "node", F.coalesce("own", F.lit(-(1 << 63))).alias("own"), F.col("own").isNull().alias("open"), part.alias("part"), "id", "c"), "crowded-blocks")
    block = member.select("tree", "node", F.struct("open", "own", "part").alias("block")).distinct()
    pairs = block.withColumnRenamed("block", "x").join(block.withColumnRenamed("block", "y"), ["tree", "node"])
    pairs = pairs.filter("x <= y AND (x.open OR y.open OR x.own <> y.own)")
    ends = F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))
    pairs = pairs.select("tree", "node", F.xxhash64("tree", "node", "x", "y").alias("group"), F.posexplode(ends).alias("side", "block")).select("tree", "node", "group", "side", "block.*")
    groups = pairs.join(member, ["tree", "node", "open", "own", "part"]).join(sets.select("id", "shingles"), "id").select("tree", "node", "group", "side", "id", "c", "shingles")
    return written(groups.groupBy("tree", "node", "group").applyInArrow(lambda t: block_links(t, percent), "a long, b long").distinct(), "crowded-links")


def labelled(docs: DataFrame, width: int = 5, percent: int = 80, crowd: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, hash of the text, n_shingles, component_id (smallest id reachable over links), kept."""
    sets = written(signatures(docs, width, id_col, text_col), "signatures")
    named = sets.filter("digest IS NOT NULL AND id IS NOT NULL")
    # A class of equal sets is a node of its own number, as rows with different texts may repeat an id.
    reps = named.groupBy("digest").agg(F.min(F.struct("id", "hash", "signature")).alias("r")).select("digest", "r.*")
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")
    signed = reps.select(F.col("node").alias("id"), "signature")
    texts = keyed(docs, id_col, text_col)
    near, every, crowds = candidates(forest(signed), crowd)
    least = percent / 100 - 0.2
    best = estimated(near, signed, least).groupBy("b").agg(F.max(F.struct("estimate", "a")).alias("m")).select("m.a", "b")
    best = written(best, "best")
    links = confirmed(best, reps, texts, width, percent)
    first = written(components(links), "components")
    label = lambda name, c: first.select(F.col("node").alias(name), F.col("component").alias(c))
    across = every.join(label("a", "x"), "a", "left").join(label("b", "y"), "b", "left").filter("coalesce(x, a) <> coalesce(y, b)").select("a", "b").join(best, ["a", "b"], "left_anti")
    more = confirmed(written(estimated(across, signed, least).select("a", "b"), "across"), reps, texts, width, percent)
    found = written(joined(first, more), "components")
    exact = within_crowds(crowds, found, reps, texts, width, percent)
    if exact is not None:
        found = joined(found, exact)
    classes = written(reps.select("digest", "node", "id").join(found, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component")), "classes")
    smallest = classes.groupBy("component").agg(F.min("id").alias("c"))
    classes = classes.select("digest", "component").join(smallest, "component").select("digest", "c")
    sets = sets.drop("signature")
    labels = sets.filter("digest IS NOT NULL").join(written(classes, "named-classes"), "digest", "left")
    out = labels.unionByName(sets.filter("digest IS NULL"), allowMissingColumns=True)  # empty texts are many and alike
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("c", "id")))
    return out.select(F.col("id").alias(id_col), "hash", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept. Settings as of labelled()."""
    return labelled(docs, **settings).drop("hash")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents that near_duplicates() keeps, with their own columns."""
    gone = labelled(docs, id_col=id_col, text_col=text_col, **settings).filter("NOT kept").select(F.col(id_col).alias("id"), "hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("hash"))
    return of_ids(rows, written(gone, "near-dropped"), ["id", "hash"], "left_anti").select("row.*")
