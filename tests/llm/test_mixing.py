import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldstone.llm import mixing as mx

SCHEMA = "doc_id long, source string, text string, key string, copies int, named string"


def rows(n, seed=0):
    r = random.Random(seed)
    out = [(i, r.choice(["a", "a", "a", "b", "c", None]), " ".join("w" for _ in range(r.choice([0, 1, 5, 5, 40, 300]))), "k", 7, "x") for i in range(n)]
    return [*out, (None, "a", None, None, None, None), (None, "a", "one two", "k", 1, "y"), (3, "b", "\t\n", "k", 1, "y"), (3, "b", "\t\n", "k", 1, "y"), (5, "hot", "z " * 9, "q", 2, "z")]


def targets(size, weights=(3, 1, 2), share=1.5, cap=2.0):
    """By sharing out again and again."""
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = share * sum(size.values()), {}, set(names)
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole >= cap * size[s]}
        if not over:
            return out | {s: left * weight[s] / whole for s in free}
        for s in over:
            out[s] = cap * size[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def words(text):
    return len((text or "").split())


@pytest.mark.parametrize("bin_rows", [100_000, 20])
def test_law(spark, bin_rows):
    data = rows(900)
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = mx.mix_counts(docs, bin_rows=bin_rows).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((x[0] is None, x[0] or 0, words(x[2])) for x in data)
    size = Counter()
    for _, s, t, *_ in data:
        size[s] += words(t)
    want, source_of = targets(size), {}
    for x in data:
        source_of.setdefault((x[0], words(x[2])), set()).add(x[1])
    taken = Counter()
    for r in got:
        (s, *_) = source_of[r.doc_id, r.size]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[s] += r.taken
    for s, n in size.items():
        if n > 1000:
            assert abs(taken[s] - want[s]) <= 0.03 * want[s]
    again = mx.mix_counts(docs.repartition(3), bin_rows=bin_rows).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_emitted_rows_are_the_copies(spark):
    data = rows(300, 4)
    docs = spark.createDataFrame(data, SCHEMA)
    counts = Counter()
    for r in mx.mix_counts(docs).collect():
        counts[r.doc_id, r.size] += r.copies
    mixed = mx.mix(docs)
    assert mixed.columns == docs.columns
    found = [tuple(r) for r in mixed.collect()]
    assert set(found) <= set(data)
    emitted = Counter((x[0], words(x[2])) for x in found)
    assert emitted == Counter({k: n for k, n in counts.items() if n})


def test_one_size_is_spread_over_bins(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    bins = mx._placed(docs, [F.col("doc_id")], "doc_id", "source", "text", 100).groupBy("class", "bin").count().collect()
    assert len(bins) == 40 and max(r["count"] for r in bins) < 200
    nulls = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"))
    assert max(r["count"] for r in mx._placed(nulls, [F.col("doc_id")], "doc_id", "source", "text", 100).groupBy("class", "bin").count().collect()) < 200


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mx.mix_counts(docs).count() == 0 and mx.mix(docs).columns == docs.columns
    blank = spark.createDataFrame([(1, None, ""), (2, "a", None)], "doc_id long, source string, text string")
    assert [r.taken for r in mx.mix_counts(blank).collect()] == [0, 0]
