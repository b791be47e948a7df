import random
import zlib

import pytest

from fieldstone.llm import sharding as sh
from fieldstone.shared import shared_path


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, slot string")


def check(got, rows, shards, most):
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for s, members in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in members) == list(range(len(members)))
    sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]
    total = sum(sizes)
    assert all(abs(x - total / shards) <= most for x in sizes), sizes
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want


def test_equal_bytes(spark):
    r = random.Random(1)
    rows = [(i, "é" * r.randrange(200), "x") for i in range(3000)]
    check(sh.assign(docs_of(spark, rows), 10, 4).collect(), rows, 10, 450)


def test_a_hot_text_and_repeated_rows(spark):
    rows = [(i, f"t{i}", None) for i in range(500)] + [(1000 + i, "the same text", None) for i in range(700)] + [(7, "repeated", None)] * 600 + [(None, None, None)] * 50
    got = sh.assign(docs_of(spark, rows).repartition(6), 8, 3).collect()
    check(got, rows, 8, 60)
    same = [r.shard for r in got if r["text_crc32"] == zlib.crc32(b"the same text")]
    assert max(same) - min(same) + 1 == len(set(same))  # neighbours


def test_few_rows_and_none(spark):
    assert len(sh.assign(docs_of(spark, [(1, "a", None)]), 40).collect()) == 1
    assert sh.assign(docs_of(spark, []), 40).count() == 0


def test_written_shards(spark):
    rows = [(i, f"text {i} " * (i % 7), "k") for i in range(400)]
    path = shared_path(spark, "shards")
    sh.shard(docs_of(spark, rows), path, 5)
    back = spark.read.parquet(path)
    assert sorted(tuple(r) for r in back.select("doc_id", "text", "slot").collect()) == rows
    assert sorted(r.shard for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3, 4]


def test_clashing_names_and_very_long_texts(spark):
    rows = [(i, f"t{i} " * 9, 7, "k", 3) for i in range(300)] + [(300, "long " * 200_000, 7, "k", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard int, k0 string, size int")
    path = shared_path(spark, "shards")
    assert sh.shard(docs, path, 4) == "shard_"
    back = spark.read.parquet(path)
    assert sorted(tuple(r) for r in back.select(*docs.columns).collect()) == rows
    got = sh.assign(docs, 4).collect()
    assert sorted(r["size"] for r in got)[-1] == 1_000_016 and sorted((r.shard, r.slot) for r in got) == sorted(set((r.shard, r.slot) for r in got))


def test_rounds_stop_at_single_rows(spark):
    docs = docs_of(spark, [(i, "x" * (100 + i), None) for i in range(200)])
    keys = sh._keyed(docs, [sh.F.col("slot")], "doc_id", "text")
    assert max(len(s) for s in sh.find_splitters(keys, 40, 0.005)) <= 3


@pytest.mark.parametrize("splitter", [(1023,), (1024,), (1023, 1024), (5, 7)])
def test_packed(splitter):
    value = 0
    for w in sh._packed(splitter):
        value = (value << 60) + w
    want = sum(d << (10 * (17 - k)) for k, d in enumerate(splitter))
    assert value == want
