import hashlib
import random
import re
from collections import defaultdict

from fieldstone.llm import exact_dedup as ed
from fieldstone.shared import shared_path

SCHEMA = "doc_id long, text string, digest string, row int"


def folded(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def rows(n=200, seed=0):
    r = random.Random(seed)
    texts = ["a  b", "a b", "a\tb", "", " ", None, "é\xa0x", "c" * 50_000, "A b", "tail ", "tail"]
    return [*((i, r.choice(texts), "d", i) for i in range(n)), (3, "a b", "again", 1), (3, "a b", "again", 1), (None, "a b", "n", 2), (None, "only here", "n", 2), (None, "only here", "m", 2)]


def want(data):
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[folded(t)].append(i)
    return {k: (min((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}


def test_marked_rows(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = ed.mark_duplicates(docs, ed.new_index(spark, buckets=4)).collect()
    groups = want(data)
    key = lambda x: tuple((y is not None, y) for y in x)
    found = [(r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in got]
    text = lambda t: hashlib.sha256(folded(t).encode()).hexdigest()
    assert sorted(found, key=key) == sorted(((i, text(t), *groups[folded(t)]) for i, t, *_ in data), key=key)
    stays = [r for r in got if r.kept]
    assert len(stays) == len(groups) == len({r.text_sha256 for r in stays}) and all(r.doc_id == r.keep_id for r in stays)


def test_dropped_rows(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(4)
    left = ed.drop_duplicates(docs, ed.new_index(spark, buckets=4))
    assert left.columns == docs.columns
    found = [tuple(r) for r in left.collect()]
    groups = want(data)
    assert sorted(folded(x[1]) for x in found) == sorted(groups)
    assert {folded(x[1]): x[0] for x in found} == {k: v[0] for k, v in groups.items()} and set(found) <= set(data)
    again = ed.drop_duplicates(docs.repartition(7), ed.new_index(spark, buckets=4)).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in left.collect())


def test_keys_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ed, "BROADCAST_KEYS", -1)
    test_dropped_rows(spark)


def test_batches_and_reopening(spark):
    path = shared_path(spark, "it's an index")
    first, second = rows(40, 1), [*rows(40, 2), (900, "new text", "d", 0), (901, "new  text", "d", 0)]
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    assert ed.drop_duplicates(frame(first), ed.DigestIndex(spark, path, 4), "o'ne\\").count() == len(want(first))
    later = ed.DigestIndex(spark, path, 4)
    left = ed.drop_duplicates(frame(second), later, "two").collect()
    assert sorted(folded(r.text) for r in left) == sorted(set(want(second)) - set(want(first)))
    marked = {r.text_sha256: r for r in ed.mark_duplicates(frame(second), later, "two").collect()}  # the batch again: the same
    assert marked[hashlib.sha256(b"new text").hexdigest()].keep_id == 900
    assert {r.keep_id for r in marked.values() if r.text_sha256 == hashlib.sha256(b"a b").hexdigest()} == {want(first)["a b"][0]}
    assert later.read().count() == len(set(want(first)) | set(want(second)))
    assert later.read().groupBy("digest").count().filter("count > 1").count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ed.mark_duplicates(docs, ed.new_index(spark, buckets=2)).count() == 0
    assert ed.drop_duplicates(docs, ed.new_index(spark, buckets=2)).collect() == []


def test_tables_are_forgotten(spark):
    index = ed.new_index(spark, buckets=2)
    assert spark.catalog.tableExists(index.table)
    ed._forget()
    assert not spark.catalog.tableExists(index.table)
