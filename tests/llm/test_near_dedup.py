import random
import re

import numpy as np
import pytest

from fieldstone.llm import near_dedup as nd
from fieldstone.llm.graph import components
from fieldstone.llm.shingles import shingle_sets, similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, width):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, percent=80):
    sets = [brute_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k, len(sets[i]), None if k is None else low[find(i)], k is None or k == low[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


def corpus(seed, groups=25, copies=9):
    r = random.Random(seed)
    word = lambda: r.choice(["Ab", "c", "déf", "g-h", "ij", "K"]) + str(r.randrange(3000))
    rows = [(900000, None), (900001, ""), (900002, " \n "), (900003, "one"), (900004, "ONE"), (900005, "a b c"), (900006, "A b  c"), (None, "x y z"), (None, "x y z")]
    for g in range(groups):
        base = [word() for _ in range(r.choice([6, 30, 80, 300]))]
        for _ in range(r.randrange(1, copies)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = word()
            rows.append((r.randrange(10**6), r.choice([" ", "\n", "\t "]).join(w)))
    r.shuffle(rows)
    return rows


def test_shingles_match_brute_force():
    texts = [t for _, t in corpus(1)] + ["x" * 70000 + " y"]
    for width in (1, 4, 5):
        got = shingle_sets([(t or "").encode() for t in texts], width)
        want = [brute_set(t, width) for t in texts]
        assert [len(x) for x in got] == [len(x) for x in want]
        for i in range(0, len(texts) - 1, 3):
            assert len(np.intersect1d(got[i], got[i + 1])) == len(want[i] & want[i + 1])
    assert similar(np.arange(8, dtype=np.uint64), np.arange(10, dtype=np.uint64), 80) and not similar(np.arange(7, dtype=np.uint64), np.arange(9, dtype=np.uint64), 80)


@pytest.mark.parametrize("seed,width,crowd", [(1, 4, 24), (2, 5, 3)])
def test_components_match_brute_force(spark, seed, width, crowd):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, component_id string").repartition(3)
    got = sorted(map(tuple, nd.near_duplicates(docs, width=width, crowd=crowd).collect()), key=str)
    assert got == brute(rows, width)


def test_keep_first_and_empty(spark):
    rows = corpus(5, 8)
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kept string")
    kept = nd.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((k for k, _, _, keep in brute(rows, 5) if keep), key=str)
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(6, 30)] + [(7, 7), (200, 199)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 5 for i in range(5, 30)) and got[200] == 199
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def star(copies, words=400, edits=6):
    """A text and copies of it with edits of their own: similar to the text and, but for a few, not to each other."""
    r = random.Random(copies)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    rows = [(copies // 2, " ".join(base))]
    for k in range(copies):
        w = list(base)
        for i in r.sample(range(4, words - 4, 5), edits):
            w[i] = f"e{k}x{i}"
        rows.append((k if k < copies // 2 else k + 1, " ".join(w)))
    return rows


def test_crowded_nodes_lose_no_links(spark):
    rows = star(1000)
    sets = [brute_set(t, 5) for _, t in rows]
    assert all(100 * len(sets[0] & s) >= 80 * len(sets[0] | s) for s in sets)
    assert 100 * len(sets[1] & sets[2]) < 80 * len(sets[1] | sets[2])
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sum(r.component_id == 0 for r in got) == len(rows)


def test_pairs_with_first_texts_are_candidates(spark):
    sets = nd.signatures(spark.createDataFrame(star(60), "doc_id long, text string"), 5)
    rows = nd.forest(sets.select("id", "signature"))
    _, every, crowds = nd.candidates(rows, 24)
    nodes = {}
    for r in crowds.collect():
        nodes.setdefault((r.tree, bytes(r.node)), []).append(r.id)
    assert nodes and {(min(ids), i) for ids in nodes.values() for i in ids if i > min(ids)} <= {(r.a, r.b) for r in every.collect()}


def test_repeated_ids_with_different_texts(spark):
    word = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(3, word("a")), (9, word("a") + " end"), (9, word("b")), (12, word("b") + " end"), (12, word("c"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = brute(rows, 5)
    assert sorted(map(tuple, nd.near_duplicates(docs).collect()), key=str) == want
    assert sorted(tuple(r) for r in nd.keep_first(docs).collect()) == sorted([rows[0], rows[2], rows[4]])


def test_components_joined_by_further_links(spark):
    from fieldstone.llm.graph import components, joined

    r = random.Random(12)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(25)]
    more = [(r.randrange(80), r.randrange(80)) for _ in range(25)] + [(3, 3)]
    root = list(range(80))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links + more:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = {x.node: x.component for x in joined(components(frame(links)), frame(more)).collect()}
    assert all(c == find(n) for n, c in got.items()) and all(find(n) == n for n in range(80) if n not in got)
    assert {n for link in links + more for n in link if link[0] != link[1]} <= set(got)
