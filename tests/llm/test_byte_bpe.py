import base64
import hashlib
import random

import numpy as np
import pytest

from fieldstone.llm import byte_bpe as bb
from fieldstone.llm.vocabularies import split_pattern, tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return bb.ByteBPE(PATH)


PARTS = ["a", "The", "don", "'", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'S", "s", "l", " ", " ", "  ", "\n", "\t", "\xa0", " ", "é", "é", "́", "日本", "1", "²", "Ⅷ", "!?", "\0", "\x1c", "\x85", "😀", "🇩🇪", "ß", "İ", "===", "\r\n", "نص", "ไทย"]


def texts(n, seed=0):
    r = random.Random(seed)
    return ["", " ", "  ", "'", "'s", " 's", "x's", "x 's", "\n's", "  x", "\n\nx", " \nx", "x  ", "'''s", "'s's", "'sam", "1's", "!'s", *["".join(r.choice(PARTS) for _ in range(r.randrange(50))) for _ in range(n)]]


def test_slices_are_the_pattern_s_matches(bpe):
    import regex

    all_texts = texts(3000)
    for i in range(0, len(all_texts), 97):
        part = all_texts[i : i + 97]
        for t, got in zip(part, bpe.slices(part), strict=True):
            assert [x.decode("utf-8", "surrogatepass") for x in got] == regex.findall(split_pattern(), t), repr(t)


def test_scan_is_the_walk():
    r = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        symbols = r.integers(0, 10, n).astype(np.int16)
        state, want = bb.START, []
        for s in symbols:
            want.append(state)
            state = bb.THEN[s, state]
        assert bb.scan(symbols).tolist() == want


@pytest.mark.parametrize("cache,long", [(200_000, 48), (5, 3)])
def test_ids_are_the_library_s(library, cache, long):
    mine = bb.ByteBPE(PATH, cache, long)
    all_texts = texts(1500, 4) + ["word" * 500, "=" * 3000, "aab" * 40, "x" * 47, " ".join("inter" * k for k in range(30))]
    for i in range(0, len(all_texts), 50):
        part = all_texts[i : i + 50]
        for t, ids in zip(part, mine.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t), repr(t)
            assert mine.decode(ids) == t.encode()


def test_frame_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(100, 6))] + [(3, None), (None, "x y"), (4, "long text " * 5000)]
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, tokens string").repartition(3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := library.encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t in rows]
    assert sorted(map(tuple, bb.round_trip(docs, PATH).collect()), key=str) == sorted(want, key=str)
    encoded = bb.encode(docs, PATH)
    for r in encoded.filter("doc_id = 4").collect():
        assert len(r.tokens) == len(r.ends)
    assert sorted(((r.doc_id, r.text) for r in bb.decode(encoded, PATH).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert bb.round_trip(docs.limit(0), PATH).count() == 0
