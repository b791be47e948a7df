import random

import numpy as np
import pytest

from fieldstone.llm import token_counts as tc
from fieldstone.llm.vocabularies import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encode_with(library, calls):
    def encode(text):
        calls.append(len(text))
        e = library.encode(text, add_special_tokens=False)
        return np.asarray(e.ids, np.int64), np.asarray([a for a, _ in e.offsets], np.int64)

    return encode


PARTS = ["the", "The'll", " ", " ", "\n", "é", "é", "日本語", "123", "!?", "<|endoftext|>", "\xa0", "ing", "'s", "  "]


@pytest.mark.parametrize("chunk,overlap", [(50, 8), (40, 3), (200, 40)])
def test_chunks_equal_whole(library, chunk, overlap):
    r = random.Random(chunk)
    for k in range(150):
        spaces = [" "] * (k % 4)
        text = "".join(r.choice(PARTS + spaces if k % 5 else ["ab", "é", "x1"]) for _ in range(r.randrange(250)))
        ids, _ = tc.chunked_ids(text, encode_with(library, []), chunk, overlap)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_overlap_widens_where_it_must(library):
    text = "one two " * 20 + "x" * 300 + " three four" * 20
    ids, widened = tc.chunked_ids(text, encode_with(library, []), 100, 10)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and widened > 0
    assert tc.chunked_ids("one two " * 200, encode_with(library, calls := []), 100, 20)[1] == 0 and max(calls) <= 140


def test_counts(spark, library):
    r = random.Random(9)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randrange(400)))) for i in range(120)] + [(5, None), (None, ""), (6, "a b " * 30000), (7, "q" * 5000)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_tokens int")
    got = tc.count_tokens(docs, PATH, chunk=200, overlap=20).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0
