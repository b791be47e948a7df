import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from fieldstone.llm.vocabularies import split_pattern, tokenizer_path  # noqa: E402
from tests.llm import test_near_dedup as near  # noqa: E402
from tests.llm import test_quality as rules  # noqa: E402


def brute(rows):
    """ids that stay after the first three stages, from rows of (doc_id, text, ...)."""
    kept = []
    for r in rows:
        words, _, symbols, _, again = rules.brute(r[1])
        if words >= 10 and 100 * again <= 20 * words:
            kept.append(r)
    first = {}
    for r in sorted(kept):
        first.setdefault(" ".join(rules.WORD.findall(r[1])), r)
    kept = list(first.values())
    return sorted(k for k, _, _, keep in near.brute([r[:2] for r in kept], 5) if keep)


def test_stages_against_brute_force(spark, tmp_path):
    import base64

    import tiktoken

    rows = [(k, t, "en", f"s{(k or 0) % 4}", 1) for k, t in near.corpus(11, 40) if k is not None]
    rows += [(10**7 + i, rows[i][1], "en", "s9", 1) for i in range(0, len(rows), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen.columns == docs.columns
        if name == "near_dedup":
            assert sorted(r.doc_id for r in seen.collect()) == brute(rows)
    texts = {r[0]: r[1] for r in rows}
    with open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {k: len(rules.WORD.findall(texts[k])) for k in brute(rows)}
    taken = Counter(r.doc_id for r in out)
    assert set(taken) <= set(sizes) and max(taken.values()) <= 2
    assert sum(sizes[k] * n for k, n in taken.items()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.1)
    for r in out:
        assert r.ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_long_texts_and_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, digest string, id string, hash long, copies int, key string"
    good = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(30)]
    rows = [(i, t, "en", "s", 1, 1, "d", "i", 5, 9, "k") for i, t in enumerate(good)]
    rows += [(50, None, None, None, None, None, None, None, None, None, None), (None, good[3], "en", None, None, 2, "d", "i", 5, 9, "k"), (51, "", "en", "s", 0, 1, "d", "i", 5, 9, "k")]
    rows += [(None, "a text of its own " + " ".join(f"z{k}" for k in range(60_000)), None, None, None, 3, None, None, None, None, None), rows[2], rows[2]]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == [x.split()[0] for x in schema.split(", ")]
        found = [tuple(r) for r in seen.collect()]
        assert set(found) <= set(rows)
        if name == "near_dedup":
            assert sorted((r[0] is None, r[0] or 0) for r in found) == [(False, i) for i in range(30)] + [(True, 0)]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {*range(30), None}
