import random
import zlib

import numpy as np
import pytest

from fieldstone.llm import token_files as tf
from fieldstone.llm.vocabularies import tokenizer_path
from fieldstone.llm.word_encoder import WordEncoder
from fieldstone.shared import shared_path

PATH = tokenizer_path("word_bpe_49k.json")
CHARS = ["a", "The", "don't", "'ve", "'s", " ", " ", "\n", "é", "é", "́", "\xa0", " ", "Σ", "ß", "日本", "1", "23", "!?", "<|endoftext|>", "\x00", "\x1c", "\x85", "İ", "😀", "ﬁ", "\t\x0b", "'", "Écôle,", "ÿ's", "straße.", "µ", "ª", "×", "÷", "²", "à1b", "x'", "LL'", "ÀÉ'LL"]


def texts(n=300):
    r = random.Random(1)
    return ["", " ", "x", *["".join(r.choice(CHARS) for _ in range(r.randrange(60))) for _ in range(n)], "word " * 20000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("cache", [250_000, 7])
def test_encoder_equals_library(library, cache):
    mine = WordEncoder(PATH, cache)
    all_texts = texts()
    for i in range(0, len(all_texts), 20):
        part = all_texts[i : i + 20]
        for t, ids in zip(part, mine.encode([x.encode() for x in part]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_files_round_trip(spark, library, tmp_path):
    r = random.Random(2)
    rows = [(i, t, "x") for i, t in enumerate(texts(150))] + [(7, "again", "y"), (7, None, "y"), (None, "no id", "z")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)
    path = shared_path(spark, "t")
    tf.write_tokens(docs, path, PATH, part_bytes=20_000)
    got = tf.with_starts(tf.checksums(spark, path), spark, path).orderBy("seq").collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.setdefault(i, []).append((len(ids) // 4, zlib.crc32(ids)))
    assert [x.id is None for x in got] == [True] + [False] * (len(got) - 1)
    assert [x.id for x in got[1:]] == sorted(x.id for x in got[1:])
    at, have = 0, {}
    for x in got:
        assert x.start == at
        at += x.n_tokens
        have.setdefault(x.id, []).append((x.n_tokens, x.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    some = tf.read_tokens(spark, path, 3, 6).orderBy("id").collect()
    assert [x.id for x in some] == [3, 4, 5] and some[0].tokens[-1] == 1


def test_format_has_delta_pages_and_indexes(spark):
    import glob

    import pyarrow.parquet as pq

    path = shared_path(spark, "t")
    tf.write_tokens(spark.createDataFrame([(i, f"some words {i}") for i in range(500)], "doc_id long, text string"), path, PATH)
    meta = pq.ParquetFile(glob.glob(path.removeprefix("file://") + "/*.parquet")[0]).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    tokens = columns["tokens.list.element"]
    assert "DELTA_BINARY_PACKED" in tokens.encodings and not tokens.has_dictionary_page
    assert tokens.has_offset_index and columns["id"].has_column_index


def test_empty(spark):
    path = shared_path(spark, "t")
    tf.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert tf.with_starts(tf.checksums(spark, path), spark, path).count() == 0


def bytes_read(spark, df):
    """Bytes that a read of the frame takes from local files."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem
    count = lambda: sum(s.getBytesRead() for s in files.getAllStatistics() if s.getScheme() == "file")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.hadoop.vectored.io.enabled", "false")  # else reads are not counted
    before = count()
    df.write.format("noop").mode("overwrite").save()
    return count() - before


def test_range_and_metadata_reads_skip_token_pages(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(tf, "FORMAT", tf.FORMAT | {"parquet.block.size": str(2 << 20), "parquet.page.row.count.limit": "500"})
    r = random.Random(5)
    words = [f"word{k}" for k in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=200))) for i in range(8000)]
    path = shared_path(spark, "t")
    tf.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH)
    (file,) = glob.glob(path.removeprefix("file://") + "/*.parquet")
    assert pq.ParquetFile(file).metadata.num_row_groups > 1
    whole = bytes_read(spark, tf.read_tokens(spark, path))
    assert bytes_read(spark, tf.read_tokens(spark, path, tokens=False)) < 0.1 * whole
    assert bytes_read(spark, tf.read_tokens(spark, path, 4000, 4010)) < 0.25 * whole
    got = tf.read_tokens(spark, path, 4000, 4010).collect()
    assert sorted(x.id for x in got) == list(range(4000, 4010))
