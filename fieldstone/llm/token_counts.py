"""Token counts by overlap resynchronisation.

Every text is cut into chunks of `chunk` bytes that overlap by `overlap` bytes; a text that one chunk covers has that
chunk alone. All chunks of a batch are encoded together, each token with the offset of the piece that it comes from.
Two neighbouring chunks are spliced at a position in their overlap where both have a token start, that follows ASCII
white space, and from which both give the same ids up to the last such position. No token of these vocabularies spans
white space, so all tokens before such a position are whole in the first chunk and all from it on are whole in the
second: the splice is exact. If an overlap has no such position, the first chunk is encoded again with an overlap
twice as wide, and in the end takes in the whole of its neighbour, so a text without white space is encoded as one.

Defined cases: a null text counts as empty and has no tokens; a null id is carried through; rows that repeat are
counted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldstone.llm.arrow import as_bytes, map_batches
from fieldstone.llm.word_encoder import WordEncoder, encoder_of

#: Fixed value: the white space that a splice follows.
SPACE = frozenset(" \t\n\x0b\x0c\r") | frozenset(b" \t\n\x0b\x0c\r")

Tokens = tuple[np.ndarray, np.ndarray]  # ids, and where in the text the token, or the piece that has it, starts
Span = tuple[int, int]


def stable_start(text: str | bytes, first: Tokens, second: Tokens, low: int, high: int) -> int | None:
    """The first position from low and below high where the encodings of two chunks can be spliced."""
    inside = lambda starts: starts[np.searchsorted(starts, low) : np.searchsorted(starts, high)]
    common = [p for p in np.intersect1d(inside(first[1]), inside(second[1])).tolist() if p and text[p - 1] in SPACE]
    if not common:
        return None
    between = lambda e, p: e[0][np.searchsorted(e[1], p) : np.searchsorted(e[1], common[-1])]
    return next((p for p in common if np.array_equal(between(first, p), between(second, p))), None)


def spans(text: str | bytes, chunk: int, overlap: int) -> list[Span]:
    """Where the chunks of a text begin and end; of bytes, never inside a character."""
    n = len(text)

    def edge(p: int) -> int:
        while isinstance(text, bytes) and 0 < p < n and text[p] & 0xC0 == 0x80:
            p -= 1
        return min(p, n)

    return [(edge(a), edge(a + chunk + overlap)) for a in range(0, max(1, n - overlap), chunk)]


def splices(text: str | bytes, chunks: list[Span], at: Callable[[int, int], Tokens], overlap: int) -> Iterator[tuple[np.ndarray, int]]:
    """Ids of the text, from one chunk after the other, and how often its overlap was widened."""
    begin, end = chunks[0]
    current, widened = at(begin, end), 0
    for start, stop in chunks[1:]:
        following, wide = at(start, stop), overlap
        splice = stable_start(text, current, following, start, end)
        while splice is None and end < stop:
            wide *= 2
            widened += 1
            end = min(stop, start + wide)
            current = at(begin, end)
            splice = stable_start(text, current, following, start, end)
        if splice is None:  # the first chunk has taken in the second
            continue
        yield current[0][: np.searchsorted(current[1], splice)], widened
        keep = np.searchsorted(following[1], splice)
        begin, end, widened, current = splice, stop, 0, (following[0][keep:], following[1][keep:])
    yield current[0], widened


def chunked_ids(text: str, encode: Callable[[str], Tokens], chunk: int, overlap: int) -> tuple[np.ndarray, int]:
    """Ids of the text from overlapping chunks, and how often an overlap was widened. encode: ids and starts of a string."""

    def at(a: int, b: int) -> Tokens:
        ids, starts = encode(text[a:b])
        return ids, starts + a

    ids, widened = zip(*splices(text, spans(text, chunk, overlap), at, overlap), strict=True)
    return np.concatenate(ids), sum(widened)


def encoded_spans(texts: list[bytes], encoder: WordEncoder) -> list[Tokens]:
    """Ids and starts of each text."""
    found = encoder.encode_all(texts)
    starts = np.repeat(found.at, np.diff(found.piece_ids))
    edge = found.text_ids.tolist()
    return [(found.ids[a:b], starts[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def chunked_counts(texts: list[bytes], encoder: WordEncoder, chunk: int, overlap: int) -> tuple[list[int], list[int], list[int]]:
    """(tokens, chunks, widened overlaps) of each text; the chunks of all texts are encoded together."""
    cuts = [spans(t, chunk, overlap) for t in texts]
    tokens = iter(encoded_spans([t[a:b] for t, chunks in zip(texts, cuts, strict=True) for a, b in chunks], encoder))
    counts, wider = [], []
    for text, chunks in zip(texts, cuts, strict=True):
        if len(chunks) == 1:
            counts.append(len(next(tokens)[0]))
            wider.append(0)
            continue
        ready = {(a, b): (ids, starts + a) for (a, b), (ids, starts) in zip(chunks, tokens, strict=False)}

        def at(a: int, b: int, text: bytes = text, ready: dict[Span, Tokens] = ready) -> Tokens:
            if (a, b) not in ready:
                while b < len(text) and text[b] & 0xC0 == 0x80:
                    b -= 1
                (ids, starts), *_ = encoded_spans([text[a:b]], encoder)
                return ids, starts + a
            return ready[a, b]

        found = list(splices(text, chunks, at, overlap))
        counts.append(sum(len(ids) for ids, _ in found))
        wider.append(sum(w for _, w in found))
    return counts, [len(c) for c in cuts], wider


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk: int = 4096, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit, chunks, widened."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        encoder = encoder_of(tokenizer)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            counts, chunks, widened = (np.array(x, np.int64) for x in chunked_counts(texts, encoder, chunk, overlap))
            sizes = np.array([len(t) for t in texts], np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (sizes, counts, counts > limit, chunks, widened))], [id_col, "n_bytes", "n_tokens", "over_limit", "chunks", "widened"])

        return run

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, chunks long, widened long", text_col, 4 << 20)
