"""A tokenizers-library encoder with a cache of pre-tokens.

The vocabulary's pre-tokenizer drops white space and its merges never cross it, so the ids of a text are those of its
words in turn. A batch of texts is cut by array operations over its bytes. Texts of printable ASCII, ASCII white space
and accented Latin-1 letters are lower-cased and cut into the library's own pre-tokens, as their characters are
normalised already and have one-to-one lower-case forms. Other texts, and those that hold the string of an added token,
are cut at ASCII white space only, and what else their words hold is left to the library. Each distinct piece of a
batch is looked at once: those that are not in the cache are encoded by the library, and the ids of all pieces are
gathered by their numbers.
"""

from __future__ import annotations

import json
import os
from array import array
from dataclasses import dataclass
from functools import cache as kept

import numpy as np
import pyarrow as pa

from fieldstone.llm.arrow import Halves, gathered

#: How the vocabulary normalises texts and cuts them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT_TAILS, LONG_TAILS = b"stmd", (b"re", b"ve", b"ll")
#: Entries of either half of a cache.
CACHE = 250_000
#: Strings that the library gets in one call.
TOGETHER = 4096

SPACE, LETTER, DIGIT, MARK = range(4)
_kind = np.full(256, MARK, np.uint8)
_kind[[32, *range(9, 14)]] = SPACE
_kind[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = LETTER
_kind[48:58] = DIGIT
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
#: Bytes of characters that the library must normalise; a continuation byte after 0xC3 is none but for those of the signs × and ÷.
_odd = np.array([b < 9 or 13 < b < 32 or b == 127 or b >= 128 and b != 0xC3 for b in range(256)])
_latin = np.array([0x80 <= b < 0xC0 and b not in (0x97, 0xB7) for b in range(256)])


@dataclass
class Encoded:
    """Ids of some texts in turn, and the pieces that they come from; each text has its range of ids and of pieces."""

    ids: np.ndarray
    text_ids: np.ndarray  # the first id of each text, and the number of ids
    at: np.ndarray  # byte offset of each piece in its text
    piece_ids: np.ndarray  # the first id of each piece, and the number of ids
    text_pieces: np.ndarray


def cut(data: np.ndarray, edge: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, folded bytes, whether a byte is no space) of the pieces of texts that each end in a line end.

    edge: where each text begins, and the end; other: texts whose words are not cut.
    """
    kind, folded = _kind[data], _fold[data]
    after = np.concatenate([[False], data[:-1] == 0xC3])
    folded[after & (data < 0x9F) & (data != 0x97)] += 32
    word = kind != SPACE
    begin = word.copy()
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    for i in np.flatnonzero(begin & (data == 39)).tolist():
        size = 2 if folded[i + 1] in SHORT_TAILS else 3 if folded[i + 1 : i + 3].tobytes() in LONG_TAILS else 0
        if size:
            begin[i + 1] = False
            begin[i + size] |= kind[i + size] == LETTER
    first = word.copy()
    first[1:] &= ~word[:-1]
    if other.any():
        whole = np.repeat(other, np.diff(edge))
        begin, folded = np.where(whole, first, begin), np.where(whole, data, folded)
    last = np.concatenate([[False], word[:-1] & ~word[1:]])
    edges = np.flatnonzero(begin | last)
    starting = begin[edges]
    return edges[starting], edges[1:][starting[:-1]], folded, word


class WordEncoder:
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.content.split() != [t.content] for t in added):
            raise ValueError("added tokens that reach beyond a word are not supported")
        self.added = [t.content.encode() for t in added]
        spec = json.loads(self.tokenizer.to_str())
        self.cuts = (
            (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == PATTERN
        )
        self.pieces = Tokenizer(self.tokenizer.model)  # for what is normalised and cut already
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known = {self.pieces: Halves(cache), self.tokenizer: Halves(cache)} if self.cuts else {self.tokenizer: Halves(cache)}

    def _other(self, texts: list[bytes], data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Texts whose words the library must normalise and cut."""
        if not self.cuts:
            return np.ones(len(texts), bool)
        odd = _odd[data]
        odd[1:] &= ~((data[:-1] == 0xC3) & _latin[data[1:]])
        out = np.zeros(len(texts), bool)
        out[np.searchsorted(edge, np.flatnonzero(odd), "right") - 1] = True
        for a in self.added:
            out |= np.fromiter((a in t for t in texts), bool, len(texts))
        return out

    def _values(self, pieces: pa.BinaryArray, library) -> tuple[np.ndarray, list[bytes]]:
        """(number of each piece's value, values)"""

        def learn(keys: list[bytes]) -> list[bytes]:
            out = []
            for k in range(0, len(keys), TOGETHER):
                strings = [x.decode("utf-8", "replace") for x in keys[k : k + TOGETHER]]
                out += [array("I", e.ids).tobytes() for e in library.encode_batch_fast(strings, add_special_tokens=False)]
            return out

        found = pieces.dictionary_encode()
        return found.indices.to_numpy(), self.known[library].values(found.dictionary.to_pylist(), learn)

    def encode_all(self, texts: list[bytes]) -> Encoded:
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
        other = self._other(texts, data, edge)
        starts, ends, folded, word = cut(data, edge, other)
        text_pieces = np.searchsorted(starts, edge)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(folded[word])])
        whole = np.repeat(other, np.diff(text_pieces))
        number, values = np.empty(len(starts), np.int64), []
        for library, rows in ((self.pieces, np.flatnonzero(~whole)), (self.tokenizer, np.flatnonzero(whole))):
            if len(rows):
                some, more = self._values(pieces if len(rows) == len(starts) else pieces.take(pa.array(rows)), library)
                number[rows] = some + len(values)
                values += more
        ids, piece_ids = gathered(values, number)
        at = starts - np.repeat(edge[:-1], np.diff(text_pieces))
        return Encoded(ids, piece_ids[text_pieces], at, piece_ids, text_pieces)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        if not texts:
            return []
        found = self.encode_all(texts)
        data, edge = found.ids.tobytes(), (4 * found.text_ids).tolist()
        return [data[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


@kept
def encoder_of(path: str) -> WordEncoder:
    """The encoder of a Python worker: later tasks of the same worker find its cache filled."""
    return WordEncoder(path)
