"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation: code points become classes (letter, number, other, space, other white space) by a table; looking one
to three characters ahead, by shifted arrays, marks white space before a word and apostrophes that begin a
contraction. A nine-state automaton over these symbols tells where the split pattern's matches begin. Its transition
functions compose associatively: blocks of symbols are composed at the same time for all blocks, the blocks' functions
are prefix-composed by doubling, and a last pass walks all blocks from their true first states. Texts of a batch are
scanned together, with a resetting symbol between them.

Pair merging: each distinct slice between boundaries is looked up once in a cache, which a Python worker keeps from
task to task; those missing are merged together, one merge per slice and round, always the leftmost pair of the lowest
rank. Long slices use a heap instead.

Token byte offsets follow from the lengths of the tokens' bytes and are kept beside the ids; decoding joins the
tokens' bytes.

Defined cases: a null text counts as empty and has no ids; bytes that are not UTF-8 are replaced as Python replaces
them; a null id column is carried through; rows that repeat are encoded alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from collections.abc import Callable
from functools import cache as kept

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldstone.llm.arrow import Halves, as_bytes, gathered, map_batches

#: White space of the split pattern, and its contractions.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# Symbols. SPACE and WHITESPACE are followed by more white space or the end, SPACE_LAST and WHITESPACE_LAST by a word.
OTHER, LETTER, NUMBER, SPACE, WHITESPACE, SPACE_LAST, WHITESPACE_LAST, QUOTE_1, QUOTE_2, RESET, SAME = range(11)
# States: what the last character belongs to. TAIL_1 and TAIL_2: characters of a contraction still to come.
START, IN_LETTER, IN_NUMBER, IN_OTHER, JOINING, IN_WHITE, TAIL_1, TAIL_2, TAIL_END = range(9)
STATES = 9
BLOCK = 128


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a match begins here) by symbol and state."""
    then, begins = np.zeros((11, STATES), np.int16), np.zeros((11, STATES), bool)
    for s in range(STATES):
        then[LETTER, s], begins[LETTER, s] = {TAIL_1: TAIL_END, TAIL_2: TAIL_1}.get(s, IN_LETTER), s not in (IN_LETTER, JOINING, TAIL_1, TAIL_2)
        then[NUMBER, s], begins[NUMBER, s] = IN_NUMBER, s not in (IN_NUMBER, JOINING)
        then[OTHER, s], begins[OTHER, s] = IN_OTHER, s not in (IN_OTHER, JOINING)
        for symbol, tail in ((QUOTE_1, TAIL_1), (QUOTE_2, TAIL_2)):
            inside = s in (IN_OTHER, JOINING)
            then[symbol, s], begins[symbol, s] = IN_OTHER if inside else tail, not inside
        for symbol in (SPACE, WHITESPACE):
            then[symbol, s], begins[symbol, s] = IN_WHITE, s != IN_WHITE
        then[SPACE_LAST, s], begins[SPACE_LAST, s] = JOINING, True
        then[WHITESPACE_LAST, s], begins[WHITESPACE_LAST, s] = IN_WHITE, True
        then[RESET, s], begins[RESET, s] = START, True
        then[SAME, s] = s
    return then, begins


THEN, BEGINS = _automaton()


def scan(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, starting from START, by an associative scan of transition functions."""
    n = len(symbols)
    blocks = max(1, -(-n // BLOCK))
    padded = np.full(blocks * BLOCK, SAME, np.int16)
    padded[:n] = symbols
    rows = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) * np.int16(STATES)
    flat = THEN.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.int16), (blocks, 1))
    for row in rows:  # the function of each block, all blocks at once
        maps = flat.take(maps + row[:, None])
    step = 1
    while step < blocks:  # prefix composition of the blocks' functions
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.int16)
    before = np.empty((BLOCK, blocks), np.int16)
    for k, row in enumerate(rows):
        before[k] = state
        state = flat.take(row + state)
    return before.T.reshape(-1)[:n]


def class_table() -> np.ndarray:
    """OTHER, LETTER, NUMBER, SPACE or WHITESPACE of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.int16, 0x110000)
    table[WHITE] = WHITESPACE
    table[32] = SPACE
    return table


def symbols_of(points: np.ndarray, table: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Symbols of code points. resets: positions that stand between texts."""
    out = table[points]
    white = (out == SPACE) | (out == WHITESPACE)
    white[resets] = True
    out[:-1] += np.where(white[:-1] & ~white[1:], SPACE_LAST - SPACE, 0).astype(np.int16)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        ahead = np.concatenate([points, [0, 0]])
        first, second = ahead[quotes + 1], ahead[quotes + 2]
        for c in CONTRACTIONS:
            hit = first == ord(c[0])
            if len(c) == 2:
                hit &= second == ord(c[1])
            out[quotes[hit]] = QUOTE_1 if len(c) == 1 else QUOTE_2
    out[resets] = RESET
    return out


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, cache: int = 120_000, long: int = 48):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, merged = array("q"), array("q")
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append(a << 20 | b)
                    merged.append(rank)
        keys, values = np.frombuffer(pairs, np.int64), np.frombuffer(merged, np.int64)
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], 1 << 62), np.append(values[order], 0)
        self.none = 1 << 40
        self.table = class_table()
        self.long, self.known = long, Halves(cache)

    def cut(self, texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
        """(the pre-tokens of all texts, each text followed by a separator; the number of each separator)."""
        joined = "\0".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # of the texts, in code points
        symbols = symbols_of(points, self.table, ends)
        starts = np.flatnonzero(BEGINS[symbols, scan(symbols)])
        at = np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), dtype=np.int32)
        offsets = np.concatenate([np.where(starts > 0, at[starts - 1], 0), at[-1:]]).astype(np.int32)
        data = joined.encode("utf-8", "surrogatepass")
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(starts, ends)

    def slices(self, texts: list[str]) -> list[list[bytes]]:
        """The pre-tokens of each text."""
        found, ends = self.cut(texts)
        found, last = found.to_pylist(), [0, *(ends + 1).tolist()]
        return [found[a:b] for a, b in zip(last, ends.tolist(), strict=False)]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], self.none)

    def _merge_long(self, piece: bytes) -> list[int]:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pair = lambda i: self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[after[i]]]) if after[i] < n else None
        heap = [(r, i) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or pair(i) != rank:
                continue
            gone = after[i]
            ids[i], alive[gone], after[i] = rank, False, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = [rank]
            elif len(p) > self.long:
                out[i] = self._merge_long(p)
            else:
                todo.append(i)
        if not todo:
            return out
        sizes = np.array([len(pieces[i]) for i in todo])
        ids = self.single[np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)]
        owner = np.repeat(np.arange(len(todo)), sizes)
        rank = np.full(len(ids), self.none)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._lookup(ids[inner], ids[inner + 1])
        while True:
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, first)
            width = np.diff(np.append(first, len(ids)))
            done = least == self.none
            if done.any():
                over = np.repeat(done, width)
                got, whose = ids[over].tolist(), owner[first[done]].tolist()
                at = 0
                for w, n in zip(whose, width[done].tolist(), strict=True):
                    out[todo[w]] = got[at : at + n]
                    at += n
                ids, owner, rank = ids[~over], owner[~over], rank[~over]
                if not len(ids):
                    return out
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                least, width = least[~done], width[~done]
            hits = np.flatnonzero(rank == np.repeat(least, width))
            leftmost = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
            ids[leftmost] = least
            keep = np.ones(len(ids), bool)
            keep[leftmost + 1] = False
            place = np.cumsum(keep) - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            at = place[leftmost]
            for k in (at - 1, at):  # the pairs that have a new token
                k = k[(k >= 0) & (k < len(ids))]
                same = np.zeros(len(k), bool)
                inside = k + 1 < len(ids)
                same[inside] = owner[k[inside]] == owner[k[inside] + 1]
                rank[k[~same]] = self.none
                rank[k[same]] = self._lookup(ids[k[same]], ids[k[same] + 1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        found, ends = self.cut(texts)
        found = found.dictionary_encode()
        learn = lambda pieces: [array("I", ids).tobytes() for ids in self.merge(pieces)]
        ids, edges = gathered(self.known.values(found.dictionary.to_pylist(), learn), found.indices.to_numpy())
        begins, data = [0, *(4 * edges[ends[:-1] + 1]).tolist()], ids.tobytes()
        return [data[a:b] for a, b in zip(begins, (4 * edges[ends]).tolist(), strict=True)]

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offsets of the tokens' ends in the text."""
        return np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@kept
def encoder_of(path: str) -> ByteBPE:
    """The encoder of a Python worker: later tasks of the same worker find its cache filled."""
    return ByteBPE(path)


def _texts(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in as_bytes(column)]


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, tokens, ends (byte offset of each token's end)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        bpe = encoder_of(ranks)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = bpe.encode(_texts(batch.column(1)))
            lists = [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array([bpe.offsets(x) for x in ids], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([batch.column(0), *lists], [id_col, "tokens", "ends"])

        return run

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, tokens array<int>, ends array<long>", text_col, 2 << 20)


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id") -> DataFrame:
    """id and the text that the tokens stand for."""

    def run(batches):
        bpe = encoder_of(ranks)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.select(id_col).schema[0].dataType.simpleString()
    return encoded.select(id_col, "tokens").mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids again, in one pass: id, n_tokens, ids_sha256, decoded_sha256."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        bpe = encoder_of(ranks)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = bpe.encode(_texts(batch.column(1)))
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(bpe.decode(x)) for x in ids], pa.string())]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

        return run

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", text_col, 2 << 20)
