"""Word-shingle sets of texts, as 64-bit hashes, by array operations over whole batches."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the polynomial over a word's bytes and of the words of a shingle.
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BYTE_BASE, -1, 1 << 64)
WORD_BASE = 0xD6E8FEB86659FD93

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
#: Bytes of words whose sums are taken together; a longer word stands alone.
SEGMENT = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_up, _down = _powers(BYTE_BASE, SEGMENT), _powers(INVERSE, SEGMENT)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words before each text and after the last), A-Z lower-cased."""
    data = _lower[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    space = _space[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes, i = np.empty(len(begin), np.uint64), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + SEGMENT, "right")))
        first, n = begin[i], int(end[j - 1] - begin[i])
        up, down = (_up[:n], _down) if n <= SEGMENT else (_powers(BYTE_BASE, n), _powers(INVERSE, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[first : first + n].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        hashes[i:j] = (sums[end[i:j] - first] - sums[begin[i:j] - first]) * down[begin[i:j] - first]
        i = j
    hashes = mix(hashes)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(begin, at)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of a text with fewer words, its whole sequence as one."""
    words, at = word_hashes(texts)
    n = max(0, len(words) - width + 1)
    rolled = np.full(n, 1, np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(WORD_BASE) + words[k : k + n])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            one = np.full(1, 1 + b - a, np.uint64)
            for w in words[a:b]:
                one = mix(one * np.uint64(WORD_BASE) + w)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)
