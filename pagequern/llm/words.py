"""Words of whole Arrow batches as 64-bit hashes, without a Python call per word.

A word is a maximal run of letters and digits; letter case is folded.  The hash
of a word is a polynomial over its code points modulo 2**64, taken from prefix
sums, then mixed.  Equal words have equal hashes in every batch.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
MASK = (1 << 64) - 1
INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))


@functools.lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(letter or digit, lower case) by code point."""
    alnum = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LN":
            alnum[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return alnum, lower


_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the next batch."""
    old = _powers.get(int(base))
    if old is None or len(old) <= n:
        p = np.full(max(n + 1, 1 << 16), base, np.uint64)
        p[0] = 1
        old = _powers[int(base)] = np.cumprod(p, dtype=np.uint64)
    return old


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def find(cp: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, hash) of every word; no word crosses a position in breaks."""
    alnum, lower = tables()
    is_word = np.zeros(len(cp) + 1, bool)
    is_word[:-1] = alnum[cp]
    turn = np.zeros(len(cp) + 1, bool)
    turn[0] = is_word[0] if len(cp) else False
    turn[1:] = is_word[1:] != is_word[:-1]
    cut = breaks[(breaks > 0) & (breaks < len(cp))]
    cut = cut[is_word[cut] & is_word[cut - 1]]
    edge = np.flatnonzero(turn)
    first, end = edge[0::2], edge[1::2]
    if len(cut):
        cut = np.unique(cut)
        first = np.sort(np.concatenate([first, cut]))
        end = np.sort(np.concatenate([end, cut]))
    n = len(cp)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(lower[cp].astype(np.uint64) * _power(MULT, n)[:n], out=total[1:])
    h = (total[end] - total[first]) * _power(INVERSE, n)[first]
    return first, end, mix(h + (end - first).astype(np.uint64))
