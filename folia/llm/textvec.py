"""Vectorised words: word bounds and 64-bit word hashes of many UTF-8 texts at once, straight from Arrow buffers.

Word classes are given by ASCII bytes (every byte of a multi-byte character falls in the same class), so a
byte table finds the same words as the corresponding regular expression on code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import splitmix

U = np.uint64
_SEP = [0x20, *range(0x09, 0x0E)]
#: ``[^\x20\x09-\x0D]+``
NON_SPACE = np.array([b not in _SEP for b in range(256)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, every non-ASCII character
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BYTES = np.array([splitmix(b + 1) for b in range(256)], U)
_BYTES_LOWER = _BYTES[LOWER]
_P = 0x9FB21C651E98DF25
_IP = pow(_P, -1, 1 << 64)
_BLOCK = 1 << 19
_pw: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pw or len(_pw[0]) < n:
        size = max(n, _BLOCK + 4096)
        _pw[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, q, U)])) for q in (_P, _IP)]
    return _pw[0], _pw[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


@dataclass
class Words:
    """Words of documents: byte bounds in ``data``, counts and first word of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    count: np.ndarray  # per document
    first: np.ndarray  # n + 1 word offsets per document

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def bytes(self, i: int, j: int, lower: bool = False) -> bytes:
        """Words i to j - 1, joined by one space."""
        data, s, e = self.data, self.start, self.end
        out = b" ".join([data[s[k] : e[k]].tobytes() for k in range(i, j)])
        return out.translate(LOWER.tobytes()) if lower else out


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """``offsets``: of n + 1 documents in ``data``. A word never crosses documents."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    on = np.zeros(hi - lo + 2, bool)
    on[1:-1] = is_word[data[lo:hi]]
    begin = on[1:-1] & ~on[:-2]
    stop = on[1:-1] & ~on[2:]
    inner = offsets[1:-1] - lo
    inner = inner[(inner > 0) & (inner < hi - lo)]
    begin[inner] = on[1:-1][inner]
    stop[inner - 1] = on[1:-1][inner - 1]
    start, end = np.flatnonzero(begin) + lo, np.flatnonzero(stop) + lo + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, np.diff(first), first)


def word_hashes(w: Words, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes (A-Z lower-cased if asked), block by block."""
    n = len(w)
    out = np.empty(n, U)
    codes = _BYTES_LOWER if lower else _BYTES
    i = 0
    while i < n:
        a = int(w.start[i])
        j = max(i + 1, int(np.searchsorted(w.end, a + _BLOCK, "right")))
        z = int(w.end[j - 1])
        pw, ipw = _powers(z - a + 1)
        s = np.zeros(z - a + 1, U)
        np.cumsum(codes[w.data[a:z]] * pw[: z - a], out=s[1:])
        at = w.start[i:j] - a
        out[i:j] = (s[w.end[i:j] - a] - s[at]) * ipw[at]
        i = j
    out += (w.end - w.start).astype(U)
    return mix(out)


_Q = U(0xC2B2AE3D27D4EB4F)


def gram_hashes(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each n consecutive word hashes, by the position of the first; ignores document bounds. Empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, U)
    m = len(h) - n + 1
    g = h[:m].copy()
    for k in range(1, n):
        g *= _Q
        g += h[k : k + m]
    return mix(g + U(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) + U(splitmix(salt)))


def inside(first: np.ndarray, count: np.ndarray, total: int, n: int) -> np.ndarray:
    """Which of the ``total - n + 1`` n-grams lie within one document."""
    m = max(0, total - n + 1)
    ok = np.ones(m, bool)
    if n > 1 and m:
        for k in range(1, n):
            cut = first[1:-1] - k
            cut = cut[(cut >= 0) & (cut < m)]
            ok[cut] = False
    return ok


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document sum of per-word values (documents without words: 0)."""
    c = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]
