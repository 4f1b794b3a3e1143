"""Words of whole texts, and 64-bit hashes of words and word sequences, for batches of texts.

A text is cut into words on its UTF-8 bytes with one translation table, so a batch of texts is
a few array operations and never a loop over words. Sequences are compared by 64-bit hashes:
two different ones agree with a probability of about 2**-64 per pair compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

_BLOCK = 1 << 20  # bytes hashed at a time
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_SPACE = b" \t\n\v\f\r"


def table(lower: bool, alphanumeric: bool = False) -> bytes:
    """A byte translation that leaves words divided by spaces.

    White space always divides. With ``alphanumeric`` every ASCII byte but digits and letters
    does; bytes above 0x7F always belong to words.
    """
    out = bytearray(range(256))
    for byte in range(256):
        char = bytes([byte])
        if char in _SPACE or (alphanumeric and byte < 128 and not char.isalnum()):
            out[byte] = 0x20
        elif lower and char.isupper() and byte < 128:
            out[byte] = byte + 32
    return bytes(out)


PLAIN = table(lower=False)
LOWER = table(lower=True)
ALNUM = table(lower=True, alphanumeric=True)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of ``base`` and of its inverse, modulo 2**64."""
    up, down = _powers.get(base, (np.zeros(0, np.uint64),) * 2)
    if len(up) < n:
        size = max(n, 2 * len(up), 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        up, down = _powers[base] = (made[0], made[1])
    return up[:n], down[:n]


@dataclass
class Words:
    """Words of a batch. ``first[k]:first[k + 1]`` are those of text k."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def texts(self) -> Iterator[tuple[int, int]]:
        return zip(self.first[:-1].tolist(), self.first[1:].tolist())

    def joined(self, lo: int, hi: int) -> bytes:
        """Words lo..hi-1 (of one text) with one space between."""
        if hi <= lo:
            return b""
        return b" ".join(self.data[self.start[lo] : self.end[hi - 1]].split())


def _hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        origin = start[k]
        stop = max(k + 1, int(np.searchsorted(end, origin + _BLOCK, side="right")))
        part = codes[origin : end[stop - 1]]
        up, down = _power(_BASE, len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[:-1], out=sums[1:])
        s, e = start[k:stop] - origin, end[k:stop] - origin
        size = (e - s).astype(np.uint64)
        out[k:stop] = mix((sums[e] - sums[s]) * down[s] + size * np.uint64(_WORD_BASE))
        k = stop
    return out


def split(texts: Sequence[str | None], how: bytes) -> Words:
    """Cut texts into words (a null text has none) with the translation ``how``."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(how) for t in texts]
    data = b" ".join([*raw, b""])
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = codes != 0x20
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    place = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)])
    return Words(data, start, end, _hashes(codes, start, end), np.searchsorted(start, place))


def sequences(words: Words, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on.

    Entry i is meaningful where i + n is within the text of word i.
    """
    h = words.hash
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = _power(_WORD_BASE, len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1] + np.uint64(n))


def shingles(words: Words, n: int, whole: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text.

    A text of fewer words is one shingle of all its words if ``whole``, else it has none; a
    text without words has none.
    """
    all_of = sequences(words, n)
    for lo, hi in words.texts():
        if hi - lo >= n:
            yield np.unique(all_of[lo : hi - n + 1])
        elif whole and hi > lo:
            short = Words(words.data, words.start, words.end, words.hash[lo:hi], words.first)
            yield sequences(short, hi - lo)
        else:
            yield np.zeros(0, np.uint64)


def batches(texts: Sequence[str | None], limit: int = 4 << 20) -> Iterator[slice]:
    """Runs of rows with about ``limit`` characters, or one row if it is longer."""
    lo, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield slice(lo, k + 1)
            lo, size = k + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed longs."""
    return h.view(np.int64)


def intervals(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merge half-open intervals that overlap or touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(pairs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out
