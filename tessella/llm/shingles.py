"""Hashed five-word shingle sets of a batch of texts, with numpy.

Words are runs of bytes outside \\x20\\x09-\\x0D after A-Z became a-z. A word's hash is a polynomial over its bytes
modulo 2**64, read off prefix sums over the whole batch, then mixed; a shingle's hash mixes those of its words.
Sets are compared by these 64-bit hashes; two different shingles of one pair of documents share a hash with a
chance of about n**2 / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
RADIX, RADIX_INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes of text worked on at once; a longer text alone is one piece.
PIECE = 1 << 19
_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX**i and RADIX**-i for i < n."""
    if _powers.get("n", 0) < n:
        size = max(n, PIECE)
        up, down = np.full(size, RADIX), np.full(size, RADIX_INVERSE)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets (from 0) of runs of rows; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of the piece."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty(n, bool)
    before[0], before[1:] = False, full[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins = full & ~before
    begins[inner] = full[inner]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, full[1:]
    ends = full & ~after
    ends[inner - 1] = full[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    up, down = powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + U(1)) * up, out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words."""
    n = len(hashes) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = (total + hashes[k : k + n]) * U(0xD6E8FEB86659FD93 + 2 * size)
    return mix(total)


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes; a text of fewer words has its whole sequence as one, one without words none."""
    for row, data, offsets in pieces(texts):
        start, _, hashes = words(data, offsets)
        bounds = np.searchsorted(start, offsets)
        grams = windows(hashes, size) if len(hashes) >= size else np.zeros(0, np.uint64)
        for k in range(len(offsets) - 1):
            a, b = bounds[k], bounds[k + 1]
            if b - a >= size:
                found = np.sort(grams[a : b - size + 1])
                if len(found) > 1:
                    keep = np.empty(len(found), bool)
                    keep[0] = True
                    np.not_equal(found[1:], found[:-1], out=keep[1:])
                    found = found[keep]
            else:
                found = windows(hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)
            yield row + k, found


def set_hash(found: np.ndarray, kind: int = 0) -> int:
    """One number for a set, as a signed 64-bit integer; another one for each kind."""
    return int((mix(found + U(0x632BE59BD9B4E019 + 2 * kind)).sum(dtype=np.uint64) + U(len(found))).astype(np.int64))
