"""Words and their 64-bit hashes for many texts at once, in numpy over UTF-8 bytes.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; the letters A to Z are lowered, other characters stay as they are. Texts are taken in chunks of
bounded size, so memory does not grow with a batch or with the number of texts; one text longer than a
chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_WEIGHT = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WEIGHT_LOWERED = _WEIGHT[_LOWER]
#: Breaks words at every ASCII character that is neither a letter nor a digit.
PLAIN_BREAKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand and kept up to one chunk."""

    def __init__(self):
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(self.up):
            return self.up[:n], self.down[:n]
        size = max(n, CHUNK_BYTES + 64)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= CHUNK_BYTES + 64:
            self.up, self.down = up, down
        return up[:n], down[:n]


_powers = _Powers()


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string or binary array; nulls are empty texts."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts [a, b) whose bytes stay within ``limit``, or single longer texts."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of consecutive texts, and where each text's words begin (n + 1 positions).

    The hash is a polynomial over random byte weights modulo 2**64, then mixed.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[borders < n]
    first[borders] = inside[borders]  # a text's first byte begins a word though the text before ends in one
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = borders[borders > 0] - 1
    last[ends] = inside[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_WEIGHT_LOWERED[data] * up, out=total[1:], dtype=np.uint64)
    hashes = mix((total[end] - total[begin]) * down[begin])
    return hashes, np.searchsorted(begin, offsets)


def shingles(hashes: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, sorted and distinct within each text, and each text's start.

    A text of fewer than ``k`` words has its whole sequence as its only shingle; without words it has none.
    """
    n = len(starts) - 1
    counts = np.diff(starts)
    held = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.zeros(n + 1, np.int64)
    np.cumsum(held, out=out[1:])
    if out[-1] == 0:
        return np.zeros(0, np.uint64), out
    owner = np.repeat(np.arange(n), held)
    at = np.arange(out[-1]) - out[owner] + starts[owner]
    length = np.minimum(counts[owner], k)
    code = np.zeros(out[-1], np.uint64)
    for i in range(k):
        live = i < length
        step = hashes[np.minimum(at + i, len(hashes) - 1)]
        code = np.where(live, mix(code * _BASE + step), code)
    for i in np.flatnonzero(held > 1):
        code[out[i]:out[i + 1]].sort()
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    starts_out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner[keep], minlength=n), out=starts_out[1:])
    return code[keep], starts_out
