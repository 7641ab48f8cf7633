"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Every delimiter is an ASCII byte, and those never occur inside a longer UTF-8 sequence, so
texts need no decoding. Words are known by a 64-bit hash of their bytes, ``content_hashes``.
Running hashes, ``prefix_hashes``, give those of any substring, but inputs that collide in them are
easily made: they only ever propose what is then compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer text is handled alone.
SLICE_BYTES = 1 << 20

# Delimiters of the words [^\x20\x09-\x0D]+.
WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# For words that are runs of ASCII letters and digits and of all other characters.
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

# A-Z as a-z, every other byte as it is.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_random = np.random.default_rng(20240229)
_BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM_FACTORS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits; a one-to-one map."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences give the hash of any substring; see ``span_hashes``."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(sums) - 1)
    return mix((sums[ends] - sums[starts]) * down[starts])


def content_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0
) -> np.ndarray:
    """64-bit hashes of byte spans by their content; another ``seed`` gives independent ones.

    Every eight bytes are mixed with their place in the span before they are added up, so no
    sum of bytes, however weighted, decides whether two spans look alike.
    """
    return seeded_hashes(data, starts, ends, (seed,))[0]


def seeded_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...]
) -> list[np.ndarray]:
    """``content_hashes`` by several seeds, which take the spans apart once."""
    sizes = np.asarray(ends - starts, np.int64)
    blocks = (sizes + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at]
    # Only the last block of a span reaches over its end.
    tail = np.flatnonzero(sizes & 7)
    last = first[tail] + blocks[tail] - 1
    eights[last] &= (np.uint64(1) << (8 * (sizes[tail] & 7)).astype(np.uint64)) - np.uint64(1)
    longest = np.arange(int(blocks.max(initial=0)), dtype=np.uint64)
    filled = blocks > 0
    found = []
    for seed in seeds:
        mixed = mix(eights ^ mix((longest + np.uint64(seed << 40)) * np.uint64(_BASE))[place])
        sums = np.zeros(len(sizes), np.uint64)
        if filled.any():
            sums[filled] = np.add.reduceat(mixed, first[filled])
        found.append(mix(sums + (sizes.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(_BASE)))
    return found


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` consecutive word hashes."""
    size = max(0, len(hashes) - n + 1)
    total = np.zeros(size, np.uint64)
    for i in range(n):
        total += mix(hashes[i : i + size] * _GRAM_FACTORS[i] + np.uint64(i))
    return mix(total)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values with at most ``limit`` bytes together, or one value each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def word_spans(
    data: np.ndarray, offsets: np.ndarray, delimiters: np.ndarray = WHITE_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin among them."""
    inside = ~delimiters[data]
    # A word never runs over the end of its text.
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
