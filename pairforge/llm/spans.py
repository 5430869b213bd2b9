"""Words, hashes of word or byte runs, and winnowing, on whole Arrow batches with NumPy.

Texts are handled as the UTF-8 bytes that Arrow holds; no Python string is made.
Hashes of runs are differences of prefix sums modulo 2^64, so the hash of any
run costs the same whatever its length.  They tell apart short runs (words of up
to ``LONG_WORD`` bytes, runs of a few hundred bytes or words); two strings made
for it can collide from about a thousand bytes on, so longer words go to BLAKE2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is a block of its own.
BLOCK_BYTES = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random odd-length code for every byte value, so that words over few letters hash apart.
BYTE_CODES = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Words between ASCII white space.
NON_SPACE = ~WHITE
#: Words of ASCII letters, digits and all other characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Words of more bytes are hashed one by one.
LONG_WORD = 128
#: A-Z to a-z, other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for i below ``n``; the largest table so far is kept."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        size = max(n, 2 * len(_POWERS.get(base, ())), 1024)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        if n > 16 * BLOCK_BYTES:
            return np.cumprod(table)[:n]
        _POWERS[base] = np.cumprod(table)
    return _POWERS[base][:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class RunHash:
    """Hashes of runs ``[start, end)`` of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, base: int):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(base, n), out=self.sums[1:])
        self.back = powers(inverse(base), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (np.asarray(end) - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + size * np.uint64(0xA0761D6478BD642F))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text starts (one more entry than texts); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``BLOCK_BYTES`` of text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of consecutive texts: byte ranges, and for each text its first word."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # rows[i]: first word of text i; one more entry than texts
    hashes: np.ndarray

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = False) -> Words:
    """Words are runs of bytes for which ``inside`` holds; none crosses a text's end."""
    n = len(data)
    flags = np.zeros(n + 1, bool)
    flags[:n] = inside[data]
    begin = flags[:n].copy()
    begin[1:] &= ~flags[: n - 1]
    first = offsets[:-1][offsets[:-1] < n]
    begin[first] = flags[first]
    end = flags[:n] & ~flags[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = flags[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    codes = (BYTE_CODES[LOWER] if lower else BYTE_CODES)[data]
    hashes = RunHash(codes, BASE).of(starts, ends)
    # A polynomial modulo a power of two fails on long strings of a certain make, whatever its base.
    for long in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        word = data[starts[long] : ends[long]]
        hashes[long] = int.from_bytes(blake2b((LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
    return Words(starts, ends, np.searchsorted(starts, offsets), hashes)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of ``width`` values the place of its least one, the last of equal ones."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    best, place, have = values, np.arange(n), 1
    while have < width:
        step = min(have, width - have)
        a, b, pa_, pb = best[:-step], best[step:], place[:-step], place[step:]
        right = b <= a
        best, place = np.where(right, b, a), np.where(right, pb, pa_)
        have += step
    return place


@dataclass
class Runs:
    """Maximal runs of windows that choose the same anchor."""

    first: np.ndarray  # first window
    count: np.ndarray  # windows in the run
    anchor: np.ndarray  # place of the anchor


def winnow(grams: np.ndarray, width: int, valid: np.ndarray) -> Runs:
    """Choose the least gram of each ``width`` consecutive ones.

    ``valid`` marks the windows (by first gram) that lie inside one text.  Two
    windows of equal content choose their anchors at equal places.
    """
    chosen = sliding_min(grams, width)
    valid = valid[: len(chosen)]
    windows = np.flatnonzero(valid)
    if not len(windows):
        return Runs(*(np.zeros(0, np.int64),) * 3)
    anchor = chosen[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(new)
    return Runs(windows[at], np.diff(np.append(at, len(windows))), anchor[at])


def combine(row: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal (row, keys) together, and where each group begins (one more entry than groups)."""
    order = np.lexsort((*keys, row))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = row[order][1:] != row[order][:-1]
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
    return order, np.append(np.flatnonzero(new), len(order))


def cover(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Flags of the places that lie in any ``[start, end)``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, np.clip(starts, 0, size), 1)
    np.add.at(steps, np.clip(ends, 0, size), -1)
    return np.cumsum(steps[:size]) > 0


def count_runs(flags: np.ndarray) -> int:
    return int(flags[:1].sum() + (flags[1:] & ~flags[:-1]).sum())
