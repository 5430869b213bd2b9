"""A run-length index of short texts, and its matching statistics.

The texts are joined with separators that differ from each other.  Of the
Burrows-Wheeler transform only the runs count: where a run begins, the common
prefix with the suffix ranked before is measured (the samples at run ends).
Inside a run it needs no look at the text: one byte further in the text, a
common prefix is one byte shorter.  Streaming over the text from sample to
sample gives the longest match of every place with any other place.
"""

from __future__ import annotations

import numpy as np

_STEP = 8

#: Pairs of places that are compared at a time.
_PAIRS = 1 << 14


def places(n: int) -> type:
    """The narrower integer that counts to ``n``."""
    return np.int32 if n < (1 << 31) - 2 else np.int64


def suffix_order(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by prefix doubling; suffixes differ within ``longest`` symbols."""
    n = len(symbols)
    kind = places(n)
    rank = np.unique(symbols, return_inverse=True)[1].astype(kind)
    depth = 1
    while True:
        key = rank * np.int64(n + 1)
        if depth < n:
            key[: n - depth] += rank[depth:] + kind(1)
        order = np.argsort(key, kind="stable").astype(kind)
        key = key[order]
        step = key[1:] != key[:-1]
        del key
        rank = np.zeros(n, kind)
        rank[order[1:]] = np.cumsum(step, dtype=kind)
        depth *= 2
        if step.all() or depth > 2 * longest + 2:
            return order, rank


def _common_prefix(data: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix from places ``a`` and ``b``, each within its own text."""
    padded = np.concatenate([data, np.zeros(_STEP, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, _STEP)
    found = np.zeros(len(a), ends.dtype)
    for first in range(0, len(a), _PAIRS):
        left, right = a[first : first + _PAIRS], b[first : first + _PAIRS]
        room = np.minimum(ends[left] - left, ends[right] - right)
        out = np.zeros(len(left), ends.dtype)
        active = np.flatnonzero(room > 0)
        while len(active):
            at = out[active]
            same = words[left[active] + at] == words[right[active] + at]
            length = np.where(same.all(1), _STEP, same.argmin(1)).astype(out.dtype)
            out[active] += length
            active = active[(length == _STEP) & (out[active] < room[active])]
        found[first : first + _PAIRS] = np.minimum(out, room)
    return found


def longest_matches(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte of the joined texts, how long a string from here also starts elsewhere.

    ``starts``: where each text begins, one more entry than texts.  Matches never
    leave a text.
    """
    sizes = np.diff(starts)
    count, n = len(sizes), len(data)
    kind = places(n + count)
    # Each text is followed by a separator of its own.
    text_of = np.repeat(np.arange(count, dtype=kind), sizes)
    place = np.arange(n, dtype=kind) + text_of
    marks = (starts[1:] + np.arange(count)).astype(kind)
    symbols = np.empty(n + count, kind)
    symbols[place] = data.astype(kind) + kind(count)
    symbols[marks] = np.arange(count)
    bytes_ = np.zeros(n + count, np.uint8)
    bytes_[place] = data
    ends = np.empty(n + count, kind)
    ends[place] = marks[text_of]
    ends[marks] = marks
    del text_of
    order, rank = suffix_order(symbols, int(sizes.max(initial=0)) + 1)
    transform = symbols[order - 1]  # the symbol before each suffix; before the first one the last
    heads = np.ones(n + count, bool)
    heads[1:] = transform[1:] != transform[:-1]
    heads[rank[0]] = True
    del transform, symbols
    at = np.flatnonzero(heads)
    at = at[at > 0]
    sampled = np.zeros(n + count, kind)
    is_sample = np.zeros(n + count, bool)
    is_sample[order[heads]] = True
    sampled[order[at]] = _common_prefix(bytes_, ends, order[at], order[at - 1])
    every = np.arange(n + count, dtype=kind)
    last = np.maximum.accumulate(np.where(is_sample, every, kind(-1)))
    before = sampled[last] - (every - last)
    by_rank = np.append(before[order], kind(0))
    return np.maximum(before, by_rank[rank + 1])[place]
