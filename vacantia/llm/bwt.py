"""Which places of a text begin with the same `depth` bytes, by interval expansion on its Burrows-Wheeler transform.

The suffixes are put in order as far as `depth` bytes. Strings of length l stand for intervals of that order; extending
one backwards by each letter that the transform has in the interval gives intervals of length l + 1. Going through them
breadth first, an interval whose end nobody has marked before ends where the common prefix with the next suffix is l long:
lengths are met in rising order, so the expansion ends at `depth`, and what is unmarked then has at least that in common.
"""

from __future__ import annotations

import numpy as np


def _sorted_places(key: np.ndarray, bits: int):
    """The places in the order of `key`, and the keys in that order; key and place share 64 bits where they fit."""
    n = len(key)
    width = max(1, int(n - 1).bit_length())
    if bits + width > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    packed = np.sort((key << np.uint64(width)) | np.arange(n, dtype=np.uint64))
    return (packed & np.uint64((1 << width) - 1)).astype(np.int64), packed >> np.uint64(width)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text` (small ints, the last one unique and 0) by the `depth` symbols that begin there, or more."""
    n = len(text)
    symbol = max(1, int(text.max()).bit_length())
    width = max(1, int(n - 1).bit_length())
    reach = max(1, min(depth, (64 - width) // symbol))
    key = np.zeros(n, np.uint64)
    for k in range(reach):
        key <<= np.uint64(symbol)
        key[: max(0, n - k)] |= text[k:].astype(np.uint64)
    bits = reach * symbol
    while True:
        order, keys = _sorted_places(key, bits)
        new = np.empty(n, bool)
        new[:1], new[1:] = True, keys[1:] != keys[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        if reach >= depth or new.all():
            return order
        bits = 2 * (n + 1).bit_length()
        key = rank << np.uint64(bits // 2)
        key[: max(0, n - reach)] |= rank[reach:]
        reach *= 2


def shared_prefixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the places of the bytes `text` in suffix order, the end of the text included, and a mask of those that
    have not `depth` bytes in common with the one before. A place with fewer bytes to the end is alone."""
    codes = np.zeros(256, np.uint8 if len(np.unique(text)) < 256 else np.uint16)
    used = np.unique(text)
    codes[used] = np.arange(1, len(used) + 1)
    coded = np.append(codes[text], codes.dtype.type(0))
    n = len(coded)
    order = suffix_order(coded, depth)
    transform = coded[order - 1]
    # Where each letter of the transform stands among the suffixes (`back`), and the next place with the same letter.
    by_letter = np.argsort(transform, kind="stable")
    back, following = np.empty(n, np.int32), np.full(n, n, np.int32)
    back[by_letter] = np.arange(n, dtype=np.int32)
    same = transform[by_letter[1:]] == transform[by_letter[:-1]]
    following[by_letter[:-1][same]] = by_letter[1:][same]
    marked = np.zeros(n + 1, bool)
    marked[0] = marked[n] = True
    left, right = np.zeros(1, np.int32), np.full(1, n, np.int32)
    everything = np.arange(n + 1, dtype=np.int32)
    for _ in range(depth):
        size = right - left
        if len(size) == 1 and size[0] == n:
            at, end = everything[:n], np.full(n, n, np.int32)
        else:
            begin = np.cumsum(size) - size
            at, end = np.repeat((left - begin).astype(np.int32), size), np.repeat(right, size)
            at += everything[: len(at)] if len(at) <= n else np.arange(len(at), dtype=np.int32)
        ends = back[at[following[at] >= end]] + 1  # the interval of each letter ends behind its last suffix
        ends = np.sort(ends[~marked[ends]])
        if not len(ends):
            break
        marked[ends] = True
        left, right = _before(marked, ends, everything), ends
    return order, marked[:n]


def _before(marked: np.ndarray, ends: np.ndarray, everything: np.ndarray) -> np.ndarray:
    """The last marked place before each of `ends` (sorted)."""
    if len(ends) * 64 > len(marked):
        last = np.maximum.accumulate(np.where(marked, everything, np.int32(0)))
        return last[ends - 1]
    out = ends - 1
    todo = np.flatnonzero(~marked[out])
    for _ in range(64):
        if not len(todo):
            return out
        out[todo] -= 1
        todo = todo[~marked[out[todo]]]
    all_ = np.flatnonzero(marked).astype(np.int32)
    return all_[np.searchsorted(all_, ends) - 1]
