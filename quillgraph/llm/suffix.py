"""Suffix arrays by two-stage sorting, in numpy.

Only suffixes that are smaller than their successors are sorted directly; all
others are induced: a scan over the buckets of first bytes, in order, puts the
predecessor of each suffix it meets at the next place of the predecessor's own
bucket.  The scan takes a bucket at a time; a run of one byte takes a pass for
each of its bytes.
"""

from __future__ import annotations

import numpy as np

PAD = 72


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros follow the text."""
    t = np.concatenate([text, np.zeros(PAD + 8, np.uint8)]).astype(np.uint64)
    two = t[:-1] << np.uint64(8) | t[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    return (four[:-4] << np.uint64(32) | four[4:])[: len(text) + PAD]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later; the last isn't."""
    n = len(text)
    rising = text[1:] > text[:-1]
    at = np.where(text[1:] != text[:-1], np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.zeros(n, bool)
    inside = at < n
    out[:-1][inside] = rising[at[inside]]
    return out


def sort_directly(key: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes at ``start`` by their first ``depth`` bytes, eight at a time among those still equal."""
    order = start[np.argsort(key[start])]
    first = key[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])[: len(order)]
    group = np.cumsum(new, dtype=np.uint64)
    tied = np.flatnonzero(~new | ~np.concatenate([new[1:], [True]])[: len(order)])
    for at in range(8, depth, 8):
        if not len(tied):
            break
        k, g = key[order[tied] + at], group[tied]
        by_key = np.argsort(k)
        rank = np.empty(len(k), np.uint64)
        ordered = k[by_key]
        rank[by_key] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
        both = g << np.uint64(32) | rank
        o = np.argsort(both)
        order[tied], both = order[tied][o], both[o]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        group[tied] = np.cumsum(new, dtype=np.uint64)
        tied = tied[~new | ~np.concatenate([new[1:], [True]])]
    return order


def suffix_array(text: np.ndarray, depth: int, key: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in order of their first ``depth`` bytes at least; equal ones stand together."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    small = smaller_than_next(text)
    key = words_at(text) if key is None else key
    direct = sort_directly(key, np.flatnonzero(small).astype(np.int32), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1], np.int32))

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Deal out the larger predecessors; those of the bucket at hand come back."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        byte = text[before]
        own = before[byte == c]
        before, byte = before[byte != c], byte[byte != c]
        if len(before):
            o = np.argsort(byte, kind="stable")
            before, byte = before[o], byte[o]
            cuts = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            for part, b in zip(np.split(before, cuts[1:]), byte[cuts].tolist()):
                waiting[b].append(part)
        return own

    out = []
    for c in range(256):
        found = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(found):
            out.append(found)
            found = induce(found, c)
        part = direct[bounds[c] : bounds[c + 1]]
        out.append(part)
        induce(part, c)
        waiting[c] = []
    return np.concatenate(out)


def common_prefixes(key: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of what each suffix in ``order`` has in common with the one before, up to ``depth`` (a multiple of 8 or more counts as that)."""
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for at in range(0, depth, 8):
        diff = key[order[open_] + at] ^ key[order[open_ - 1] + at]
        same = diff == 0
        # bytes in common before the first one that differs
        out[open_[~same]] += (63 - (np.frexp(diff[~same].astype(np.float64))[1] - 1)) // 8 if (~same).any() else 0
        out[open_[same]] += 8
        open_ = open_[same]
    return np.minimum(out, depth)
