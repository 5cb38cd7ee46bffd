"""Suffix array by two-stage sorting, and the substrings that repeat in it."""

from __future__ import annotations

import numpy as np


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the empty suffix is the smallest."""
    n = len(t)
    if not n:
        return np.zeros(0, bool)
    step = np.r_[np.sign(t[1:].astype("i2") - t[:-1].astype("i2")), np.int16(-1)]
    at = np.where(step != 0, np.arange(n), n)
    decided = np.minimum.accumulate(at[::-1])[::-1]     # the next place where neighbours differ
    return step[decided] > 0


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """Starts of all suffixes, in order of (at least) their first ``depth`` bytes.

    Stage one sorts the suffixes smaller than their successors directly. Stage two
    scans the buckets of first bytes in order: a larger suffix is its first byte before
    a suffix that comes earlier, so it is appended to its bucket when that one is met.
    Within a bucket these come first; those that share their first byte with the
    suffix they follow from form the next round of the same bucket.
    """
    t = np.frombuffer(data, "u1")
    n, small = len(t), types(t)
    text = data.decode("latin-1")
    direct = np.flatnonzero(small)
    keys = [text[i:i + depth] for i in direct.tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    ends = np.cumsum(np.bincount(t[direct], minlength=256))
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def before(found: np.ndarray) -> np.ndarray:
        """Larger suffixes one byte before ``found``, in its order."""
        p = found[found > 0] - 1
        return p[~small[p]]

    def deal(p: np.ndarray) -> None:
        if len(p):
            first = t[p]
            order = np.argsort(first, kind="stable")
            p, first = p[order], first[order]
            cut = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]).tolist() + [len(p)]
            for a, b in zip(cut, cut[1:]):
                large[first[a]].append(p[a:b])

    if n:
        large[t[n - 1]].append(np.array([n - 1]))       # induced by the empty suffix
    for c in range(256):
        now = np.concatenate(large[c]) if large[c] else np.zeros(0, "i8")
        while len(now):
            out.append(now)
            p = before(now)
            same = t[p] == c
            deal(p[~same])
            now = p[same]
        smaller = direct[ends[c - 1] if c else 0:ends[c]]
        if len(smaller):
            out.append(smaller)
            deal(before(smaller))
    return np.concatenate(out) if out else np.zeros(0, "i8")


def common_prefixes(data: bytes, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, up to ``most``; both have ``most`` bytes."""
    padded = data + b"\0" * 8
    word = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = np.full(len(a), most)
    alive = np.arange(len(a))
    for k in range(0, most, 8):
        x = word[a[alive] + k] ^ word[b[alive] + k]
        differ = x != 0
        x = x[differ]
        equal = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype("i8") >> 3
        out[alive[differ]] = np.minimum(k + equal, most)
        alive = alive[~differ]
        if not len(alive):
            break
    return out


def repeated_starts(pieces: list[bytes], length: int) -> np.ndarray:
    """Mask over the concatenated ``pieces``: positions whose next ``length`` bytes, all
    within their piece, also start at another such position."""
    data = b"".join(pieces)
    sizes = np.array([len(p) for p in pieces], "i8")
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    order = suffix_array(data, length)
    order = order[room[order] >= length]
    twice = np.zeros(len(data), bool)
    if len(order) > 1:
        same = common_prefixes(data, order[:-1], order[1:], length) >= length
        twice[order[:-1][same]] = twice[order[1:][same]] = True
    return twice


def _sorted(text: bytes, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of the ``width`` bytes at each start among all different ones, and the common prefix of each two neighbours by rank."""
    numbers: dict[bytes, int] = {}
    of = np.array([numbers.setdefault(text[i:i + width], len(numbers)) for i in starts.tolist()])
    strings = np.frombuffer(b"".join(numbers), "u1").reshape(-1, width)
    order = np.argsort(strings.view(f"S{width}").ravel(), kind="stable")
    differ = strings[order[1:]] != strings[order[:-1]]
    rank = np.empty(len(order), "i8")
    rank[order] = np.arange(len(order))
    return rank[of], differ.argmax(axis=1)


def anchored_starts(pieces: list[bytes], at: np.ndarray, gram: int, length: int) -> np.ndarray:
    """The mask of :func:`repeated_starts` for pieces whose windows of ``length`` bytes all
    hold one of the grams of ``gram`` bytes that start ``at`` places of the concatenation.

    Equal windows have their first gram at one offset. So of all suffixes those that
    start at a gram suffice, with the bytes before it as suffixes of the text read
    backwards: windows with ``k`` bytes before their gram are equal where both sorted
    orders have a common prefix of ``k`` and of ``length - k`` bytes.
    """
    data, sizes = b"".join(pieces), np.array([len(p) for p in pieces], "i8")
    ends, most, n = np.cumsum(sizes), length - gram, len(at)
    piece = np.searchsorted(ends, at, "right")
    end = ends[piece]
    # The windows, by their starts, whose first gram this is.
    first = np.maximum(np.maximum(end - sizes[piece], at - most), np.r_[-1, at[:-1]] + 1)
    last = np.minimum(at, end - length)
    text = b"\0" * most + data + b"\0" * length
    after, after_common = _sorted(text, at + most, length)
    before, before_common = _sorted(text[::-1], len(text) - most - at, most)
    twice = np.zeros(len(data), bool)
    for k in range(most + 1):
        own = np.flatnonzero((first <= at - k) & (at - k <= last))
        if len(own) > 1:
            a = np.r_[0, np.cumsum(after_common < length - k)][after[own]]
            b = np.r_[0, np.cumsum(before_common < k)][before[own]]
            _, kind, count = np.unique(a * n + b, return_inverse=True, return_counts=True)
            twice[at[own[count[kind] > 1]] - k] = True
    return twice
