"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard of bytes.

Spark deals shards of about a megabyte to tasks; this helper sorts one. Suffixes are classified as smaller (S) or
larger (L) than their right neighbour, leftmost S substrings are sorted and named (recursively where names repeat), and
all other suffixes are induced from them: bucket by bucket with numpy for bytes, item by item for names and words.
"""

from __future__ import annotations

import numpy as np

#: Letters of two substrings that are compared for all pairs at once; what is longer is compared pair by pair.
STEPWISE = 64
#: Alphabets over so many letters are sorted item by item, since buckets are too small for numpy.
MANY = 1024


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """Starts of the sorted suffixes of ``s``: integers below ``letters``, the last a 0 that occurs nowhere else."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    if letters > MANY:
        return np.asarray(_of_names(s.tolist(), letters), np.int64)
    small = _kinds(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    bounds = np.r_[0, np.cumsum(np.bincount(s, minlength=letters))]
    rough = _induce(s, small, lms, bounds)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    in_order = rough[is_lms[rough]]
    names = np.zeros(n, np.int64)
    names[in_order] = np.cumsum(np.r_[False, _differ(s, lms, in_order)])
    reduced = names[lms]
    n_names = int(reduced.max()) + 1
    if n_names == len(lms):
        order = np.empty(len(lms), np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        order = np.asarray(_of_names(reduced.tolist(), n_names))
    return _induce(s, small, lms[order], bounds)


def _kinds(s: np.ndarray) -> np.ndarray:
    """True where a suffix is of kind S."""
    n = len(s)
    rises = np.ones(n, np.int8)  # the last suffix counts as S
    rises[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64))
    at = np.where(rises != 0, np.arange(n), n)
    return rises[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _append(sa: np.ndarray, ends: np.ndarray, items: np.ndarray, chars: np.ndarray, way: int) -> None:
    """Put ``items``, in their order, at the ends of their buckets, which grow to the right (1) or to the left (-1)."""
    order = np.argsort(chars, kind="stable")
    chars, items = chars[order], items[order]
    first = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
    count = np.diff(np.r_[first, len(chars)])
    nth = np.arange(len(chars)) - np.repeat(first, count)
    sa[ends[chars] + way * nth] = items
    ends[chars[first]] += way * count


def _chained(front: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """What ``front`` induces in its own bucket: left neighbours with the same letter, theirs, and so on, round by round."""
    count = behind[front]
    total = int(count.sum())
    if not total:
        return front[:0]
    seed = np.repeat(np.arange(len(front)), count)
    step = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + 1
    return (front[seed] - step)[np.lexsort((seed, step))]


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S suffixes in order; from those in any order, sorted by substring."""
    n, letters = len(s), len(bounds) - 1
    at = np.arange(n)
    behind = at - np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], at, 0))  # equal letters to the left
    sa = np.full(n, -1, np.int64)
    last = bounds[1:] - 1
    _append(sa, last.copy(), lms[::-1], s[lms[::-1]], -1)
    planted = np.bincount(s[lms], minlength=letters)
    heads = bounds[:-1].copy()
    for c in range(letters):
        if heads[c] > bounds[c]:
            more = _chained(sa[bounds[c] : heads[c]], behind)
            sa[heads[c] : heads[c] + len(more)] = more
            heads[c] += len(more)
            _left(s, small, False, sa, heads, sa[bounds[c] : heads[c]], 1, c)
        if planted[c]:
            _left(s, small, False, sa, heads, sa[bounds[c + 1] - planted[c] : bounds[c + 1]], 1, c)
    ends = last.copy()
    for c in range(letters - 1, 0, -1):
        if last[c] > ends[c]:
            more = _chained(sa[ends[c] + 1 : last[c] + 1][::-1], behind)
            sa[ends[c] - len(more) + 1 : ends[c] + 1] = more[::-1]
            ends[c] -= len(more)
            _left(s, small, True, sa, ends, sa[ends[c] + 1 : last[c] + 1][::-1], -1, c)
        if heads[c] > bounds[c]:
            _left(s, small, True, sa, ends, sa[bounds[c] : heads[c]][::-1], -1, c)
    sa[0] = n - 1
    return sa


def _left(s: np.ndarray, small: np.ndarray, kind: bool, sa: np.ndarray, ends: np.ndarray, front: np.ndarray, way: int, own: int) -> None:
    """Induce the left neighbours, of one kind and in other buckets than their ``own``, of the suffixes in ``front``."""
    left = front[front > 0] - 1
    left = left[(small[left] == kind) & (s[left] != own)]
    if len(left):
        _append(sa, ends, left, s[left], way)


def _differ(s: np.ndarray, lms: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """Whether neighbours among the sorted leftmost S substrings differ."""
    length = np.zeros(len(s), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = in_order[:-1], in_order[1:]
    out = length[a] != length[b]
    left = np.flatnonzero(~out)
    for k in range(min(STEPWISE, int(length.max()))):
        left = left[length[a[left]] > k]
        if not len(left):
            break
        unlike = s[a[left] + k] != s[b[left] + k]
        out[left[unlike]] = True
        left = left[~unlike]
    for i in left[length[a[left]] > STEPWISE].tolist():  # few are so long, as runs of one letter are
        x, y, n = int(a[i]), int(b[i]), int(length[a[i]])
        out[i] = not np.array_equal(s[x + STEPWISE : x + n], s[y + STEPWISE : y + n])
    return out


def _of_names(s: list[int], letters: int) -> list[int]:
    """Suffix array of a list of names, the last the only 0: the same method item by item, names being many."""
    n = len(s)
    if n == letters:
        out = [0] * n
        for i, c in enumerate(s):
            out[c] = i
        return out
    small = [True] * n
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    bounds = np.r_[0, np.cumsum(np.bincount(s, minlength=letters))]
    starts, stops = bounds[:-1].tolist(), bounds[1:].tolist()

    def induce(lms: list[int]) -> list[int]:
        sa = [-1] * n
        ends = stops.copy()
        for i in reversed(lms):
            c = s[i]
            ends[c] -= 1
            sa[ends[c]] = i
        heads = starts.copy()
        for k in range(n):
            i = sa[k] - 1
            if i >= 0 and not small[i]:
                c = s[i]
                sa[heads[c]] = i
                heads[c] += 1
        ends = stops.copy()
        for k in range(n - 1, -1, -1):
            i = sa[k] - 1
            if i >= 0 and small[i]:
                c = s[i]
                ends[c] -= 1
                sa[ends[c]] = i
        sa[0] = n - 1
        return sa

    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    rough = induce(lms)
    after = dict(zip(lms, lms[1:] + [n - 1], strict=True))
    names, name, before = {}, -1, None
    for i in rough:
        if i in after:
            own = s[i : after[i] + 1]
            name += own != before
            names[i], before = name, own
    reduced = [names[i] for i in lms]
    return induce([lms[i] for i in _of_names(reduced, name + 1)])


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For every position: the length of the prefix that it shares with its forerunner in ``sa``, and the forerunner.

    Kept in text order (permuted). A position whose left letter equals its forerunner's has one less than its left
    neighbour; only the others, and the places in ``fresh``, are compared, as many letters at a time as 63 bits hold, up to ``most``
    letters: lengths are exact as long as no more than ``most`` letters lie from the last of ``fresh`` to what matters.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    i = np.arange(n)
    own = np.ones(n, bool)
    own[1:] = (before[1:] <= 0) | (s[i[1:] - 1] != s[before[1:] - 1])
    if fresh is not None:
        own[fresh] = True
    bits = max(9, int(s.max()).bit_length())
    each = 63 // bits
    padded = np.r_[s, np.zeros(8, s.dtype)].astype(np.uint64)
    # unlike ends at which comparing stops: s holds one 0, at its end
    words = np.zeros(n + 1, np.uint64)
    for k in range(each):
        words[:n] |= padded[k : n + k] << np.uint64(bits * k)
    at = np.flatnonzero(own & (before >= 0))
    length = np.zeros(n, np.int64)
    a, b = at.copy(), before[at]
    live = np.arange(len(at))
    got = np.zeros(len(at), np.int64)
    while len(live):
        x = words[np.minimum(a[live] + got[live], n)] ^ words[np.minimum(b[live] + got[live], n)]
        same = x == 0
        tail = live[~same]
        if len(tail):
            low = x[~same]
            low = low & (~low + np.uint64(1))  # the lowest bit that differs
            got[tail] += (np.bitwise_count(low - np.uint64(1)) // bits).astype(np.int64)
        live = live[same]
        got[live] += each
        live = live[got[live] < most]
    length[at] = np.minimum(got, most)
    anchor = np.maximum.accumulate(np.where(own, i, 0))
    return np.maximum(length[anchor] - (i - anchor), 0), before


def repeated_starts(parts: list[np.ndarray], span: int) -> list[np.ndarray]:
    """For each array of letters (bytes, or hashes of words): where a string of ``span`` starts that also starts elsewhere, in it or another."""
    sizes = np.array([len(p) + 1 for p in parts])
    starts = np.cumsum(sizes) - sizes
    flat, letters = np.concatenate(parts), 256
    if flat.dtype != np.uint8:
        distinct, flat = np.unique(flat, return_inverse=True)
        letters = len(distinct)
    s = np.ones(int(sizes.sum()) + 1, np.int64 if letters > 256 else np.int16)  # 1 parts the arrays, 0 ends all
    s[-1] = 0
    held = np.ones(len(s), bool)
    held[starts + sizes - 1], held[-1] = False, False
    s[held] = flat.astype(s.dtype) + 2
    most = int(sizes.max()) + 1
    length, before = common_prefixes(s, suffix_array(s, letters + 2), most, starts)
    room = np.zeros(len(s), np.int64)
    for size, at in zip(sizes.tolist(), starts.tolist(), strict=True):
        room[at : at + size] = np.arange(size - 1, -1, -1)
    hit = (length >= span) & (room >= span)
    out = hit.copy()
    out[before[hit]] = True
    return [np.flatnonzero(out[at : at + len(p)]) for p, at in zip(parts, starts.tolist(), strict=True)]
