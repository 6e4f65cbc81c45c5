"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy: each bucket is induced as a whole."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol is the only smallest one."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32)))
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    small = np.ones(n, bool)
    small[:-1] = np.where(nxt < n, step[np.minimum(nxt, n - 2)] > 0, False)
    return small


def _with_runs(at: np.ndarray, back: np.ndarray) -> np.ndarray:
    """``at`` followed by all that its runs of one symbol induce: first one step back, then two, and so on."""
    reps = back[at]
    most = int(reps.max(initial=0))
    if most <= 6:
        parts = [at]
        for d in range(1, most + 1):
            parts.append(at[reps >= d] - d)
        return np.concatenate(parts) if most else at
    which = np.repeat(np.arange(len(at)), reps + 1)
    d = np.arange(len(which)) - np.repeat(np.cumsum(reps + 1) - (reps + 1), reps + 1)
    return (at[which] - d)[np.argsort(d, kind="stable")]


def _induce(t: np.ndarray, lms: np.ndarray, counts: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from ``lms``, the leftmost smaller suffixes in their order."""
    n, sigma = len(t), len(counts)
    ends = np.cumsum(counts)
    begins = ends - counts
    sa = np.full(n, -1, np.int32)
    head, tail = begins.copy(), ends.copy()
    lms_of = t[lms]
    by = np.argsort(lms_of, kind="stable")
    lms_sorted, lms_counts = lms[by], np.bincount(lms_of, minlength=sigma)
    lms_at = np.concatenate(([0], np.cumsum(lms_counts)))
    live = np.flatnonzero(counts)

    def scatter(q, ch, ptr, sign):
        order = np.argsort(ch, kind="stable")
        ch, q = ch[order], q[order]
        num = np.bincount(ch, minlength=sigma)
        rank = np.arange(len(ch)) - (np.cumsum(num) - num)[ch]
        sa[ptr[ch] + (rank if sign > 0 else -1 - rank)] = q
        ptr += sign * num

    for c in live:
        first = sa[begins[c] : head[c]]
        every = _with_runs(first, back) if len(first) else first
        sa[begins[c] : begins[c] + len(every)] = every
        head[c] = begins[c] + len(every)
        src = np.concatenate((every, lms_sorted[lms_at[c] : lms_at[c + 1]]))
        q = src[src > 0] - 1
        ch = t[q]
        up = ch > c
        if up.any():
            scatter(q[up], ch[up], head, 1)
    for c in live[::-1]:
        first = sa[tail[c] : ends[c]][::-1]
        every = _with_runs(first, back) if len(first) else first
        tail[c] = ends[c] - len(every)
        sa[tail[c] : ends[c]] = every[::-1]
        src = np.concatenate((every, sa[begins[c] : head[c]][::-1]))
        q = src[src > 0] - 1
        ch = t[q]
        down = ch < c
        if down.any():
            scatter(q[down], ch[down], tail, -1)
    sa[0] = n - 1  # the end mark precedes all
    return sa


def _rank(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a sequence over a large alphabet: sorting by 1, 2, 4, ... symbols, ties only."""
    n = len(names)
    rank = names.astype(np.int32)
    order = np.argsort(rank, kind="stable").astype(np.int32)
    r = rank[order]
    new = np.concatenate(([True], r[1:] != r[:-1]))
    place = np.arange(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, place, np.int32(0)))
    h = 1
    while True:
        size = np.diff(np.append(np.flatnonzero(new), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))  # places in order that are not settled
        if not len(tied):
            return order
        at = order[tied]
        nxt = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = (rank[at].astype(np.int64) << 32) | nxt
        by = np.argsort(key, kind="stable")
        order[tied] = at[by]
        key = key[by]
        split = np.concatenate(([True], key[1:] != key[:-1]))
        new[tied] = split
        rank[order[tied]] = np.maximum.accumulate(np.where(new, place, np.int32(0)))[tied]
        h *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of small non-negative integers; the last must be 0, and 0 nowhere else."""
    t = np.ascontiguousarray(t, np.uint16)
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(t)
    new_run = np.concatenate(([True], t[1:] != t[:-1]))
    back = (np.arange(n) - np.maximum.accumulate(np.where(new_run, np.arange(n), 0))).astype(np.int32)
    lms = lms.astype(np.int32)
    if len(lms) > 1:
        sa = _induce(t, lms, counts, back)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        found = sa[is_lms[sa]]
        nth = np.empty(n, np.int32)
        nth[lms] = np.arange(len(lms))
        length = np.append(np.diff(lms) + 1, 1)
        a, b = found[:-1], found[1:]
        same = length[nth[a]] == length[nth[b]]
        live = np.flatnonzero(same)
        k = 0
        while len(live):
            equal = t[a[live] + k] == t[b[live] + k]
            same[live[~equal]] = False
            live = live[equal]
            k += 1
            live = live[length[nth[a[live]]] > k]
        names = np.empty(len(lms), np.int64)
        names[nth[found]] = np.concatenate(([0], np.cumsum(~same)))
        lms = found if not same.any() else lms[_rank(names)]
    return _induce(t, lms, counts, back)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the symbols that its suffix shares with the one before it in the suffix array.

    Where the symbols before both are equal the value is that of the position before less one; only the
    others are compared, a few symbols at a time.
    """
    n = len(t)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = sa[0]
    at = np.arange(n, dtype=np.int32)
    before = np.where((at > 0) & (phi > 0), t[at - 1] != t[phi - 1], True)
    before[sa[0]] = True
    some = np.flatnonzero(before)
    some = some[some != sa[0]]
    padded = np.concatenate((t.astype(np.uint16), np.zeros(8, np.uint16)))
    four = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), (n + 4,), (2,))
    out = np.zeros(n, np.int32)
    a, b, left = some.astype(np.int32), phi[some], some
    done = np.zeros(len(some), np.int32)
    live = np.arange(len(some), dtype=np.int32)
    k = 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        ok = (x < n) & (y < n)
        diff = np.where(ok, four[np.minimum(x, n)] ^ four[np.minimum(y, n)], np.uint64(1))
        ended = diff != 0
        low = diff & (~diff + np.uint64(1))
        first = np.where(low < (1 << 16), 0, np.where(low < (1 << 32), 1, np.where(low < (1 << 48), 2, 3)))
        done[live[ended]] = k + first[ended]
        live = live[~ended]
        k += 4
    out[left] = done
    anchor = np.maximum.accumulate(np.where(before, at, np.int32(0)))
    return out[anchor] - (at - anchor)


def repeated_windows(parts: list[bytes], width: int) -> list[np.ndarray]:
    """For each part, whether the ``width`` bytes from each start also begin anywhere else in the parts."""
    lengths = [len(p) for p in parts]
    t = np.ones(sum(lengths) + len(parts) + 1, np.uint16)
    firsts = np.cumsum([0, *[n + 1 for n in lengths]])
    for p, at in zip(parts, firsts[:-1].tolist(), strict=True):
        t[at : at + len(p)] = np.frombuffer(p, np.uint8) + np.uint16(2)
    t[-1] = 0
    sa = suffix_array(t)
    shared = common_prefixes(t, sa)
    hit = shared >= width
    by_rank = hit[sa]
    hit[sa[:-1]] |= by_rank[1:]
    return [hit[at : at + max(0, n - width + 1)] for at, n in zip(firsts[:-1].tolist(), lengths, strict=True)]
