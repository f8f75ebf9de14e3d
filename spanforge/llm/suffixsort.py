"""Suffix arrays by linear grouping, and groups of equal windows of bytes by way of them.

``suffix_array`` sorts the suffixes of a sequence of numbers in two passes. Suffixes
are grouped by their longest Lyndon prefix: groups are worked off in descending
order; each suffix of a group finds, over pointers to the previous smaller one, the
suffix whose prefix it extends, and those are set apart above their group by how
often they were extended. Then the groups' inner order is emitted from the
smallest suffix on. Nothing is renamed or sorted again.

``equal_windows`` parses bytes at triggers into phrases that overlap by a trigger, so
that none begins another; the suffix array of the parse orders all suffixes at
phrases, and a window of bytes is known by what comes before its next phrase and
by which suffixes there agree for the rest of the window.
"""

from __future__ import annotations

import gc

import numpy as np

#: Bytes of a trigger, and one in how many places is one.
TRIGGER, DENSITY = 4, 32


def suffix_array(s: list[int]) -> list[int]:
    """The starts of the suffixes of s, smallest suffix first."""
    n = len(s)
    group, previous, done = [0] * (n + 1), [-1] * (n + 1), bytearray(n + 1)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        if c in by_symbol:
            by_symbol[c].append(i)
        else:
            by_symbol[c] = [i]
    # members of each group: a set, or the only one; the empty suffix is smallest of all
    members: list[set[int] | int] = [n]
    for c in sorted(by_symbol):
        own = by_symbol[c]
        for i in own:
            group[i] = len(members)
        members.append(set(own) if len(own) > 1 else own[0])
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    finished = []

    def set_apart(h: int, moved) -> None:
        """Those of group h become a group of their own, right above what is left of it."""
        rest, new = members[h], len(members)
        if type(moved) is int:
            rest.discard(moved)
            group[moved] = new
            members.append(moved)
        else:
            rest.difference_update(moved)
            for p in moved:
                group[p] = new
            members.append(set(moved) if len(moved) > 1 else moved[0])
        if len(rest) == 1:
            (members[h],) = rest
        above = upper[h]
        lower.append(h)
        upper.append(above)
        upper[h] = new
        lower[above] = new

    at = len(members) - 1
    lower.append(at)  # stands above the highest group
    upper.append(-1)
    members.append(-1)
    while at > 0:
        finished.append(at)
        own = members[at]
        if type(own) is int:
            done[own] = 1
            p = own - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[own] = p
            if p >= 0 and type(members[group[p]]) is set:
                set_apart(group[p], p)
        else:
            order = sorted(own)
            for i in order:
                done[i] = 1
            times: dict[int, int] = {}
            for i in order:
                p = i - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                previous[i] = p
                if p >= 0 and type(members[group[p]]) is set:
                    times[p] = times.get(p, 0) + 1
            parts: dict[tuple[int, int], list[int]] = {}
            for p, c in times.items():
                parts.setdefault((group[p], c), []).append(p)
            # the most extended first: each next part goes in right above what is left of its group
            for h, c in sorted(parts, reverse=True) if len(parts) > 1 else parts:
                moved, rest = parts[h, c], members[h]
                if type(rest) is set and len(moved) < len(rest):
                    set_apart(h, moved)
        at = lower[at]
    start, total = [0] * len(members), 1
    for g in reversed(finished):
        start[g] = total
        own = members[g]
        total += 1 if type(own) is int else len(own)
    found = [n] * (n + 1)
    placed = bytearray(n + 1)
    placed[n] = 1
    for k in range(n + 1):
        i = found[k] - 1
        while i >= 0 and not placed[i]:
            placed[i] = 1
            g = group[i]
            found[start[g]] = i
            start[g] += 1
            i = previous[i]
    return found[1:]


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """How many of the next ``width`` bytes at places a and b agree. text goes on for so many behind all places."""
    out, step = np.empty(len(a), np.int64), np.arange(width)
    for s in range(0, len(a), 1 << 15):
        differ = text[a[s : s + (1 << 15), None] + step] != text[b[s : s + (1 << 15), None] + step]
        out[s : s + (1 << 15)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return out


_ODD, _INVERSE = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_MIX = np.uint64(0x9FB21C651E98DF25)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def phrases(text: np.ndarray) -> np.ndarray:
    """Where the phrases of a text begin; it must end with a trigger's worth of zeros."""
    four = np.ndarray(len(text) - TRIGGER + 1, "<u4", text, strides=(1,))
    hit = ((four * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(DENSITY) == 0  # four zeros are a trigger
    return np.flatnonzero(hit)


def equal_windows(pieces: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The piece of each window of ``width`` bytes, in order, and its class: equal windows have equal ones.

    sizes has the number of windows of each piece, which is width - 1 less than its bytes.
    """
    gap = b"\0" * TRIGGER
    text = np.frombuffer(gap + gap.join(pieces) + b"\0" * (width + TRIGGER), np.uint8)
    lengths = sizes + width - 1
    first = TRIGGER + np.cumsum(lengths + TRIGGER) - lengths - TRIGGER
    piece = np.repeat(np.arange(len(sizes)), sizes)
    at = first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begins = phrases(text[: len(text) - width])
    raw = text.tobytes()
    parse = [raw[a : b + TRIGGER] for a, b in zip(begins.tolist(), begins[1:].tolist())]
    rank = {p: k for k, p in enumerate(sorted(set(parse)))}
    collects = gc.isenabled()
    gc.disable()  # many small objects, none in a cycle
    try:
        order = np.array(suffix_array([rank[p] for p in parse]), np.int64)
    finally:
        if collects:
            gc.enable()
    places = begins[order]
    shared = np.concatenate([[0], _common(text, places[:-1], places[1:], width)])
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    # the next phrase of each window, and how far it is; one whose trigger the window does not hold whole is not its own
    following = np.searchsorted(begins[: len(order)], at)
    inside = following < len(order)
    tail = np.where(inside, begins[np.minimum(following, len(order) - 1)] - at, width)
    tail = np.where(tail > width - TRIGGER, width, tail)
    with np.errstate(over="ignore"):
        x = _mixed(text.astype(np.uint64) + np.uint64(1))
        power = np.cumprod(np.full(len(text) + 1, _ODD), dtype=np.uint64)
        back = np.cumprod(np.full(len(text) + 1, _INVERSE), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(x * power[:-1], dtype=np.uint64)])
        key = _mixed((sums[at + tail] - sums[at]) * back[at] + tail.astype(np.uint64))
        by_tail = np.argsort(tail, kind="stable")
        cuts = np.searchsorted(tail[by_tail], np.arange(width + 1))
        for t in range(width):
            own = by_tail[cuts[t] : cuts[t + 1]]
            if len(own):
                agree = np.cumsum(shared < width - t)
                key[own] = _mixed(key[own] ^ (agree[where[following[own]]].astype(np.uint64) * _ODD))
    sort = np.argsort(key, kind="stable")
    same = key[sort][1:] == key[sort][:-1]
    apart = np.flatnonzero(same)
    if (_common(text, at[sort[apart]], at[sort[apart + 1]], width) < width).any():  # two windows with one key: by their bytes, then
        whole = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, width)[at]).view(f"V{width}").ravel()
        return piece, np.unique(whole, return_inverse=True)[1].ravel()
    classes = np.empty(len(at), np.int64)
    classes[sort] = np.cumsum(np.concatenate([[0], ~same])) if len(at) else 0
    return piece, classes
