"""Linear suffix-array construction by Lyndon groups.

Phase 1 takes the groups of suffixes in descending order, starting from groups by
first symbol. Each suffix of the group points to its previous suffix of a smaller
group; the prefix of that one grows by this group's prefix, once for each suffix that
points to it, so it moves into a new group behind its old one. In the end a group's
common prefix is its suffixes' longest Lyndon prefix.

Phase 2 walks the array upwards: behind every placed suffix, the chain of these
pointers puts suffixes at the next free places of their groups. Nothing is named
again or sorted recursively.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of all suffixes of ``text`` (non-negative integers) in ascending order."""
    symbols = [*text, -1]
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    group, members, first_by_end = [0] * n, {}, {}
    first = 0
    for rank, i in enumerate(order):
        if rank and symbols[i] != symbols[order[rank - 1]]:
            first = rank
        group[i] = first
        members.setdefault(first, set()).add(i)
    for first, own in members.items():
        first_by_end[first + len(own)] = first
    smaller = [-1] * n
    end = n
    while end:
        now = first_by_end[end]
        reached: dict[int, int] = defaultdict(int)
        for i in sorted(members[now]):
            j = i - 1
            while j >= 0 and group[j] >= now:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                reached[j] += 1
        grown: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for j, times in reached.items():
            grown[group[j]][times].append(j)
        for old, by_times in grown.items():
            own = members.pop(old)
            stop = old + len(own)
            for times in sorted(by_times, reverse=True):
                moved = by_times[times]
                own.difference_update(moved)
                first_by_end[stop] = stop - len(moved)
                stop -= len(moved)
                members[stop] = set(moved)
                for j in moved:
                    group[j] = stop
            if own:
                members[old] = own
                first_by_end[stop] = old
        end = now
    out, placed, free = [0] * n, [False] * n, list(range(n))
    out[0], placed[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            out[free[group[j]]] = j
            free[group[j]] += 1
            placed[j] = True
            j = smaller[j]
    return out[1:]


def common_prefixes(text: Sequence[int], order: Sequence[int]) -> list[int]:
    """Length of the common prefix of each suffix in ``order`` with the one before it (0 for the first)."""
    rank = [0] * len(order)
    for k, i in enumerate(order):
        rank[i] = k
    out, h = [0] * len(order), 0
    for i in range(len(order)):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < len(order) and j + h < len(order) and text[i + h] == text[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def repeated_starts(texts: Sequence[bytes], length: int) -> list[list[int]]:
    """For every text the starts of its ``length``-byte strings that also start anywhere else in ``texts``."""
    joined: list[int] = []
    owner: list[tuple[int, int]] = []
    for k, text in enumerate(texts):
        joined += text
        owner += [(k, i) for i in range(len(text))]
        joined.append(256 + k)
        owner.append((k, len(text)))
    order = suffix_array(joined)
    shared = common_prefixes(joined, order)
    out: list[list[int]] = [[] for _ in texts]
    for k, at in enumerate(order):
        if max(shared[k], shared[k + 1] if k + 1 < len(order) else 0) >= length:
            out[owner[at][0]].append(owner[at][1])
    return [sorted(x) for x in out]
