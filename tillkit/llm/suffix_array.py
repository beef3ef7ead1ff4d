"""Suffix sorting by linear grouping.

Suffixes are grouped by their Lyndon prefix, groups are taken from the highest
down, and each group refines the groups of its members' previous smaller
suffixes. A second pass writes every group's members in their final order. No
renaming, no recursion.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of ``text`` (any integers, any repeats)."""
    n = len(text) + 1  # an end mark, smaller than all, stands at n - 1
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    order = [n - 1]
    group = [0] * n          # start of each suffix's group in ``order``
    size = [0] * n           # members of the group that starts here
    size[0] = 1
    for c in sorted(by_symbol):
        members = by_symbol[c]
        start = len(order)
        size[start] = len(members)
        for i in members:
            group[i] = start
        order += members
    where = [0] * n
    for k, i in enumerate(order):
        where[i] = k
    smaller = list(range(-1, n - 1))  # previous suffix that may be smaller

    # Refine, highest group first.
    end = n - 1
    while end >= 0:
        start = group[order[end]]
        hits: dict[int, int] = {}
        for i in order[start:end + 1]:
            p = smaller[i]
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        if hits:
            ranks = set(hits.values())
            for count in sorted(ranks, reverse=True):
                moved = [p for p, k in hits.items() if k == count] if len(ranks) > 1 else list(hits)
                homes: dict[int, list[int]] = {}
                for p in moved:
                    homes.setdefault(group[p], []).append(p)
                for home, own in homes.items():
                    left = size[home]
                    if len(own) == left:
                        continue  # the whole group moves on together
                    for p in own:
                        left -= 1
                        other, at = order[home + left], where[p]
                        order[at], where[other] = other, at
                        order[home + left], where[p] = p, home + left
                    size[home] = left
                    size[home + left] = len(own)
                    for p in own:
                        group[p] = home + left
        end = start - 1

    # Emit: the least suffix first, each suffix placing its predecessors.
    free = group[:]
    placed = [False] * n
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = True
    fill = list(range(n))
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not placed[p]:
            home = free[p]
            out[fill[home]] = p
            fill[home] += 1
            placed[p] = True
            p = smaller[p]
    return out[1:]


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Symbols that each suffix shares with the one before it in ``order``."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out, same = [0] * n, 0
    for i in range(n):
        k = rank[i]
        if not k:
            same = 0
            continue
        j = order[k - 1]
        while i + same < n and j + same < n and text[i + same] == text[j + same]:
            same += 1
        out[k] = same
        if same:
            same -= 1
    return out
