"""A suffix array in linear time by grouping, without renaming and recursion.

Phase one sorts suffixes into groups by their Lyndon prefix, the longest Lyndon word that starts at the suffix. Groups begin as the symbols. They
are taken in descending order; each suffix of the group finds, over previous-smaller pointers, the nearest suffix before it in a
lower group, whose prefix it extends. Suffixes that are extended equally often leave their group for a new one right above it. A
group that has been taken is final. Phase two reads the array from its start and puts each suffix whose Lyndon prefix ends where the
read one begins in the next place of its group. (Grouping construction: Baier 2016.)
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Positions of `text` in suffix order. Symbols are numbers from 0; 0 parts texts and must come first; positions of 0 are left out.

    Suffixes end at the next 0, and equal ones are ordered by the order of those.
    """
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in by_symbol:
            by_symbol[c].append(i)
        else:
            by_symbol[c] = [i]
    ends = by_symbol.pop(0, [])
    if not by_symbol:
        return []
    symbols = sorted(by_symbol)
    number = {c: g for g, c in enumerate(symbols)}
    members = [by_symbol[c] for c in symbols]
    number[0] = -1
    group = [number[c] for c in text]
    upper = list(range(1, len(symbols) + 1))
    lower = list(range(-1, len(symbols) - 1))
    previous, taken = [0] * n, bytearray(n)
    final = []
    g = len(symbols) - 1
    while g >= 0:
        own = [s for s in members[g] if group[s] == g]
        if own:
            final.append((g, own))
            parents: dict[int, list[int]] = {}
            last, run = 0, 0
            for s in own:
                taken[s] = 1
                p = s - 1
                while taken[p]:
                    p = previous[p]
                previous[s] = p
                if p == last:
                    run += 1
                else:
                    if run and group[last] >= 0:
                        if run in parents:
                            parents[run].append(last)
                        else:
                            parents[run] = [last]
                    last, run = p, 1
            if run and group[last] >= 0:
                if run in parents:
                    parents[run].append(last)
                else:
                    parents[run] = [last]
            for run in sorted(parents, reverse=True) if len(parents) > 1 else parents:
                made: dict[int, int] = {}
                for p in parents[run]:
                    old = group[p]
                    if old in made:
                        new = made[old]
                        members[new].append(p)
                    else:
                        new = made[old] = len(members)
                        members.append([p])
                        above = upper[old]
                        upper.append(above)
                        lower.append(old)
                        lower[above] = new
                        upper[old] = new
                    group[p] = new
        members[g] = None
        g = lower[g]
    place = [0] * len(members)
    start = 0
    for g, own in reversed(final):
        place[g] = start
        start += len(own)
    out = [0] * start
    placed = bytearray(n)
    for s in ends:
        placed[s] = 1
    for source in (ends, out):
        for s in source:
            p = s - 1
            while p >= 0 and not placed[p]:
                g = group[p]
                q = place[g]
                out[q] = p
                place[g] = q + 1
                placed[p] = 1
                p = previous[p]
    return out
