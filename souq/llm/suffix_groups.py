"""Suffix array by linear grouping.

Phase one groups suffixes by their Lyndon prefix.  Suffixes start in groups
by first symbol; groups are taken in descending order.  Every suffix s of the
group finds its previous smaller one p (through the pointers of suffixes that
were taken before), and the p's leave their groups: those that were found by
more suffixes of the group go to a higher new group, right above the one that
they leave.  Phase two emits the order: from the smallest suffix on, each
suffix emitted puts its predecessor, and the chain of that one's pointers, at
the next free places of their groups.  Nothing is renamed or recursed.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of all suffixes in ascending order; the last symbol must be the unique smallest."""
    n = len(symbols)
    members: dict[int, set] = {}
    for i, c in enumerate(symbols):
        members.setdefault(c, set()).add(i)
    names = sorted(members)
    group_of = [0] * n
    below: list[int] = []                       # the next lower group
    content: list[set] = []
    for k, c in enumerate(names):
        below.append(k - 1)
        content.append(members[c])
        for i in members[c]:
            group_of[i] = k
    above = [k + 1 for k in range(len(names))]
    above[-1] = -1
    top = len(names) - 1
    prev, done = [-1] * n, [False] * n
    g = top
    while g >= 0:
        found: dict[int, int] = {}
        for s in sorted(content[g]):
            j = s - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[s] = j
            done[s] = True
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        if found:
            by_count: dict[int, list] = {}
            for p, k in found.items():
                by_count.setdefault(k, []).append(p)
            for k in sorted(by_count, reverse=True):
                leaving: dict[int, list] = {}
                for p in by_count[k]:
                    leaving.setdefault(group_of[p], []).append(p)
                for old, ps in leaving.items():
                    if len(ps) == len(content[old]):
                        continue                # all leave: the group itself is the new one
                    new = len(content)
                    content.append(set(ps))
                    content[old].difference_update(ps)
                    below.append(old)
                    above.append(above[old])
                    if above[old] >= 0:
                        below[above[old]] = new
                    else:
                        top = new
                    above[old] = new
                    for p in ps:
                        group_of[p] = new
        g = below[g]
    # phase two
    start, at, g = [0] * len(content), 0, 0
    while g >= 0:
        start[g] = at
        at += len(content[g])
        g = above[g]
    out, placed = [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    start[group_of[n - 1]] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            k = group_of[s]
            out[start[k]] = s
            start[k] += 1
            placed[s] = True
            s = prev[s]
    return out


def common_prefixes(symbols: list[int], order: list[int]) -> list[int]:
    """lcp[i]: symbols that the suffixes order[i - 1] and order[i] have in common (lcp[0] = 0)."""
    n = len(symbols)
    rank, lcp, k = [0] * n, [0] * n, 0
    for i, s in enumerate(order):
        rank[s] = i
    for s in range(n):
        r = rank[s]
        if r:
            t = order[r - 1]
            while s + k < n and t + k < n and symbols[s + k] == symbols[t + k]:
                k += 1
            lcp[r] = k
            k = max(0, k - 1)
        else:
            k = 0
    return lcp
