"""Suffix array by linear grouping of suffixes under their Lyndon prefixes.

First phase: suffixes are grouped by their longest Lyndon prefix.  Groups start as first signs and
are handled in descending order.  For each suffix of a group, its previous-smaller pointer is the
last earlier suffix in a lower group; those are regrouped by how many members of the handled group
point at them, which appends the handled prefix to theirs.  Second phase: going up the order,
the suffix before each one taken, and those its pointers lead to, take the next place in their group.
No suffix is renamed and nothing is recursive.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes of ``text`` in ascending order."""
    n = len(text)
    if not n:
        return []
    first = {c: k for k, c in enumerate(sorted(set(text)), 1)}
    # Groups form a linked list in ascending order; `rank` is re-dealt when a gap is used up.
    group = [first[c] for c in text]
    members: dict[int, set[int]] = defaultdict(set)
    for i, g in enumerate(group):
        members[g].add(i)
    rank: dict[int, int] = {g: g << 40 for g in members}
    below = {g: g - 1 for g in members}
    top = len(first)
    above = {g: g + 1 if g < top else None for g in members}
    new = top
    prev = [-2] * n
    now = top
    while now:
        own = sorted(members[now])
        mine = rank[now]
        for s in own:
            j = s - 1
            while j >= 0 and rank[group[j]] >= mine:
                j = prev[j]
            prev[s] = j
        times: dict[int, int] = defaultdict(int)
        for s in own:
            if prev[s] >= 0:
                times[prev[s]] += 1
        by: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for p, k in times.items():
            by[k][group[p]].append(p)
        for k in sorted(by, reverse=True):
            for g, moved in by[k].items():
                if len(moved) == len(members[g]):
                    continue  # all of the group moves: it stays as it is, below what moved before
                new += 1
                up = above.get(g)
                low, high = rank[g], rank[up] if up in rank else rank[g] + (2 << 40)
                if high - low < 2:
                    _spread(rank, below, above, g)
                    low, high = rank[g], rank[up] if up in rank else rank[g] + (2 << 40)
                rank[new] = (low + high) // 2
                below[new], above[new] = g, up
                above[g] = new
                if up in rank:
                    below[up] = new
                members[new] = set(moved)
                members[g].difference_update(moved)
                for p in moved:
                    group[p] = new
        now = below[now]
    order = sorted((g for g in members if members[g]), key=rank.__getitem__)
    at, place = 0, {}
    for g in order:
        place[g] = at
        at += len(members[g])
    out, done = [-1] * n, [False] * n

    def settle(s: int) -> None:
        while s >= 0 and not done[s]:
            done[s] = True
            out[place[group[s]]] = s
            place[group[s]] += 1
            s = prev[s]

    settle(n - 1)
    for i in range(n):
        settle(out[i] - 1)
    return out


def _spread(rank, below, above, at) -> None:
    """Deal ranks anew, wide apart, in the order of the list."""
    while below.get(at) in rank:
        at = below[at]
    k = 1
    while at in rank:
        rank[at] = k << 40
        k += 1
        at = above.get(at)


def repeated_windows(docs: Sequence[bytes], width: int) -> list[list[bool]]:
    """For documents in order, whether each byte lies in a ``width``-byte string that an earlier one holds.

    In-memory form of the repeat operator: neighbours in the suffix array that share ``width`` signs form
    a run, and every start in a run whose document is not the run's first covers its window.
    """
    text: list[int] = []
    owner: list[int] = []
    for k, d in enumerate(docs):
        text += [x + len(docs) for x in d] + [k]  # a separator of its own ends each document
        owner += [k] * (len(d) + 1)
    order = suffix_array(text)
    cover = [[False] * len(d) for d in docs]
    base, at = [], 0
    for d in docs:
        base.append(at)
        at += len(d) + 1
    fits = lambda s: s - base[owner[s]] + width <= len(docs[owner[s]])
    run: list[int] = []
    for s in [*order, None]:
        if s is not None and run and fits(s) and text[run[-1] : run[-1] + width] == text[s : s + width]:
            run.append(s)
            continue
        least = min((owner[x] for x in run), default=0)
        for x in run:
            if owner[x] > least:
                a = x - base[owner[x]]
                cover[owner[x]][a : a + width] = [True] * width
        run = [s] if s is not None and fits(s) else []
    return cover
