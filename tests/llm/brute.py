"""Plain computations that several tests hold results against."""

from __future__ import annotations

from collections import defaultdict


def classes(rows, percent=80):
    """(id, set size, smallest id reached by links) of rows (id, text)."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j])):
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in members[find(i)] if rows[j][0] is not None]
        out.append((k, len(sets[i]), min(ids) if ids else None))
    return out
