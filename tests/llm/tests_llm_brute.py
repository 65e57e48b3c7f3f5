"""Brute-force models that several tests use."""

from itertools import combinations


def components(rows, level):
    """Ids that stay: the least of each component of links, and all without words."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + level.n]) for i in range(max(1, len(w) - level.n + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and level.den * len(a & b) >= level.num * len(a | b):
            p, q = sorted((root(i), root(j)))
            up[q] = p
    return {rows[root(i)][0] for i in range(len(rows))}
