"""Brute-force helpers of the corpus tests."""

from __future__ import annotations

from conftest_rows import line, prose

__all__ = ["components_by_force", "line", "prose"]


def components_by_force(ids, link):
    """Smallest reachable id of each id, comparing all pairs."""
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if link(a, b):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: root(i) for i in ids}
