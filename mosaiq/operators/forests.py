"""Minimum spanning forests inside a task, on arrays of edges."""

from __future__ import annotations

import numpy as np


def pick_least(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n components the position of its first edge (edges are in order of weight), or -1."""
    best = np.full(n, len(u), np.int64)
    at = np.arange(len(u))
    np.minimum.at(best, u, at)
    np.minimum.at(best, v, at)
    best[best == len(u)] = -1
    return best


def merge_labels(parent: np.ndarray) -> np.ndarray:
    """Roots of a forest of parent pointers, by doubling."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def local_forest(u: np.ndarray, v: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Borůvka inside a task. Edges are in order of weight; ``own`` says which vertices belong here.

    Returns (label of each vertex, positions of forest edges). A component joins along its lightest edge, which is
    certain to be in the forest as all edges at own vertices are known; it waits where that edge leads outside.
    """
    label, chosen, live = np.arange(n), [], np.arange(len(u))
    while True:
        lu, lv = label[u[live]], label[v[live]]
        keep = lu != lv
        live, lu, lv = live[keep], lu[keep], lv[keep]
        if not len(live):
            break
        best = pick_least(lu, lv, n)
        c = np.flatnonzero((best >= 0) & own)
        e = best[c]
        inside = own[lu[e]] & own[lv[e]]
        c, e = c[inside], e[inside]
        if not len(c):
            break
        other = np.where(lu[e] == c, lv[e], lu[e])
        parent = np.arange(n)
        parent[c] = other
        two = (parent[parent[c]] == c) & (c < parent[c])
        parent[c[two]] = c[two]
        label = merge_labels(parent)[label]
        chosen.append(np.unique(live[e]))
    return label, np.unique(np.concatenate(chosen)) if chosen else np.empty(0, np.int64)


def thin(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the edges of a minimum spanning forest, ties going to the edge of smaller ends."""
    if not len(u):
        return np.empty(0, np.int64)
    order = np.lexsort((v, u, w))
    ids, inv = np.unique(np.r_[u, v], return_inverse=True)
    keep = local_forest(inv[: len(u)][order], inv[len(u) :][order], np.ones(len(ids), bool), len(ids))[1]
    return order[keep]
