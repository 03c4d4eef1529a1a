"""Union of linked items inside one bounded block."""

from __future__ import annotations

import numpy as np


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item reachable by the links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        open_ = low < high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def exact_links(sets: list[np.ndarray], numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among sets of 64-bit values: pairs (i, root) of each linked component.

    Every pair sharing a value is counted through an inverted index, so the
    result is that of comparing all pairs: linked if
    denominator * intersection >= numerator * union.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    new = np.empty(len(ranked), dtype=bool)
    new[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(ranked))
    of = np.empty(len(every), dtype=np.int64)
    of[order] = group
    posting = owner[order]
    offset = np.concatenate([[0], np.cumsum(sizes)])
    left, right = [], []
    for i in range(1, n):
        groups = of[offset[i] : offset[i + 1]]
        first = begin[groups]
        length = end[groups] - first
        total = int(length.sum())
        step = np.ones(total, dtype=np.int64)
        step[0] = first[0]
        at = np.cumsum(length)[:-1]
        step[at] = first[1:] - (first[:-1] + length[:-1] - 1)
        shared = np.bincount(posting[np.cumsum(step)], minlength=n)[:i]
        linked = np.flatnonzero((shared > 0) & (denominator * shared >= numerator * (sizes[:i] + sizes[i] - shared)))
        if len(linked):
            left.append(np.full(len(linked), i))
            right.append(linked)
    if not left:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    root = roots_of(n, np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]
