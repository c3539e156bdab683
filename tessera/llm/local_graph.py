"""Numpy helpers that run inside one task."""

from __future__ import annotations

import numpy as np


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the undirected pairs (a[i], b[i]): the distinct ids, and for each the smallest id it reaches."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label) and np.array_equal(label[left], label[right]):
            return ids, ids[label]
        label = new
