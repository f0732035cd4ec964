"""Connected parts of one task's rows."""

from __future__ import annotations

import numpy as np


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex of the connected part of each of n vertices."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (root[root] != root).any():
            root = root[root]
