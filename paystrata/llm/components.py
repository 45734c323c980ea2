"""Connected components of links inside one block."""

from __future__ import annotations

import numpy as np

def block_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links (a, b).

    Hooks every root to the smallest root it is linked to and shortens the
    paths, until nothing changes.
    """
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            shorter = root[root]
            if (shorter == root).all():
                break
            root = shorter
    return root
