"""Partitioning around medoids on a whole matrix of distances, for small inputs."""

import numpy as np


def _by_blocks(d, f):
    return f(d)


def pam_build(d: np.ndarray, k: int) -> list[int]:
    """BUILD: the first of its medoids are those of a smaller k."""
    medoids = [int(_by_blocks(d, lambda x: x.sum(1)).argmin())]
    near = d[:, medoids].min(1)
    while len(medoids) < k:
        gain = _by_blocks(d, lambda x: np.maximum(near - x, 0).sum(1))
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
        near = np.minimum(near, d[:, medoids[-1:]][:, 0])
    return medoids


def pam(d: np.ndarray, k: int, rounds: int = 300, built: list[int] | None = None) -> np.ndarray:
    """Medoids of distances: BUILD, then the best swap while the cost falls; ties to the lowest index."""
    medoids = (built or pam_build(d, k))[:k]
    cost = d[:, medoids].min(1).sum()
    for _ in range(rounds):
        own = d[:, medoids]
        rests = [np.delete(own, i, 1).min(1) if k > 1 else np.full(len(d), np.inf) for i in range(k)]
        swaps = _by_blocks(d, lambda x: np.stack([np.minimum(rest, x).sum(1) for rest in rests]))  # noqa: B023
        best = (cost - 1e-12, None)
        for i, costs in enumerate(swaps):
            costs[medoids] = np.inf
            j = int(costs.argmin())
            if costs[j] < best[0]:
                best = (costs[j], (i, j))
        if best[1] is None:
            break
        medoids[best[1][0]], cost = best[1][1], best[0]
    return np.array(sorted(medoids))


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    k = labels.max() + 1
    onehot = np.eye(k)[labels]
    sums, n = _by_blocks(d, lambda x: (x @ onehot).T).T, onehot.sum(0)
    own = sums[np.arange(len(d)), labels] / np.maximum(n[labels] - 1, 1)
    other = sums / n
    other[np.arange(len(d)), labels] = np.inf
    b = other.min(1)
    s = np.where(n[labels] == 1, 0.0, (b - own) / np.maximum(np.maximum(own, b), 1e-300))
    return float(s.mean())
