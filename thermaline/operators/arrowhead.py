"""Least squares where most parameters belong to one time only.

An observation depends on a few parameters shared by all times and on those of its own time. Projecting each time's
rows off its own parameters leaves a small system in the shared ones, a sum over times; its solution gives each time's own
by one more small solve. Only the small system reaches the driver. Numpy only; the rows of one time are bounded by the
number of reference locations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Eigenvalues of the scaled shared system below this share of the largest count as zero.
RANK = 1e-14


@dataclass
class Rows:
    """Observations of one time: shared and own design, values and weights."""

    g: np.ndarray
    l: np.ndarray
    y: np.ndarray
    w: np.ndarray


def own_inverse(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orthonormal basis of the weighted own design, its pseudo-inverse and that of its normal matrix."""
    a = rows.l * np.sqrt(rows.w)[:, None]
    if not a.size:
        k = a.shape[1]
        return np.zeros((len(a), 0)), np.zeros((k, len(a))), np.zeros((k, k))
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    keep = s > s.max() * 1e-11 if s.size and s.max() > 0 else np.zeros(len(s), dtype=bool)
    u, s, vt = u[:, keep], s[keep], vt[keep]
    return u, (vt.T / s) @ u.T, (vt.T / s**2) @ vt


def partial(rows: Rows, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int, int]:
    """Contribution to the shared system for the residual at ``p``: normal matrix, right side, squares, observations, rank of the own design."""
    sw = np.sqrt(rows.w)
    u, _, _ = own_inverse(rows)
    g, r = rows.g * sw[:, None], (rows.y - rows.g @ p) * sw
    g, r = g - u @ (u.T @ g), r - u @ (u.T @ r)
    return g.T @ g, g.T @ r, float(r @ r), len(r), u.shape[1]


def solve(s: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Step, inverse and rank of a shared system, scaled to unit diagonal; directions that nothing determines stay zero."""
    if not len(b):
        return np.zeros(0), np.zeros((0, 0)), 0
    d = np.sqrt(np.where(np.diag(s) > 0, np.diag(s), 1.0))
    scaled = s / d[:, None] / d[None, :]
    inverse = np.linalg.pinv(scaled, rcond=RANK, hermitian=True) / d[:, None] / d[None, :]
    return inverse @ b, inverse, int(np.linalg.matrix_rank(scaled, tol=RANK * np.linalg.norm(scaled, 2), hermitian=True))


def own(rows: Rows, p: np.ndarray, cov: np.ndarray, err: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Own parameters, their covariance, that with the shared ones, how they follow the shared ones, and their own normal inverse."""
    _, pinv, normal = own_inverse(rows)
    sw = np.sqrt(rows.w)
    value = pinv @ ((rows.y - rows.g @ p) * sw)
    follow = pinv @ (rows.g * sw[:, None])
    cross = -follow @ cov
    return value, normal * err - cross @ follow.T, cross, follow, normal * err


def root(cov: np.ndarray) -> np.ndarray:
    """Lower triangular root of a covariance matrix, by eigenvectors where it is singular."""
    try:
        return np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(cov)
        return np.linalg.qr((vectors * np.sqrt(np.maximum(values, 0.0))).T)[1].T


def dense(blocks: list[Rows]) -> tuple[np.ndarray, np.ndarray, float]:
    """The same problem as one matrix: parameters (shared, then each time's), covariance and error variance. For tests."""
    ng, nl, n = blocks[0].g.shape[1], blocks[0].l.shape[1], len(blocks)
    x = np.zeros((sum(len(b.y) for b in blocks), ng + nl * n))
    at = 0
    for k, b in enumerate(blocks):
        x[at : at + len(b.y), :ng] = b.g
        x[at : at + len(b.y), ng + k * nl : ng + (k + 1) * nl] = b.l
        at += len(b.y)
    w, y = np.sqrt(np.concatenate([b.w for b in blocks])), np.concatenate([b.y for b in blocks])
    scale = np.maximum(np.linalg.norm(x * w[:, None], axis=0), 1e-300)
    p = np.linalg.lstsq(x * w[:, None] / scale, y * w, rcond=1e-13)[0] / scale
    r = (y - x @ p) * w
    err = float(r @ r) / (len(y) - np.linalg.matrix_rank(x * w[:, None] / scale, tol=1e-9))
    inverse = np.linalg.pinv((x * w[:, None] / scale).T @ (x * w[:, None] / scale), rcond=1e-13, hermitian=True) / scale[:, None] / scale[None, :]
    return p, inverse * err, err
