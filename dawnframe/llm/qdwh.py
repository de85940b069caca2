"""Spectral divide-and-conquer by QDWH polar decompositions (a bounded matrix, on the driver).

The polar factor U of ``A - s I`` has eigenvalue +1 where A's is above the shift s and -1 below, so ``(U + I) / 2``
projects on the invariant subspace of the eigenvalues above s.  A is compressed to that subspace and to its complement,
and both are split again until single components remain.  U is found by the QR-based dynamically weighted Halley iteration
(Nakatsukasa, Bai and Gygi 2010; Nakatsukasa and Higham 2013), at most about six steps whatever the condition.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Beyond this weight a step goes by QR, which is stable for ill-conditioned matrices; below by Cholesky's cheaper solve.
QR_ABOVE = 100.0
STEPS = 40
#: A block whose eigenvalues agree to this part of the whole matrix's norm isn't split: any basis of it will do.
FLAT = 4 * EPS


def polar(a: np.ndarray) -> np.ndarray:
    """The symmetric orthogonal polar factor of a symmetric matrix without a zero eigenvalue."""
    k = len(a)
    scale = np.linalg.norm(a)
    if scale == 0:
        return np.eye(k)
    x = a / scale
    r = np.linalg.qr(x, mode="r")
    smallest = np.abs(np.diag(r)).min()
    low = EPS
    if smallest > EPS:
        low = max(EPS, 0.9 / (np.sqrt(k) * np.abs(np.linalg.inv(r)).sum(axis=0).max()))
    low = min(low, 1.0)
    eye = np.eye(k)
    for _ in range(STEPS):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        a_ = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))))
        b_ = (a_ - 1) ** 2 / 4
        c_ = a_ + b_ - 1
        if c_ > QR_ABOVE:
            q = np.linalg.qr(np.vstack([np.sqrt(c_) * x, eye]))[0]
            new = (b_ / c_) * x + (a_ - b_ / c_) / np.sqrt(c_) * (q[:k] @ q[k:].T)
        else:
            z = eye + c_ * (x.T @ x)
            half = np.linalg.solve(np.linalg.cholesky(z), x.T)
            new = (b_ / c_) * x + (a_ - b_ / c_) * np.linalg.solve(np.linalg.cholesky(z).T, half).T
        new = (new + new.T) / 2
        low = min(1.0, low * (a_ + b_ * low**2) / (1 + c_ * low**2))
        moved = np.linalg.norm(new - x)
        x = new
        if 1 - low < 10 * EPS and moved < np.cbrt(EPS):
            return x
    return x


def _range(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal basis of a projector's range: two subspace steps from its longest columns, picked so that they aren't parallel."""
    rest, picked = projector.copy(), []
    for _ in range(rank):
        at = int(np.argmax((rest * rest).sum(axis=0)))
        v = rest[:, at] / np.linalg.norm(rest[:, at])
        rest -= np.outer(v, v @ rest)
        picked.append(v)
    basis = np.linalg.qr(projector @ np.array(picked).T)[0]
    return np.linalg.qr(projector @ basis)[0]


def _shifts(a: np.ndarray):
    """Shifts to try: the median of the diagonal, then the mean, then places in Gershgorin's interval."""
    diagonal = np.diag(a)
    around = np.abs(a).sum(axis=1) - np.abs(diagonal)
    low, high = (diagonal - around).min(), (diagonal + around).max()
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    for part in (0.5, 0.381966, 0.618034, 0.25, 0.75, 0.1, 0.9, 0.05, 0.95):
        yield float(low + part * (high - low))


def _split(a: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the upper and the lower invariant subspace, or None if the eigenvalues are all one to working precision."""
    k = len(a)
    mean = np.trace(a) / k
    if np.linalg.norm(a - mean * np.eye(k)) <= FLAT * whole:
        return None
    best, left = None, np.inf
    for shift in _shifts(a):
        u = polar(a - shift * np.eye(k))
        upper = (u + np.eye(k)) / 2
        rank = int(round(float(np.trace(upper))))
        if not 0 < rank < k:
            continue
        above = _range(upper, rank)
        below = _range(np.eye(k) - above @ above.T, k - rank)
        error = np.linalg.norm(above.T @ a @ below)
        if error < left:
            best, left = (above, below), error
        if left <= 10 * EPS * k * whole:
            return best
    return best if best is not None and left <= 1e-10 * whole else _deflated(a)


def _deflated(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where no shift parts the eigenvalues (they lie within rounding of each other): the direction of the largest row, refined by polar powers."""
    k = len(a)
    mean = np.trace(a) / k
    b = a - mean * np.eye(k)
    v = b[:, int(np.argmax((b * b).sum(axis=0)))]
    v = v / np.linalg.norm(v)
    for _ in range(200):
        v = b @ (b @ v)
        v = v / np.linalg.norm(v)
    above = v[:, None]
    return above, _range(np.eye(k) - above @ above.T, k - 1)


def leading(a: np.ndarray, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    Only the subspaces that hold them are split on.  Values are Rayleigh quotients; each vector's largest entry is positive.
    """
    a = (np.asarray(a, float) + np.asarray(a, float).T) / 2
    d = len(a)
    count = d if count is None else min(count, d)
    whole = float(np.linalg.norm(a))
    found: list[np.ndarray] = []
    waiting = [np.eye(d)] if d else []  # bases, the one with the largest eigenvalues last
    while waiting and len(found) < count:
        basis = waiting.pop()
        inner = basis.T @ a @ basis
        parts = _split((inner + inner.T) / 2, whole) if basis.shape[1] > 1 else None
        if parts is None:
            found += list(basis.T)
        else:
            upper, lower = (np.linalg.qr(basis @ p)[0] for p in parts)
            waiting += [lower, upper]
    vectors = np.array([v / np.linalg.norm(v) for v in found]).reshape(-1, d)
    values = np.einsum("ij,jk,ik->i", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")[:count]
    vectors, values = vectors[order], values[order]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]) if len(vectors) else np.empty(0)
    return values, vectors * signs[:, None]
