"""Eigenvalues and eigenvectors of a symmetric matrix: reduction to tridiagonal form, then divide and conquer.

A tridiagonal matrix is torn into two halves and a rank-one change. The halves are solved, entries that the change hardly touches are deflated, and the
roots of the secular equation give the eigenvalues of the whole, each held as its distance from the nearer pole. The vectors come from the change that has
exactly these roots, so they are orthogonal however close the roots lie.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
_HALVINGS = 90


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q): q.T @ a @ q is tridiagonal, by reflections of one column after the other."""
    a, n = np.array(a, dtype=np.float64), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if not size:
            continue
        x[0] += np.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """m[i, j] = d[i] - root j of 1 + rho * sum(z2 / (d - x)), for rising d; each column to full relative precision."""
    k = len(d)
    ends = np.append(d[1:], d[-1] + rho * z2.sum())
    gap = ends - d
    mid = 1 + rho * (z2[:, None] / (d[:, None] - (d + gap / 2)[None, :])).sum(axis=0)
    left = mid > 0
    left[-1] = True
    pole = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    away = d[:, None] - d[pole][None, :]
    sign = np.where(left, 1.0, -1.0)
    lo, hi = np.zeros(k), np.where(np.arange(k) == k - 1, gap, gap / 2)
    for _ in range(_HALVINGS):
        # halve the exponent first, then the interval
        at = np.where(lo > hi / 4, (lo + hi) / 2, np.sqrt(np.maximum(lo, hi * 1e-200)) * np.sqrt(hi))
        f = 1 + rho * (z2[:, None] / (away - (sign * at)[None, :])).sum(axis=0)
        far = (f > 0) == left  # the root is nearer to the pole than this
        hi, lo = np.where(far, at, hi), np.where(far, lo, at)
    return away - (sign * (lo + hi) / 2)[None, :]


def _merge(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of diag(d) + rho * z z', rho >= 0."""
    n = len(d)
    order = np.argsort(d, kind="stable")
    d, z, turn = d[order].copy(), z[order].copy(), np.eye(n)[:, order]
    size = float(z @ z)
    if size:
        z, rho = z / np.sqrt(size), rho * size
    small = 8 * EPS * max(float(np.abs(d).max()), rho)
    live: list[int] = []
    for i in range(n):
        if rho * abs(z[i]) <= small:
            z[i] = 0.0
            continue
        if live:
            j = live[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[i] / r, z[j] / r
            if abs((d[i] - d[j]) * c * s) <= small:  # two poles as good as one: turn the change into one of them
                turn[:, [j, i]] = turn[:, [j, i]] @ np.array([[c, s], [-s, c]])
                d[j], d[i] = d[j] * c * c + d[i] * s * s, d[j] * s * s + d[i] * c * c
                z[j], z[i] = 0.0, r
                live.pop()
        live.append(i)
    values, vectors = d.copy(), np.eye(n)
    if live:
        at = np.array(live)
        at = at[np.argsort(d[at], kind="stable")]
        own, zs = d[at], z[at]
        m = _roots(own, zs * zs, rho)
        values[at] = own - np.diag(m)
        # the change that has exactly these roots
        k = len(at)
        between = own[:, None] - own[None, :]
        np.fill_diagonal(between, 1.0)
        ratio = m[:, :-1] / np.where(np.arange(k - 1)[None, :] < np.arange(k)[:, None], between[:, :-1], between[:, 1:]) if k > 1 else np.ones((k, 0))
        exact = np.copysign(np.sqrt(np.abs(ratio.prod(axis=1) * m[:, -1] / rho)), zs)
        v = exact[:, None] / m
        vectors[np.ix_(at, at)] = v / np.linalg.norm(v, axis=0)
    rise = np.argsort(values, kind="stable")
    return values[rise], (turn @ vectors)[:, rise]


def divide(diagonal: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of a tridiagonal matrix."""
    n = len(diagonal)
    if n == 1:
        return diagonal.copy(), np.ones((1, 1))
    half = n // 2
    beta = float(off[half - 1])
    upper, lower = diagonal[:half].copy(), diagonal[half:].copy()
    upper[-1] -= abs(beta)
    lower[0] -= abs(beta)
    d1, q1 = divide(upper, off[: half - 1])
    d2, q2 = divide(lower, off[half:])
    z = np.concatenate([q1[-1], np.copysign(1.0, beta) * q2[0]])
    values, vectors = _merge(np.concatenate([d1, d2]), z, abs(beta))
    return values, np.concatenate([q1 @ vectors[:half], q2 @ vectors[half:]])


def symmetric(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, the largest entry of each being positive (of several the first)."""
    scale = float(np.abs(a).max()) if a.size else 0.0
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    diagonal, off, q = tridiagonal(np.asarray(a) / scale)
    values, vectors = divide(diagonal, off)
    vectors = (q @ vectors)[:, ::-1]
    return values[::-1] * scale, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))])
