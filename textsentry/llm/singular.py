"""Singular values and right vectors of a small triangle, without squaring it.

Householder reflections reduce the matrix to an upper bidiagonal; the dqds
transform takes its singular values, down to the smallest with high relative
accuracy, and twisted factorisations give the vectors of the wanted ones. All
of it works on a matrix of the size of one row, whatever the data.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps
# Steps allowed per singular value; a handful is usual.
_STEPS = 200
# Values closer than this, relatively, have their vectors made orthogonal to one another.
_CLUSTER = 1e-3


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and ``v`` of ``u.T @ matrix @ v``, which is upper bidiagonal."""
    a = np.array(matrix, np.float64)
    size = a.shape[1]
    v = np.eye(size)
    for k in range(size):
        _reflect(a[k:, k:])
        if k + 2 < size:
            h = _reflect(a[k:, k + 1 :].T)
            v[:, k + 1 :] -= 2.0 * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _reflect(block: np.ndarray) -> np.ndarray:
    """Turn the first column of ``block`` onto its first entry, in place; the reflection's unit vector."""
    h = block[:, 0].copy()
    scale = np.abs(h).max(initial=0.0)
    if not scale or not np.abs(h[1:]).max(initial=0.0):
        return np.zeros_like(h)
    h /= scale
    h[0] += np.copysign(np.sqrt(h @ h), h[0])
    h /= np.sqrt(h @ h)
    block -= 2.0 * np.outer(h, h @ block)
    block[1:, 0] = 0.0
    return h


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """One transform of squares ``q`` and ``e`` with ``shift``; false if the shift is above the least value."""
    top, off = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    for i in range(len(e)):
        top[i] = d + e[i]
        if d < 0 or top[i] <= 0:
            return top, off, False
        ratio = q[i + 1] / top[i]
        off[i] = e[i] * ratio
        d = d * ratio - shift
    top[-1] = d
    return top, off, d >= 0


def _shift(q: np.ndarray, e: np.ndarray) -> float:
    """The smaller eigenvalue of the trailing two rows, a little lowered: mostly just below the least one."""
    a, b, c = q[-2], e[-1], q[-1]
    half = 0.5 * (a + b + c)
    return max(0.0, a * c / (half + np.sqrt(max(half * half - a * c, 0.0)) or 1.0)) if half > 0 else 0.0


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The singular values of an upper bidiagonal, falling, by dqds with deflation."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if not scale:
        return np.zeros(len(diagonal))
    found: list[float] = []
    blocks = [((diagonal / scale) ** 2, (above / scale) ** 2, 0.0)]
    while blocks:
        q, e, base = blocks.pop()
        for _ in range(_STEPS * max(len(q), 1)):
            if len(q) == 0:
                break
            small = np.flatnonzero(e <= _EPS * _EPS * (base + np.minimum(q[:-1], q[1:]))) if len(e) else []
            if len(q) == 1 or (len(small) and small[-1] == len(e) - 1):
                found.append(base + q[-1])
                q, e = q[:-1], e[: len(q) - 2 if len(q) > 1 else 0]
                continue
            if len(small):
                at = int(small[-1]) + 1
                blocks.append((q[:at], e[: at - 1], base))
                q, e = q[at:], e[at:]
                continue
            if q[0] < q[-1]:  # grade the block downwards, so that the least values come out first
                q, e = _flipped(q, e)
                continue
            shift = _shift(q, e)
            for trial in (shift, 0.75 * shift, 0.25 * shift, 0.0):
                top, off, fits = _dqds(q, e, trial)
                if fits:
                    break
            q, e, base = top, off, base + trial
        else:
            raise ArithmeticError("dqds did not converge")
    return scale * np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def _flipped(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block read backwards: the bidiagonal of the same singular values that starts with its last row.

    A zero-shift transform keeps the values; the reversed transpose has the same squares.
    """
    return q[::-1].copy(), e[::-1].copy()


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """An eigenvector of ``L D L'`` near ``value``: both factorisations meet at the row of the least pivot."""
    n, tiny = len(d), np.finfo(np.float64).tiny / _EPS
    safe = lambda x: x if abs(x) > tiny else tiny
    down, s = np.empty(max(n - 1, 0)), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = safe(s[i] + d[i])
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    up, p = np.empty(max(n - 1, 0)), np.empty(n)
    p[-1] = d[-1] - value
    gamma = np.empty(n)
    gamma[-1] = s[-1] + d[-1]
    for i in range(n - 2, -1, -1):
        ratio = d[i] / safe(d[i] * low[i] * low[i] + p[i + 1])
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
        gamma[i] = s[i] + ratio * p[i + 1]
    z = np.zeros(n)
    r = int(np.argmin(np.abs(gamma)))
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
        if abs(z[i + 1]) > 1e100:
            z /= abs(z[i + 1])
    return z / np.sqrt(z @ z)


def _independent(z: np.ndarray, others: list[np.ndarray], tri: np.ndarray, square: float) -> np.ndarray:
    """``z`` without its part in ``others``; where little is left, inverse iteration finds a vector beside them."""

    def cleared(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for y in others:
                x = x - (x @ y) * y
        return x

    if not others:
        return z
    out = cleared(z)
    if np.sqrt(out @ out) > 0.5:
        return out / np.sqrt(out @ out)
    rng = np.random.default_rng(len(others))
    out = cleared(rng.standard_normal(len(z)))
    shifted = tri - (square + 4 * _EPS * np.abs(tri).max()) * np.eye(len(z))
    for _ in range(4):
        out /= np.sqrt(out @ out)
        try:
            out = cleared(np.linalg.solve(shifted, out))
        except np.linalg.LinAlgError:
            break
    return out / np.sqrt(out @ out)


def leading_directions(triangle: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All singular values of ``triangle``, falling, and its first ``count`` right vectors as columns."""
    diagonal, above, v = bidiagonalise(triangle)
    values = singular_values(diagonal, above)
    scale = max(values.max(initial=0.0), np.finfo(np.float64).tiny)
    diagonal, above = diagonal / scale, above / scale
    floor = _EPS * _EPS
    diagonal = np.where(np.abs(diagonal) < floor, floor, diagonal)  # keeps the factors finite
    d, low = diagonal * diagonal, above / diagonal[:-1]
    tri = np.diag(d)
    tri[1:, 1:] += np.diag(above * above)
    tri += np.diag(diagonal[:-1] * above, 1) + np.diag(diagonal[:-1] * above, -1)
    # The bidiagonal is split where it is split to working precision, else a vector would leak across.
    cuts = [0, *(np.flatnonzero(np.abs(above) <= _EPS * floor) + 1).tolist(), len(d)]
    out: list[np.ndarray] = []
    for k in range(min(count, len(values))):
        square = (values[k] / scale) ** 2
        near = [out[j] for j in range(k) if values[j] - values[k] <= _CLUSTER * values[0]]
        best = None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            z = np.zeros(len(d))
            z[a:b] = _twisted(d[a:b], low[a : b - 1], square)
            z = _independent(z, near, tri, square)
            miss = np.abs(tri @ z - square * z).max()
            if best is None or miss < best[0]:
                best = (miss, z)
        out.append(best[1])
    return values, v @ np.array(out).T if out else np.zeros((len(d), 0))
