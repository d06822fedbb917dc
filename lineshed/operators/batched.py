"""Solvers for many spectra at once, in NumPy: Voigt profiles, projections, bounded least squares.

What a call costs in the interpreter is shared by all spectra in it, and derivatives come with the profiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np

from lineshed.operators.kernels import _weideman

BLOCK = 4096  # points whose powers stay in the cache
POOL = 256  # spectra that are solved at a time
TERMS, POWERS = 40, 8  # errors of 2e-15 at most


def faddeeva_parts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary part of w(x + iy) for y of 0 or more.

    Weideman's expansion in TERMS terms, as polynomials of POWERS terms each (one matrix product) in the highest power.
    """
    shape = x.shape
    x, y = x.ravel(), np.broadcast_to(y, shape).ravel()
    scale, a = _weideman(TERMS)
    inner = np.ascontiguousarray(a[::-1].reshape(-1, POWERS))
    out = np.empty(len(x), dtype=np.complex128)
    powers = np.empty((POWERS, min(BLOCK, len(x))), dtype=np.complex128)
    powers[:1] = 1
    for at in range(0, len(x), BLOCK):
        u, v = scale + y[at : at + BLOCK], x[at : at + BLOCK]
        down = np.empty(len(v), dtype=np.complex128)  # 1 / (scale - iz)
        den = 1 / (u * u + v * v)
        np.multiply(u, den, out=down.real)
        np.multiply(v, den, out=down.imag)
        if len(v) < powers.shape[1]:
            powers = np.ascontiguousarray(powers[:, : len(v)])
        z = powers[1]
        np.multiply(2 * scale, down, out=z)
        z -= 1
        for k in range(2, POWERS):
            np.multiply(powers[k - 1], z, out=powers[k])
        sums = (inner @ powers.view(np.float64)).view(np.complex128)
        top, p = powers[-1] * z, sums[-1]
        for k in range(len(sums) - 2, -1, -1):
            p *= top
            p += sums[k]
        p *= 2 * down
        p += 1 / math.sqrt(math.pi)
        np.multiply(p, down, out=out[at : at + BLOCK])
    return out.real.reshape(shape), out.imag.reshape(shape)


def voigt_derivatives(energy: np.ndarray, center: np.ndarray, sigma: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, ...]:
    """Voigt profiles of area 1 and their derivatives by center, sigma and gamma, (rows, peaks, points) of axes (rows, points)."""
    sigma, gamma = np.broadcast_to(sigma, center.shape)[:, :, None], np.broadcast_to(gamma, center.shape)[:, :, None]
    sharp = sigma < 1e-10
    away = energy[:, None, :] - center[:, :, None]
    width = np.where(sharp, 1.0, sigma)
    root = width * math.sqrt(2)
    x, y = away / root, gamma / root
    real, imaginary = faddeeva_parts(x, y)
    slope, across = 2 * (y * imaginary - x * real), 2 / math.sqrt(math.pi) - 2 * (x * imaginary + y * real)
    k = 1 / (width * math.sqrt(2 * math.pi))
    out = k * real, -k / root * slope, -k / width * (real + x * slope - y * across), -k / root * across
    if sharp.any():
        with np.errstate(divide="ignore", invalid="ignore"):
            den = away * away + gamma * gamma
            lorentz = gamma / math.pi / den, 2 * gamma / math.pi * away / den**2, np.zeros_like(away), (away * away - gamma * gamma) / math.pi / den**2
        out = tuple(np.where(sharp, a, b) for a, b in zip(lorentz, out))
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of (rows, n, points) with (rows, points)."""
    return (a @ b[:, :, None])[:, :, 0]


def orthogonal(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal vectors of each row's span of b (rows, n, points), and the pseudoinverse of b; dependent ones give zeros."""
    q, n = b.copy(), b.shape[1]
    upper = np.zeros((len(b), n, n))
    for c in range(n):
        col = q[:, c]
        before = np.sqrt(np.einsum("ij,ij->i", col, col))
        for _ in range(2 if c else 0):
            s = product(q[:, :c], col)
            col -= (s[:, None, :] @ q[:, :c])[:, 0]
            upper[:, :c, c] += s
        norm = np.sqrt(np.einsum("ij,ij->i", col, col))
        good = norm > b.shape[2] * np.finfo(float).eps * before
        upper[:, c, c] = np.where(good, norm, 1)
        col *= np.where(good, 1 / upper[:, c, c], 0)[:, None]
    inverse = q.copy()
    for c in range(n - 1, -1, -1):
        for d in range(c + 1, n):
            inverse[:, c] -= upper[:, c, d, None] * inverse[:, d]
        inverse[:, c] /= upper[:, c, c, None]
    return q, inverse


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Small symmetric systems (rows, n, n) of any scale; singular ones by least squares."""
    scale = 1 / np.sqrt(np.maximum(np.einsum("ijj->ij", a), 1e-300))
    unit, right = a * scale[:, :, None] * scale[:, None, :], b * scale
    try:
        return scale * np.linalg.solve(unit, right[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return scale * np.stack([np.linalg.lstsq(u, v, rcond=None)[0] for u, v in zip(unit, right)])


Evaluate = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]  # rows, parameters -> cost, gradient, Hessian


def normal(residual: np.ndarray, jacobian: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, gradient and Gauss-Newton Hessian of residuals (rows, points) and Jacobians (rows, parameters, points)."""
    return np.einsum("ij,ij->i", residual, residual), product(jacobian, residual), jacobian @ jacobian.transpose(0, 2, 1)


def least_squares(evaluate: Evaluate, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 100, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kernels.least_squares with its steps and ends, for many rows: parameters, costs, converged.

    Rows that have ended make room for others, so that each step is taken by many.
    """
    p = np.clip(start, low, high)
    n, m = p.shape
    cost, gradient, hessian = np.zeros(n), np.zeros((n, m)), np.zeros((n, m, m))
    damping, taken, done = np.full(n, 1e-3), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    diagonal = np.arange(m)
    active, begun = np.empty(0, dtype=np.int64), 0
    while len(active) or begun < n:
        if begun < n and len(active) <= POOL // 2:
            fresh = np.arange(begun, min(n, begun + POOL - len(active)))
            cost[fresh], gradient[fresh], hessian[fresh] = evaluate(fresh, p[fresh])
            active, begun = np.concatenate([active, fresh]), begun + len(fresh)
        g = gradient[active]
        free = ~((p[active] <= low[active]) & (g > 0) | (p[active] >= high[active]) & (g < 0))
        flat = np.where(free, np.abs(g), 0).max(axis=1) < tolerance * np.maximum(1.0, cost[active])
        spent = taken[active] >= rounds
        ended = flat | (damping[active] >= 1e12)
        done[active[ended & ~spent]] = True
        goes = ~(ended | spent)
        active, g, free = active[goes], g[goes], free[goes]
        if not len(active):
            continue
        h = hessian[active] * (free[:, :, None] & free[:, None, :])
        h[:, diagonal, diagonal] += np.where(free, damping[active][:, None] * np.maximum(h[:, diagonal, diagonal], 1e-12), 1)
        q = np.clip(p[active] + solve(h, np.where(free, -g, 0)), low[active], high[active])
        new, new_gradient, new_hessian = evaluate(active, q)
        better = new < cost[active]
        rows = active[better]
        gain = cost[rows] - new[better]
        p[rows], cost[rows], gradient[rows], hessian[rows] = q[better], new[better], new_gradient[better], new_hessian[better]
        damping[rows] = np.maximum(damping[rows] / 5, 1e-12)
        taken[rows] += 1
        damping[active[~better]] *= 4
        small = np.zeros(len(active), dtype=bool)
        small[better] = gain < tolerance * np.maximum(cost[rows], 1e-300)
        done[active[small]] = True
        active = active[~small]
    return p, cost, done


def projected(y: np.ndarray, profiles: np.ndarray, slopes: Sequence[tuple[np.ndarray, Sequence[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """What y leaves of its projection on the profiles, and its Jacobian (Golub and Pereyra).

    slopes: for each group of parameters the derivatives (rows, n, points) and the profile that each moves.
    """
    q, inverse = orthogonal(profiles)
    rest = y - (product(q, y)[:, None, :] @ q)[:, 0]
    a = product(inverse, y)
    parts = []
    for d, of in slopes:
        of = list(of)
        moved = d * a[:, of, None]
        moved -= (moved @ q.transpose(0, 2, 1)) @ q
        moved += inverse[:, of] * product(d, rest)[:, :, None]
        parts.append(-moved)
    return rest, np.concatenate(parts, axis=1)


def varpro(energy: np.ndarray, intensity: np.ndarray, of: np.ndarray, centers: np.ndarray, sigma: float, gamma: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kernels.varpro for many starts: residuals, costs, converged. Row r starts from centers[r] on the spectrum of[r]."""
    k = centers.shape[1]
    each = range(k)

    def at(rows: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = of[rows]
        v, dc, ds, _ = voigt_derivatives(energy[s], p[:, :k], p[:, k:], np.float64(gamma))
        return projected(intensity[s], v, [(dc, each), (ds, each)])

    wide = np.full_like(centers, sigma)
    low, high = np.concatenate([centers - reach, 0.2 * wide], axis=1), np.concatenate([centers + reach, 5 * wide], axis=1)
    p, cost, done = least_squares(lambda rows, q: normal(*at(rows, q)), np.concatenate([centers, wide], axis=1), low, high)
    rest = [at(rows, p[rows])[0] for rows in slices(len(p))]
    return np.concatenate(rest) if rest else np.empty((0, energy.shape[1])), cost, done


def slices(n: int) -> Iterator[np.ndarray]:
    for k in range(0, n, POOL):
        yield np.arange(k, min(n, k + POOL))


def by_length(energies: Sequence, intensities: Sequence, rows: Sequence[int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rows of as many points each, with their axes and spectra as matrices."""
    groups: dict[int, list[int]] = {}
    for r in rows:
        groups.setdefault(len(intensities[r]), []).append(r)
    for own in groups.values():
        yield own, *(np.array([np.asarray(x[r], dtype=np.float64) for r in own]) for x in (energies, intensities))
