"""Numerical kernels in NumPy; they run inside Arrow operators or once on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np

FWHM_PER_SIGMA = 2 * math.sqrt(2 * math.log(2))


@lru_cache(maxsize=4)
def _weideman(n: int) -> tuple[float, np.ndarray]:
    """Scale and coefficients of Weideman's rational expansion of the Faddeeva function."""
    m = 2 * n
    scale = math.sqrt(n / math.sqrt(2))
    theta = np.arange(-m + 1, m) * math.pi / m
    t = scale * np.tan(theta / 2)
    f = np.concatenate([[0.0], np.exp(-t * t) * (scale * scale + t * t)])
    a = np.fft.fft(np.fft.fftshift(f)).real / (2 * m)
    return scale, a[1 : n + 1][::-1]


def faddeeva(z: np.ndarray, n: int = 64) -> np.ndarray:
    """w(z) = exp(-z^2) erfc(-iz) for imaginary parts of 0 or more."""
    scale, a = _weideman(n)
    z = np.asarray(z, dtype=np.complex128)
    down = scale - 1j * z
    return 2 * np.polyval(a, (scale + 1j * z) / down) / (down * down) + 1 / (math.sqrt(math.pi) * down)


def voigt(energy: np.ndarray, center: float, sigma: float, gamma: float) -> np.ndarray:
    """Voigt profile of area 1; gamma is the half width of the Lorentzian part."""
    if sigma < 1e-10:
        return gamma / math.pi / ((energy - center) ** 2 + gamma * gamma)
    return faddeeva((energy - center + 1j * gamma) / (sigma * math.sqrt(2))).real / (sigma * math.sqrt(2 * math.pi))


def voigt_derivatives(energy: np.ndarray, center: float, sigma: float, gamma: float) -> tuple[np.ndarray, ...]:
    """The profile and its derivatives by center, sigma and gamma.

    From w'(z) = 2i / sqrt(pi) - 2 z w(z).
    """
    root = sigma * math.sqrt(2)
    z = (np.asarray(energy, dtype=np.float64) - center + 1j * gamma) / root
    w = faddeeva(z)
    slope = 2j / math.sqrt(math.pi) - 2 * z * w
    k = 1 / (sigma * math.sqrt(2 * math.pi))
    return k * w.real, -k * slope.real / root, -k / sigma * (w + z * slope).real, -k * slope.imag / root


def voigt_curvature(energy: np.ndarray, center: float, sigma: float, gamma: float) -> np.ndarray:
    """The second derivative by center, from w''(z) = -2 w(z) - 2 z w'(z)."""
    root = sigma * math.sqrt(2)
    z = (np.asarray(energy, dtype=np.float64) - center + 1j * gamma) / root
    w = faddeeva(z)
    slope = 2j / math.sqrt(math.pi) - 2 * z * w
    return (-2 * w - 2 * z * slope).real / (root * root * sigma * math.sqrt(2 * math.pi))


def uniform_grid(half: float, n: int) -> np.ndarray:
    return np.linspace(-half, half, n) if n > 1 else np.zeros(1)


def sinh_grid(half: float, n: int, strength: float = 2.0) -> np.ndarray:
    """Denser about 0."""
    return half * np.sinh(strength * np.linspace(-1, 1, n)) / math.sinh(strength)


def chebyshev_grid(half: float, n: int) -> np.ndarray:
    """Denser at the ends."""
    return half * -np.cos(math.pi * (np.arange(n) + 0.5) / n) / math.cos(math.pi / (2 * n))


@dataclass(frozen=True)
class Peaks:
    """What to fit: one component a center; a doublet's partner stands at center + split with 1 / ratio of its height."""

    energy: np.ndarray
    centers: tuple[float, ...]
    sigmas: tuple[float, ...]
    gamma: float
    split: float = 0.0
    ratio: float = 1.0
    shift_half: float = 0.3
    width_half: float = 0.1
    n_shift: int = 31
    n_width: int = 7
    ridge: float = 1e-8

    def basis(self, shift: float = 0.0, width: float = 0.0, gamma: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Profiles and their derivatives by center and sigma, one column a component."""
        out = []
        for center, sigma in zip(self.centers, self.sigmas):
            v = voigt_derivatives(self.energy, center + shift, sigma + width, self.gamma + gamma)
            if self.split:
                p = voigt_derivatives(self.energy, center + shift + self.split, sigma + width, self.gamma + gamma)
                v = tuple(a + b / self.ratio for a, b in zip(v, p))
            out.append(v[:3])
        return tuple(np.stack(x, axis=1) for x in zip(*out))

    def curvature(self, shift: float = 0.0, width: float = 0.0, gamma: float = 0.0) -> np.ndarray:
        """Second derivatives of the profiles by center, one column a component."""
        out = []
        for center, sigma in zip(self.centers, self.sigmas):
            h = voigt_curvature(self.energy, center + shift, sigma + width, self.gamma + gamma)
            if self.split:
                h = h + voigt_curvature(self.energy, center + shift + self.split, sigma + width, self.gamma + gamma) / self.ratio
            out.append(h)
        return np.stack(out, axis=1)


@dataclass
class Dictionary:
    """Candidate profiles on a grid of shifts and widths, with what solves for amplitudes at each."""

    shifts: np.ndarray
    widths: np.ndarray
    columns: np.ndarray  # (n_energy, n_dict), each of length 1
    profiles: np.ndarray  # (n_dict, n_energy, n_comp)
    weights: np.ndarray  # (n_dict, n_comp, n_energy)
    by_center: np.ndarray
    by_sigma: np.ndarray
    coupling: np.ndarray = field(default=None)

    def astype(self, kind: np.dtype) -> Dictionary:
        """The same in another precision; shifts and widths stay doubles."""
        return replace(self, **{name: getattr(self, name).astype(kind, copy=False) for name in ("columns", "profiles", "weights", "by_center", "by_sigma", "coupling")})

    @property
    def nominal(self) -> int:
        return int(np.argmin(np.abs(self.shifts))) * len(self.widths) + int(np.argmin(np.abs(self.widths)))


def build_dictionary(p: Peaks, gamma: float = 0.0) -> Dictionary:
    shifts = uniform_grid(p.shift_half, p.n_shift)
    widths = uniform_grid(p.width_half, p.n_width)
    widths = widths[widths > -0.9 * min(p.sigmas)]
    cells = [p.basis(s, w, gamma) for s in shifts for w in widths]
    profiles, by_center, by_sigma = (np.stack(x) for x in zip(*cells))
    whole = profiles.sum(axis=2)
    norm = np.linalg.norm(whole, axis=1, keepdims=True)
    gram = np.einsum("kec,ked->kcd", profiles, profiles) + p.ridge * np.eye(profiles.shape[2])
    weights = np.linalg.solve(gram, profiles.transpose(0, 2, 1))
    coupling = np.linalg.solve(gram, np.einsum("kec,ked->kcd", profiles, by_sigma))
    return Dictionary(shifts, widths, np.where(norm > 1e-10, whole / np.maximum(norm, 1e-300), 0).T, profiles, weights, by_center, by_sigma, coupling)


def vertex(left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    den = 2 * (2 * middle - left - right)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(np.where(np.abs(den) > 1e-30, (right - left) / den, 0.0), -0.5, 0.5)


def solve_amplitudes(y: np.ndarray, weights: np.ndarray, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares amplitudes and the mean squared residual of each row."""
    a = y @ weights.T
    r = y - a @ profiles.T
    return a, np.einsum("ij,ij->i", r, r) / y.shape[1]


def _dot(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", u, v)


def _ratio(over: np.ndarray, under: np.ndarray) -> np.ndarray:
    """0 where there is nothing to project on."""
    fine = under > 1e-20
    return np.where(fine, over / np.where(fine, under, 1), 0)


def solve_four_step(y: np.ndarray, d: Dictionary, cell: int, curvature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Amplitudes, shift, width and chi2 by projecting residuals on the derivatives at one cell.

    Amplitude first; the residual's part along the derivative by center is the shift; what is left
    along the derivative by sigma is the width; last the width's pull on the amplitudes is taken out.
    With curvature, the second derivatives by center, the six steps: what the shift does to the profile
    in second order isn't taken for width.
    """
    a, chi2 = solve_amplitudes(y, d.weights[cell], d.profiles[cell])
    rest = y - a @ d.profiles[cell].T
    along_c, along_s = a @ d.by_center[cell].T, a @ d.by_sigma[cell].T
    shift = _ratio(_dot(rest, along_c), _dot(along_c, along_c))
    over = _dot(rest, along_s) - shift * _dot(along_c, along_s)
    if curvature is not None:
        over -= 0.5 * shift * shift * _dot(a @ curvature.T, along_s)
    width = _ratio(over, _dot(along_s, along_s))
    if a.shape[1] == 1:
        pull = 1 + width * d.coupling[cell][0, 0]
        return a / np.where(np.abs(pull) > 1e-6, pull, 1)[:, None], shift, width, chi2
    system = np.eye(a.shape[1]) + width[:, None, None] * d.coupling[cell]
    fine = np.abs(np.linalg.det(system)) > 1e-6
    system[~fine] = np.eye(a.shape[1])
    return np.linalg.solve(system, a[:, :, None])[:, :, 0], shift, width, chi2


#: A grid point up to so many widths off counts as within the range of the linear steps.
TAYLOR = 0.35
#: Up to this chi2, in squares of the highest point, the grid's coarseness outweighs the noise.
CLEAN = 3e-4


def solve_dictionary(y: np.ndarray, d: Dictionary, refine: str = "parabola", peaks: Peaks | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Amplitudes, shift, width and chi2 of each row: best cell, then a refinement.

    none, parabola, four_step; six_step (of `peaks`); taylor: four steps from the nominal cell where the
    best one is near it, else from the best; clean: four steps where the amplitude fit's chi2 is small
    against the highest point, else the amplitudes at the cell.
    """
    scores = y @ d.columns
    best = scores.argmax(axis=1)
    n_w = len(d.widths)
    i, j = best // n_w, best % n_w
    n, k = len(y), d.profiles.shape[2]
    at_cell = best
    if refine == "taylor":
        sigma = float(np.mean(peaks.sigmas))
        near = (np.abs(d.shifts[i]) / sigma < TAYLOR) & (np.abs(d.widths[j]) / sigma < TAYLOR)
        at_cell = np.where(near, d.nominal, best)
    shift, width = d.shifts[at_cell // n_w].copy(), d.widths[at_cell % n_w].copy()
    steps = refine in ("four_step", "six_step", "taylor", "clean")
    if k == 1 and not steps:
        profile = d.profiles[at_cell, :, 0]
        a = _dot(y, d.weights[at_cell, 0])
        profile *= a[:, None]
        np.subtract(y, profile, out=profile)
        amplitudes, chi2 = a[:, None], _dot(profile, profile) / y.shape[1]
    else:
        amplitudes, chi2 = np.empty((n, k)), np.empty(n)
        order = np.argsort(at_cell, kind="stable")
        edges = np.flatnonzero(np.diff(at_cell[order])) + 1
        for rows in np.split(order, edges) if n else []:
            cell = int(at_cell[rows[0]])
            if not steps:
                amplitudes[rows], chi2[rows] = solve_amplitudes(y[rows], d.weights[cell], d.profiles[cell])
                continue
            curvature = peaks.curvature(d.shifts[cell // n_w], d.widths[cell % n_w]) if refine == "six_step" else None
            own, ds, dw, chi2[rows] = solve_four_step(y[rows], d, cell, curvature)
            if refine == "clean":
                noisy = chi2[rows] >= CLEAN * (y[rows].max(axis=1) ** 2 + 1e-20)
                own[noisy] = y[rows[noisy]] @ d.weights[cell].T
                ds[noisy] = dw[noisy] = 0
            amplitudes[rows] = own
            shift[rows] += ds
            width[rows] += dw
    if refine == "parabola":
        r = np.arange(n)
        for axis, at, grid, step in ((shift, i, d.shifts, n_w), (width, j, d.widths, 1)):
            inside = (at > 0) & (at < len(grid) - 1)
            if inside.any():
                b = best[inside]
                axis[inside] += vertex(scores[r[inside], b - step], scores[r[inside], b], scores[r[inside], b + step]) * (grid[1] - grid[0])
    return amplitudes, shift, width, chi2


def polynomial_base(energy: np.ndarray, degree: int) -> np.ndarray:
    """Orthonormal columns that span the polynomials up to a degree."""
    x = np.linspace(-1, 1, len(energy)) if len(energy) < 2 else 2 * (energy - energy.min()) / np.ptp(energy) - 1
    return np.linalg.qr(np.stack([x**k for k in range(degree + 1)], axis=1))[0]


class Products:
    """Inner products of the profiles of several one-component dictionaries, by pairs of cells.

    base: orthonormal columns of a background that is fitted along. What profiles and spectra have of it
    is taken out before, which gives the amplitudes of the joint fit.
    """

    def __init__(self, dictionaries: list[Dictionary], base: np.ndarray | None = None):
        self.dictionaries = dictionaries
        kind = dictionaries[0].profiles.dtype
        self.base = None if base is None else base.astype(kind, copy=False)
        self.flat = [self.apart(d.profiles[:, :, 0]) for d in dictionaries]
        self.grams = [[p @ q.T for q in self.flat] for p in self.flat]
        self.scale = [1 / np.maximum(np.linalg.norm(p, axis=1), np.finfo(kind).tiny) for p in self.flat]

    def apart(self, rows: np.ndarray) -> np.ndarray:
        return rows if self.base is None else rows - (rows @ self.base) @ self.base.T


def _joint(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves one small symmetric system a row; gram is (k, k, rows), right (k, rows)."""
    k = len(right)
    for c in range(k):
        gram[c, c] += 1e-8
    if k == 1:
        return right / gram[0]
    if k == 2:
        det = gram[0, 0] * gram[1, 1] - gram[0, 1] * gram[1, 0]
        return np.stack([gram[1, 1] * right[0] - gram[0, 1] * right[1], gram[0, 0] * right[1] - gram[1, 0] * right[0]]) / det
    return np.linalg.solve(gram.transpose(2, 0, 1), right.T[:, :, None])[:, :, 0].T


def solve_multipeak(y: np.ndarray, dictionaries: list[Dictionary] | Products, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Amplitudes, shifts and widths of each component (columns) and chi2, by alternating projections.

    Each component in turn is matched to its own dictionary against what the others leave; then all
    amplitudes are solved for jointly. Spectra are projected on every profile once; from then on only
    products of profiles are needed.
    """
    products = dictionaries if isinstance(dictionaries, Products) else Products(dictionaries)
    ds, grams = products.dictionaries, products.grams
    y = products.apart(y)
    n, k = len(y), len(ds)
    rows = np.arange(n)
    cells = [np.full(n, d.nominal) for d in ds]
    shifts, widths = np.zeros((n, k)), np.zeros((n, k))
    projected = [y @ p.T for p in products.flat]

    def amplitudes() -> np.ndarray:
        gram = np.stack([np.stack([grams[c][e][cells[c], cells[e]] for e in range(k)]) for c in range(k)])
        return _joint(gram, np.stack([projected[c][rows, cells[c]] for c in range(k)]))

    a = amplitudes()
    for _ in range(rounds):
        for c, d in enumerate(ds):
            scores = projected[c].copy()
            for e in range(k):
                if e != c:
                    scores -= a[e][:, None] * grams[e][c][cells[e]]
            scores *= products.scale[c]
            best = scores.argmax(axis=1)
            cells[c] = best
            n_w = len(d.widths)
            i, j = best // n_w, best % n_w
            shifts[:, c], widths[:, c] = d.shifts[i], d.widths[j]
            for axis, at, grid, step in ((shifts, i, d.shifts, n_w), (widths, j, d.widths, 1)):
                inside = (at > 0) & (at < len(grid) - 1)
                if inside.any():
                    b = best[inside]
                    axis[inside, c] += vertex(scores[rows[inside], b - step], scores[rows[inside], b], scores[rows[inside], b + step]) * (grid[1] - grid[0])
            a = amplitudes()
    rest = y.copy()
    for c in range(k):
        rest -= a[c][:, None] * products.flat[c][cells[c]]
    return a.T, shifts, widths, _dot(rest, rest) / y.shape[1]


def polish(y: np.ndarray, each: list[Peaks], amplitudes: np.ndarray, shifts: np.ndarray, widths: np.ndarray, base: np.ndarray | None = None, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Damped Gauss-Newton steps off the grid, for all spectra at once: amplitudes, shifts, widths and chi2.

    A spectrum takes a step only if it lowers its residual; else its damping grows.
    """
    n, k = shifts.shape
    e = each[0].energy[None, :]
    centers = np.array([p.centers[0] for p in each])
    sigmas = np.array([p.sigmas[0] for p in each])
    gammas = np.array([p.gamma for p in each])
    clear = (lambda v: v) if base is None else (lambda v: v - np.einsum("nkb,eb->nke", np.einsum("nke,eb->nkb", v, base), base))
    y = y - (y @ base) @ base.T if base is not None else y

    def profiles(s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = (sigmas + w)[:, :, None]
        root = width * math.sqrt(2)
        z = (e[None] - (centers + s)[:, :, None] + 1j * gammas[None, :, None]) / root
        f = faddeeva(z)
        slope = 2j / math.sqrt(math.pi) - 2 * z * f
        scale = 1 / (width * math.sqrt(2 * math.pi))
        return clear(scale * f.real), clear(-scale * slope.real / root), clear(-scale / width * (f + z * slope).real)

    def state(s: np.ndarray, w: np.ndarray) -> tuple:
        v, dc, ds = profiles(s, w)
        gram = np.einsum("nae,nbe->nab", v, v) + 1e-10 * np.eye(k)
        a = np.linalg.solve(gram, np.einsum("nae,ne->na", v, y)[:, :, None])[:, :, 0]
        rest = y - np.einsum("na,nae->ne", a, v)
        return a, rest, np.einsum("ne,ne->n", rest, rest), v, dc, ds

    shifts, widths = shifts.copy(), widths.copy()
    a, rest, cost, v, dc, ds = state(shifts, widths)
    damping = np.full(n, 1e-3)
    for _ in range(rounds):
        j = np.concatenate([v, a[:, :, None] * dc, a[:, :, None] * ds], axis=1)
        h = np.einsum("nae,nbe->nab", j, j)
        diagonal = np.einsum("naa->na", h)
        h = h + np.eye(3 * k) * (damping[:, None] * diagonal + 1e-12 * diagonal.max(axis=1, keepdims=True) + 1e-300)[:, :, None]
        step = np.linalg.solve(h, np.einsum("nae,ne->na", j, rest)[:, :, None])[:, :, 0]
        s = shifts + np.clip(step[:, k : 2 * k], -0.5 * sigmas, 0.5 * sigmas)
        w = np.maximum(widths + np.clip(step[:, 2 * k :], -0.3 * sigmas, 0.3 * sigmas), -0.8 * sigmas)
        new = state(s, w)
        better = new[2] < cost
        damping = np.where(better, damping / 10, damping * 10)
        shifts[better], widths[better] = s[better], w[better]
        a, rest, cost, v, dc, ds = (np.where(better.reshape(-1, *[1] * (old.ndim - 1)), fresh, old) for fresh, old in zip(new, (a, rest, cost, v, dc, ds)))
    return a, shifts, widths, cost / y.shape[1]


def shirley(energy: np.ndarray, intensity: np.ndarray, rounds: int = 50, tolerance: float = 1e-5) -> np.ndarray:
    """Proctor-Sherwood background between the end points; it integrates counts along a rising axis."""
    turn = slice(None, None, -1) if energy[0] > energy[-1] else slice(None)
    y = np.asarray(intensity, dtype=np.float64)[turn]
    background = np.zeros_like(y)
    for _ in range(rounds):
        run = np.cumsum(y - background)
        if abs(run[-1]) < 1e-10:
            break
        new = y[0] + (y[-1] - y[0]) * run / run[-1]
        done = np.abs(new - background).max() < tolerance
        background = new
        if done:
            break
    return background[turn]


def tougaard(energy: np.ndarray, intensity: np.ndarray, c: float = 1643.0) -> np.ndarray:
    """Universal-curve background, scaled so that it meets the tenth of the points with the highest loss."""
    y = np.asarray(intensity, dtype=np.float64)
    n = len(y)
    if n < 3:
        return np.full(n, y.mean())
    m = max(1, n // 10)
    low = min(y[:m].mean(), y[-m:].mean())
    if abs(y[:m].mean() - y[-m:].mean()) < 1e-10 * max(abs(y[:m].mean()), abs(y[-m:].mean()), 1.0):
        return np.full(n, low)
    turn = slice(None) if y[-m:].mean() >= y[:m].mean() else slice(None, None, -1)
    signal = (y - low)[turn]
    t = np.arange(n) * abs(energy[-1] - energy[0]) / (n - 1)
    loss = np.convolve(signal, t / (c + t * t) ** 2)[:n]
    scale = loss[-m:].mean()
    return np.full(n, low) if abs(scale) < 1e-30 else (signal[-m:].mean() / scale * loss)[turn] + low


@lru_cache(maxsize=8)
def _smoothing(window: int, degree: int) -> np.ndarray:
    half = window // 2
    vander = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    return vander @ np.linalg.pinv(vander)


def savitzky_golay(y: np.ndarray, window: int = 11, degree: int = 3) -> np.ndarray:
    """Polynomial smoothing; the ends are read off the polynomials of the first and last windows."""
    half = window // 2
    projection = _smoothing(window, degree)
    out = np.convolve(y, projection[half][::-1], mode="same")
    out[:half] = (projection @ y[:window])[:half]
    out[-half:] = (projection @ y[-window:])[-half:]
    return out


def find_peaks(y: np.ndarray, height: float = -math.inf, distance: int = 1, prominence: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places and prominences of local maxima; of peaks nearer than `distance` the higher one stays."""
    inner = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:])) + 1
    inner = inner[y[inner] >= height]
    kept: list[int] = []
    for k in inner[np.argsort(-y[inner], kind="stable")]:
        if all(abs(k - o) >= distance for o in kept):
            kept.append(int(k))
    peaks, prominences = [], []
    for k in sorted(kept):
        higher_left = np.flatnonzero(y[:k] > y[k])
        higher_right = np.flatnonzero(y[k + 1 :] > y[k])
        a = higher_left[-1] if len(higher_left) else 0
        b = k + 1 + higher_right[0] if len(higher_right) else len(y) - 1
        p = y[k] - max(y[a : k + 1].min(), y[k : b + 1].min())
        if p >= prominence:
            peaks.append(k)
            prominences.append(p)
    return np.array(peaks, dtype=np.int64), np.array(prominences)


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone piecewise cubic interpolation by Fritsch and Carlson, with Butland's weighted harmonic slopes."""
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return y[0] + s[0] * (at - x[0])
    d = np.zeros(len(x))
    same = s[:-1] * s[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        d[1:-1] = np.where(same, (w1 + w2) / (w1 / s[:-1] + w2 / s[1:]), 0)
    for end, (h0, h1, s0, s1) in ((0, (h[0], h[1], s[0], s[1])), (-1, (h[-1], h[-2], s[-1], s[-2]))):
        e = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        d[end] = 0 if np.sign(e) != np.sign(s0) else 3 * s0 if np.sign(s0) != np.sign(s1) and abs(e) > 3 * abs(s0) else e
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    return (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * d[k] + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * h[k] * d[k + 1]


def least_squares(residual, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 100, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Bounded Levenberg-Marquardt with forward differences: parameters, Jacobian, cost, converged."""
    p = np.clip(np.asarray(start, dtype=np.float64), low, high)
    r = residual(p)
    cost, damping = r @ r, 1e-3
    jacobian = np.zeros((len(r), len(p)))
    for _ in range(rounds):
        for k in range(len(p)):
            step = 1e-7 * max(abs(p[k]), 1e-3)
            if p[k] + step > high[k]:
                step = -step
            q = p.copy()
            q[k] += step
            jacobian[:, k] = (residual(q) - r) / step
        gradient, hessian = jacobian.T @ r, jacobian.T @ jacobian
        free = ~((p <= low) & (gradient > 0) | (p >= high) & (gradient < 0))
        if not free.any() or np.abs(gradient[free]).max() < tolerance * max(1.0, cost):
            return p, jacobian, cost, True
        while damping < 1e12:
            h = hessian[np.ix_(free, free)]
            move = np.zeros(len(p))
            move[free] = np.linalg.lstsq(h + damping * np.diag(np.maximum(np.diag(h), 1e-12)), -gradient[free], rcond=None)[0]
            q = np.clip(p + move, low, high)
            s = residual(q)
            if s @ s < cost:
                gain = cost - s @ s
                p, r, cost, damping = q, s, s @ s, max(damping / 5, 1e-12)
                if gain < tolerance * max(cost, 1e-300):
                    return p, jacobian, cost, True
                break
            damping *= 4
        else:
            return p, jacobian, cost, True
    return p, jacobian, cost, False


def varpro(energy: np.ndarray, intensity: np.ndarray, centers: list[float], sigmas: list[float], gamma: float, reach: float = 1.0) -> dict:
    """Centers and widths by an outer bounded fit; amplitudes are projected out in every step."""
    k = len(centers)

    def basis(p: np.ndarray) -> np.ndarray:
        return np.stack([voigt(energy, p[c], p[k + c], gamma) for c in range(k)], axis=1)

    def residual(p: np.ndarray) -> np.ndarray:
        b = basis(p)
        return intensity - b @ np.linalg.lstsq(b, intensity, rcond=None)[0]

    start = np.array([*centers, *sigmas])
    low = np.array([*[x - reach for x in centers], *[0.2 * s for s in sigmas]])
    high = np.array([*[x + reach for x in centers], *[5 * s for s in sigmas]])
    p, _, cost, done = least_squares(residual, start, low, high)
    b = basis(p)
    return {"centers": p[:k], "sigmas": p[k:], "amplitudes": np.linalg.lstsq(b, intensity, rcond=None)[0], "chi2": cost / len(energy), "converged": done}


def poisson_fisher(jacobian: np.ndarray, mean: np.ndarray, exposure: float = 1.0) -> np.ndarray:
    """Fisher information of parameters under Poisson counts of these means."""
    return exposure * (jacobian.T / mean) @ jacobian


def covariance_bound(fisher: np.ndarray) -> tuple[np.ndarray | None, int]:
    """Inverse (null if rank deficient) and rank, decided on the matrix of unit diagonal."""
    scale = np.sqrt(np.diag(fisher))
    if (scale <= 0).any():
        return None, int((scale > 0).sum())
    unit = fisher / np.outer(scale, scale)
    values = np.linalg.eigvalsh(unit)
    rank = int((values > len(values) * np.finfo(float).eps * values[-1]).sum())
    return (np.linalg.inv(unit) / np.outer(scale, scale), rank) if rank == len(values) else (None, rank)


def doniach_sunjic(energy: np.ndarray, center: float, fwhm_l: float, asymmetry: float, fwhm_g: float = 0.0, kinetic: bool = False) -> np.ndarray:
    """A Doniach-Šunjić line, broadened by a Gaussian, scaled to a trapezoid area of 1 on the axis.

    The axis must be evenly spaced if there is broadening; beyond its ends the line counts as 0.
    """
    alpha, gamma = min(max(asymmetry, 0.0), 0.9999), max(fwhm_l / 2, 1e-10)
    delta = (energy - center) * (1 if kinetic else -1)
    y = np.cos(math.pi * alpha / 2 + (1 - alpha) * np.arctan(delta / gamma)) / (delta * delta + gamma * gamma) ** ((1 - alpha) / 2)
    if fwhm_g > 1e-10:
        sigma, step = fwhm_g / FWHM_PER_SIGMA, abs(energy[1] - energy[0])
        half = max(int(4 * sigma / step), 1)
        g = np.exp(-0.5 * (np.arange(-half, half + 1) * step / sigma) ** 2)
        y = np.convolve(y, g / g.sum())[half : half + len(y)]
    area = abs(np.trapezoid(y, energy))
    return y / area if area > 1e-30 else y


def mixed_basis(energy: np.ndarray, components: list[dict]) -> np.ndarray:
    """Profiles of area 1, one column each: of `shape` voigt (center, sigma, gamma) or doniach_sunjic (its arguments)."""
    shapes = {"voigt": voigt, "doniach_sunjic": doniach_sunjic}
    return np.stack([shapes[c["shape"]](energy, **{k: v for k, v in c.items() if k != "shape"}) for c in components], axis=1)


def quantile_grid(values: np.ndarray, n: int) -> np.ndarray:
    """As many grid points as asked for, at equal steps of the values' distribution; equal ones count once."""
    return np.unique(np.quantile(values, np.linspace(0, 1, n))) if len(values) else np.zeros(1)
