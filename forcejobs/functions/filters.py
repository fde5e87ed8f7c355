"""Signal conditioning of equal-length traces: recursive low pass, polynomial smoothing, spectrum. numpy, for use in Arrow helpers."""

from __future__ import annotations

import numpy as np


def sections(order: int, cutoff_hz: float, rate_hz: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order (and, for an odd order, one first-order) sections of a digital Butterworth low pass."""
    w = np.tan(np.pi * cutoff_hz / rate_hz)
    out = []
    for k in range(order // 2):
        q = 2 * np.sin(np.pi * (2 * k + 1) / (2 * order))
        norm = 1 + q * w + w * w
        out.append((np.array([1, 2, 1]) * w * w / norm, np.array([1, 2 * (w * w - 1) / norm, (1 - q * w + w * w) / norm])))
    if order % 2:
        out.append((np.array([1, 1, 0]) * w / (1 + w), np.array([1, (w - 1) / (1 + w), 0])))
    return out


def _pass(x: np.ndarray, cascade: list) -> np.ndarray:
    """One pass over the rows of x, each section settled on its first value."""
    for b, a in cascade:
        y = np.empty_like(x)
        first = x[:, 0]
        z1, z2 = first * (1 - b[0]), first * (b[2] - a[2])
        for t in range(x.shape[1]):
            y[:, t] = b[0] * x[:, t] + z1
            z1, z2 = b[1] * x[:, t] - a[1] * y[:, t] + z2, b[2] * x[:, t] - a[2] * y[:, t]
        x = y
    return x


def low_pass(x: np.ndarray, cutoff_hz: float, rate_hz: float, order: int = 2, dual: bool = True) -> np.ndarray:
    """Rows of x through a Butterworth low pass; dual: forward and back, without lag, at a cutoff corrected for it."""
    pad = min(3 * order, x.shape[1] - 1)
    if pad < 1:
        return x.copy()
    if dual:
        cutoff_hz = min(cutoff_hz / (np.sqrt(2) - 1) ** (1 / (2 * order)), 0.499 * rate_hz)
    cascade = sections(order, cutoff_hz, rate_hz)
    long = np.concatenate((2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]), axis=1)
    y = _pass(long, cascade)
    if dual:
        y = _pass(y[:, ::-1], cascade)[:, ::-1]
    return y[:, pad:-pad]


#: Doubles of one moment of a block of traces under all cutoffs: what a step of the recursion touches stays in the cache.
MOMENT = 2048


def low_passes(x: np.ndarray, cutoffs_hz: np.ndarray, rate_hz: float, order: int = 2) -> np.ndarray:
    """low_pass() of every row under every cutoff (rows, cutoffs, samples), to the last bit.

    The recursion runs over time once for all cutoffs of a block of rows, whose moments are contiguous.
    """
    rows, n = x.shape
    pad = min(3 * order, n - 1)
    if pad < 1:
        return np.repeat(x[:, None, :], len(cutoffs_hz), axis=1)
    limits = [min(f / (np.sqrt(2) - 1) ** (1 / (2 * order)), 0.499 * rate_hz) for f in cutoffs_hz]
    cascades = [sections(order, f, rate_hz) for f in limits]
    # per section the three b and the three a, each a column of all cutoffs
    steps = [tuple(np.array([c[k][i] for c in cascades]).T[:, :, None] for i in (0, 1)) for k in range(len(cascades[0]))]
    long = np.concatenate((2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]), axis=1)
    out = np.empty((rows, len(cascades), n))
    wide = max(1, MOMENT // len(cascades))
    for at in range(0, rows, wide):
        y = np.ascontiguousarray(long[at : at + wide].T)[:, None, :]
        for _ in range(2):
            for b, a in steps:
                y = _moments(y, b, a)
            y = y[::-1]
        out[at : at + wide] = y[pad:-pad].transpose(2, 1, 0)
    return out


def _moments(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """One section over (moments, cutoffs, rows), settled on the first moment, in _pass()'s order of operations."""
    z1, z2 = x[0] * (1 - b[0]), x[0] * (b[2] - a[2])
    y, u, v = np.empty((len(x), *z1.shape)), np.empty_like(z1), np.empty_like(z1)
    for now, out in zip(x, y):
        np.add(np.multiply(b[0], now, out=u), z1, out=out)
        np.subtract(np.multiply(b[1], now, out=u), np.multiply(a[1], out, out=v), out=u)
        np.add(u, z2, out=z1)
        np.subtract(np.multiply(b[2], now, out=u), np.multiply(a[2], out, out=v), out=z2)
    return y


def polynomial_smooth(x: np.ndarray, width: int, degree: int) -> np.ndarray:
    """Savitzky-Golay smoothing with an odd width; the ends follow the polynomials of the end windows."""
    half = width // 2
    t = np.arange(-half, half + 1)
    fit = np.vander(t, degree + 1, increasing=True)
    hat = fit @ np.linalg.pinv(fit)
    y = np.array([np.convolve(row, hat[half][::-1], "same") for row in x])
    y[:, :half] = x[:, :width] @ hat[:half].T
    y[:, -half:] = x[:, -width:] @ hat[half + 1 :].T
    return y


def power_spectrum(x: np.ndarray) -> np.ndarray:
    """One-sided power of each row, mean removed, padded to a power of two."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    p = np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), n)) ** 2
    p[:, 1:-1] *= 2
    return p


def share_cutoff(x: np.ndarray, rate_hz: float, share: float = 0.99) -> np.ndarray:
    """Frequency of the first bin whose running power reaches the share of all."""
    p = power_spectrum(x)
    run = np.cumsum(p, axis=1)
    at = (run >= share * run[:, -1:]).argmax(1)
    return at * rate_hz / (2 * (p.shape[1] - 1))


def residual_cutoff(residual: np.ndarray, cutoffs: np.ndarray, tail: int) -> np.ndarray:
    """Per row of residual RMS by cutoff: the cutoff whose RMS is nearest the intercept of the line through the tail."""
    x = cutoffs[-tail:] - cutoffs[-tail:].mean()
    slope = residual[:, -tail:] @ x / (x @ x)
    intercept = residual[:, -tail:].mean(1) - slope * cutoffs[-tail:].mean()
    return cutoffs[np.abs(residual - intercept[:, None]).argmin(1)]


def step_place(x: np.ndarray, wide: int, ratio: float) -> np.ndarray:
    """Per row the first sample at which the level changes at once, -1 where none does.

    The means of `wide` samples on both sides of a step differ by over `ratio` times their noise, which the row's usual
    change from sample to sample tells (the median of its size, over 0.9539 for noise without memory), and over half of
    that comes at once, as on a slope it does not.
    """
    n = x.shape[1]
    if n < 4 * wide:
        return np.full(len(x), -1)
    total = np.pad(np.cumsum(x, axis=1), ((0, 0), (1, 0)))
    mean = (total[:, wide:] - total[:, :-wide]) / wide
    rise = mean[:, wide:] - mean[:, :-wide]  # at place i: samples i+wide.. less the wide ones before
    usual = np.median(np.abs(np.diff(x, axis=1)), axis=1, keepdims=True) / 0.9539
    noise = np.maximum(usual * np.sqrt(2 / wide), 1e-9 * np.maximum(np.abs(x).max(1, keepdims=True), 1.0))
    jump = np.abs(np.diff(x, axis=1))[:, wide - 1 : wide - 1 + rise.shape[1]]  # the change at the place itself
    ok = (np.abs(rise) > ratio * noise) & (jump > 0.5 * np.abs(rise))
    # a step shows a little before its place, and most at it
    near = np.minimum(ok.argmax(1)[:, None] + np.arange(wide), ok.shape[1] - 1)
    size = np.where(np.take_along_axis(ok, near, 1), np.abs(np.take_along_axis(rise, near, 1)), -1)
    return np.where(ok.any(1), np.take_along_axis(near, size.argmax(1)[:, None], 1)[:, 0] + wide, -1)


def durbin_watson(r: np.ndarray) -> np.ndarray:
    """Durbin-Watson statistic of each row of residuals; 2 where they are all zero."""
    power = (r * r).sum(1)
    return np.where(power > 0, (np.diff(r, axis=1) ** 2).sum(1) / np.where(power > 0, power, 1), 2.0)


def exponential_rise(y: np.ndarray, dt: float) -> tuple[float, float, float, float]:
    """(base, size, time constant, mean absolute residual in percent of the fit) of b + A (1 - exp(-t / tau))."""
    return tuple(float(v[0]) for v in exponential_rises(np.asarray(y, float)[None], dt))


def exponential_rises(y: np.ndarray, dt: float) -> tuple[np.ndarray, ...]:
    """exponential_rise() of every row at once, its four answers as columns; no number for a row that has none.

    tau is sought by golden section over its logarithm, from one sample to the whole span, until it stands still.
    """
    rows, n = y.shape
    out = np.full((4, rows), np.nan)
    t = np.arange(n) * dt
    fine = np.flatnonzero(np.isfinite(y).all(1))
    if n < 3 or t[-1] <= 0 or not len(fine):
        return tuple(out)
    y = y[fine]
    level = y.mean(1)

    def solve(log_tau: np.ndarray):
        g = 1 - np.exp(-t / np.exp(log_tau)[:, None])
        mean = g.mean(1)
        gc = g - mean[:, None]
        size = (gc * y).sum(1) / np.maximum((gc * gc).sum(1), 1e-300)
        base = level - size * mean
        off = y - base[:, None] - size[:, None] * g
        return base, size, (off * off).sum(1)

    ratio = (np.sqrt(5) - 1) / 2
    low, high = np.full(len(y), np.log(dt)), np.full(len(y), np.log(t[-1]))
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = solve(a)[2], solve(b)[2]
    for _ in range(200):
        if (high - low).max() <= 1e-15:
            break
        left = fa <= fb
        low, high = np.where(left, low, a), np.where(left, b, high)
        at = np.where(left, high - ratio * (high - low), low + ratio * (high - low))
        f = solve(at)[2]
        a, b, fa, fb = np.where(left, at, b), np.where(left, a, at), np.where(left, f, fb), np.where(left, fa, f)
    base, size, _ = solve((low + high) / 2)
    tau = np.exp((low + high) / 2)
    held = np.abs(y) >= np.finfo(float).eps
    fit = base[:, None] + size[:, None] * (1 - np.exp(-t / tau[:, None]))
    apart = np.where(held, np.abs(fit - y) / np.where(held, np.abs(y), 1.0), 0.0)
    count = held.sum(1)
    out[:, fine] = base, size, tau, np.where(count > 0, 100 * apart.sum(1) / np.maximum(count, 1), np.nan)
    return tuple(out)


def spline_resample(y: np.ndarray, points: int) -> np.ndarray:
    """Not-a-knot cubic spline through a row's (or every row's) values, read at evenly spaced points.

    The ends make the second and the last but one curvature their own equations; between them the band is solved forth
    and back, all rows at once.
    """
    rows = np.atleast_2d(y)
    n = rows.shape[1]
    if n < 4:
        out = np.stack([np.interp(np.linspace(0, n - 1, points), np.arange(n), r) for r in rows])
        return out if np.ndim(y) > 1 else out[0]
    r = np.zeros_like(rows, dtype=float)
    r[:, 1:-1] = 6 * (rows[:, 2:] - 2 * rows[:, 1:-1] + rows[:, :-2])
    k = np.zeros_like(r)
    k[:, 1], k[:, -2] = r[:, 1] / 6, r[:, -2] / 6
    if n > 4:
        right, scale = r[:, 2 : n - 2].copy(), np.zeros(n - 4)
        if n > 5:
            right[:, 0] -= k[:, 1]
            right[:, -1] -= k[:, -2]
        else:
            right[:, 0] -= k[:, 1] + k[:, -2]
        pivot = 4.0
        right[:, 0] /= pivot
        for i in range(1, n - 4):
            scale[i] = 1 / pivot
            pivot = 4 - scale[i]
            right[:, i] = (right[:, i] - right[:, i - 1]) / pivot
        for i in range(n - 6, -1, -1):
            right[:, i] -= scale[i + 1] * right[:, i + 1]
        k[:, 2 : n - 2] = right
    k[:, 0], k[:, -1] = 2 * k[:, 1] - k[:, 2], 2 * k[:, -2] - k[:, -3]
    x = np.linspace(0, n - 1, points)
    j = np.minimum(x.astype(int), n - 2)
    u = x - j
    v = 1 - u
    out = v * rows[:, j] + u * rows[:, j + 1] + ((v**3 - v) * k[:, j] + (u**3 - u) * k[:, j + 1]) / 6
    return out if np.ndim(y) > 1 else out[0]


def _warp_costs(reference: np.ndarray, x: np.ndarray, band: int) -> tuple[np.ndarray, int, int]:
    """Least cost up to every pair of places, one row of x in the last axis; ties go diagonal, then up, then left.

    A cell of the recurrence is computed for all rows at once.
    """
    n, m = len(reference), x.shape[1]
    band = max(band, abs(n - m))
    cost = np.full((n + 1, m + 1, len(x)), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            least = np.minimum(np.minimum(cost[i - 1, j - 1], cost[i - 1, j]), cost[i, j - 1])
            cost[i, j] = np.abs(reference[i - 1] - x[:, j - 1]) + least
    return cost, n, m


def warp_path(reference: np.ndarray, x: np.ndarray, band: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(total cost, pairs (place in the reference, place in the row) from start to end) of the cheapest path of every row."""
    cost, n, m = _warp_costs(reference, x, band)
    rows, i, j = np.arange(len(x)), np.full(len(x), n), np.full(len(x), m)
    steps: list[np.ndarray] = []
    while (live := (i > 0) & (j > 0)).any():
        at = rows[live]
        steps.append(np.column_stack((at, i[live] - 1, j[live] - 1)))
        ways = np.stack([cost[i[live] - 1, j[live] - 1, at], cost[i[live] - 1, j[live], at], cost[i[live], j[live] - 1, at]])
        step = ways.argmin(0)
        i[live] -= step != 2
        j[live] -= step != 1
    flat = np.concatenate(steps)[::-1]
    order = np.argsort(flat[:, 0], kind="stable")
    return cost[n, m], np.split(flat[order][:, 1:], np.cumsum(np.bincount(flat[:, 0], minlength=len(x)))[:-1])


def carried(path: np.ndarray, n: int) -> np.ndarray:
    """Mean place in the row that each of the reference's n points was carried to."""
    return np.bincount(path[:, 0], path[:, 1], n) / np.maximum(np.bincount(path[:, 0], minlength=n), 1)


def warp_rows(reference: np.ndarray, x: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Band-limited dynamic time warping of every row: (total absolute cost, mean place in the row of each reference point)."""
    cost, paths = warp_path(reference, x, band)
    return cost, np.array([carried(p, len(reference)) for p in paths]).reshape(len(x), len(reference))


def warp_to(reference: np.ndarray, y: np.ndarray, band: int) -> tuple[float, np.ndarray]:
    """warp_rows() of one row."""
    cost, place = warp_rows(reference, y[None], band)
    return float(cost[0]), place[0]


def smoothing_matrix(points: int, basis: int, penalty: float) -> np.ndarray:
    """points x points matrix of a clamped cubic B-spline fit with a second-difference penalty.

    The fit's own shapes are shrunk by 1 / (1 + penalty x roughness) each.
    Those that the penalty does not see (lines) are not shrunk at all, so that no penalty is too large to be exact.
    """
    b = spline_basis(points, basis)
    half = np.linalg.inv(np.linalg.cholesky(b.T @ b))
    rough, shapes = np.linalg.eigh(half @ roughness(basis) @ half.T)
    rough = np.where(rough < 1e-9 * rough.max(), 0.0, rough)
    own = b @ half.T @ shapes
    return (own / (1 + penalty * rough)) @ own.T


def roughness(basis: int) -> np.ndarray:
    """Penalty matrix of second differences of basis coefficients."""
    d = np.diff(np.eye(basis), 2, axis=0)
    return d.T @ d


def spline_basis(points: int, basis: int) -> np.ndarray:
    """points x basis matrix of a clamped uniform cubic B-spline basis."""
    inner = np.linspace(0, 1, basis - 2)
    knots = np.concatenate(([0] * 3, inner, [1] * 3))
    x = np.linspace(0, 1, points)
    b = np.zeros((points, len(knots) - 1))
    for i in range(len(knots) - 1):
        b[:, i] = (x >= knots[i]) & (x < knots[i + 1])
    b[-1, np.flatnonzero(np.diff(knots) > 0)[-1]] = 1
    for p in range(1, 4):
        nxt = np.zeros((points, b.shape[1] - 1))
        for i in range(b.shape[1] - 1):
            left, right = knots[i + p] - knots[i], knots[i + p + 1] - knots[i + 1]
            if left > 0:
                nxt[:, i] += (x - knots[i]) / left * b[:, i]
            if right > 0:
                nxt[:, i] += (knots[i + p + 1] - x) / right * b[:, i + 1]
        b = nxt
    return b


def best_penalty(x: np.ndarray, basis: int) -> list[float]:
    """Per row the penalty of least generalised cross-validation error: powers of ten from -10 to 10, then tenths about the best."""

    def errors(penalties: np.ndarray) -> np.ndarray:
        out = []
        for p in penalties:
            hat = smoothing_matrix(x.shape[1], basis, p)
            free = 1 - np.trace(hat) / x.shape[1]
            out.append(((x - x @ hat.T) ** 2).mean(1) / free**2)
        return np.stack(out, axis=1)

    coarse = np.arange(-10.0, 11.0)
    power = coarse[errors(10**coarse).argmin(1)]
    out = np.empty(len(x))
    for p in np.unique(power):
        fine, rows = p + np.arange(-9, 10) / 10, np.flatnonzero(power == p)
        own = x[rows]
        e = np.stack([((own - own @ h.T) ** 2).mean(1) / (1 - np.trace(h) / x.shape[1]) ** 2 for h in (smoothing_matrix(x.shape[1], basis, 10**f) for f in fine)], axis=1)
        out[rows] = 10 ** fine[e.argmin(1)]
    return out.tolist()


def varimax(loadings: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Pairwise varimax rotation of the columns of a loading matrix, rows scaled to unit length meanwhile (Kaiser)."""
    scale = np.sqrt((loadings**2).sum(1, keepdims=True))
    x = loadings / np.where(scale > 0, scale, 1)
    p, k = x.shape
    for _ in range(sweeps):
        turned = 0.0
        for a in range(k):
            for b in range(a + 1, k):
                u, v = x[:, a] ** 2 - x[:, b] ** 2, 2 * x[:, a] * x[:, b]
                angle = 0.25 * np.arctan2(2 * (u @ v - u.sum() * v.sum() / p), (u @ u - v @ v) - (u.sum() ** 2 - v.sum() ** 2) / p)
                s, c = np.sin(angle), np.cos(angle)
                x[:, a], x[:, b] = c * x[:, a] + s * x[:, b], c * x[:, b] - s * x[:, a]
                turned = max(turned, abs(angle))
        if turned < 1e-10:
            break
    return x * scale
