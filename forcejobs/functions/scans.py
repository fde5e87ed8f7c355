"""Order-dependent scans of a trial's samples, as Arrow-vectorised helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .traces import TESTS, area_of, blocks, confirmed_return, first_where, lists, numbers, span_level


def rows_of(values: pa.Array) -> Iterator[np.ndarray]:
    """Every trace as doubles, null as an empty one."""
    size = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    yield from np.split(numbers(values.flatten()), ends[:-1]) if len(ends) else ()


def running_integral(a: np.ndarray, dt: float, rule: str) -> np.ndarray:
    """Running integral along the last axis from its first value: trapezoid, rectangle or Simpson's rule (odd places by one trapezoid)."""
    out = np.zeros(a.shape)
    if a.shape[-1] < 2:
        return out
    if rule == "rectangle":
        out[..., 1:] = np.cumsum(a[..., :-1], axis=-1) * dt
        return out
    half = 0.5 * (a[..., 1:] + a[..., :-1]) * dt
    if rule == "trapezoid":
        out[..., 1:] = np.cumsum(half, axis=-1)
        return out
    if rule != "simpson":
        raise ValueError(f"unknown rule {rule}")
    pairs = (a[..., :-2:2] + 4 * a[..., 1:-1:2] + a[..., 2::2]) * dt / 3
    even = out[..., 2::2].shape[-1]
    out[..., 2::2] = np.cumsum(pairs, axis=-1)[..., :even]
    odd = out[..., 1::2].shape[-1]
    out[..., 1::2] = out[..., : a.shape[-1] - 1 : 2][..., :odd] + half[..., ::2]
    return out


def integral_from(x: np.ndarray, start: np.ndarray, dt: np.ndarray, rule: str, direction: str) -> np.ndarray:
    """Integral of every row that is zero at its start; before it (or after it, backward) 0. A row without a start is no number."""
    out = np.full(x.shape, np.nan)
    for s, step in np.unique(np.column_stack((start, dt))[np.isfinite(start)], axis=0).tolist():
        own, i = (start == s) & (dt == step), int(s)
        y = np.zeros((int(own.sum()), x.shape[1]))
        if i < x.shape[1]:
            if direction == "forward":
                y[:, i:] = running_integral(x[own, i:], step, rule)
            else:
                y[:, : i + 1] = -running_integral(x[own, : i + 1][:, ::-1], step, rule)[:, ::-1]
        out[own] = y
    return out


def integrated(rule: str = "trapezoid", direction: str = "forward"):
    """Column function (values, start index, dt): integral that is zero at start; before it (or after it, backward) 0."""

    @F.arrow_udf("array<double>")
    def run(values: pa.Array, start: pa.Array, dt: pa.Array) -> pa.Array:
        start, dt = numbers(start), numbers(dt)
        return lists([(rows, integral_from(x, start[rows], dt[rows], rule, direction)) for rows, x in blocks(values)], len(values))

    return run


def ramp(rule: str, g: float):
    """Column function (force, weight, onset, takeoff, dt): struct of residual and ramped (see quantities.ramp_to_impulse)."""

    @F.arrow_udf("residual double, ramped array<double>")
    def run(force: pa.Array, weight: pa.Array, onset: pa.Array, takeoff: pa.Array, dt: pa.Array) -> pa.Array:
        weight, onset, takeoff, dt = numbers(weight), numbers(onset), numbers(takeoff), numbers(dt)
        residual, out = np.full(len(force), np.nan), []
        for rows, x in blocks(force):
            w, end = weight[rows], np.fmin(takeoff[rows], x.shape[1] - 1)
            start = np.where((onset[rows] < end) & (w > 0), onset[rows], np.nan)
            v = integral_from((x - w[:, None]) / (w[:, None] / g), start, dt[rows], rule, "forward")
            left = area_of(x, w, start, end, dt[rows]) / (w / g) - v[np.arange(len(rows)), end.astype(int)]
            share = np.maximum(np.minimum(np.arange(x.shape[1]), end[:, None]) - start[:, None], 0) / (end - start)[:, None]
            residual[rows] = left
            out.append((rows, v + left[:, None] * share))
        return pa.StructArray.from_arrays([pa.array(residual, mask=np.isnan(residual)), lists(out, len(force))], ["residual", "ramped"])

    return run


def motion(rule: str, g: float):
    """Column function (force, weight, onset, dt): struct of velocity and displacement, zero up to onset, and net power."""

    @F.arrow_udf("velocity array<double>, displacement array<double>, net_power array<double>")
    def run(force: pa.Array, weight: pa.Array, onset: pa.Array, dt: pa.Array) -> pa.Array:
        weight, onset, dt = numbers(weight), numbers(onset), numbers(dt)
        parts: tuple[list, list, list] = ([], [], [])
        for rows, x in blocks(force):
            w = weight[rows][:, None]
            v = integral_from((x - w) / (w / g), onset[rows], dt[rows], rule, "forward")
            for part, y in zip(parts, (v, integral_from(v, onset[rows], dt[rows], rule, "forward"), (x - w) * v)):
                part.append((rows, y))
        return pa.StructArray.from_arrays([lists(p, len(force)) for p in parts], ["velocity", "displacement", "net_power"])

    return run


#: What `default_chain` finds of a trial, and what it adds with a gravity.
PLACED = "weight double, weight_sd double, takeoff int, onset int, touchdown int"
PUSHED = "net_impulse double, peak double"
MOVED = "velocity array<double>, displacement array<double>, net_power array<double>"


def default_chain(epoch: int, k: float, threshold: float, span: int, back: int, g: float | None = None, pushed: bool = False):
    """Column function (force, dt): struct of PLACED, with pushed of PUSHED, and of MOVED where g is given, by the default rules of each.

    PUSHED is the impulse less weight from onset to the last sample in contact (null unless onset is before takeoff), and
    the greatest sample before takeoff. It is what the single searches find one after another, in one pass, so that a trace goes to one worker once.
    """
    told = [PLACED, *([PUSHED] if pushed else []), *([MOVED] if g is not None else [])]
    names = [x.split()[0] for x in PLACED.split(", ")]
    doubles = [x.split()[0] for x in PUSHED.split(", ")] if pushed else []

    @F.arrow_udf(", ".join(told))
    def run(force: pa.Array, dt: pa.Array) -> pa.Array:
        dt, count = numbers(dt), len(force)
        found = {x: np.full(count, np.nan) for x in names + doubles}
        moved: tuple[list, list, list] = ([], [], [])
        for rows, x in blocks(force):
            n, place = len(rows), lambda at, hit: np.where(hit, at, np.nan)
            weight, sd = span_level(x[:, :epoch], "mean", 1) if x.shape[1] >= epoch else np.full((2, n), np.nan)
            level = np.full(n, float(threshold))
            takeoff = place(*first_where(x, TESTS["<"], level, np.full(n, float(epoch)), np.full(n, float(x.shape[1])), span))
            lower = weight - k * sd
            onset = place(*first_where(x, TESTS["<"], np.where((sd > 0) & (lower > 0), lower, np.nan), np.full(n, float(epoch)), takeoff, span))
            onset = np.maximum(onset - back, 0.0)
            for name, v in zip(names, (weight, sd, takeoff, onset, place(*confirmed_return(x, takeoff, level, weight)))):
                found[name][rows] = v
            if pushed:
                ordered = onset < takeoff
                found["net_impulse"][rows] = np.where(ordered, area_of(x, weight, onset, takeoff - 1, dt[rows]), np.nan)
                before = np.arange(x.shape[1]) < takeoff[:, None]
                top = np.where(before & ~np.isnan(x), x, -np.inf).max(1)
                found["peak"][rows] = np.where(top > -np.inf, top, np.nan)
            if g is not None:
                w = weight[:, None]
                v = integral_from((x - w) / (w / g), onset, dt[rows], "trapezoid", "forward")
                for part, y in zip(moved, (v, integral_from(v, onset, dt[rows], "trapezoid", "forward"), (x - w) * v)):
                    part.append((rows, y))
        out = [pa.array(found[x], mask=np.isnan(found[x])) for x in names[:2]]
        out += [pa.array(np.nan_to_num(found[x]).astype(np.int32), mask=np.isnan(found[x])) for x in names[2:]]
        out += [pa.array(found[x], mask=np.isnan(found[x])) for x in doubles]
        if g is not None:
            out += [lists(p, count) for p in moved]
        return pa.StructArray.from_arrays(out, [x.split()[0] for x in ", ".join(told).split(", ")])

    return run


def onset_heights(variants: list[tuple[float, int]], first: int, span: int, g: float):
    """Column function (force, weight, sd, takeoff, dt): struct of jump heights by impulse, a double k{k}_back{back} for each variant.

    Its onset is the first of span samples from `first` on and before takeoff that are under the weight less k
    deviations, stepped back; null without one, or where it does not lie before takeoff.
    """
    names = [f"k{k}_back{back}" for k, back in variants]

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def run(force: pa.Array, weight: pa.Array, sd: pa.Array, takeoff: pa.Array, dt: pa.Array) -> pa.Array:
        weight, sd, takeoff, dt = numbers(weight), numbers(sd), numbers(takeoff), numbers(dt)
        found = {n: np.full(len(force), np.nan) for n in names}
        for rows, x in blocks(force):
            w, end = weight[rows], takeoff[rows]
            onsets = {}
            for k in {k for k, _ in variants}:
                lower = w - k * sd[rows]
                level = np.where((sd[rows] > 0) & (lower > 0), lower, np.nan)
                at, hit = first_where(x, TESTS["<"], level, np.full(len(rows), float(first)), end, span)
                onsets[k] = np.where(hit, at, np.nan)
            for name, (k, back) in zip(names, variants):
                start = np.maximum(onsets[k] - back, 0.0)
                v = area_of(x, w, start, end - 1, dt[rows]) / (w / g)
                found[name][rows] = np.where(start < end, v * v / (2 * g), np.nan)
        return pa.StructArray.from_arrays([pa.array(v, mask=np.isnan(v)) for v in found.values()], names)

    return run


#: What `steadiest` finds of a trace.
STEADIEST = "start int, variance double, candidates int, rejected int, tied int, tied_low double, tied_high double"


def steadiest(x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """STEADIEST of every row, no number where there is none.

    Windows with a sample at or under 0.025 of the median are left out. Variances come from sums of the samples less
    their median, and count to nine digits.
    """
    out = {f.split()[0]: np.full(len(x), np.nan) for f in STEADIEST.split(", ")}
    for k in ("candidates", "rejected", "tied"):
        out[k][:] = 0
    for at in range(0, len(x) if x.shape[1] >= n else 0, 256):
        part, own = slice(at, at + 256), x[at : at + 256]
        rows, centre = np.arange(len(own)), np.median(own, axis=1)
        y = own - centre[:, None]
        s, q, low = (np.pad(np.cumsum(v, axis=1), ((0, 0), (1, 0))) for v in (y, y * y, own <= 0.025 * centre[:, None]))
        mean = (s[:, n:] - s[:, :-n]) / n
        var = np.round((q[:, n:] - q[:, :-n]) / n - mean**2, 9)
        ok = low[:, n:] == low[:, :-n]
        some, best = ok.any(1), np.where(ok, var, np.inf).argmin(1)
        best = np.where(ok[rows, best], best, ok.argmax(1))
        tied = ok & (var == var[rows, best][:, None])
        held = tied.any(1)
        out["start"][part], out["variance"][part] = (np.where(some, v, np.nan) for v in (best, np.abs(var[rows, best])))
        out["candidates"][part], out["rejected"][part], out["tied"][part] = ok.sum(1), (~ok).sum(1), tied.sum(1)
        level = mean + centre[:, None]
        out["tied_low"][part] = np.where(held, np.where(tied, level, np.inf).min(1), np.nan)
        out["tied_high"][part] = np.where(held, np.where(tied, level, -np.inf).max(1), np.nan)
    return out


def steadiest_window(n: int):
    """Column function (force): start and variance of the steadiest n samples (first on ties), what was considered, and the ties."""

    @F.arrow_udf(STEADIEST)
    def run(force: pa.Array) -> pa.Array:
        fields = [f.split() for f in STEADIEST.split(", ")]
        found = {k: np.full(len(force), 0.0 if k in ("candidates", "rejected", "tied") else np.nan) for k, _ in fields}
        for rows, x in blocks(force):
            for k, v in steadiest(x, n).items():
                found[k][rows] = v
        cols = [pa.array(found[k], mask=np.isnan(found[k])) for k, _ in fields]
        return pa.StructArray.from_arrays([c.cast(pa.int32()) if kind == "int" else c for c, (_, kind) in zip(cols, fields)], [k for k, _ in fields])

    return run


def trailing_onset(window: int, k: float):
    """Column function (force): start of the last run of samples under their trailing mean less k deviations, before the minimum."""

    @F.arrow_udf("int")
    def run(force: pa.Array) -> pa.Array:
        out = []
        for a in rows_of(force):
            bottom = int(np.nanargmin(a)) if len(a) else 0
            if bottom <= window + 1:
                out.append(None)
                continue
            x = a - a.mean()
            s, q = (np.concatenate(([0.0], np.cumsum(v))) for v in (x, x * x))
            m = window + 1
            avg = (s[m:] - s[:-m]) / m
            dev = np.sqrt(np.maximum((q[m:] - q[:-m] - m * avg**2) / (m - 1), 0))
            low = np.zeros(len(a), bool)
            low[window:] = x[window:] < avg - k * dev - 1e-6  # a flat trace is never under its own mean
            low[: window + 1] = False
            found = np.flatnonzero(low[:bottom])
            if not len(found):
                out.append(None)
                continue
            quiet = np.flatnonzero(~low[: found[-1]])
            out.append(int(quiet[-1]) + 1)
        return pa.array(out, pa.int32())

    return run
