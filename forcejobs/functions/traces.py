"""Searches and sums over the samples of many trials at once, as Arrow-vectorised column functions.

Each function takes a column of sample arrays and columns or numbers of bounds. Traces of one length are one matrix.
Spans are [start, stop); an index that is not found, or whose bounds are null, is null. A sample that is null or no
number passes no test.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an Arrow batch: whatever the length of traces, a worker holds a few matrices of this size.
BATCH_BYTES = 2 << 20

TESTS = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends traces to Python in batches of BATCH_BYTES at most, not of 10,000 rows; a
    smaller bound that the session has stays. Every Python step in a plan has a worker of its own for each core."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(\d+)b?", conf.get(name))
    if not found or not 0 < int(found[1]) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


class Low(NamedTuple):
    """Test of a sample for low force: its value, or its magnitude, under the threshold."""

    threshold: float
    comparison: str = "signed"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _number(x) -> Column:
    return _c(x).cast("double")


def _bounds(values: Column, start, stop) -> tuple[Column, Column]:
    return _number(start), _number(F.size(values) if stop is None else stop)


def blocks(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of their samples) for every length among the traces; null and empty ones are left out."""
    size = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, flat.reshape(-1, n) if len(rows) == len(size) else flat[(ends[rows] - n)[:, None] + np.arange(n)]


def numbers(a: pa.Array) -> np.ndarray:
    """A numeric column as doubles, null as not a number."""
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def lists(rows: list[tuple[np.ndarray, np.ndarray]], count: int, blank: bool = False) -> pa.Array:
    """Array column from (rows, matrix) blocks; a row in no block is null, as is one whose first value is not a number.

    blank: a value that is not a number is a null inside its array instead.
    """
    size, flat = np.zeros(count, np.int64), []
    for at, x in rows:
        ok = np.ones(len(at), bool) if blank else ~np.isnan(x[:, 0])
        size[at[ok]] = x.shape[1]
        flat.append((at[ok], x[ok]))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if count else 0)
    for at, x in flat:
        out[(ends[at] - x.shape[1])[:, None] + np.arange(x.shape[1])] = x
    offsets = pa.array(np.concatenate(([0], ends)), pa.int32(), mask=np.append(size == 0, False))
    return pa.ListArray.from_arrays(offsets, pa.array(out, from_pandas=blank))


def _index(count: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    """Integer column from (rows, index, whether it was found)."""
    at, ok = np.zeros(count, np.int32), np.zeros(count, bool)
    for rows, i, hit in found:
        at[rows], ok[rows] = i, hit
    return pa.array(at, mask=~ok)


def _held(ok: np.ndarray, span: int) -> np.ndarray:
    """Places from which span samples in a row pass."""
    if span <= 1:
        return ok
    out = np.zeros_like(ok)
    if span <= ok.shape[1]:
        run = np.pad(np.cumsum(ok, axis=1, dtype=np.int32), ((0, 0), (1, 0)))
        out[:, : ok.shape[1] - span + 1] = run[:, span:] - run[:, :-span] == span
    return out


def _within(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    i = np.arange(n)
    return (i >= start[:, None]) & (i < stop[:, None])


def _pick(ok: np.ndarray, start: np.ndarray, stop: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    ok = ok & _within(ok.shape[1], start, stop)
    at = ok.shape[1] - 1 - ok[:, ::-1].argmax(1) if last else ok.argmax(1)
    return at, ok.any(1)


def first_where(x: np.ndarray, passes, level: np.ndarray, start: np.ndarray, stop: np.ndarray, span: int, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Per trace, (place, whether there is one) of the first (or last) sample from which span samples pass the test against level."""
    return _pick(_held(passes(x, level[:, None]), span), start, stop, last)


def find(values: Column, test: str, level, start=0, stop=None, span: int = 1, last: bool = False, magnitude: bool = False) -> Column:
    """First (or last) sample of the span from which `span` samples (or their magnitudes) in a row pass the test against level."""
    passes = TESTS[test]

    @F.arrow_udf("int")
    def run(values: pa.Array, level: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
        level, start, stop, out = numbers(level), numbers(start), numbers(stop), []
        for rows, x in blocks(values):
            out.append((rows, *first_where(np.abs(x) if magnitude else x, passes, level[rows], start[rows], stop[rows], span, last)))
        return _index(len(values), out)

    return run(values, _number(level), *_bounds(values, start, stop))


def band(values: Column, lower, upper, start=0, stop=None, span: int = 1, last: bool = False, inside: bool = False) -> Column:
    """First (or last) sample of the span from which `span` samples in a row lie outside (or inside) lower..upper."""

    @F.arrow_udf("int")
    def run(values: pa.Array, lower: pa.Array, upper: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
        lower, upper, start, stop, out = numbers(lower), numbers(upper), numbers(start), numbers(stop), []
        for rows, x in blocks(values):
            low, high = lower[rows][:, None], upper[rows][:, None]
            ok = (x >= low) & (x <= high) if inside else (x < low) | (x > high)
            out.append((rows, *_pick(_held(ok, span), start[rows], stop[rows], last)))
        return _index(len(values), out)

    return run(values, _number(lower), _number(upper), *_bounds(values, start, stop))


def passes_upwards(values: Column, level, start, stop) -> Column:
    """First sample of the span that is at or under level and whose next one is over it."""

    @F.arrow_udf("int")
    def run(values: pa.Array, level: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
        level, start, stop, out = numbers(level), numbers(start), numbers(stop), []
        for rows, x in blocks(values):
            ok, t = np.zeros(x.shape, bool), level[rows][:, None]
            ok[:, :-1] = (x[:, :-1] <= t) & (x[:, 1:] > t)
            out.append((rows, *_pick(ok, start[rows], stop[rows], False)))
        return _index(len(values), out)

    return run(values, _number(level), *_bounds(values, start, stop))


def falls(values: Column, threshold: float, span: int) -> Column:
    """First sample that falls under the threshold and is followed by `span` samples under it."""

    @F.arrow_udf("int")
    def run(values: pa.Array) -> pa.Array:
        out = []
        for rows, x in blocks(values):
            ok = _held(x < threshold, span + 1)
            ok[:, 1:] &= x[:, :-1] >= threshold
            ok[:, 0] = False
            out.append((rows, ok.argmax(1), ok.any(1)))
        return _index(len(values), out)

    return run(values)


def confirmed_return(x: np.ndarray, off: np.ndarray, threshold: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per trace, (place, whether there is one) of the first run over the threshold from off on that reaches weight."""
    t = threshold[:, None]
    end = np.full(len(x), float(x.shape[1]))
    confirmed, hit = _pick((x > t) & (x >= weight[:, None]), off, end, False)
    before, any_low = _pick(x <= t, off, np.where(hit, confirmed, 0), True)
    return before + 1, hit & any_low & (x[np.arange(len(x)), np.nan_to_num(off).astype(int)] <= threshold)


def return_to(values: Column, takeoff, threshold, weight) -> Column:
    """Start of the first run over the threshold from takeoff on that reaches weight; null if takeoff itself is over it."""

    @F.arrow_udf("int")
    def run(values: pa.Array, takeoff: pa.Array, threshold: pa.Array, weight: pa.Array) -> pa.Array:
        takeoff, threshold, weight, out = numbers(takeoff), numbers(threshold), numbers(weight), []
        for rows, x in blocks(values):
            out.append((rows, *confirmed_return(x, takeoff[rows], threshold[rows], weight[rows])))
        return _index(len(values), out)

    return run(values, _number(takeoff), _number(threshold), _number(weight))


def extreme(values: Column, start, stop, greatest: bool) -> Column:
    """Place of the least or greatest sample of the span, the first on ties; samples that are no number are skipped."""

    @F.arrow_udf("int")
    def run(values: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
        start, stop, out = numbers(start), numbers(stop), []
        for rows, x in blocks(values):
            ok = _within(x.shape[1], start[rows], stop[rows]) & ~np.isnan(x)
            at = np.where(ok, x, -np.inf).argmax(1) if greatest else np.where(ok, x, np.inf).argmin(1)
            out.append((rows, at, ok.any(1)))
        return _index(len(values), out)

    return run(values, *_bounds(values, start, stop))


def argmin(values: Column, start, end) -> Column:
    """Place of the least sample of [start, end), the first on ties."""
    return extreme(values, start, end, False)


def argmax(values: Column, start, end) -> Column:
    """Place of the greatest sample of [start, end), the first on ties."""
    return extreme(values, start, end, True)


def runs(values: Column, low: Low) -> Column:
    """Maximal runs of low samples: array of (start, end), both ends inside."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(values: pa.Array) -> pa.Array:
        owner, first, last = [], [], []
        for rows, x in blocks(values):
            ok = (np.abs(x) if low.comparison == "magnitude" else x) < low.threshold
            step = np.diff(np.pad(ok.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            r, s = np.nonzero(step == 1)
            owner.append(rows[r])
            first.append(s)
            last.append(np.nonzero(step == -1)[1] - 1)
        owner, first, last = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (owner, first, last))
        order = np.argsort(owner, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(values)))))
        offsets = pa.array(ends, pa.int32(), mask=np.append(values.is_null().to_numpy(zero_copy_only=False), False))
        found = pa.StructArray.from_arrays([pa.array(first[order], pa.int32()), pa.array(last[order], pa.int32())], ["start", "end"])
        return pa.ListArray.from_arrays(offsets, found)

    return run(values)


def span_level(x: np.ndarray, centre: str, less: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean or median, and two-pass deviation, of every row; no number where a sample is not finite."""
    fine, mean = np.isfinite(x).all(1), x.mean(1, keepdims=True)
    mid = np.where(fine, np.median(x, axis=1) if centre == "median" else mean[:, 0], np.nan)
    return mid, np.where(fine, np.sqrt(((x - mean) ** 2).sum(1) / (x.shape[1] - less)), np.nan)


def level(values: Column, start, stop, centre: str = "mean", less: int = 1) -> Column:
    """struct(level, sd) of the span: mean or median, and two-pass deviation over the count minus `less`.

    Both are null where the span is not wholly inside the trace, holds less than two samples or one that is not finite.
    """

    @F.arrow_udf("level double, sd double")
    def run(values: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
        start, stop = numbers(start), numbers(stop)
        mid, sd = np.full(len(values), np.nan), np.full(len(values), np.nan)
        for rows, x in blocks(values):
            ok = (start[rows] >= 0) & (stop[rows] <= x.shape[1]) & (stop[rows] - start[rows] >= 2)
            for a, b in np.unique(np.column_stack((start[rows], stop[rows]))[ok].astype(int), axis=0).tolist():
                own = ok & (start[rows] == a) & (stop[rows] == b)
                mid[rows[own]], sd[rows[own]] = span_level(x[own, a:b], centre, less)
        return pa.StructArray.from_arrays([pa.array(v, mask=np.isnan(v)) for v in (mid, sd)], ["level", "sd"])

    return run(values, *_bounds(values, start, stop))


def area_of(x: np.ndarray, less: np.ndarray, start: np.ndarray, end: np.ndarray, dt: np.ndarray) -> np.ndarray:
    """Per trace what area() gives, no number where that is null."""
    a, b = start, np.minimum(end, x.shape[1] - 1)
    ok = np.isfinite(a) & np.isfinite(b)
    inside = _within(x.shape[1], a, b + 1)
    y = np.where(inside, x - less[:, None], 0.0)
    at = lambda i: y[np.arange(len(x)), np.clip(np.nan_to_num(i), 0, x.shape[1] - 1).astype(int)]
    total = np.where(b - a >= 1, (y.sum(1) - (at(a) + at(b)) / 2) * dt, 0.0)
    return np.where(ok & np.isfinite(y).all(1), total, np.nan)


def area(values: Column, less, start, end, dt) -> Column:
    """Trapezoid area of the samples start..end, both inside, minus `less`; 0 for fewer than two, null if one is not finite."""

    @F.arrow_udf("double")
    def run(values: pa.Array, less: pa.Array, start: pa.Array, end: pa.Array, dt: pa.Array) -> pa.Array:
        less, start, end, dt = numbers(less), numbers(start), numbers(end), numbers(dt)
        out = np.full(len(values), np.nan)
        for rows, x in blocks(values):
            out[rows] = area_of(x, less[rows], start[rows], end[rows], dt[rows])
        return pa.array(out, mask=np.isnan(out))

    return run(values, _number(less), _number(start), _number(end), _number(dt))


def steepest(values: Column, width: int, start, end) -> Column:
    """struct(start, rise) of the greatest rise over `width` samples within start..end, the first on ties."""

    @F.arrow_udf("start int, rise double")
    def run(values: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        start, end = numbers(start), numbers(end)
        at, rise = np.zeros(len(values), np.int32), np.full(len(values), np.nan)
        for rows, x in blocks(values):
            if x.shape[1] <= width:
                continue
            up = x[:, width:] - x[:, :-width]
            ok = _within(up.shape[1], start[rows], end[rows] - width + 1) & ~np.isnan(up)
            best = np.where(ok, up, -np.inf).argmax(1)
            at[rows] = best
            rise[rows] = np.where(ok.any(1), up[np.arange(len(rows)), best], np.nan)
        none = np.isnan(rise)
        return pa.StructArray.from_arrays([pa.array(at, mask=none), pa.array(rise, mask=none)], ["start", "rise"])

    return run(values, _number(start), _number(end))


def peaks(values: Column, start, stop) -> Column:
    """Number of samples inside the span, its ends left out, that rise over the one before and are not under the next."""

    @F.arrow_udf("long")
    def run(values: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
        start, stop = numbers(start), numbers(stop)
        n = np.zeros(len(values), np.int64)
        for rows, x in blocks(values):
            top = (x[:, 1:-1] > x[:, :-2]) & (x[:, 2:] <= x[:, 1:-1])
            n[rows] = (top & _within(top.shape[1], start[rows], stop[rows] - 2)).sum(1)
        return pa.array(n, mask=np.isnan(start) | np.isnan(stop))

    return run(values, *_bounds(values, start, stop))


def drop_from_top(values: Column, start, percent: float) -> Column:
    """First sample after start that is under (1 - percent) of the greatest one from start up to it."""

    @F.arrow_udf("int")
    def run(values: pa.Array, start: pa.Array) -> pa.Array:
        start, out = numbers(start), []
        for rows, x in blocks(values):
            end = np.full(len(rows), float(x.shape[1]))
            seen = np.where(_within(x.shape[1], start[rows], end) & ~np.isnan(x), x, -np.inf)
            ok = x < np.maximum.accumulate(seen, axis=1) * (1 - percent / 100)
            out.append((rows, *_pick(ok, start[rows] + 1, end, False)))
        return _index(len(values), out)

    return run(values, _number(start))


def crest_and_dip(values: Column, start, end) -> Column:
    """struct(start, stop): the first local maximum between start and end, and the next local minimum; both or neither."""

    @F.arrow_udf("start int, stop int")
    def run(values: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        start, end = numbers(start), numbers(end)
        out = np.zeros((2, len(values)), np.int32)
        ok = np.zeros(len(values), bool)
        for rows, x in blocks(values):
            up, down = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
            up[:, 1:], down[:, 1:] = x[:, 1:] > x[:, :-1], x[:, 1:] < x[:, :-1]
            crest, dip = up.copy(), down.copy()
            crest[:, :-1] &= ~up[:, 1:]
            dip[:, :-1] &= ~down[:, 1:]
            top, hit = _pick(crest, start[rows] + 1, end[rows], False)
            low, also = _pick(dip, top + 1.0, end[rows], False)
            out[0, rows], out[1, rows], ok[rows] = top, low, hit & also
        return pa.StructArray.from_arrays([pa.array(v, mask=~ok) for v in out], ["start", "stop"])

    return run(values, _number(start), _number(end))


def moving_average(values: Column, width: int) -> Column:
    """Boxcar mean, centred for an odd width; the ends hold the mean of the end window. A shorter trace has no answer."""
    before = (width - 1) // 2

    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        out = []
        for rows, x in blocks(values):
            y = np.full(x.shape, np.nan)
            if x.shape[1] >= width:
                mean = np.lib.stride_tricks.sliding_window_view(x, width, axis=1).mean(2)
                y[:, before : before + mean.shape[1]] = mean
                y[:, :before], y[:, before + mean.shape[1] :] = mean[:, :1], mean[:, -1:]
            out.append((rows, y))
        return lists(out, len(values))

    return run(values)


def residuals(values: Column, start, stop) -> Column:
    """struct(rms, durbin_watson, slope per sample) of the span about its mean; the statistic is null where nothing varies."""

    @F.arrow_udf("rms double, durbin_watson double, slope double")
    def run(values: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
        start, stop = numbers(start), numbers(stop)
        found = np.full((3, len(values)), np.nan)
        for rows, x in blocks(values):
            inside = _within(x.shape[1], start[rows], stop[rows])
            n = np.maximum(inside.sum(1, keepdims=True), 1)
            e = np.where(inside, x - np.where(inside, x, 0.0).sum(1, keepdims=True) / n, 0.0)
            i = np.where(inside, np.arange(x.shape[1]), 0.0)
            t = np.where(inside, i - i.sum(1, keepdims=True) / n, 0.0)
            step = np.where(inside[:, 1:] & inside[:, :-1], np.diff(e, axis=1), 0.0)
            power, run_ = (e * e).sum(1), (t * t).sum(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out = np.stack([np.sqrt(power / n[:, 0]), (step * step).sum(1) / power, (t * e).sum(1) / run_])
            found[:, rows] = np.where(inside.any(1), out, np.nan)
        return pa.StructArray.from_arrays([pa.array(v, mask=~np.isfinite(v)) for v in found], ["rms", "durbin_watson", "slope"])

    return run(values, *_bounds(values, start, stop))


def landing_shape(force: Column, weight, rate_hz, threshold: float = 20.0) -> Column:
    """struct(takeoff, landings): start of the first low-force run that ends in a landing, and how many do.

    Runs across small gaps are one (SHAPE: gap seconds and height); a run is a flight if the rise out of it is steep and
    high enough, up to the first place where smoothed force stops rising, within the longest rise.
    """

    @F.arrow_udf("takeoff int, landings int")
    def run(force: pa.Array, weight: pa.Array, rate: pa.Array) -> pa.Array:
        weight, rate = numbers(weight), numbers(rate)
        takeoff, landings = np.full(len(force), -1, np.int32), np.zeros(len(force), np.int32)
        for rows, x in blocks(force):
            low = x < threshold
            for i in np.flatnonzero(low.any(1)).tolist():
                r = rows[i]
                found = [a for a, b in _merged(x[i], low[i], weight[r], rate[r]) if _lands(x[i, b : b + int(SHAPE["rise_s"] * rate[r])], weight[r], rate[r])]
                landings[r] = len(found)
                if found:
                    takeoff[r] = found[0]
        none = np.isnan(weight)
        return pa.StructArray.from_arrays([pa.array(takeoff, mask=none | (takeoff < 0)), pa.array(landings, mask=none)], ["takeoff", "landings"])

    return run(force, _number(weight), _number(rate_hz))


#: Fixed values of the landing-shape rule: rise rate in weights per second, peak and gap height in weights, times in seconds.
SHAPE = {"rate": 20.0, "peak": 0.5, "rise_s": 0.6, "slope_s": 0.01, "run_s": 0.008, "gap_s": 0.02, "gap": 0.1, "climb": 0.2}


def _merged(x: np.ndarray, low: np.ndarray, weight: float, rate: float) -> list[tuple[int, int]]:
    """Low runs [start, stop) of a trace, those with a small gap between them as one, the short ones left out."""
    step = np.diff(np.pad(low.astype(np.int8), 1))
    out: list[list[int]] = []
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
        if out and a - out[-1][1] <= int(SHAPE["gap_s"] * rate) and x[out[-1][1] : a].max() <= SHAPE["gap"] * max(weight, 0.0):
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= max(int(SHAPE["run_s"] * rate), 1)]


def _lands(y: np.ndarray, weight: float, rate: float) -> bool:
    """Whether the samples after a run rise as a landing does."""
    if not weight > 0 or len(y) < 4:
        return False
    span = max(int(SHAPE["slope_s"] * rate), 3)
    lead = (span - 1) // 2
    smooth = np.convolve(y, np.full(span, 1 / span))[lead : lead + len(y)]
    slope = np.diff(smooth)
    flat = np.flatnonzero(_held(slope[None] <= 0, span)[0])
    flat = flat[(flat >= span) & (flat < len(slope) - span)]
    top = int(flat[0]) if len(flat) else int(smooth.argmax())
    if top < span or not (slope[:top] > 0).any():
        return False
    climb = y[: top + 1].max() - y[0]
    rises = (y[span:] - y[:-span])[:top] * rate / span
    steep = len(rises) > 0 and rises.max() / weight >= SHAPE["rate"]
    return bool(climb >= SHAPE["climb"] * weight and steep and y[: top + 1].max() / weight >= SHAPE["peak"])


def trough_to_peak(values: Column, start, stop) -> Column:
    """struct(low, high): the least sample of the span (first on ties), and the greatest after it (last on ties)."""

    @F.arrow_udf("low int, high int")
    def run(values: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
        start, stop = numbers(start), numbers(stop)
        found, ok = np.zeros((2, len(values)), np.int32), np.zeros(len(values), bool)
        for rows, x in blocks(values):
            inside = _within(x.shape[1], start[rows], stop[rows])
            low = np.where(inside, x, np.inf).argmin(1)
            after = inside & (np.arange(x.shape[1]) > low[:, None])
            high = x.shape[1] - 1 - np.where(after, x, -np.inf)[:, ::-1].argmax(1)
            found[0, rows], found[1, rows], ok[rows] = low, high, after.any(1)
        return pa.StructArray.from_arrays([pa.array(v, mask=~ok) for v in found], ["low", "high"])

    return run(values, *_bounds(values, start, stop))


def facts(values: Column) -> Column:
    """What a column of numbers is like, as a struct: counts of rows, finite ones and exact zeros; least, greatest, mean,
    median and deviation of the finite ones; whether every row rises on the one before, by even steps; and the rate that
    such steps imply (20 to 10,000 a unit). A column with a row that is not finite neither rises nor is even."""
    names = ["least", "greatest", "mean", "median", "sd", "rate_hz"]

    @F.arrow_udf("n long, finite long, zeros long, least double, greatest double, mean double, median double, sd double, rate_hz double, increasing boolean, even boolean")
    def run(values: pa.Array) -> pa.Array:
        count = len(values)
        n, finite, zeros = (np.zeros(count, np.int64) for _ in range(3))
        told = {x: np.full(count, np.nan) for x in names}
        rises, even = np.ones(count, bool), np.ones(count, bool)
        for rows, x in blocks(values):
            ok = np.isfinite(x)
            k = ok.sum(1)
            n[rows], finite[rows], zeros[rows] = x.shape[1], k, (x == 0).sum(1)
            some = k > 0
            y = np.where(ok, x, 0.0)
            mean = y.sum(1) / np.maximum(k, 1)
            told["least"][rows] = np.where(some, np.where(ok, x, np.inf).min(1), np.nan)
            told["greatest"][rows] = np.where(some, np.where(ok, x, -np.inf).max(1), np.nan)
            told["mean"][rows] = np.where(some, mean, np.nan)
            order = np.sort(np.where(ok, x, np.inf), axis=1)
            at = np.arange(len(rows))
            told["median"][rows] = np.where(some, (order[at, np.maximum(k - 1, 0) // 2] + order[at, np.minimum(k // 2, x.shape[1] - 1)]) / 2, np.nan)
            square = (np.where(ok, x - mean[:, None], 0.0) ** 2).sum(1)
            told["sd"][rows] = np.where(k > 1, np.sqrt(square / np.maximum(k - 1, 1)), np.nan)
            whole, step = k == x.shape[1], np.diff(y, axis=1)
            rises[rows] = whole & (step > 0).all(1)
            if step.shape[1]:
                even[rows] = whole & (step.max(1) - step.min(1) <= 1e-9)
                pace = 1 / np.where(rises[rows] & even[rows], (y[:, -1] - y[:, 0]) / step.shape[1], np.nan)
                told["rate_hz"][rows] = np.where((pace >= 20) & (pace <= 10_000), pace, np.nan)
            else:
                even[rows] = whole
        cols = [pa.array(v) for v in (n, finite, zeros)] + [pa.array(told[x], mask=np.isnan(told[x])) for x in names] + [pa.array(rises), pa.array(even)]
        return pa.StructArray.from_arrays(cols, ["n", "finite", "zeros", *names, "increasing", "even"])

    return run(values)
