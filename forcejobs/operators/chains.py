"""Grids of whole chains of rules: axes over rules, names and numbers, and a tree that takes every shared step once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scans
from ..functions import traces as T
from .landmarks import GRAVITY, samples_for

#: Steps in the order in which they run, the rules of each, and the parameters that a rule reads with their defaults.
RULES: dict[str, dict[str, dict]] = {
    "weighing": {"fixed_window": {"seconds": 1.0, "centre": "mean"}, "lowest_variance": {"seconds": 0.5}},
    "takeoff": {"absolute_force": {"threshold": 20.0, "span": 3}, "descending": {"threshold": 20.0, "span": 2}, "longest_run": {"threshold": 20.0, "span": 3}},
    "onset": {"noise_relative": {"k": 5.0, "span": 3, "back": 3}, "share_of_weight": {"share": 0.95, "span": 3, "back": 3}},
}
#: A chain is a rule for each step; what it was set to beyond the rule's defaults goes with it.
BASE = {step: next(iter(rules)) for step, rules in RULES.items()}
#: Answers' codes: the place of a code is what a trial holds.
CODES = ("answered", "no_weight", "no_takeoff", "collapsed_band", "no_onset")


class Refused(ValueError):
    """A grid that cannot be made of these axes."""


@dataclass(frozen=True)
class Axis:
    """What varies: rules of a step, or names or numbers of one of its parameters; one of the three."""

    step: str
    rules: tuple[str, ...] = ()
    parameter: str = ""
    names: tuple[str, ...] = ()
    numbers: tuple[float, ...] = ()

    @property
    def values(self) -> tuple:
        return self.rules or self.names or self.numbers

    @property
    def title(self) -> str:
        return f"{self.step}.{self.parameter}" if self.parameter else self.step


def checked(axes: list[Axis]) -> list[Axis]:
    """The axes in the order of their steps; one that states no value, two kinds, or what no rule reads, is refused."""
    for a in axes:
        if a.step not in RULES:
            raise Refused(f"{a.title}: no such step, of {', '.join(RULES)}")
        if sum(map(bool, (a.rules, a.names, a.numbers))) != 1:
            raise Refused(f"{a.title}: state rules, names or numbers, one of the three")
        unknown = [r for r in a.rules if r not in RULES[a.step]]
        if unknown:
            raise Refused(f"{a.title}: no rule {unknown[0]}")
        if not a.rules:
            readers = [r[a.parameter] for r in RULES[a.step].values() if a.parameter in r]
            if not readers:
                raise Refused(f"{a.title}: no rule reads it")
            if bool(a.names) != isinstance(readers[0], str):
                raise Refused(f"{a.title}: takes {'names' if isinstance(readers[0], str) else 'numbers'}")
    steps = list(RULES)
    return sorted(axes, key=lambda a: steps.index(a.step))


@dataclass(frozen=True)
class Variant:
    """One point of a grid: its label, and for each step the rule with the parameters that the rule reads."""

    label: str
    chain: tuple[tuple[str, str, tuple[tuple[str, object], ...]], ...]


def expand(axes: list[Axis], cap: int | None = None) -> tuple[list[Variant], bool]:
    """(variants, whether a stated cap cut them): mixed radix, the first axis fastest, axes in the order of their steps."""
    axes, out = checked(axes), []
    total = int(np.prod([len(a.values) for a in axes], dtype=object)) if axes else 1
    for i in range(total if cap is None else min(total, max(cap, 1))):
        rest, chosen, settings, told = i, dict(BASE), {}, []
        for a in axes:
            rest, at = divmod(rest, len(a.values))
            value = a.values[at]
            told.append(f"{a.title}={value}")
            if a.rules:
                chosen[a.step] = value
            else:
                settings[a.step, a.parameter] = value
        chain = tuple(
            (step, rule, tuple(sorted((p, settings.get((step, p), d)) for p, d in RULES[step][rule].items()))) for step, rule in chosen.items()
        )
        out.append(Variant(",".join(told) or "baseline", chain))
    return out, len(out) < total


class Tree:
    """Steps of chains on a block of traces of one length; a step that two chains share under one prefix is taken once.

    A step's key holds what it reads: takeoff reads where weighing ended, onset all of the weighing, and the step back
    and the check against takeoff come after the search for the onset.
    """

    def __init__(self, x: np.ndarray, rate: float, steady: np.ndarray) -> None:
        self.x, self.rate, self.steady = x, rate, steady
        self.rows = np.arange(len(x))
        self.total = np.pad(np.cumsum(x, axis=1), ((0, 0), (1, 0)))
        self.place = np.arange(x.shape[1])
        self.held: dict = {}
        self.masks: dict = {}
        self.taken = 0

    def _once(self, key: tuple, make: Callable):
        if key not in self.held:
            self.held[key] = make()
            self.taken += 1
        return self.held[key]

    def weigh(self, rule: str, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end of the window, weight, deviation); not a number where the window is not whole."""
        n = samples_for(p["seconds"], self.rate)
        start = np.zeros(len(self.x)) if rule == "fixed_window" else self.steady
        ok = np.isfinite(start) & (start + n <= self.x.shape[1]) & (n >= 2)
        at = np.where(ok, start, 0).astype(int)[:, None] + np.arange(min(n, self.x.shape[1]))
        y = np.take_along_axis(self.x, np.minimum(at, self.x.shape[1] - 1), 1)
        ok &= np.isfinite(y).all(1)
        mean = y.mean(1)
        centre = np.median(y, axis=1) if p.get("centre") == "median" else mean
        sd = np.sqrt(((y - mean[:, None]) ** 2).sum(1) / max(n - 1, 1))
        return tuple(np.where(ok, v, np.nan) for v in (start + n, centre, sd))

    def _low(self, threshold: float) -> tuple[np.ndarray, tuple]:
        """Samples under the threshold, and their runs: rows, first samples, samples after the last one."""
        if threshold not in self.masks:
            low = self.x < threshold
            edge = np.zeros((len(low), low.shape[1] + 1), bool)
            edge[:, 1:-1] = low[:, 1:] != low[:, :-1]
            edge[:, 0], edge[:, -1] = low[:, 0], low[:, -1]
            r, at = np.nonzero(edge)
            self.masks[threshold] = low, (r[::2], at[::2], at[1::2])
        return self.masks[threshold]

    def _low_from(self, threshold: float, rule: str, seconds: float, end: np.ndarray) -> np.ndarray:
        """The same samples, without those before the window's end."""
        key = threshold, rule, seconds
        if key not in self.masks:
            self.masks[key] = self._low(threshold)[0] & (self.place >= end[:, None])
        return self.masks[key]

    def _first(self, ok: np.ndarray) -> np.ndarray:
        """First place of every row that holds; not a number where none does."""
        at = ok.argmax(1)
        return np.where(ok[self.rows, at], at, np.nan)

    def take_off(self, rule: str, p: dict, end: np.ndarray, window: tuple) -> np.ndarray:
        span, (low, runs) = int(p["span"]), self._low(p["threshold"])
        if rule == "longest_run":  # the longest run from the end of the window on, the first of equals
            (r, a, b), n = runs, self.x.shape[1]
            a = np.maximum(a, np.where(np.isnan(end), n, end)[r])
            held = np.flatnonzero(b > a)
            r, a, size = r[held], a[held], (b - a)[held]
            out = np.full(len(self.x), np.nan)
            if len(r):
                begun = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                size, back = np.divmod(np.maximum.reduceat(size * (n + 1) + (n - a), begun), n + 1)
                out[r[begun]] = np.where(size >= span, n - back, np.nan)
            return out
        after = self._low_from(p["threshold"], *window, end)
        if rule == "absolute_force":
            return self._first(_run(after, span))
        ok = _run(after, span + 1).copy()
        ok[:, 1:] &= ~low[:, :-1]
        ok[:, 0] = False
        return self._first(ok)

    def search(self, rule: str, p: dict, weighing: tuple, weighed: tuple) -> np.ndarray:
        """First place from the end of weighing on where the trace stays under the rule's level; -1 where the band has no width."""
        key = weighing, rule, p.get("k"), p.get("share")
        if key not in self.masks:
            end, weight, sd = weighed
            if rule == "noise_relative":
                level = weight - p["k"] * sd
                flat = (sd <= 0) | (level <= 0)
            else:
                level, flat = p["share"] * weight, np.zeros(len(weight), bool)
            self.masks[key] = (self.x < level[:, None]) & (self.place >= end[:, None]), flat
        under, flat = self.masks[key]
        return np.where(flat, -1, self._first(_run(under, int(p["span"]))))

    def steps(self, chain: tuple) -> tuple:
        """(key of its weighing, weighed; key, takeoff; key, place found, samples back) of one chain."""
        (_, wr, wp), (_, tr, tp), (_, onr, op) = chain
        w, t, o = dict(wp), dict(tp), dict(op)
        weighing, window = (wr, wp), (wr, w["seconds"])
        weighed = self._once(("weighing", weighing), lambda: self.weigh(wr, w))
        off = ("takeoff", *window, tr, tp)
        takeoff = self._once(off, lambda: self.take_off(tr, t, weighed[0], window))
        on = ("onset", weighing, onr, tuple(kv for kv in op if kv[0] != "back"))
        found = self._once(on, lambda: self.search(onr, o, weighing, weighed))
        return weighing, weighed, off, takeoff, (*on, o["back"]), found, o["back"]

    def heights(self, chains: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(jump heights by impulse, codes), a row for each chain; chains of one weighing are one matrix."""
        values, codes = np.empty((len(chains), len(self.x))), np.empty((len(chains), len(self.x)), np.int8)
        groups: dict = {}
        for k, chain in enumerate(chains):
            weighing, weighed, off, takeoff, on, found, back = self.steps(chain)
            _, offs, ons, members = groups.setdefault(weighing, (weighed, {}, {}, []))
            if off not in offs:
                b = np.where(np.isnan(takeoff), 0, takeoff - 1).astype(int)
                offs[off] = len(offs), takeoff, b, self.total[self.rows, b + 1], self.x[self.rows, b]
            if on not in ons:
                a = np.where(found >= 0, np.maximum(found - back, 0), 0).astype(int)
                ons[on] = len(ons), found, a, self.total[self.rows, a], self.x[self.rows, a]
            members.append((k, offs[off][0], ons[on][0]))
        for (_, weight, _), offs, ons, members in groups.values():
            takeoff, b, upto, last = (np.array(x) for x in list(zip(*offs.values()))[1:])
            found, a, before, first = (np.array(x) for x in list(zip(*ons.values()))[1:])
            mass = weight / GRAVITY
            for at in range(0, len(members), 64):
                k, i, j = (np.array(x) for x in zip(*members[at : at + 64]))
                code = np.where(found[j] < takeoff[i], 0, 4).astype(np.int8)
                code[found[j] == -1] = 3
                code[np.isnan(takeoff)[i]] = 2
                code[:, np.isnan(weight)] = 1
                value = upto[i] - before[j] - (first[j] + last[i]) / 2 - (b[i] - a[j]) * weight
                velocity = value / self.rate / mass
                codes[k] = code
                values[k] = np.where((code == 0) & np.isfinite(velocity), velocity**2 / (2 * GRAVITY), np.nan)
        return values, codes

    def height(self, chain: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(jump height by impulse, code) of one chain."""
        values, codes = self.heights([chain])
        return values[0], codes[0]


def _run(ok: np.ndarray, span: int) -> np.ndarray:
    """Places from which span samples in a row hold."""
    if not 1 < span <= 8:
        return T._held(ok, span)
    n = ok.shape[1] - span + 1
    out = np.zeros_like(ok)
    if n > 0:
        held = ok[:, :n] & ok[:, 1 : n + 1]
        for k in range(2, span):
            held &= ok[:, k : n + k]
        out[:, :n] = held
    return out


def _window(trials: DataFrame, variants: list[Variant]) -> int:
    """Samples of the steadiest window, which every variant that weighs there shares; 0 where none does."""
    seconds = {dict(p)["seconds"] for v in variants for s, r, p in v.chain if r == "lowest_variance"}
    if len(seconds) > 1:
        raise Refused("one length of the steadiest window at a time")
    rate = trials.select("sample_rate_hz").first() if seconds else None
    return samples_for(seconds.pop(), rate[0]) if rate else 0


def _told(trials: DataFrame) -> DataFrame:
    return trials.select("trial_id", "subject", "sample_rate_hz", "force")


def _answers(batches: Iterator[pa.RecordBatch], chains: list[tuple], window: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(trials, values, codes) of parts of the batches; values and codes have a row for each chain."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            rates = T.numbers(part.column("sample_rate_hz"))
            values, codes = np.full((len(chains), part.num_rows), np.nan), np.full((len(chains), part.num_rows), 1, np.int8)
            for rows, x in T.blocks(part.column("force")):
                steady = scans.steadiest(x, window)["start"] if window else np.full(len(rows), np.nan)
                for hz in np.unique(rates[rows]).tolist():
                    own = rates[rows] == hz
                    values[:, rows[own]], codes[:, rows[own]] = Tree(x[own], hz, steady[own]).heights(chains)
            yield part, values, codes


def _distinct(variants: list[Variant]) -> tuple[list[tuple], np.ndarray]:
    """The chains that differ, and which of them each variant is: a parameter that a rule does not read makes no other chain."""
    place: dict = {}
    at = np.array([place.setdefault(v.chain, len(place)) for v in variants], int)
    return list(place), at


def heights(trials: DataFrame, variants: list[Variant]) -> DataFrame:
    """trial_id, subject, values (jump height under each variant, in order; null without an answer) and codes of every trial."""
    (chains, of), window = _distinct(variants), _window(trials, variants)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, codes in _answers(batches, chains, window):
            ends = pa.array(np.arange(part.num_rows + 1) * len(of), pa.int32())
            flat = values[of].T.ravel()
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(flat, mask=np.isnan(flat)), pa.array(codes[of].T.ravel()))]
            yield pa.record_batch([part.column(0), part.column(1), *lists], names=["trial_id", "subject", "values", "codes"])

    kind = lambda x: trials.schema[x].dataType.simpleString()
    return _told(trials).mapInArrow(run, f"trial_id {kind('trial_id')}, subject {kind('subject')}, values array<double>, codes array<tinyint>")


def tally(trials: DataFrame, variants: list[Variant]) -> DataFrame:
    """by_variant() of heights(): each task adds up its trials, and a row for each variant leaves it."""
    (chains, of), window = _distinct(variants), _window(trials, variants)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(CODES) + 2, len(chains)), np.int64)  # trials, those of each code, and those with a value
        total, least, greatest = np.zeros(len(chains)), np.full(len(chains), np.inf), np.full(len(chains), -np.inf)
        for _, values, codes in _answers(batches, chains, window):
            none = np.isnan(values)
            of_code = [np.count_nonzero(codes == k, axis=1) for k in range(1, len(CODES))]
            size = values.shape[1]
            counts += np.array([np.full(len(chains), size), size - sum(of_code), *of_code, size - np.count_nonzero(none, axis=1)])
            total += np.where(none, 0.0, values).sum(1)
            least = np.minimum(least, np.where(none, np.inf, values).min(1, initial=np.inf))
            greatest = np.maximum(greatest, np.where(none, -np.inf, values).max(1, initial=-np.inf))
        if counts[0].any():
            none = counts[-1] == 0
            cols = [pa.array(np.arange(len(of)), pa.int32()), *(pa.array(x[of]) for x in counts), *(pa.array(x[of], mask=none[of]) for x in (total, least, greatest))]
            yield pa.record_batch(cols, names=["variant", "trials", *CODES, "held", "total", "least", "greatest"])

    longs = ["trials", *CODES, "held"]
    d = _told(trials).mapInArrow(run, f"variant int, {', '.join(f'{x} long' for x in longs)}, total double, least double, greatest double")
    told = trials.sparkSession.createDataFrame([(i, v.label) for i, v in enumerate(variants)], "variant int, label string")
    mean = F.try_divide(F.sum("total"), F.sum("held")).alias("mean")
    d = d.groupBy("variant").agg(*(F.sum(x).alias(x) for x in longs[:-1]), mean, F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    return d.join(F.broadcast(told), "variant")


def by_variant(swept: DataFrame, variants: list[Variant]) -> DataFrame:
    """A row for each variant: label, trials, how many answered and how many each step refused, mean, least and greatest value."""
    told = swept.sparkSession.createDataFrame([(i, v.label) for i, v in enumerate(variants)], "variant int, label string")
    d = swept.select(F.posexplode(F.arrays_zip("values", "codes")).alias("variant", "x")).select("variant", "x.*")
    of = lambda k: F.count(F.when(F.col("codes") == k, 1)).alias(CODES[k])
    d = d.groupBy("variant").agg(F.count("*").alias("trials"), *map(of, range(len(CODES))), F.avg("values").alias("mean"), F.min("values").alias("least"), F.max("values").alias("greatest"))
    return d.join(F.broadcast(told), "variant")
