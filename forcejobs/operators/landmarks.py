"""Weighing, takeoff, onset and landing of every trial, each under a named rule. A rule that cannot answer gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scans
from ..functions import traces as T

#: Standard gravity in metres per second squared.
GRAVITY = 9.80665


def samples_for(seconds: float, rate_hz: float, rounding: str = "nearest") -> int:
    """Samples of a duration: nearest (half away from zero), truncate or ceiling; 0 unless it is positive."""
    import math

    x = seconds * rate_hz
    if x <= 0:
        return 0
    return {"nearest": math.floor(x + 0.5), "truncate": math.trunc(x), "ceiling": math.ceil(x)}[rounding]


def weigh(trials: DataFrame, start: int = 0, samples: int = 100, centre: str = "mean", dispersion: str = "sample") -> DataFrame:
    """Adds epoch_end, weight and weight_sd from a window of samples at a stated start."""
    found = T.level(F.col("force"), start, start + samples, centre, 1 if dispersion == "sample" else 0)
    d = trials.withColumn("_w", found).withColumn("epoch_end", F.lit(start + samples))
    return d.withColumns({"weight": F.col("_w.level"), "weight_sd": F.col("_w.sd")}).drop("_w")


#: Test of a sample for low force: (threshold, signed or magnitude).
low = T.Low


def takeoff_absolute(force: Column, start, threshold: float = 20.0, span: int = 3, comparison: str = "signed") -> Column:
    """Start of the first `span` samples in a row of low force from start on."""
    return T.find(force, "<", threshold, start, span=span, magnitude=comparison == "magnitude")


def takeoff_longest_run(runs: Column, span: int, filter_first: bool = False) -> Column:
    """Of low-force runs: (takeoff, end, qualifying runs, whether it is the first of them); the first on ties."""
    length = lambda r: r["end"] - r["start"] + 1
    fit = F.filter(runs, lambda r: length(r) >= span)
    pool = fit if filter_first else runs
    best = F.array_max(F.transform(pool, lambda r: F.struct(length(r).alias("n"), (-r["start"]).alias("back"), r["end"].alias("end"))))
    start = -best["back"]
    return F.when(
        best["n"] >= span,
        F.struct(start.alias("takeoff"), best["end"].alias("end"), F.size(fit).alias("qualifying"), (F.get(fit, F.lit(0))["start"] == start).alias("is_first")),
    )


def takeoff_descending(force: Column, threshold: float = 20.0, span: int = 2) -> Column:
    """First sample that falls under the threshold and is followed by `span` samples under it."""
    return T.falls(force, threshold, span)


def takeoff_flight_noise(trials: DataFrame, start: Column, provisional: float = 10.0, trim: float = 0.25, k: float = 5.0) -> DataFrame:
    """Adds noise_takeoff and noise_threshold: the threshold is set again from the middle of the provisional flight."""
    f = F.col("force")
    d = trials.withColumn("_p", T.find(f, "<=", provisional, start))
    d = d.withColumn("_q", F.coalesce(T.find(f, ">", provisional, F.col("_p")) - 1, F.size(f) - 1))
    cut = F.floor(trim * (F.col("_q") - F.col("_p"))).cast("int")
    d = d.withColumn("_m", T.level(f, F.col("_p") + cut, F.col("_q") - cut))
    again = F.coalesce(F.col("_m.level") + k * F.col("_m.sd"), F.lit(provisional))
    d = d.withColumn("noise_threshold", F.when(F.col("_p").isNotNull(), again))
    return d.withColumn("noise_takeoff", F.coalesce(T.find(f, "<=", F.col("noise_threshold"), start), F.col("_p"))).drop("_p", "_q", "_m")


def onset(force: Column, lower, span: int, back: int, start, end, upper=None, pick: str = "first") -> Column:
    """First (or last) sample of [start, end) from which `span` samples are under lower, or over upper where it is given.

    It is stepped back, not under 0.
    """
    last = pick == "last"
    at = T.find(force, "<", lower, start, end, span, last) if upper is None else T.band(force, lower, upper, start, end, span, last)
    return F.when(at.isNotNull(), F.greatest(at - back, F.lit(0)))


def onset_noise(
    force: Column, weight: Column, sd: Column, k: float, span: int, back: int, start, end,
    sides: str = "below_only", fraction: float | None = None, pick: str = "first",
) -> Column:
    """Onset by a band of k deviations; a collapsed band gives null, or a band at `fraction` of the weight if stated."""
    lower = weight - k * sd
    collapsed = (sd <= 0) | (lower <= 0)
    level = F.when(~collapsed, lower)
    if fraction is not None:
        level = F.coalesce(level, F.when(collapsed, fraction * weight))
    # a band that stands in for a collapsed one has no upper side
    upper = None if sides == "below_only" else F.when(collapsed, float("inf")).otherwise(weight + k * sd)
    return onset(force, level, span, back, start, end, upper, pick)


def onset_final_departure(force: Column, weight: Column, sd: Column, k: float, bound: Column) -> Column:
    """The sample after the last quiet one up to bound."""
    lower = weight - k * sd
    end = F.least(bound + 1, F.size(force))
    quiet = T.find(force, ">=", F.when((sd > 0) & (lower > 0), lower), 0, end, last=True)
    return F.when(quiet.isNotNull(), F.least(quiet + 1, end - 1))


def touchdown(force: Column, takeoff: Column, threshold: Column | float, weight: Column) -> Column:
    """Start of the first run over the threshold after takeoff that reaches the weight; null if it never does."""
    return T.return_to(force, takeoff, threshold, weight)


def landing_absolute(force: Column, start, threshold: float = 20.0, span: int = 2) -> Column:
    """First sustained contact once the plate has been unloaded."""
    return T.find(force, ">=", threshold, T.find(force, "<", threshold, start), span=max(span, 1))


def place(trials: DataFrame, k: float = 5.0, threshold: float = 20.0, span: int = 3, back: int = 3, moving: bool = False, pushed: bool = False) -> DataFrame:
    """The default chain: weighing, then takeoff, onset and touchdown (takeoff first: onset is searched before it).

    With moving, also velocity and displacement, zero up to onset, and net_power; with pushed, net_impulse up to takeoff and
    peak, the greatest sample before it. All is found in one pass, in a generator
    of one row: a filter on what it finds is not pushed below it, where the pass would run twice.
    """
    found = scans.default_chain(100, k, threshold, span, back, GRAVITY if moving else None, pushed)(F.col("force"), 1 / F.col("sample_rate_hz"))
    added = ["epoch_end", "weight", "weight_sd", "takeoff", "onset", "touchdown", *(["net_impulse", "peak"] if pushed else []), *(["velocity", "displacement", "net_power"] if moving else [])]
    d = trials.drop(*added).select("*", F.inline(F.array(found)))
    return d.withColumn("epoch_end", F.lit(100)).select(*(x for x in trials.columns if x not in added), *added)
