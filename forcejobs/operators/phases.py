"""Phase boundaries and analysis windows: an index at a crossing or an extremum between two landmarks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import traces as T


def rising_crossing(force: Column, level: Column, start: Column, end: Column) -> Column:
    """From the least sample of [start, end), the last one at or under level up to end; null unless that is before end."""
    found = T.find(force, "<=", level, T.argmin(force, start, end), end + 1, last=True)
    return F.when((end > start) & (end < F.size(force)) & (found < end), found)


def falling_crossing(force: Column, level: Column, start: Column, end: Column) -> Column:
    """From the greatest sample of [start, end), the first one at or under level up to end; null unless past the anchor."""
    anchor = T.argmax(force, start, end)
    found = T.find(force, "<=", level, anchor, end + 1)
    return F.when((end > start) & (end < F.size(force)) & (found > anchor), found)


def velocity_crossing(velocity: Column, start: Column, end: Column, threshold: float = 0.0) -> Column:
    """The sample after the first pair that passes threshold upwards, from the least velocity of [start, end)."""
    found = T.passes_upwards(velocity, threshold, T.argmin(velocity, start, end), end - 1)
    return F.when((start + 1 < end) & (end <= F.size(velocity)), found + 1)


def stabilised(force: Column, weight: Column, start: Column, dwell: int, percent: float = 5.0) -> Column:
    """End of the first `dwell` samples in a row within percent of the weight, from start on."""
    half = weight * percent / 100
    return T.band(force, weight - half, weight + half, start, span=dwell, inside=True) + dwell - 1


def dropoff(smoothed: Column, start: Column, percent: float = 5.0) -> Column:
    """First sample after start below (1 - percent) of the running maximum since start."""
    return T.drop_from_top(smoothed, start, percent)


def sticking_region(velocity: Column, start, end) -> Column:
    """struct(start, stop): first local maximum after start, and the next local minimum that velocity rises from; both or neither."""
    return T.crest_and_dip(velocity, start, end)
