"""Columns of a placed trial by name, made when they are asked for (a column needs a running session)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: onset < takeoff: without it every quantity between the two is blank; last is the last sample in contact.
_COLUMNS = {
    "force": lambda: F.col("force"),
    "weight": lambda: F.col("weight"),
    "onset": lambda: F.col("onset"),
    "takeoff": lambda: F.col("takeoff"),
    "touchdown": lambda: F.col("touchdown"),
    "dt": lambda: 1 / F.col("sample_rate_hz"),
    "last": lambda: F.col("takeoff") - 1,
    "ordered": lambda: F.col("onset") < F.col("takeoff"),
}


def __getattr__(name: str) -> Column:
    if name not in _COLUMNS:
        raise AttributeError(name)
    return _COLUMNS[name]()
