"""Trials of vertical force built from the orders table, one row per trial, with the SQL text of the same arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.traces import bounded

RATE_HZ = 100.0
#: Trials in a task: their traces, velocities and powers are some 80 MB, which a Python step may hold at once.
PART_ROWS = 8192

#: Force of sample i of trial k with weight w and push j; every constant is a double, so that all engines agree.
FORCE_SQL = """
CASE WHEN k % 70 = 0 AND i BETWEEN 120 AND 122 THEN 0e0
     WHEN i <= 149 THEN w0 + {e}
     WHEN i <= 179 THEN w0 - 4e0 * ((i - 150) / 30e0) * (1e0 - (i - 150) / 30e0) * 0.42e0 * w0 + {e}
     WHEN i <= 204 THEN w0 + 4e0 * ((i - 180) / 25e0) * (1e0 - (i - 180) / 25e0) * (1.85e0 + j / 50e0) * w0
     WHEN i <= 249 THEN 0e0
     WHEN i <= 254 THEN (i - 249) / 5e0 * 3.4e0 * w0
     ELSE w0 + (1e0 - (i - 254) / 35e0) * 2.4e0 * w0 END
""".format(e="CASE WHEN k % 190 = 0 THEN 0e0 ELSE (((k * 7919 + i * 104729) % 1000) / 1000e0 - 0.5e0) * 2.4e0 END")

#: A row per trial: key, athlete, year, weight, push and number of samples.
ORDERS_SQL = """
SELECT o_orderkey AS k, o_custkey % 20 AS subject, year(o_orderdate) AS occasion, 520e0 + (o_custkey % 20) * 25e0 AS w0,
       (o_orderkey % 1009) / 1009e0 * 16e0 - 8e0 AS j, CASE WHEN o_orderkey % 110 = 0 THEN 240 ELSE 290 END AS n
FROM orders
"""


def _force(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples of every trial by FORCE_SQL's arithmetic, operation by operation, so that the doubles are the same."""
    i = np.arange(290)
    fall, push = (i - 150) / 30.0, (i - 180) / 25.0
    dip, rise = 4.0 * fall * (1.0 - fall) * 0.42, 4.0 * push * (1.0 - push)
    land, settle = (i - 249) / 5.0 * 3.4, (1.0 - (i - 254) / 35.0) * 2.4
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            k, w, j, n = (part.column(x).to_numpy(zero_copy_only=False)[:, None] for x in ("trial_id", "w0", "j", "n"))
            e = np.where(k % 190 == 0, 0.0, (((k * 7919 + i * 104729) % 1000) / 1000.0 - 0.5) * 2.4)
            f = w + settle * w
            f[:, 250:255] = (land * w)[:, 250:255]
            f[:, 205:250] = 0.0
            f[:, 180:205] = (w + rise * (1.85 + j / 50.0) * w)[:, 180:205]
            f[:, 150:180] = (w - dip * w + e)[:, 150:180]
            f[:, :150] = (w + e)[:, :150]
            f[np.flatnonzero(k[:, 0] % 70 == 0), 120:123] = 0.0
            offsets = np.concatenate(([0], np.cumsum(n[:, 0])))
            force = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(f[i < n]))
            yield pa.record_batch([part.column(0), part.column(1), part.column(2), force], names=["trial_id", "subject", "occasion", "force"])


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df over all cores, where its files give fewer parts than that, and with rows in parts of about that many at most:
    for narrow rows that are about to grow.

    A Python step keeps each row, with all its columns, until Spark has read its answer. Answers of a few bytes wait in the
    socket while the step's input is slow, so that a part's traces are held all at once: a large part's went to disk.
    """
    parts, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    wanted = -(-df.count() // rows) if rows else 0
    return df.repartition(max(cores, wanted)) if parts < max(2 * cores, wanted) else df


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial_id, subject, occasion, sample_rate_hz, force of every order: a trial's samples stay one array of one row."""
    return trials_of_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def trials_of_orders(orders: DataFrame) -> DataFrame:
    """trials() of the given rows of the orders."""
    orders = spread(bounded(orders).select("o_orderkey", "o_custkey", "o_orderdate"), PART_ROWS)
    d = orders.selectExpr(
        "cast(o_orderkey as long) AS trial_id",
        "cast(o_custkey % 20 as long) AS subject",
        "year(o_orderdate) AS occasion",
        "520e0 + (o_custkey % 20) * 25e0 AS w0",
        "(o_orderkey % 1009) / 1009e0 * 16e0 - 8e0 AS j",
        "CASE WHEN o_orderkey % 110 = 0 THEN 240 ELSE 290 END AS n",
    )
    d = d.mapInArrow(_force, "trial_id long, subject long, occasion int, force array<double>")
    return d.select("trial_id", "subject", "occasion", F.lit(RATE_HZ).alias("sample_rate_hz"), "force")


def samples(trials: DataFrame, *keep: str) -> DataFrame:
    """Long form: trial_id, idx, force and the columns in keep."""
    return trials.select("trial_id", *keep, F.posexplode("force").alias("idx", "force"))


#: Long form of the trials for SQL engines: s(trial_id, subject, occasion, idx, f).
SAMPLES_CTE = f"""
o AS ({ORDERS_SQL}),
s AS (SELECT k AS trial_id, subject, occasion, i AS idx, {FORCE_SQL} AS f FROM o, range(290) AS r(i) WHERE i < n)
"""
