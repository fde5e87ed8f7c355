"""Curve sets: mean, covariance and components, continuum tests, registration and warping, conditioning of traces."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filters as X
from ..functions import traces as T


#: Rows that are warped at a time.
STRIP = 1024


def by_rows(column: str, out: str, kind: str, f: Callable[[np.ndarray], list]):
    """mapInArrow-style step: rows of equal length go to f as one matrix; f gives a value or an array per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list = [None] * batch.num_rows
            for rows, x in T.blocks(batch.column(column)):
                for i, v in zip(rows.tolist(), f(x)):
                    values[i] = v
            keep = [c for c in batch.schema.names if c != column]
            values = [v.tolist() if isinstance(v, np.ndarray) else v for v in values]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(values, kind)], names=[*keep, out])

    return run


def per_trace(df: DataFrame, column: str, out: str, f: Callable[[np.ndarray], list], array: bool = True) -> DataFrame:
    """Adds `out` (and drops `column`): f over the traces of a batch that have the same length."""
    schema = ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k != column) + f", `{out}` " + ("array<double>" if array else "double")
    return df.mapInArrow(by_rows(column, out, pa.list_(pa.float64()) if array else pa.float64(), f), schema)


def points(curves: DataFrame, key: str, value: str, *keep: str) -> DataFrame:
    """Long form: key, point, y and the columns in keep."""
    return curves.select(key, *keep, F.posexplode(value).alias("point", "y"))


def covariance(curves: DataFrame, value: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(curves, mean, covariance) of curves of one length: tasks' sums are added up by Spark, and p * (p + 1) numbers reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, None, None
        for batch in batches:
            for _, x in T.blocks(batch.column(0)):
                n += len(x)
                s = x.sum(0) + (0 if s is None else s)
                q = x.T @ x + (0 if q is None else q)
        if n:
            rows = [*zip(range(len(s)), q), (len(s), s), (len(s) + 1, np.full(1, float(n)))]
            yield pa.record_batch([pa.array([r for r, _ in rows], pa.int32()), pa.array([v.tolist() for _, v in rows])], names=["row", "v"])

    parts = curves.select(F.col(value).cast("array<double>").alias("y")).mapInArrow(sums, "row int, v array<double>")
    cells = parts.select("row", F.posexplode("v").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x"))
    found = {r.row: r.v for r in cells.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "x"))), lambda z: z["x"]).alias("v")).collect()}
    if not found:
        return 0, np.zeros(0), np.zeros((0, 0))
    p = len(found) - 2
    n, s, q = int(found[p + 1][0]), np.array(found[p]), np.array([found[i] for i in range(p)])
    return n, s / n, (q - np.outer(s, s) / n) / max(n - 1, 1)


def components(cov: np.ndarray, share: float = 0.99) -> tuple[np.ndarray, np.ndarray]:
    """(variances, vectors as columns) of the fewest components that hold the share; a vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), share) + 1)
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(0), np.arange(k)])
    return values[:k], vectors


def two_sample_t(curves: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """Pointwise t of two groups of curves with pooled variance; 0 where nothing varies."""
    d = points(curves.where(F.col(group).isin(first, second)), group, value)
    g = d.groupBy("point").agg(
        *[
            f(F.when(F.col(group) == x, F.col("y").cast("double"))).alias(f"{n}{i}")
            for i, x in enumerate((first, second))
            for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))
        ]
    )
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2)
    error = F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))
    return g.select("point", F.when(error > 0, (F.col("m0") - F.col("m1")) / error).otherwise(0.0).alias("t"))


def clusters(field: DataFrame, threshold: float) -> DataFrame:
    """Maximal runs of points with |t| over threshold: start, stop, extent, peak. The field has a row per point."""
    w = Window.orderBy("point")
    d = field.where(F.abs("t") > threshold).withColumn("grp", F.col("point") - F.row_number().over(w))
    return d.groupBy("grp").agg(F.min("point").alias("start"), F.max("point").alias("stop"), F.count("*").alias("extent"), F.max(F.abs("t")).alias("peak")).drop("grp")


def inference(field: DataFrame, threshold: float) -> DataFrame:
    """Every point of a field with its t, the threshold, and the start of the cluster it belongs to (null: none)."""
    held = clusters(field, threshold).select("start", "stop")
    return field.join(F.broadcast(held), F.col("point").between(F.col("start"), F.col("stop")), "left").select("point", "t", F.lit(threshold).alias("threshold"), F.col("start").alias("cluster"))


def sign_flip_maxima(curves: DataFrame, key: str, value: str, permutations: int) -> DataFrame:
    """Per permutation, the greatest |t| over the points of one-sample t with each curve's sign drawn by a hash of both.

    A task draws the signs of its curves as a matrix and sends one row of sums by point for each permutation.
    """
    d = curves.select(F.col(key).cast("string").alias("k"), F.col(value).cast("array<double>").alias("y"))
    sums = d.mapInArrow(_signed_sums(permutations), "perm int, n long, s array<double>, q array<double>")
    sums = sums.select("perm", "n", F.posexplode(F.arrays_zip("s", "q")).alias("point", "z"))
    t = sums.groupBy("perm", "point").agg(F.sum("n").alias("n"), F.sum("z.s").alias("s"), F.sum("z.q").alias("q"))
    spread = F.expr("(q - s * s / n) / (n - 1)")
    t = t.select("perm", F.when(spread > 0, F.abs(F.col("s") / F.col("n")) / F.sqrt(spread / F.col("n"))).otherwise(0.0).alias("t"))
    return t.groupBy("perm").agg(F.max("t").alias("greatest"))


def _signed_sums(permutations: int):
    """For mapInArrow over rows (key, curve): per permutation, the curves and their signed sums and squares by point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, None, None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for rows, x in T.blocks(batch.column(1)):
                signs = np.ones((permutations, len(rows)))
                for j, i in enumerate(rows.tolist()):
                    signs[1:, j] = [1.0 if hashlib.md5(f"{p}_{keys[i]}".encode()).digest()[0] < 128 else -1.0 for p in range(1, permutations)]
                n, s, q = n + len(rows), signs @ x + (0 if s is None else s), (x * x).sum(0) + (0 if q is None else q)
        if n:
            yield pa.record_batch([pa.array(range(permutations), pa.int32()), pa.array([n] * permutations), pa.array(s.tolist()), pa.array([q.tolist()] * permutations)], names=["perm", "n", "s", "q"])

    return run


def label_shuffle_maxima(curves: DataFrame, key: str, group: str, value: str, first, second, permutations: int) -> DataFrame:
    """Per permutation from 1, the greatest |t| over the points of two_sample_t with the labels shuffled.

    A permutation orders the curves by a hash of both, and as many of the first as `first` has curves are that group.
    """
    d = curves.where(F.col(group).isin(first, second)).select(key, group, F.col(value).alias("y"))
    size = d.where(F.col(group) == first).count()
    d = d.select(key, "y", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm"))
    place = F.row_number().over(Window.partitionBy("perm").orderBy(F.xxhash64("perm", key), key))
    d = d.select("perm", "y", (place <= size).alias("one")).select("perm", "one", F.posexplode("y").alias("point", "x"))
    part = lambda f, one: f(F.when(F.col("one") == one, F.col("x").cast("double")))
    t = d.groupBy("perm", "point").agg(*[part(f, one).alias(f"{n}{i}") for i, one in enumerate((True, False)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    error = F.expr("sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1))")
    return t.select("perm", F.when(error > 0, F.abs(F.expr("m0 - m1") / error)).otherwise(0.0).alias("t")).groupBy("perm").agg(F.max("t").alias("greatest"))


def permutation_threshold(maxima: DataFrame, alpha: float = 0.05) -> float:
    """The value of rank ceil((1 - alpha) P) among the maxima of permutations 1 to P; number 0, the data, is left out."""
    found = sorted(r.greatest for r in maxima.where("perm > 0").select("greatest").collect())
    rank = min(max(int(np.ceil((1 - alpha) * len(found))), 1), len(found))
    return found[rank - 1]


def random_field_threshold(fwhm: float, points_: int, df: float, alpha: float = 0.05) -> float:
    """t over which the expected Euler characteristic of a smooth one-dimensional field is alpha (two-sided, by bisection)."""
    from math import exp, lgamma, log, pi

    def tail(t: float) -> float:
        grid = np.linspace(0, 1, 2001)[1:]
        u = t + (1 - grid) / grid * max(1.0, t)
        log_density = lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * log(df * pi) - (df + 1) / 2 * np.log1p(u * u / df)
        return float(np.trapezoid(np.exp(log_density) * max(1.0, t) / grid**2, grid))

    def expected(t: float) -> float:
        resels = (points_ - 1) / fwhm
        return tail(t) + resels * (4 * log(2)) ** 0.5 / (2 * pi) * exp(-(df - 1) / 2 * np.log1p(t * t / df))

    low, high = 0.0, 100.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) > alpha / 2 else (low, mid)
    return high


def smoothness(curves: DataFrame, value: str) -> float:
    """Full width at half maximum of the residuals' field, from the ratio of their power to that of their gradient."""
    _, mean, cov = covariance(curves, value)
    d = np.diag(cov)
    step = d[1:] + d[:-1] - 2 * np.diag(cov, 1)
    ok = (d[1:] + d[:-1]) > 0
    return float(np.sqrt(4 * np.log(2) / max((step[ok] / ((d[1:] + d[:-1])[ok] / 2)).mean(), 1e-12)))


def register(curves: DataFrame, key: str, value: str, landmark: str) -> DataFrame:
    """Curves warped piecewise linearly so that their landmark falls at its mean place; without one the warped curve is null."""
    share = curves.select((F.col(landmark) / (F.size(value) - 1)).alias("s")).where("s > 0 AND s < 1").agg(F.avg("s")).first()[0]
    schema = f"{key} {dict(curves.dtypes)[key]}, registered array<double>"

    def warp(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for y, at in zip(b[value], b[landmark]):
                n = len(y)
                if share is None or pd.isna(at) or not 0 < at < n - 1:
                    rows.append(None)
                    continue
                x = np.linspace(0, 1, n)
                rows.append(np.interp(np.interp(x, [0, share, 1], [0, at / (n - 1), 1]), x, np.asarray(y, float)))
            yield pd.DataFrame({key: b[key], "registered": rows})

    return curves.select(key, value, landmark).mapInPandas(warp, schema)


def warped_cost(curves: DataFrame, key: str, value: str, reference: list[float], band: int) -> DataFrame:
    """Per curve the cost of warping it to a reference, and its greatest departure from a straight path."""
    ref = np.asarray(reference, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost, departure = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.nan)
            for rows, x in T.blocks(batch.column(1)):
                for at in range(0, len(rows), STRIP):
                    own = rows[at : at + STRIP]
                    cost[own], place = X.warp_rows(ref, x[at : at + STRIP], band)
                    departure[own] = np.abs(place - np.arange(len(ref))).max(1)
            yield pa.record_batch([batch.column(0), pa.array(cost), pa.array(departure)], names=[key, "cost", "departure"])

    d = curves.select(key, F.col(value).cast("array<double>").alias("y"))
    return d.mapInArrow(run, f"{key} {dict(curves.dtypes)[key]}, cost double, departure double")


def warped_pairs(curves: DataFrame, key: str, value: str, reference: list[float], band: int) -> DataFrame:
    """The path of every curve's warp to a reference, a row for each pair: key, step, reference_place, place, carried_to.

    carried_to is the mean place in the curve of all pairs of that reference place. Curves without points give no rows.
    """
    ref = np.asarray(reference, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in T.blocks(batch.column(1)):
                for at in range(0, len(rows), STRIP):
                    own = rows[at : at + STRIP]
                    _, paths = X.warp_path(ref, x[at : at + STRIP], band)
                    size = np.array([len(p) for p in paths])
                    flat = np.concatenate(paths)
                    mean = np.concatenate([X.carried(p, len(ref))[p[:, 0]] for p in paths])
                    step = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                    keys = batch.column(0).take(pa.array(np.repeat(own, size)))
                    cols = [keys, *(pa.array(v.astype(np.int32)) for v in (step, flat[:, 0], flat[:, 1])), pa.array(mean)]
                    yield pa.record_batch(cols, names=[key, "step", "reference_place", "place", "carried_to"])

    d = curves.select(key, F.col(value).cast("array<double>").alias("y"))
    return d.mapInArrow(run, f"{key} {dict(curves.dtypes)[key]}, step int, reference_place int, place int, carried_to double")
