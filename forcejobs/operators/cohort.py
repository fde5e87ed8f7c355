"""Reductions over trials: best-of-n rules per athlete, agreement, reliability, sweeps of rules."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Trials that each rule takes, and the least number a group must hold for it.
RULES = {"best_of_n_by_peak_force": (1, 1), "mean_of_best_three_of_at_least_five": (3, 5), "mean_of_best_two": (2, 2)}


def aggregate_trials(trials: DataFrame, group: list[str], rank: str, value: str, rule: str, least: int = 0, key: str = "trial_id") -> DataFrame:
    """Per group the value (mean) and deviation of the trials a rule takes, with a status that says why one is null.

    Trials are ranked by `rank`, greatest first, and key. Only key, rank and value travel. The status is ok, too_few_trials,
    ranking_value_absent, tied_at_boundary (the last one taken equals the next), too_few_usable or value_absent.
    """
    takes, needs = RULES[rule]
    needs = max(needs, least, takes)
    w = Window.partitionBy(*group).orderBy(F.col(rank).desc_nulls_last(), F.col(key))
    d = trials.select(*group, key, rank, value)
    ranked = d.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(rank).over(w))
    taken = F.col("_n") <= takes
    out = ranked.groupBy(*group).agg(
        F.count("*").alias("trials"),
        F.count(rank).alias("_ranked"),
        F.count(value).alias("_usable"),
        F.count(F.when(taken, F.col(value))).alias("_held"),
        F.max(F.when(F.col("_n") == takes, F.col(rank) == F.col("_next"))).alias("_tied"),
        F.avg(F.when(taken, F.col(value))).alias("_mean"),
        F.stddev_samp(F.when(taken, F.col(value))).alias("_sd"),
    )
    status = (
        F.when(F.col("trials") < needs, "too_few_trials")
        .when(F.col("_ranked") < F.col("trials"), "ranking_value_absent")
        .when(F.coalesce("_tied", F.lit(False)), "tied_at_boundary")
        .when(F.col("_usable") < needs, "too_few_usable")
        .when(F.col("_held") < takes, "value_absent")
        .otherwise("ok")
    )
    ok = status == "ok"
    return out.select(*group, "trials", status.alias("status"), F.when(ok, F.col("_mean")).alias("value"), F.when(ok & (takes > 1), F.col("_sd")).alias("dispersion"))


def limits_of_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Bias, deviation and 95 % limits of b - a, Pearson's r and the ordinary-least-products line of b on a. One row."""
    diff = F.col(b) - F.col(a)
    d = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count("*").alias("n"),
        F.avg(diff).alias("bias"),
        F.stddev_samp(diff).alias("sd"),
        F.covar_samp(a, b).alias("_cov"),
        F.stddev_samp(a).alias("_sa"),
        F.stddev_samp(b).alias("_sb"),
        F.avg(a).alias("_ma"),
        F.avg(b).alias("_mb"),
    )
    # what merged sums leave of a deviation of equal values is no variation
    vary = lambda s, m: F.when(F.col(s) > 1e-12 * F.abs(F.col(m)), F.col(s))
    d = d.withColumns({"_sa": vary("_sa", "_ma"), "_sb": vary("_sb", "_mb")})
    d = d.withColumn("r", F.try_divide("_cov", F.col("_sa") * F.col("_sb")))
    d = d.withColumn("slope", F.signum("r") * F.try_divide("_sb", "_sa"))
    return d.select(
        "n",
        "bias",
        "sd",
        (F.col("bias") - 1.96 * F.col("sd")).alias("lower"),
        (F.col("bias") + 1.96 * F.col("sd")).alias("upper"),
        "r",
        "slope",
        (F.col("_mb") - F.col("slope") * F.col("_ma")).alias("intercept"),
    ).withColumns({x: F.when(F.col("n") >= 2, F.col(x)) for x in ("bias", "sd", "lower", "upper")})


def coefficient_of_variation(trials: DataFrame, subject: str, value: str) -> DataFrame:
    """Mean over subjects of 100 * SD / mean of their trials (two values at least, mean not 0). One row."""
    per = trials.groupBy(subject).agg(F.stddev_samp(value).alias("s"), F.avg(value).alias("m"), F.count(value).alias("k"))
    return per.where("k >= 2 AND m <> 0").agg(F.avg(100 * F.col("s") / F.col("m")).alias("cv_percent"), F.count("*").alias("subjects"))


def intraclass(grid: DataFrame, subject: str, column: str, value: str) -> DataFrame:
    """Single-measure intraclass correlation (consistency, absolute agreement) of a full subject x column grid.

    Mean squares come from sums by subject and by column, which are joined to nothing but each other's totals; a grid
    that is not full gives nulls.
    """
    rows = grid.groupBy(subject).agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    columns = grid.groupBy(column).agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    r = rows.agg(F.count("*").alias("n"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.sum(F.col("s") * F.col("s")).alias("rs"))
    q = columns.agg(F.count("*").alias("c"), F.sum(F.col("s") * F.col("s")).alias("cs"))
    t = grid.agg(F.sum(value).alias("t"), F.sum(F.col(value) * F.col(value)).alias("tt"), F.count(value).alias("cells"))
    d = r.crossJoin(q).crossJoin(t)
    n, c, t, cells = F.col("n"), F.col("c"), F.col("t"), F.col("cells")
    mean = t * t / (n * c)
    between, measured = F.col("rs") / c - mean, F.col("cs") / n - mean
    residual = (F.col("tt") - mean - between - measured) / ((n - 1) * (c - 1))
    bms, mms = between / (n - 1), measured / (c - 1)
    full = (F.col("k0") == c) & (F.col("k1") == c) & (cells == n * c) & (n >= 2) & (c >= 2)
    consistency = (bms - residual) / (bms + (c - 1) * residual)
    agreement = (bms - residual) / (bms + (c - 1) * residual + c * (mms - residual) / n)
    return d.select(n.alias("subjects"), c.alias("measurements"), F.when(full, consistency).alias("icc_consistency"), F.when(full, agreement).alias("icc_agreement"))


#: Rows and resamples whose weights are drawn at a time: the matrices stay in a core's cache.
STRIP, DRAWS = 256, 250
#: Poisson(1) by the leading bits of a draw; -1 where an edge lies among those that share them.
LEAD_BITS = 12


def _poisson_table() -> tuple[np.ndarray, np.ndarray]:
    """(edges of the weights 0, 1, .. on [0, 1), weight by leading bits or -1)."""
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    ends = np.arange((1 << LEAD_BITS) + 1) / (1 << LEAD_BITS)
    low, high = np.searchsorted(edges, ends[:-1], side="right"), np.searchsorted(edges, ends[1:], side="right")
    return edges, np.where(low == high, low, -1).astype(float)


POISSON = _poisson_table()


def poisson_weights(u: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of a matrix of 64-bit draws, each by its leading 53 bits."""
    edges, table = POISSON
    weights = table.take((u >> np.uint64(64 - LEAD_BITS)).astype(np.intp))
    open_ = np.nonzero(weights < 0)
    weights[open_] = np.searchsorted(edges, (u[open_] >> np.uint64(11)) * 2.0**-53, side="right")
    return weights


def _resample_sums(resamples: int):
    """For mapInArrow over rows (hash, x, y): per resample, sums of the drawn weights with 1, x, y and their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((resamples, 6))
        draw = np.arange(1, resamples + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            h, x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            terms = np.column_stack((np.ones(len(x)), x, y, x * x, y * y, x * y))
            for at in range(0, len(x), STRIP):
                key, part = h[at : at + STRIP].astype(np.int64).view(np.uint64), terms[at : at + STRIP]
                for first in range(0, resamples, DRAWS):
                    u = key ^ draw[first : first + DRAWS]
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                        u ^= u >> np.uint64(shift)
                        u *= np.uint64(factor)
                    u ^= u >> np.uint64(31)
                    total[first : first + DRAWS] += poisson_weights(u) @ part
        yield pa.record_batch([pa.array(np.arange(resamples), pa.int32()), *map(pa.array, total.T)], names=["i", "n", "sx", "sy", "xx", "yy", "xy"])

    return run


def bootstrap_products_line(pairs: DataFrame, key: str, a: str, b: str, resamples: int) -> DataFrame:
    """2.5 to 97.5 % intervals of the ordinary-least-products line over resamples, each row drawn a Poisson(1) number of times.

    The draw of (row, resample) comes from a hash of both, so the result does not depend on the layout. A task draws the
    weights of its rows as a matrix and sends one row of sums per resample.
    """
    kept = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = kept.select(F.xxhash64(key).alias("h"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    sums = d.mapInArrow(_resample_sums(resamples), "i int, n double, sx double, sy double, xx double, yy double, xy double")
    d = sums.groupBy("i").agg(*[F.sum(n).alias(n) for n in ("n", "sx", "sy", "xx", "yy", "xy")])
    cov, vx, vy = F.expr("xy - sx*sy/n"), F.expr("xx - sx*sx/n"), F.expr("yy - sy*sy/n")
    d = d.withColumn("slope", F.signum(cov) * F.sqrt(F.try_divide(vy, vx))).withColumn("intercept", F.expr("sy/n - slope*sx/n"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return d.agg(
        q("slope", 0.025).alias("slope_low"),
        q("slope", 0.975).alias("slope_high"),
        q("intercept", 0.025).alias("intercept_low"),
        q("intercept", 0.975).alias("intercept_high"),
    ).withColumns({"proportional_bias": ~F.lit(1.0).between(F.col("slope_low"), F.col("slope_high")), "fixed_bias": ~F.lit(0.0).between(F.col("intercept_low"), F.col("intercept_high"))})


def headline(variants: DataFrame, key: str = "trial_id", value: str = "value", flagged: str | None = None) -> DataFrame:
    """Per trial, over the values of rule variants: count, least, greatest, upper middle, spread, and spread in percent.

    With `flagged`, a Boolean column, the same without the flagged variants in columns clean_*, and how many were left out.
    """

    def of(test: Column, prefix: str) -> dict[str, Column]:
        v = F.sort_array(F.collect_list(F.when(test, F.col(value))))
        n = F.size(v)
        middle, spread = F.get(v, F.floor(n / 2).cast("int")), F.when(n >= 2, F.get(v, n - 1) - F.get(v, F.lit(0)))
        return {
            f"{prefix}counted": n.cast("long"),
            f"{prefix}least": F.get(v, F.lit(0)),
            f"{prefix}greatest": F.get(v, n - 1),
            f"{prefix}middle": middle,
            f"{prefix}spread": spread,
            f"{prefix}percent": 100 * spread / F.abs(middle),
        }

    usable = F.col(value).isNotNull()
    cols = of(usable, "")
    if flagged:
        cols |= of(usable & ~F.col(flagged), "clean_") | {"excluded": F.count(F.when(usable & F.col(flagged), 1))}
    return variants.groupBy(key).agg(*[c.alias(n) for n, c in cols.items()])


def headline_in_rows(trials: DataFrame, variants: str, key: str = "trial_id", keep: list[str] = []) -> DataFrame:  # noqa: B006
    """headline() of variants that stand in an array of (.., value) in the trial's row: nothing is shuffled."""
    v = F.sort_array(F.transform(F.filter(variants, lambda x: x["value"].isNotNull()), lambda x: x["value"]))
    d = trials.select(key, *keep, v.alias("v"))
    n = F.size("v")
    middle, spread = F.get("v", F.floor(n / 2).cast("int")), F.when(n >= 2, F.get("v", n - 1) - F.get("v", F.lit(0)))
    return d.select(
        key, *keep, n.cast("long").alias("counted"), F.get("v", F.lit(0)).alias("least"), F.get("v", n - 1).alias("greatest"),
        middle.alias("middle"), spread.alias("spread"), (100 * spread / F.abs(middle)).alias("percent"),
    )


def exact_quantiles(d: DataFrame, group: str, value: str, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """Per group the quantiles of a value, interpolated between neighbours: group and a column for each share, by its name.

    Meant for few groups of any size. The rows are counted in even bins between a group's least and greatest value; only
    the distinct values of the bins that hold a wanted rank are then put in order, so that no task holds a group.
    Nulls are left out; a group without values is absent.
    """
    rows = written(d.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")), "values")
    ends = rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    at = F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    binned = rows.join(F.broadcast(ends), "g").select("g", "n", "v", F.coalesce(at, F.lit(0)).cast("int").alias("bin"))
    counts = binned.groupBy("g", "bin").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    below = F.sum("k").over(Window.partitionBy("g").orderBy("bin")) - F.col("k")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("r")) for name, p in shares.items()])
    ranks = counts.withColumn("below", below).withColumn("w", F.explode(wanted))
    ranks = ranks.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("w.r"), F.ceil("w.r")))))
    ranks = ranks.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("k"))).select("g", "bin", "below", "rank", "w")
    cells = ranks.select("g", "bin", "below").distinct()
    held = binned.join(F.broadcast(cells), ["g", "bin"]).groupBy("g", "bin", "v").agg(F.count("*").alias("k"), F.first("below").alias("below"))
    upto = F.col("below") + F.sum("k").over(Window.partitionBy("g", "bin").orderBy("v"))
    held = held.select("g", "bin", "v", "k", upto.alias("upto"))
    found = ranks.drop("below").join(held, ["g", "bin"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("k")))
    pairs = found.groupBy("g", "w").agg(F.min(F.struct("rank", "v")).alias("a"), F.max(F.struct("rank", "v")).alias("b"))
    value_at = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("w.r") - F.col("a.rank"))
    out = pairs.select("g", F.col("w.name").alias("name"), value_at.alias("q")).groupBy("g").pivot("name", list(shares)).agg(F.first("q"))
    return out.withColumnRenamed("g", group)


def cv_with_rules(df: DataFrame, subject: str, value: str, dispersion: str) -> DataFrame:
    """One row: cv_percent over the athletes with two values or more, and `rules`, what was counted and how (map of text)."""
    spread = {"sample": F.stddev_samp, "population": F.stddev_pop}[dispersion]
    d = df.select(F.col(subject).alias("who"), F.col(value).alias("x"))
    per = d.groupBy("who").agg(spread("x").alias("s"), F.avg("x").alias("m"), F.count("x").alias("k")).where("k >= 2 AND m <> 0")
    rules = {"construct": "coefficient_of_variation", "quantity": value, "dispersion": dispersion, "unit": subject}
    return per.agg(F.avg(100 * F.col("s") / F.col("m")).alias("cv_percent"), F.count("*").alias("subjects")).withColumn(
        "rules", F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    )


def cv_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Difference of two rows of cv_with_rules(): null with status unlike_conventions where their rules count unlike."""
    a, b = (d.select(F.col("cv_percent").alias(f"{n}_cv"), F.col("rules").alias(f"{n}_rules")) for n, d in (("first", first), ("second", second)))
    told = lambda n: F.col(f"{n}_rules")["dispersion"]
    alike = told("first").eqNullSafe(told("second")) & F.col("first_rules")["unit"].eqNullSafe(F.col("second_rules")["unit"])
    return a.join(b).select(
        told("first").alias("first_dispersion"),
        told("second").alias("second_dispersion"),
        F.when(alike, F.col("first_cv") - F.col("second_cv")).alias("difference"),
        F.when(alike, "ok").otherwise("unlike_conventions").alias("status"),
    )
