"""Undeclared exports, grids, provenance, quantiles, and the queries that have no SQL against brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from forcejobs.functions import filters as X
from forcejobs.functions import traces as T
from forcejobs.jobs import provenance
from forcejobs.jobs.registry import oracle_sql, queries
from forcejobs.operators import cohort as C
from forcejobs.operators import sweeps
from forcejobs.sources import files
from forcejobs.sources.trials import RATE_HZ, trials


def test_exports_tell_their_format():
    body = "\n".join(f"{i / 100};{700 + i % 7};1.5" for i in range(50))
    got = files.read_export(f"a\nb;c\nt;Fz;z\n{body}\n7\n")
    assert (got["delimiter"], got["skipped_lines"], got["header_detected"], got["row_count"], got["ragged_rows"]) == ("semicolon", 3, True, 50, 1)
    assert (got["time_column"], got["force_column"], got["rate_hz"], got["rate_source"]) == (0, 1, 100.0, "even")
    rounded = files.read_export("\n".join(f"{i / 1200:.3f} {700 + i % 7}" for i in range(200)))
    assert rounded["rate_source"] == "reconstructed" and rounded["rate_hz"] == pytest.approx(1200, rel=2e-3)
    samples = files.read_export("\n".join(f"{i},{700 + i % 7}" for i in range(20)))
    assert (samples["rate_source"], samples["rate_hz"], samples["force_column"]) == ("not_seconds", None, 1)
    assert files.read_export("no numbers\nat all") == {"problem": "no_numeric_row"} == files.read_export("")
    assert files.read_export("1,2\n") == {"problem": "too_few_rows"}


def test_a_clock_is_a_line_within_the_last_digit_of_every_stamp():
    i = np.arange(300)
    kind = lambda x, digits: (files.clock(np.asarray(x, float), digits) or (None,))[0]
    assert kind(i / 250, 3) == "even"
    assert kind(5.5 + i * 0.004, None) == "even"
    for hz, digits in ((128, 4), (1200, 3), (960, 2)):
        found = files.clock(np.round(i / hz, digits), digits)
        assert found[0] == "reconstructed" and abs(found[1] / hz - 1) < 5 * 10.0**-digits / (300 / hz)
    late = i / 250 + 0.003 * (i >= 150)
    assert kind(late, 3) == "uneven" and kind(late, 2) == "reconstructed"
    assert kind(i, 0) == "not_seconds" and kind(i * 0.004 * 1e5, None) == "not_seconds"
    assert kind(-i / 250, 3) is None and kind([1.0] * 9, 3) is None and kind([0.0, np.nan], 3) is None and kind([1.0], 3) is None
    assert kind(700 + np.random.default_rng(1).normal(0, 5, 300), 3) is None
    assert kind([0.0, 0.001, 0.001], 3) == "uneven"  # three stamps that rounding alone could make


def test_grids_count_with_the_first_axis_fastest():
    variants, capped = sweeps.grid({"a": [1, 2], "b": "xy"})
    assert [tuple(v.values()) for v in variants] == [(1, "x"), (2, "x"), (1, "y"), (2, "y")] and not capped
    cut, capped = sweeps.grid({"a": [1, 2], "b": "xy"}, 3)
    assert cut == variants[:3] and capped
    assert sweeps.label(variants[1]) == "a=2,b=x"


def test_identity_of_a_chain_hangs_on_its_content_alone():
    turned = {s: (r, dict(reversed(p.items()))) for s, (r, p) in provenance.DEFAULT.items()}
    assert provenance.identity(turned) == provenance.identity(provenance.DEFAULT)
    other = provenance.DEFAULT | {"onset": ("noise_relative", {"k": "3.0"})}
    assert provenance.identity(other) != provenance.identity(provenance.DEFAULT)


def test_landing_shape_passes_over_an_unloading_without_a_landing(spark):
    rise = np.concatenate((np.full(150, 700.0), np.full(10, 5.0), np.linspace(20, 1400, 80), np.linspace(1400, 700, 10)))
    fly = np.concatenate((np.zeros(45), [900.0, 2300.0, 2000.0, 1500.0], np.linspace(1400, 700, 40), np.full(30, 700.0), np.zeros(60)))
    d = spark.createDataFrame([(np.concatenate((rise, fly)).tolist(), 700.0), ([700.0] * 100, 700.0), ([0.0] * 9, None)], "f array<double>, w double")
    got = [tuple(r.s) for r in d.select(T.landing_shape(F.col("f"), F.col("w"), F.lit(100.0)).alias("s")).collect()]
    assert got == [(250, 1), (None, 0), (None, None)]


def test_stems_and_missing_samples(spark):
    d = spark.createDataFrame([("AT1_2..force.txt",), ("x.csv",)], "name string").select(files.stem(F.col("name"), ".force.txt").alias("s"))
    assert [r.s for r in d.collect()] == ["AT1_2", None]
    d = spark.createDataFrame([([1.0, 0.0, float("nan")],), ([0.0, 0.0],), ([5.0],), ([],)], "y array<double>")
    got = [tuple(r)[1:] for r in files.missing_report(d, "y", 0.0).collect()]
    assert got == [(1, 0, 1, 1, 2), (0, 2, 0, 0, 1), (0, 0, 1, -1, -1), (0, 0, 0, -1, -1)]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    values = {"a": np.concatenate((rng.normal(size=501), np.full(300, 0.25))), "b": rng.integers(0, 3, 40).astype(float), "c": np.array([7.0])}
    d = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v] + [("a", None), ("d", None)], "g string, v double")
    got = {r.g: (r.m, r.p) for r in C.exact_quantiles(d, "g", "v", {"m": 0.5, "p": 0.95}, bins=7).collect()}
    assert set(got) == set(values)
    for g, v in values.items():
        assert got[g] == pytest.approx((np.median(v), np.quantile(v, 0.95)), abs=1e-12)


def test_empty_and_null_traces_give_nulls(spark):
    d = spark.createDataFrame([([],), (None,), ([1.0, float("nan"), 3.0],)], "y array<double>")
    y = F.col("y")
    got = d.select(
        T.find(y, ">", 2.0).alias("found"), T.argmax(y, 0, F.size(y)).alias("top"), T.level(y, 0, 3)["level"].alias("level"),
        T.area(y, 0.0, 0, 2, 1.0).alias("area"), T.moving_average(y, 2).alias("smooth"), T.runs(y, T.Low(2.0)).alias("runs"),
    ).collect()
    assert [r.found for r in got] == [None, None, 2] and [r.top for r in got] == [None, None, 2]
    assert [r.level for r in got] == [None] * 3 and [r.area for r in got] == [None] * 3
    assert got[1].runs is None and got[0].runs == [] and [tuple(x) for x in got[2].runs] == [(0, 0)]


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - {"sign_flip_threshold", "agreement_bootstrap"}))
def test_queries_without_sql_answer_finite_rows(spark, sf_dir, name):
    rows = queries()[name](spark, sf_dir).collect()
    assert rows
    for r in rows[:200]:
        for v in r:
            for x in v if isinstance(v, list) else [v]:
                assert x is None or not isinstance(x, float) or np.isfinite(x), r


@pytest.fixture(scope="module")
def traces(spark, sf_dir):
    return {r.trial_id: np.array(r.force) for r in trials(spark, sf_dir).where("trial_id % 40 = 1").collect()}


def some(spark, sf_dir, name, traces):
    found = {r.trial_id: r for r in queries()[name](spark, sf_dir).where(F.col("trial_id").isin(list(traces))).collect()}
    return [(found[k], y) for k, y in traces.items() if k in found]


def test_smoothing_against_fits_of_every_window(spark, sf_dir, traces):
    t = np.arange(-4, 5)
    for r, y in some(spark, sf_dir, "polynomial_smoothing", traces):
        smooth = [np.polyval(np.polyfit(t, y[i - 4 : i + 5], 3), 0) for i in range(4, len(y) - 4)]
        ends = [np.polyval(np.polyfit(t, y[:9], 3), k) for k in range(-4, 0)] + [np.polyval(np.polyfit(t, y[-9:], 3), k) for k in range(1, 5)]
        assert r.peak == pytest.approx(max(smooth + ends), rel=1e-9)


def test_spectrum_against_a_plain_transform(spark, sf_dir, traces):
    for r, y in some(spark, sf_dir, "spectrum_cutoff", traces):
        x = np.concatenate((y - y.mean(), np.zeros(512 - len(y) if len(y) > 256 else 256 - len(y))))
        n = len(x)
        power = np.abs(np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n) @ x) ** 2
        power[1:-1] *= 2
        at = int((np.cumsum(power) >= 0.99 * power.sum() * (1 - 1e-12)).argmax())
        assert r.cutoff_hz == pytest.approx(at * RATE_HZ / n)


def test_cutoffs_against_loops(spark, sf_dir, traces):
    candidates = np.arange(4.0, 41.0, 2.0)
    for r, y in some(spark, sf_dir, "cutoff_by_whiteness", traces):
        left = [y - X.low_pass(y[None], f, RATE_HZ)[0] for f in candidates]
        dw = [sum((e[i] - e[i - 1]) ** 2 for i in range(1, len(e))) / sum(x * x for x in e) for e in left]
        assert r.cutoff_hz == candidates[int(np.argmin(np.abs(np.array(dw) - 2)))]
    for r, y in some(spark, sf_dir, "cutoff_by_residuals", traces):
        rms = np.array([np.sqrt(np.mean((y - X.low_pass(y[None], f, RATE_HZ)[0]) ** 2)) for f in candidates])
        intercept = np.polyfit(candidates[-6:], rms[-6:], 1)[1]
        assert r.cutoff_hz == candidates[int(np.argmin(np.abs(rms - intercept)))]


def test_exponential_against_a_dense_grid(spark, sf_dir):
    rng = np.random.default_rng(2)
    for _ in range(5):
        t = np.arange(40) * 0.01
        y = 600 + 900 * (1 - np.exp(-t / rng.uniform(0.03, 0.2))) + rng.normal(size=40)
        base, size, tau, residual = X.exponential_rise(y, 0.01)
        error = lambda x: np.linalg.lstsq(np.column_stack((np.ones(40), 1 - np.exp(-t / x))), y, rcond=None)[1][0]  # noqa: E731,B023
        best = min(np.exp(np.linspace(np.log(0.01), np.log(0.39), 2000)), key=error)
        assert tau == pytest.approx(best, rel=3e-3)
        assert residual == pytest.approx(100 * np.mean(np.abs(base + size * (1 - np.exp(-t / tau)) - y) / y))


def test_scores_against_all_curves_at_once(spark, sf_dir):
    curves = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    x = np.array([curves[k] for k in sorted(curves)])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    share = np.cumsum(values[::-1]) / values.sum()
    want = (x - x.mean(0)) @ vectors[:, ::-1][:, : int(np.searchsorted(share, 0.9) + 1)]
    got = {r.vec_id: np.array(r.scores) for r in queries()["curve_scores"](spark, sf_dir).collect()}
    assert np.abs(np.array([got[k] for k in sorted(got)])) == pytest.approx(np.abs(want), abs=1e-6)


def test_penalties_have_the_least_cross_validation_error(spark, sf_dir):
    found = {r.vec_id: r.penalty for r in queries()["smoothing_penalties"](spark, sf_dir).collect()}
    curves = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(8).collect()}
    for k, y in curves.items():
        def error(p):
            hat = X.smoothing_matrix(64, 20, p)
            return ((y - hat @ y) ** 2).mean() / (1 - np.trace(hat) / 64) ** 2  # noqa: B023

        assert error(found[k]) <= min(error(10.0**e) for e in range(-10, 11)) + 1e-12


def test_gain_of_the_zero_lag_filter_is_half_power_at_its_cutoff(spark, sf_dir):
    rows = queries()["filter_gain"](spark, sf_dir).collect()
    assert {r.hz for r in rows} == {float(f) for f in range(2, 21, 2)}
    assert all(r.gain == pytest.approx(0.5**0.5, rel=0.05) for r in rows if r.hz == 10.0)
    assert collections.Counter(r.trials for r in rows)
