"""Helpers against closed forms, and rules on traces with missing samples and flat bands."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from forcejobs.functions import arrays as A
from forcejobs.functions import filters as X
from forcejobs.functions import scans
from forcejobs.operators import cohort as C
from forcejobs.operators import landmarks as L
from forcejobs.operators import phases as P
from forcejobs.operators import waveform as V
from forcejobs.sources import files


def one(spark, column, **arrays):
    d = spark.createDataFrame([tuple(arrays.values())], list(arrays))
    return d.select(column.alias("x")).first()[0]


def test_running_integrals_of_a_line_and_a_parabola():
    t = np.arange(11) * 0.1
    assert scans.running_integral(t, 0.1, "trapezoid")[-1] == pytest.approx(0.5)
    assert scans.running_integral(t, 0.1, "rectangle")[-1] == pytest.approx(0.45)
    cubic = scans.running_integral(t**3, 0.1, "simpson")
    assert cubic[::2] == pytest.approx(t[::2] ** 4 / 4)
    assert cubic[1] == pytest.approx(0.05 * (t[0] ** 3 + t[1] ** 3))
    assert scans.running_integral(np.array([1.0]), 0.1, "simpson").tolist() == [0.0]


def test_durations_round_half_away_from_zero():
    assert [L.samples_for(x, 100) for x in (0.005, 0.015, 0.025, 0.0, -1.0)] == [1, 2, 3, 0, 0]
    assert (L.samples_for(0.019, 100, "truncate"), L.samples_for(0.011, 100, "ceiling")) == (1, 2)


def test_extrema_take_the_first_on_ties(spark):
    y = [3.0, 1.0, 1.0, 5.0, 5.0]
    assert one(spark, A.argmin(F.col("y"), 0, 5), y=y) == 1
    assert one(spark, A.argmax(F.col("y"), 0, 5), y=y) == 3
    assert one(spark, A.argmax(F.col("y"), 2, 2), y=y) is None


def test_runs_of_low_force(spark):
    got = one(spark, A.runs(F.col("y"), L.low(20.0)), y=[0.0, 0.0, 30.0, 1.0, 40.0, 5.0])
    assert [(r["start"], r["end"]) for r in got] == [(0, 1), (3, 3), (5, 5)]
    best = one(spark, L.takeoff_longest_run(A.runs(F.col("y"), L.low(20.0)), 2), y=[0.0, 0.0, 30.0, 1.0, 40.0, 5.0])
    assert (best["takeoff"], best["end"], best["qualifying"], best["is_first"]) == (0, 1, 1, True)
    assert one(spark, L.takeoff_longest_run(A.runs(F.col("y"), L.low(20.0)), 3), y=[0.0, 0.0, 30.0]) is None


def trial(spark, force):
    return spark.createDataFrame([(1, 1, 1, 100.0, force)], "trial_id long, subject long, occasion int, sample_rate_hz double, force array<double>")


def test_a_flat_band_or_a_missing_sample_declines(spark):
    flat = [700.0] * 150 + [500.0] * 20 + [0.0] * 40 + [900.0] * 20
    row = L.place(trial(spark, flat)).first()
    assert (row.weight, row.weight_sd, row.onset, row.takeoff, row.touchdown) == (700.0, 0.0, None, 170, 210)
    row = L.place(trial(spark, [float("nan"), *flat[1:]])).first()
    assert row.weight is None and row.onset is None
    row = L.place(trial(spark, [700.0] * 20)).first()
    assert (row.weight, row.takeoff, row.touchdown) == (None, None, None)


def test_crossings_decline_without_a_true_crossing(spark):
    y = [5.0, 1.0, 2.0, 6.0, 7.0]
    assert one(spark, P.rising_crossing(F.col("y"), F.lit(3.0), F.lit(0), F.lit(4)), y=y) == 2
    assert one(spark, P.rising_crossing(F.col("y"), F.lit(9.0), F.lit(0), F.lit(4)), y=y) is None
    assert one(spark, P.falling_crossing(F.col("y"), F.lit(1.5), F.lit(0), F.lit(3)), y=y) == 1
    assert one(spark, P.velocity_crossing(F.col("y"), F.lit(0), F.lit(5), 3.0), y=y) == 3


def test_dropoff_and_stability(spark):
    y = [1.0, 10.0, 9.8, 11.0, 10.6, 10.0, 12.0]
    assert one(spark, P.dropoff(F.col("y"), F.lit(1)), y=y) == 5
    assert one(spark, P.dropoff(F.col("y"), F.lit(6)), y=y) is None
    assert one(spark, P.stabilised(F.col("y"), F.lit(10.0), F.lit(0), 2), y=y) == 2


def test_butterworth_gain_is_half_power_at_the_cutoff():
    t = np.arange(4000) / 1000
    for dual in (False, True):
        y = X.low_pass(np.sin(2 * np.pi * 20 * t)[None], 20.0, 1000.0, 2, dual)[0][1000:3000]
        assert np.sqrt(2 * (y**2).mean()) == pytest.approx(math.sqrt(0.5), rel=2e-3)
    assert X.low_pass(np.full((1, 50), 3.0), 10.0, 100.0)[0] == pytest.approx(np.full(50, 3.0))


def test_smoothing_keeps_polynomials_and_spline_keeps_cubics():
    x = np.linspace(-1, 1, 41)
    assert X.polynomial_smooth((x**3)[None], 9, 3)[0] == pytest.approx(x**3)
    assert X.spline_resample(x**3, 101) == pytest.approx(np.linspace(-1, 1, 101) ** 3)
    assert X.smoothing_matrix(41, 12, 0.0) @ x**3 == pytest.approx(x**3, abs=1e-9)
    assert X.smoothing_matrix(41, 12, 10.0) @ np.ones(41) == pytest.approx(np.ones(41))


def test_spectrum_warping_and_exponential():
    t = np.arange(256) / 256
    assert X.share_cutoff(np.sin(2 * np.pi * 16 * t)[None], 256.0)[0] == pytest.approx(16.0)
    cost, place = X.warp_to(np.array([0.0, 1, 2, 1, 0]), np.array([0.0, 0, 1, 2, 1, 0]), 3)
    assert cost == 0.0 and place[2] == 3
    s = np.arange(60) * 0.01
    base, size, tau, residual = X.exponential_rise(5 + 3 * (1 - np.exp(-s / 0.1)), 0.01)
    assert (base, size, tau) == pytest.approx((5, 3, 0.1), rel=1e-4) and residual < 1e-3
    assert X.durbin_watson(np.array([[1.0, -1, 1, -1], [0, 0, 0, 0]])).tolist() == [3.0, 2.0]


def test_components_and_varimax_recover_axes(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 2)) * [3, 1] @ np.array([[1, 1, 0, 0], [0, 0, 1, -1.0]])
    d = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, y array<double>")
    n, mean, cov = V.covariance(d, "y")
    assert n == 400 and mean == pytest.approx(x.mean(0)) and cov == pytest.approx(np.cov(x.T))
    values, vectors = V.components(cov, 0.99)
    turned = np.abs(X.varimax(vectors * np.sqrt(values)))
    assert ((turned > 0.05 * turned.max()).sum(1) == 1).all()
    assert V.random_field_threshold(10.0, 101, 30) > V.random_field_threshold(50.0, 101, 30) > 2


def test_registration_keeps_a_curve_without_a_landmark(spark):
    y = np.abs(np.linspace(0, 1, 21) - 0.25).tolist()
    d = spark.createDataFrame([(1, y, 5), (2, y[::-1], 15), (3, y, None)], "k int, y array<double>, at int")
    got = {r.k: r.registered for r in V.register(d, "k", "y", "at").collect()}
    assert np.argmin(got[1]) == np.argmin(got[2]) == 10 and got[3] is None


def test_reductions_say_why_they_decline(spark):
    rows = [("a", 1, 9.0, 1.0), ("a", 2, 8.0, 3.0), ("a", 3, 8.0, 5.0), ("b", 4, 1.0, 2.0), ("c", 5, None, 2.0), ("c", 6, 3.0, 4.0), ("d", 7, 3.0, None), ("d", 8, 2.0, 1.0)]
    d = spark.createDataFrame(rows, "g string, trial_id long, r double, v double")
    got = {r.g: (r.status, r.value) for r in C.aggregate_trials(d, ["g"], "r", "v", "mean_of_best_two").collect()}
    assert got == {"a": ("tied_at_boundary", None), "b": ("too_few_trials", None), "c": ("ranking_value_absent", None), "d": ("too_few_usable", None)}
    best = {r.g: (r.status, r.value) for r in C.aggregate_trials(d, ["g"], "r", "v", "best_of_n_by_peak_force").collect()}
    assert best["a"] == ("ok", 1.0) and best["d"] == ("value_absent", None)


def test_templates(spark):
    d = spark.createDataFrame([("AT01_2.txt",), ("AT_2.txt",), ("x.csv",)], "name string")
    got = [tuple(r) for r in files.identify(d, "name", "AT{subject}_{trial}", ".txt").select("subject", "trial", "status").collect()]
    assert got == [("01", "2", "ok"), ("", "", "unidentified"), ("", "", "without_suffix")]
    with pytest.raises(ValueError):
        files.template_pattern("AT{a}{b}", ".txt")


def test_penalty_follows_the_noise():
    x = np.linspace(0, 1, 64)
    rough = np.sin(12 * x) + 0.3 * np.random.default_rng(0).standard_normal(64)
    smooth, noisy = X.best_penalty(np.stack([np.sin(12 * x), rough]), 20)
    assert noisy > smooth > 0
