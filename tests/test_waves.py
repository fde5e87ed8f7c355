"""Numeric references for the waveform jobs: every path of a warp, steps in a trace, curve sets in plain numpy, ramps and ankles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forcejobs.functions import filters as X
from forcejobs.jobs.registry import queries
from forcejobs.operators import landmarks as L
from forcejobs.operators import quantities as Q
from forcejobs.operators import waveform as V
from forcejobs.sources.trials import trials


def every_path(n, m):
    """All monotone paths from (0, 0) to (n - 1, m - 1)."""
    if n == m == 1:
        return [[(0, 0)]]
    out = []
    for i, j in ((n - 1, m - 1), (n - 1, m), (n, m - 1)):
        if i and j:
            out += [[*p, (n - 1, m - 1)] for p in every_path(i, j)]
    return out


def backwards(path):
    """Steps of a path from its end: 0 diagonal, 1 up, 2 left."""
    return [{(1, 1): 0, (1, 0): 1, (0, 1): 2}[a - c, b - d] for (a, b), (c, d) in zip(path[::-1], path[-2::-1])]


@pytest.mark.parametrize("n, m, band", [(4, 4, 4), (3, 5, 9), (5, 3, 9), (1, 4, 4), (4, 4, 1)])
def test_a_warp_is_the_cheapest_of_all_paths_and_settles_ties(n, m, band):
    rng = np.random.default_rng(n * m)
    paths = [p for p in every_path(n, m) if all(abs(i - j) <= max(band, abs(n - m)) for i, j in p)]
    for _ in range(25):
        reference, rows = rng.integers(0, 3, n).astype(float), rng.integers(0, 3, (4, m)).astype(float)
        cost, found = X.warp_path(reference, rows, band)
        for y, c, pairs in zip(rows, cost, found):
            sums = [sum(abs(reference[i] - y[j]) for i, j in p) for p in paths]
            assert c == min(sums)
            # of the cheapest, the one whose steps from the end are least: diagonal, then up, then left
            best = min((p for p, s in zip(paths, sums) if s == c), key=backwards)
            assert [tuple(x) for x in pairs.tolist()] == best
            want = [np.mean([j for i, j in best if i == k]) for k in range(n)]
            assert np.allclose(X.carried(pairs, n), want)


def test_pairs_of_a_warp_are_rows(spark):
    d = spark.createDataFrame([(1, [0.0, 1.0, 1.0, 2.0]), (2, None), (3, []), (4, [2.0, 2.0, 2.0, 2.0])], "k int, y array<double>")
    rows = V.warped_pairs(d, "k", "y", [0.0, 1.0, 2.0], 3).collect()
    assert {r.k for r in rows} == {1, 4}
    own = sorted((r.step, r.reference_place, r.place, r.carried_to) for r in rows if r.k == 1)
    assert own == [(0, 0, 0, 0.0), (1, 1, 1, 1.5), (2, 1, 2, 1.5), (3, 2, 3, 3.0)]


def test_a_step_is_found_and_a_slope_or_noise_is_none():
    rng, i = np.random.default_rng(1), np.arange(200)
    noise = rng.normal(0, 1, (40, 200))
    assert (X.step_place(noise, 10, 12) == -1).all()
    assert (X.step_place(noise + i * 2.0, 10, 12) == -1).all()
    assert (X.step_place(noise + 200 * np.sin(i / 25), 10, 12) == -1).all()
    found = X.step_place(noise + 40.0 * (i >= 90), 10, 12)
    assert (np.abs(found - 90) <= 5).all() and (found >= 0).all()
    assert X.step_place(noise[:, :30], 10, 12).tolist() == [-1] * 40
    assert X.step_place(np.full((1, 100), 5.0), 10, 12).tolist() == [-1]


def test_a_step_inside_the_interval_gives_no_cutoff(spark, sf_dir):
    rows = queries()["quiet_cutoff"](spark, sf_dir).collect()
    dips = {r.trial_id for r in trials(spark, sf_dir).where("trial_id % 70 = 0").select("trial_id").collect()}
    stance = {r.trial_id: r for r in rows if r.part == "stance"}
    assert len(rows) == 2 * len(stance) and dips
    for i, r in stance.items():
        assert (r.cutoff_hz is None) == (i in dips) == (r.step_at is not None)
        assert i not in dips or 110 <= r.step_at <= 123
    assert all(r.cutoff_hz is None and r.step_at is not None for r in rows if r.part == "to_landing")


def test_functional_scores_are_projections_in_plain_numpy(spark, sf_dir):
    got = {r.vec_id: r.scores for r in queries()["functional_scores"](spark, sf_dir).collect()}
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    y = np.array([r.embedding for r in d], float)
    basis = X.spline_basis(64, 20)
    c = y @ np.linalg.solve(basis.T @ basis + 1e-2 * X.roughness(20), basis.T).T
    centred = c - c.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / (len(c) - 1))
    order = np.argsort(-values)
    k = int(np.searchsorted(np.cumsum(values[order]) / values.sum(), 0.9 - 1e-12)) + 1
    want = centred @ vectors[:, order[:k]]
    mine = np.array([got[r.vec_id] for r in d])
    assert mine.shape == want.shape
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-8)
    assert np.allclose(mine @ mine.T, want @ want.T, atol=1e-7)


def test_warped_curves_cost_what_a_plain_recurrence_finds(spark, sf_dir):
    placed = L.place(trials(spark, sf_dir)).where("onset < takeoff").collect()
    y = {r.trial_id: X.spline_resample(np.array(r.force[r.onset : r.takeoff]), 51) for r in placed}
    mean = np.mean(list(y.values()), axis=0)
    got = {r.trial_id: r for r in queries()["warped_curves"](spark, sf_dir).collect()}
    assert got.keys() == y.keys()
    for i in list(y)[:12]:
        cost = np.full((52, 52), np.inf)
        cost[0, 0] = 0
        for a in range(1, 52):
            for b in range(max(1, a - 10), min(51, a + 10) + 1):
                cost[a, b] = abs(mean[a - 1] - y[i][b - 1]) + min(cost[a - 1, b - 1], cost[a - 1, b], cost[a, b - 1])
        assert got[i].cost == pytest.approx(cost[51, 51], rel=1e-9)


def test_registered_curves_put_the_minimum_where_the_mean_one_is(spark, sf_dir):
    placed = L.place(trials(spark, sf_dir)).where("onset < takeoff").collect()
    y = {r.trial_id: np.array(r.force[r.onset : r.takeoff]) for r in placed}
    at = {i: int(x.argmin()) for i, x in y.items()}
    inside = {i: at[i] / (len(x) - 1) for i, x in y.items() if 0 < at[i] < len(x) - 1}
    share = np.mean(list(inside.values()))
    for r in queries()["registered_curves"](spark, sf_dir).collect():
        if r.trial_id not in inside:
            assert r.registered is None
            continue
        x = np.linspace(0, 1, len(y[r.trial_id]))
        want = np.interp(np.interp(x, [0, share, 1], [0, inside[r.trial_id], 1]), x, y[r.trial_id])
        assert np.allclose(r.registered, want, rtol=1e-9)


def test_ramp_meets_both_ends(spark):
    rng = np.random.default_rng(4)
    force = [*(600 + rng.normal(0, 1, 150)), *np.linspace(600, 300, 30), *np.linspace(300, 1500, 30), *np.zeros(40)]
    d = spark.createDataFrame([(1, 100.0, [float(x) for x in force]), (2, 100.0, [600.0] * 200)], "trial_id long, sample_rate_hz double, force array<double>")
    rows = {r.trial_id: r for r in Q.ramp_to_impulse(L.place(d), "rectangle").collect()}
    r = rows[1]
    f, w, a, b = np.array(r.force), r.weight, r.onset, r.takeoff
    acc = (f - w) / (w / L.GRAVITY)
    left = np.concatenate(([0], np.cumsum(acc[a:-1]) * 0.01))
    goal = np.sum((acc[a:b] + acc[a + 1 : b + 1]) / 2) * 0.01
    residual = goal - left[b - a]
    want = left + residual * np.clip(np.arange(len(left)) / (b - a), 0, 1)
    assert r.ramp_residual == pytest.approx(residual) and abs(residual) > 1e-3
    assert np.allclose(r.ramped[a:], want) and r.ramped[a] == 0 and r.ramped[b] == pytest.approx(goal)
    assert rows[2].ramped is None and rows[2].ramp_residual is None


def test_ankles_shift_a_flight_and_unsure_markers_do_not(spark):
    t = spark.createDataFrame([(i, s) for i, s in ((1, 1), (2, 1), (3, 1), (4, 2))], "trial_id long, subject long")
    foot = lambda i, event, drop: (i, event, 0.0, 0.4, 0.0, 0.0, 0.1, -drop)
    m = [foot(1, "takeoff", 0.1), foot(1, "landing", 0.0), foot(2, "takeoff", 0.1), foot(3, "takeoff", 0.1), foot(3, "landing", 0.0), foot(3, "landing", 0.0), foot(4, "takeoff", 0.1), foot(4, "landing", 0.0)]
    markers = spark.createDataFrame(m, "trial_id long, event string, knee_x double, knee_y double, ankle_x double, ankle_y double, toe_x double, toe_y double")
    who = spark.createDataFrame([(1, 1.8)], "subject long, stature double")
    got = {r.trial_id: r.ankle_shift for r in Q.ankle_shift(t, markers, who).collect()}
    length = 1.8 * np.hypot(Q.ANKLE_HEIGHT, Q.FOOT_LENGTH * Q.AHEAD_OF_ANKLE)
    lean = np.arctan2(Q.ANKLE_HEIGHT, Q.FOOT_LENGTH * Q.AHEAD_OF_ANKLE)
    assert got[1] == pytest.approx(length * (np.sin(np.pi / 4 + lean) - np.sin(lean)))
    assert got[2] is None and got[3] is None and got[4] is None
    h = spark.range(1).select(Q.height_with_shift(F.lit(0.5), F.lit(0.05)).alias("a"), Q.height_with_shift(F.lit(0.5), F.lit(0.0)).alias("b"), Q.height_with_shift(F.lit(0.0), F.lit(0.0)).alias("z")).first()
    flight = L.GRAVITY * 0.25
    assert h.a == pytest.approx(flight / 8 * (1 - 0.1 / flight) ** 2) and h.b == pytest.approx(flight / 8) and h.z is None
