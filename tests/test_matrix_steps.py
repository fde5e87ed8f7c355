"""Steps over whole batches of traces that were lambdas or loops for each sample or trace."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forcejobs.functions import filters as X
from forcejobs.operators import landmarks as L
from forcejobs.operators import quantities as Q
from forcejobs.sources import files


def test_rises_of_many_traces_are_those_of_each():
    t = np.arange(40) * 0.01
    rng = np.random.default_rng(3)
    y = np.array([5 + k + (3 + k) * (1 - np.exp(-t / (0.03 + 0.02 * k))) + rng.normal(0, 0.05, 40) for k in range(8)])
    y[3, 7] = np.nan
    found = np.column_stack(X.exponential_rises(y, 0.01))
    assert np.isnan(found[3]).all()
    one = np.array([X.exponential_rise(row, 0.01) for row in y])
    assert np.allclose(found, one, rtol=1e-6, equal_nan=True)
    assert abs(found[0, 2] - 0.03) < 0.01
    assert np.isnan(X.exponential_rises(y[:, :2], 0.01)).all()


def test_bucket_means_are_one_step_over_a_batch(spark):
    x = [float(i % 13) for i in range(97)]
    odd = [None, float("nan"), float("inf"), *x[3:]]
    d = spark.createDataFrame([(1, x), (2, odd), (3, x[:10]), (4, None), (5, x[:41])], "id int, x array<double>")
    out = d.select("id", files.decimate(F.col("x"), F.size("x"), 40).alias("m"))
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.m for r in out.collect()}
    edges = [b * 97 // 40 for b in range(41)]
    want = lambda v: [sum(v[a:b]) / (b - a) for a, b in zip(edges, edges[1:])]
    assert got[1] == want(x)
    assert got[2] == want([0.0, 0.0, 0.0, *x[3:]])
    assert got[3] == x[:10] and len(got[5]) == 40


def test_a_ramp_is_one_step_over_a_batch(spark):
    d = spark.createDataFrame([(1, 100.0, [600.0] * 100 + [500.0] * 20 + [900.0] * 20 + [0.0] * 30)], "trial_id long, sample_rate_hz double, force array<double>")
    d = d.withColumns({"weight": F.lit(600.0), "weight_sd": F.lit(1.0), "onset": F.lit(100), "takeoff": F.lit(140)})
    d = d.unionByName(d.withColumns({"trial_id": F.lit(2).cast("long"), "onset": F.lit(None).cast("int")}))
    out = Q.ramp_to_impulse(d, "rectangle")
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
    one, none = out.orderBy("trial_id").collect()
    assert none.ramped is None and none.ramp_residual is None
    a = (np.array(one.force) - 600.0) / (600.0 / L.GRAVITY)
    goal = 0.005 * (a[100:140] + a[101:141]).sum()
    assert one.ramped[100] == 0 and one.ramped[140] == pytest.approx(goal)
    assert one.ramp_residual == pytest.approx(goal - 0.01 * a[100:140].sum())


def test_the_grid_of_rules_is_whole(spark, sf_dir):
    from forcejobs.jobs.registry import queries

    rows = queries()["rule_grid"](spark, sf_dir).collect()
    assert sorted(r.variant for r in rows) == list(range(1296)) and len({r.label for r in rows}) == 1296
    assert not any(r.capped for r in rows) and any(r.label.endswith("onset.span=5") for r in rows)


def test_a_chain_among_all_is_the_chain_alone():
    from forcejobs.jobs.batch_queries import GRID
    from forcejobs.operators import chains

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(600, 5, (30, 120)), rng.normal(15, 9, (30, 130))], axis=1)
    x[:4, 110:113], x[4, 30], x[5, :120], x[6] = 2.0, np.nan, 700.0, 700.0
    variants, cut = chains.expand(GRID)
    steady = np.where(np.arange(30) % 7 == 3, np.nan, 40.0)
    values, codes = chains.Tree(x, 100.0, steady).heights([v.chain for v in variants])
    assert not cut and set(np.unique(codes)) >= {0, 1, 2, 3}
    for k in range(0, len(variants), 37):
        value, code = chains.Tree(x, 100.0, steady).height(variants[k].chain)
        assert np.array_equal(values[k], value, equal_nan=True) and np.array_equal(codes[k], code)


def test_the_steadiest_windows_of_a_batch_are_those_of_each_trace():
    from forcejobs.functions import scans

    rng = np.random.default_rng(4)
    x = rng.normal(600, 5, (300, 140)).round(1)
    x[1], x[2, 60:], x[3, 9], x[4, ::20] = 600.0, 0.0, np.nan, 0.0
    got = scans.steadiest(x, 50)
    for k, a in enumerate(x):
        bad = np.array([(a[i : i + 50] <= 0.025 * np.median(a)).any() for i in range(91)])
        assert (got["candidates"][k], got["rejected"][k]) == ((~bad).sum(), bad.sum())
        if bad.all():
            assert np.isnan(got["start"][k])
        elif k != 3:
            var = np.where(bad, np.inf, [a[i : i + 50].var() for i in range(91)])
            assert var[int(got["start"][k])] <= var.min() + 1e-8
    assert got["tied"][1] == 91 and got["tied_low"][1] == got["tied_high"][1] == 600.0
    assert np.isnan(scans.steadiest(x[:, :49], 50)["start"]).all()
