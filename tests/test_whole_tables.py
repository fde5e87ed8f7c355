"""Queries over whole tables: no trial, sample or resample is left out."""

import duckdb
import numpy as np
import pytest

from forcejobs.jobs import trial_queries
from forcejobs.jobs.registry import oracle_sql, queries
from forcejobs.operators import cohort as C
from forcejobs.operators import waveform as V
from forcejobs.sources.trials import trials


@pytest.fixture(scope="module")
def whole(sf_dir):
    """Runs a query's SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf_dir}/orders.parquet'")
    return lambda name: con.execute(oracle_sql()[name]).df()


def test_every_order_is_a_trial(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = trials(spark, sf_dir)
    assert found.count() == orders.count()
    assert found.join(orders, found.trial_id == orders.o_orderkey, "left_anti").count() == 0


@pytest.mark.parametrize("name", ["results", "weighing_lowest_variance", "takeoff_rules", "force_and_rates"])
def test_trial_queries_on_every_order(spark, sf_dir, whole, name):
    want = whole(name)
    got = queries()[name](spark, sf_dir).toPandas()[list(want.columns)]
    assert len(got) == len(want)
    key = ["trial_id"]
    got, want = got.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True)
    for c in want.columns:
        a, b = got[c], want[c]
        assert (a.isna() == b.isna()).all(), c
        held = ~a.isna()
        if a.dtype.kind == "f" or b.dtype.kind == "f":
            assert ((a[held].astype(float) - b[held].astype(float)).abs() <= 2e-5).all(), c
        else:
            assert (a[held].astype(str) == b[held].astype(str)).all(), c


def test_moving_average_returns_every_sample(spark, sf_dir):
    d = trials(spark, sf_dir)
    assert queries()["moving_average"](spark, sf_dir).count() == d.selectExpr("sum(size(force))").first()[0]


def test_residual_statistics_answer_flat_trials(spark, sf_dir):
    got = queries()["residual_statistics"](spark, sf_dir).persist()
    assert got.count() == trials(spark, sf_dir).count()
    flat = got.where("trial_id % 190 = 0").collect()
    assert flat and all((r.rms, r.durbin_watson, r.slope) == (0.0, None, 0.0) for r in flat)


def test_label_shuffles_find_a_difference_and_none_where_there_is_none(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(40, 8))
    y[:20, 2:4] += 3.0
    d = spark.createDataFrame([(i, int(i >= 20), x.tolist()) for i, x in enumerate(y)], "k long, g int, y array<double>")
    maxima = V.label_shuffle_maxima(d, "k", "g", "y", 0, 1, 200)
    found = sorted(r.greatest for r in maxima.collect())
    assert len(found) == 200 and len(set(found)) > 190
    threshold = V.permutation_threshold(maxima)
    assert threshold == found[189]
    assert [(r.start, r.stop) for r in V.clusters(V.two_sample_t(d, "g", "y", 0, 1), threshold).collect()] == [(2, 3)]


def test_bootstrap_draws_as_many_resamples_as_the_reference(spark, sf_dir, monkeypatch):
    asked = []
    monkeypatch.setattr(C, "bootstrap_products_line", lambda *a: asked.append(a[-1]))
    queries()["agreement_bootstrap"](spark, sf_dir)
    assert asked == [5000]


def test_an_excursion_that_changes_sides_is_an_onset(spark, monkeypatch):
    force = [700.0 + (-1.0) ** i for i in range(150)] + [600.0, 800.0, 600.0] + [700.0] * 47
    d = spark.createDataFrame([(1, force, 700.0, 1.0, 100, 200)], "trial_id long, force array<double>, weight double, weight_sd double, epoch_end int, takeoff int")
    monkeypatch.setattr(trial_queries, "placed", lambda *a: d)
    assert trial_queries.onset_rules(spark, "").first().two_sided_run == 147
