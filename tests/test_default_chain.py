"""The default chain in one pass: what the single searches find, few Python steps, small batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forcejobs.functions import traces as T
from forcejobs.jobs.registry import queries
from forcejobs.operators import landmarks as L
from forcejobs.operators import quantities as Q
from forcejobs.sources.trials import trials

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def one_by_one(d):
    """The chain by a search for each landmark."""
    d = L.weigh(d)
    d = d.withColumn("takeoff", L.takeoff_absolute(F.col("force"), F.col("epoch_end")))
    onset = L.onset_noise(F.col("force"), F.col("weight"), F.col("weight_sd"), 5.0, 3, 3, F.col("epoch_end"), F.col("takeoff"))
    d = d.withColumns({"onset": onset, "touchdown": L.touchdown(F.col("force"), F.col("takeoff"), 20.0, F.col("weight"))})
    return Q.with_motion(d)


def test_one_pass_finds_what_the_searches_find(spark, sf_dir):
    d = trials(spark, sf_dir).select("trial_id", "sample_rate_hz", "force")
    odd = [None, [], [700.0], [700.0] * 300, [float("nan")] * 300, [700.0] * 120 + [float("inf")] * 30 + [0.0] * 50, [None] + [700.0, 701.0] * 80 + [0.0] * 30 + [900.0] * 9]
    d = d.unionByName(spark.createDataFrame([(-1 - k, 100.0, x) for k, x in enumerate(odd)], d.schema))
    want = {r.trial_id: r for r in one_by_one(d).collect()}
    got = {r.trial_id: r for r in L.place(d, moving=True).collect()}
    assert got.keys() == want.keys() and len(got) == d.count()
    for k, r in want.items():
        for name in ("epoch_end", "weight", "weight_sd", "takeoff", "onset", "touchdown", "velocity", "displacement", "net_power"):
            np.testing.assert_equal(got[k][name], r[name], f"{k} {name}")


@pytest.mark.parametrize(("name", "steps"), [("results", 2), ("power_and_work", 2), ("push_off", 3), ("phase_boundaries", 4), ("compare_pairs", 5)])
def test_a_trace_is_sent_to_few_python_workers(spark, sf_dir, name, steps):
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= steps


def test_traces_travel_in_small_batches(spark, sf_dir):
    before = spark.conf.get(BOUND)
    try:
        spark.conf.set(BOUND, "64MB")
        trials(spark, sf_dir)
        assert int(spark.conf.get(BOUND).rstrip("b")) == T.BATCH_BYTES
        spark.conf.set(BOUND, "1000")
        trials(spark, sf_dir)
        assert spark.conf.get(BOUND) .rstrip("b") == "1000"  # a smaller bound of the session stays
    finally:
        spark.conf.set(BOUND, before)
