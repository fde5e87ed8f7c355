"""Quantities, variants and draws that are found in the pass that places the landmarks, or many at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forcejobs.jobs import cohort_queries as J
from forcejobs.jobs.trial_queries import results_frame
from forcejobs.operators import cohort as C
from forcejobs.operators import quantities as Q
from forcejobs.jobs.trial_queries import placed


def steps(d) -> int:
    """Python steps of a plan that follow the making of the traces."""
    return d._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


@pytest.mark.parametrize("make", [J.ranked, lambda s, d: results_frame(s, d).where("height_takeoff IS NOT NULL").select("trial_id", "height_flight")])
def test_ranked_trials_take_one_step(spark, sf_dir, make):
    assert steps(make(spark, sf_dir)) == 1


def test_impulse_and_peak_of_the_chain_are_those_of_the_single_steps(spark, sf_dir):
    one = results_frame(spark, sf_dir).select("trial_id", "net_impulse", "peak")
    peak = F.array_max(F.slice("force", 1, F.col("takeoff"))).alias("top")
    many = Q.default_quantities(placed(spark, sf_dir)).select("trial_id", F.col("net_impulse").alias("other"), peak)
    rows = one.join(many, "trial_id").collect()
    assert len(rows) > 1000 and any(r.net_impulse is None for r in rows)
    assert all(r.net_impulse == r.other and r.peak == r.top for r in rows)


def test_variants_take_one_step_and_only_those_asked_for(spark, sf_dir):
    assert steps(J.paired_rules(spark, sf_dir)) == 2
    all_, two = J.variants_in_rows(spark, sf_dir), J.variants_in_rows(spark, sf_dir, only=[(5, 3), (8, 0)])
    found = {r.trial_id: {x.rule: x.value for x in r.v} for r in all_.collect()}
    for r in two.collect():
        assert [x.rule for x in r.v] == ["k5_back3", "k8_back0"]
        assert all(found[r.trial_id][x.rule] == x.value for x in r.v)


def test_drawn_weights_are_those_of_the_whole_draw():
    rng = np.random.default_rng(5)
    edges, table = C.POISSON
    near = np.concatenate([(edges[:6] * 2.0**53).astype(np.uint64) + np.uint64(k) for k in range(3)]) << np.uint64(11)
    u = np.concatenate([rng.integers(0, 2**64, 50_000, dtype=np.uint64), near, [np.uint64(0), np.uint64(2**64 - 1)]]).reshape(-1, 2)
    assert (C.poisson_weights(u) == np.searchsorted(edges, (u >> np.uint64(11)) * 2.0**-53, side="right")).all()
    assert (table >= 0).mean() > 0.99


def test_only_a_column_that_may_be_a_clock_is_read_for_its_digits(monkeypatch):
    from forcejobs.sources import files

    seen = []
    real = files._digits
    monkeypatch.setattr(files, "_digits", lambda texts: (seen.append(texts[0]), real(texts))[1])
    body = "\n".join(f"{i / 100:.2f} ,{520 + i * 37 % 91}.25, 1.5,{'x' if i == 7 else i}" for i in range(90))
    told = files.read_export(f"plate\ntime,Fz,aux,n\n{body}\n7\n")
    assert seen == ["0.00 "] or seen[0] == "0.00 " and "520.25" not in seen
    assert (told["delimiter"], told["skipped_lines"], told["header_detected"], told["row_count"], told["ragged_rows"]) == ("comma", 2, True, 90, 1)
    assert (told["time_column"], told["force_column"], told["rate_hz"], told["rate_source"]) == (0, 1, 100.0, "even")
