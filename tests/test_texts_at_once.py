"""Texts of files that are written and read a batch at a time, and filters that take all cutoffs at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forcejobs.functions import filters as X
from forcejobs.jobs.registry import queries
from forcejobs.sources import files

#: Ways to write a number, and what only looks like one.
ODD = ["", "  ", "\t", "\r", "1.5", "+1.5", " 2 ", "3\r", "1d", "1F", "0x1p3", "0x1.8p1f", "NaN", "nan", "-nan", "-NaN", "Infinity", "-inf", "+INF", "1e5", "1e999", "-1e999",
       "1e-999", ".5", "5.", "1_0", "１", "--1", "1e", "\x0b7", "0x10", "1e5D", "+-1", "nan(1)", "1.2.3"]


def test_lines_are_read_as_a_cast_reads_them(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, text string")
    want = {r.i: (r.blank, r.v) for r in d.select("i", (F.trim("text") == "").alias("blank"), F.col("text").try_cast("double").alias("v")).collect()}
    for r in files.read_column(d, "text", "", 0).collect():
        blank, v = want[r.i]
        assert (r.blank_lines, r.bad_lines) == (int(blank), [] if blank or v is not None else [1]), ODD[r.i]
        assert r["values"] == ([] if blank or v is None else [pytest.approx(v, nan_ok=True)]), ODD[r.i]


def test_reading_takes_a_batch_at_once(spark, sf_dir):
    texts = [(1, "0\t1.5\n1\t2.5\n\n2\tx\n3\n4\t-1e2\n"), (2, ""), (3, None), (4, "\n".join(f"{i}\t{i}" for i in range(3000)) + "\nx\tx")]
    out = files.read_column(spark.createDataFrame(texts, "i int, text string"), "text", "\t", 1)
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: r for r in out.collect()}
    assert (got[1]["values"], got[1].total, got[1].blank_lines, got[1].bad_lines) == ([1.5, 2.5, -100.0], -96.0, 2, [4, 5])
    assert (got[2]["values"], got[2].blank_lines, got[2].bad_lines) == ([], 1, [])
    assert got[3]["values"] is None and got[3].total is None and got[3].bad_lines is None
    assert got[4]["values"] == [float(i) for i in range(3000)] and got[4].bad_lines == [3001]
    for name in ("read_delimited", "read_modes"):
        assert "lambdafunction" not in queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_text_of_a_trace(spark):
    d = spark.createDataFrame([(1, [0.1, 612.0, 1e300]), (2, []), (3, None)], "i int, x array<double>")
    got = {r.i: r.t for r in d.select("i", files.text_lines(F.col("x"), "<{i}> {x};", "END").alias("t")).collect()}
    assert [float(x.split()[1][:-1]) for x in got[1].removesuffix("END").split("\n")] == [0.1, 612.0, 1e300]
    assert got[1].startswith("<0> 0.1;\n<1> ") and got[2] == "END" and got[3] is None


@pytest.mark.parametrize("order", [2, 3])
def test_all_cutoffs_at_once_are_each_cutoff_to_the_last_bit(order):
    cutoffs = np.arange(4.0, 41.0, 2.0)
    for shape in ((300, 60), (3, 2), (2, 1)):
        x = np.random.default_rng(1).normal(700, 90, shape)
        x[0] = 640.0
        want = np.stack([X.low_pass(x, f, 100.0, order) for f in cutoffs], axis=1)
        assert np.array_equal(X.low_passes(x, cutoffs, 100.0, order), want)


def test_a_grid_is_added_up_in_its_tasks(spark, sf_dir):
    from forcejobs.jobs.batch_queries import GRID
    from forcejobs.operators import chains
    from forcejobs.sources.trials import trials

    assert "Generate" not in queries()["rule_grid"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    variants, _ = chains.expand(GRID, 40)
    d = trials(spark, sf_dir).limit(300)
    d = d.unionByName(d.limit(2).withColumns({"trial_id": F.col("trial_id") + 10**7, "force": F.slice("force", 1, 30)}))
    short = d.where("trial_id > 10000000")
    for some in (d, short, d.where("false")):
        want = {r.variant: r.asDict() for r in chains.by_variant(chains.heights(some, variants), variants).collect()}
        got = {r.variant: r.asDict() for r in chains.tally(some, variants).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == {x: v if not isinstance(v, float) else pytest.approx(v, rel=1e-12) for x, v in want[k].items()}
    assert all(r.mean is None and r.no_weight == 2 for r in chains.tally(short, variants).collect())
