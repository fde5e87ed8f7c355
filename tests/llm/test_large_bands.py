"""A band that no cut makes smaller is compared whole."""

import numpy as np
import pytest

from forcejobs.llm import near_copies as N


@pytest.mark.parametrize("batch", [10_000, 300])
def test_no_text_of_a_large_band_is_left_out(spark, monkeypatch, batch):
    n, rng = 2600, np.random.default_rng(8)
    monkeypatch.setattr(N, "LEVELS", 0)  # the band is left over at once
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    minima = rng.integers(0, 1 << 30, (n, N.BANDS * N.ROWS))
    sets = [rng.integers(0, 1 << 60, 20) for _ in range(n)]
    order = rng.permutation(n)
    want = set()
    for a, b in zip(order[:120:2].tolist(), order[1:120:2].tolist()):  # pairs anywhere in the band's order
        minima[b], sets[b] = minima[a], np.append(sets[a], 7)
        want.add((min(a, b), max(a, b)))
    try:
        rest = spark.createDataFrame([(5, 0, i, len(sets[i]), minima[i].tolist(), i) for i in range(n)], "key long, band int, u long, n long, minima array<int>, root long")
        texts = spark.createDataFrame([(i, np.sort(x).tolist()) for i, x in enumerate(sets)], "u long, set array<long>")
        found = [(min(r.a, r.b), max(r.a, r.b)) for r in N._across_groups(rest.repartition(3), texts).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(set(found)) and set(found) == want


def test_two_rows_of_a_key_meet_once(spark):
    n = 3000
    rest = spark.createDataFrame([(1, i, i, n, [1]) for i in range(n)], "key long, u long, root long, rows long, minima array<int>")
    groups: dict = {}
    for r in N._blocks(rest).select("key", "u", "side").collect():
        groups.setdefault(r.key, []).append((r.u, r.side))
    met = np.zeros((n, n), int)
    for rows in groups.values():
        assert len(rows) < 1.3 * N.SKETCHED
        u, side = (np.array(x) for x in zip(*rows))
        met[np.ix_(u, u)] += (side[:, None] < 0) | (side[:, None] != side)
    assert (met[~np.eye(n, dtype=bool)] == 1).all()
