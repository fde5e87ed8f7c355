"""Near copies: texts are picked by bitmaps and stay where they are; components stop at stars."""

from pyspark.sql import functions as F

from forcejobs.llm import common
from forcejobs.llm.near_copies import one_of_near_copies, with_rows


def test_rows_are_picked_without_a_shuffle_of_the_table(spark):
    table = spark.range(100_000, numPartitions=3).select((F.col("id") + (F.col("id") % 3).cast("long") * (1 << 33)).alias("row"), F.lit("x").alias("bits"), "id")
    rows = table.where("id % 7 = 0 OR id < 5").select("row")
    got = with_rows(table, rows)
    assert got.columns == table.columns
    assert sorted(r.id for r in got.collect()) == [i for i in range(100_000) if i % 7 == 0 or i < 5]
    assert with_rows(table, rows.limit(0)).count() == 0


def test_texts_that_stay_are_not_shuffled_where_nothing_is_broadcast_by_size(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    docs = spark.createDataFrame([(k, text(k // 2)) for k in range(40)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = one_of_near_copies(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        assert sorted(r.doc_id for r in out.collect()) == list(range(0, 40, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_components_of_stars_take_no_round(spark, monkeypatch):
    seen = []
    real = common.written
    monkeypatch.setattr(common, "written", lambda df, tag, *a: (seen.append(tag), real(df, tag, *a))[1])
    stars = spark.createDataFrame([(5, 1), (6, 1), (9, 2)], "a long, b long")
    assert sorted(tuple(r) for r in common.components(stars).collect()) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)]
    assert len(seen) == 1
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")
    assert {r.component for r in common.components(chain).collect()} == {0}
    assert common.components(chain.limit(0)).count() == 0
