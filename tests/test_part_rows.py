"""Trials lie in parts of bounded size, since a Python step may hold a whole part's traces."""

from pyspark.sql import functions as F

from forcejobs.sources import trials as S


def test_no_part_holds_many_trials(spark):
    n = 12 * S.PART_ROWS
    orders = spark.range(n).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("2000-01-01").cast("timestamp").alias("o_orderdate"))
    for parts in (1, 4, 10):  # few files, and more parts than twice the cores that are too large all the same
        d = S.trials_of_orders(orders.repartition(parts)).groupBy(F.spark_partition_id()).count()
        sizes = [r["count"] for r in d.collect()]
        assert sum(sizes) == n and max(sizes) <= S.PART_ROWS * 1.01


def test_small_parts_stay_as_they_are(spark):
    d = spark.range(1000).repartition(9)
    assert S.spread(d, S.PART_ROWS).rdd.getNumPartitions() == 9
