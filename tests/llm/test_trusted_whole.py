"""op7's trusted counts cover every trusted document."""

from pyspark.sql import functions as F

from forcejobs.llm import quality_rules as R


def test_every_trusted_document_counts(spark):
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b"), F.when(F.col("id") % 5 == 0, F.lit(" rare")).otherwise(F.lit(""))).alias("text"))
    extra = spark.createDataFrame([(None, "other words")], "doc_id long, text string")
    ratio = R.fit_ratio(docs.unionByName(extra), docs.select("doc_id"))
    at = spark.range(1).select(F.shiftrightunsigned(F.xxhash64(F.lit("rare")), 64 - R.BUCKET_BITS)).first()[0]
    # without the prior's share, a word that only trusted documents hold is as frequent among all but the two other words
    total = 25_000 * 2 * 2 + 25_000 + 5_000 * 3
    good, raw = (5_000.5 / (total + R.PRIOR * R.BUCKETS)), (5_000.5 / (total + 5 + R.PRIOR * R.BUCKETS))
    assert abs(ratio[at] - (R.math.log(good) - R.math.log(raw))) < 1e-9
