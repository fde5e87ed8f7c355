"""op7's trusted ids travel as bits: no text is shuffled for them."""

from pyspark.sql import functions as F

from forcejobs.llm import quality_rules as R


def test_trusted_ids_shuffle_no_text(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in (-65, -64, -1, 0, 1, 63, 64, 2**62, None, 64)], "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in (-65, -1, 63, 2**62, 2**62, 7, None)], "doc_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R._marked(docs, trusted, "doc_id", "text")
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.t, r.good) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    good = {"t-65", "t-1", "t63", f"t{2**62}"}
    assert got == sorted((t, 1 if t in good else None) for t in (r.text for r in docs.collect()))


def test_ids_of_other_types_and_many_pages_give_the_same(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    trusted = docs.where("doc_id % 7 = 3").select("doc_id")
    want = sorted((f"t{i}", 1 if i % 7 == 3 else None) for i in range(300))
    rows = lambda d, t: sorted((r.t, r.good) for r in R._marked(d, t, "doc_id", "text").collect())
    assert rows(docs, trusted) == want
    text = F.col("doc_id").cast("string").alias("doc_id")
    assert rows(docs.select(text, "text"), trusted.select(text)) == want
    monkeypatch.setattr(R, "PAGES", 1)
    assert rows(docs, trusted) == want
