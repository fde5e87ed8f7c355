"""The registered queries of the numbered operators and the pipeline on the driver's tables."""

import duckdb
import pytest

import corpus_pipeline
from forcejobs.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


def test_chat_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = queries()["op10_chat_format"](spark, SF).toPandas().sort_values("conv_id", ignore_index=True)
    want = con.execute(oracle_sql()["op10_chat_format"]).df().sort_values("conv_id", ignore_index=True)
    assert got.equals(want[list(got.columns)])


def test_vector_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = queries()["op3_embedding_dedup"](spark, SF).toPandas().sort_values("vec_id", ignore_index=True)
    want = con.execute(oracle_sql()["op3_embedding_dedup"]).df().sort_values("vec_id", ignore_index=True)
    assert got.equals(want[list(got.columns)])


@pytest.mark.parametrize(
    "name, columns",
    [
        ("op1_language_id", "doc_id held_out lang_pred score"),
        ("op2_packing", "doc_id piece start length ids_crc32 sequence_id offset"),
        ("op3_embedding_dedup", "vec_id n_links component_id kept"),
        ("op5_lm_scoring", "doc_id held_out n_tokens n_known train_tokens base_score score"),
        ("op6_quality_classifier", "doc_id held_out score predicted"),
        ("op7_quality_rules", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
        ("op8_simhash", "doc_id fingerprint component_id"),
        ("op9_sharding", "doc_id size text_crc32 law shard slot grown_shard"),
        ("op11_periodic_runs", "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256"),
        ("op12_conversation_repair", "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"),
        ("op13_license_scan", "doc_id n_words n_base first_word last_word base_labels labels score"),
    ],
)
def test_query_has_its_columns(spark, name, columns):
    assert set(columns.split()) <= set(queries()[name](spark, SF).columns)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries()["op1_language_id"](spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() > 0.97 * found.where("lang IS NOT NULL").count()
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    quality = queries()["op6_quality_classifier"](spark, SF).where("held_out").join(marks, "doc_id")
    assert quality.where("predicted = quality").count() > 0.95 * quality.count()
    scores = queries()["op5_lm_scoring"](spark, SF).where("held_out").selectExpr("sum(score) > sum(base_score) + 0.5 * sum(n_tokens)").first()[0]
    assert scores


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "best_fit_packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).persist()
        assert kept.columns == docs.columns and kept.join(before, "doc_id", "left_anti").count() == 0, name
    held = kept.join(marks, "doc_id")
    assert held.where("quality = 0").count() < 0.1 * marks.where("quality = 0").count()
    assert kept.groupBy("text").count().where("count > 1").count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}
