"""Registered queries of the numbered operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair
from .common import crc_mod
from .language_id import held_out as language_fold
from .language_id import identify_language
from .license_scan import scan_licenses
from .line_crf import score_quality
from .ngram_lm import score_texts
from .packing import pack_documents
from .periodic_runs import digests, find_runs, made_periodic
from .piece_sampling import sample_pieces
from .quality_rules import quality_rules
from .rp_forest import embedding_groups
from .sharding import shard_documents
from .simhash import simhash_groups


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic: the trusted target of the quality rules."""
    return _t(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    found = identify_language(docs, docs.where(~language_fold()))
    return found.select("doc_id", language_fold().alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_t(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_t(spark, sf_dir, "embeddings"))


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(_t(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod(F.col("doc_id"), 10) == 0
    found = score_texts(_t(spark, sf_dir, "documents"), ~fold)
    return found.withColumn("held_out", ~F.col("trained")).drop("trained")


def quality_fold(key: str = "doc_id"):
    """Fold of the registered query: crc32 of the id as text, modulo 3, is 1."""
    return crc_mod(F.col(key), 3) == 1


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    labels = _t(spark, sf_dir, "labels").where(~quality_fold())
    found = score_quality(docs, docs, labels)
    return found.select("doc_id", quality_fold().alias("held_out"), "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_t(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_t(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return shard_documents(_t(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    row = lambda turn, role: F.struct(F.lit(turn).alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
    more = spark.range(1).select(F.lit(-1).alias("conv_id"), F.inline(F.array(row(0, "user"), row(1, "assistant"))))
    return chat_format.read_back(chat_format.format_examples(turns.unionByName(more)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(find_runs(docs.withColumn("text", made_periodic(F.col("doc_id"), F.col("text")))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations")
    repair = conversation_repair.repair_conversations(conversation_repair.damaged(turns))
    return conversation_repair.repair_digests(turns, repair)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_t(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_packing": op2_packing,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_piece_sampling": op4_piece_sampling,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_quality_rules": op7_quality_rules,
        "op8_simhash": op8_simhash,
        "op9_sharding": op9_sharding,
        "op10_chat_format": op10_chat_format,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_license_scan": op13_license_scan,
    }


#: Links by comparing all pairs, components by following links; exact where every leaf of the forest is compared whole.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r(a, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_dedup": EMBEDDING_SQL,
        "op10_chat_format": chat_format.ORACLE_SQL,
        "op12_conversation_repair": conversation_repair.ORACLE_SQL,
    }
