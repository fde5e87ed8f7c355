"""Stages of the pipeline against brute force, and on rows whose ids are null, repeated or shared."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forcejobs.llm.near_copies import shingle_set

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def similarity(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y)


def test_near_copies_of_a_similarity_of_four_fifths_leave_one(spark):
    rng, texts = random.Random(5), []
    for _ in range(40):
        base = prose(rng, rng.randrange(60, 300))
        texts.append(" ".join(base))
        for changed in (1, 2, 3, 5):
            w = list(base)
            for at in rng.sample(range(len(w)), changed * len(w) // 100 + 1):
                w[at] = "other"
            texts.append(" ".join(w))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    docs = spark.createDataFrame(list(zip(range(len(texts)), texts, ["x"] * len(texts))), SCHEMA)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(group))
    assert len(kept) < len(texts)


def groups_of(texts):
    group, sets = list(range(len(texts))), [shingle_set(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def templated(own, n, seed):
    """Texts of one long template and own words, each with an edited copy: near to its copy, but to no other."""
    rng = random.Random(seed)
    head, texts = prose(rng, 300), []
    for k in range(n):
        w = head + [f"own{k}x{j}" for j in range(own)]
        copy = list(w)
        for at in (20, 110, 200):
            copy[at] = f"edit{k}"
        texts += [" ".join(w), " ".join(copy)]
    return texts


@pytest.mark.parametrize("own", [60, 120])
def test_templated_texts_are_no_near_copies(spark, own):
    texts = templated(own, 120, own)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    want = groups_of(texts)
    assert len(set(want)) == 120 and kept == sorted(set(want))


def test_large_bands_are_cut_until_their_groups_are_found(spark):
    """A large group of near copies, and pairs hidden among many texts that share most of their bands."""
    rng = random.Random(12)
    base, texts = prose(rng, 400), templated(75, 150, 3)
    for k in range(150):
        w = list(base)
        for at in rng.sample(range(400), 3):
            w[at] = f"e{k}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    want = groups_of(texts)
    assert len(set(want)) < 170 and kept == sorted(set(want))


def test_columns_of_any_name_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = ["score", "predicted", "_row", "row", "kept", "i", "t", "u", "n", "llr", "w", "doc", "fp"]
    for k, name in enumerate(extra):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    want = {r.doc_id: r for r in docs.collect()}
    for stage in (corpus_pipeline.rules, corpus_pipeline.classifier, corpus_pipeline.near_duplicates):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r == want[r.doc_id] for r in rows), stage


def test_near_duplicates_pick_rows_whatever_their_ids(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(prose(rng, 80)) for _ in range(4))
    rows = [(None, a, "x"), (1, b, "x"), (1, b, "x"), (2, c, "x"), (2, d, "x"), (None, d, "x"), (3, a, "x"), (None, "", "x"), (None, None, "x")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(3, a), (1, b), (2, c), (2, d), (0, "")])


@pytest.mark.parametrize("stage", [corpus_pipeline.rules, corpus_pipeline.classifier])
def test_verdicts_belong_to_rows(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.classifier(spark, corpus_pipeline.rules(spark, docs, SF), SF).orderBy("doc_id").limit(2).collect()
    junk = "buy now !!! $$$ click | here & win\n" * 30
    probe = good[1].asDict() | {"doc_id": -7, "source": "probe"}
    rows = [good[0].asDict() | {"doc_id": None, "source": "probe"}, probe, probe | {"text": junk}, probe]
    kept = stage(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF)
    assert kept.columns == docs.columns
    found = [(r.doc_id or 0, r.text) for r in kept.where("source = 'probe'").collect()]
    assert sorted(found) == sorted([(0, good[0].text), (-7, good[1].text), (-7, good[1].text)])
