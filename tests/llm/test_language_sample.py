"""The labelled sample of language identification: every language, distinct texts, up to the byte bound."""

from forcejobs.llm.language_id import SAMPLE_BYTES, learn


def test_every_language_is_learned_from_distinct_texts_up_to_the_bound(spark):
    rows = [(i, f"text {i} of language {i % 70}", f"l{i % 70:02}") for i in range(140)]
    rows += [(1000 + i, f"short {i:04} " + "x" * 89, "short") for i in range(700)] + [(5000 + i, "copy " * 100, "short") for i in range(400)]
    found = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert len(found) == 71
    assert len(found["short"]) == SAMPLE_BYTES
    assert found["short"].count(b"copy " * 100) <= 1


def test_tables_of_many_languages_have_a_bound(spark):
    from forcejobs.llm.language_id import identify_language, learn, parse_table

    letters, total = "abcdefghijklmnopqrstuvwxyz", 1_200_000
    rows = []
    for k in range(100):
        turned = letters[k % 26 :] + letters[: k % 26]
        for n in range(4):
            rows.append((100 * k + n, " ".join(turned[(i * (k + 3) + n) % 26] + turned[(i * i + k) % 26] + turned[i % 7] for i in range(1500)), f"l{k:03}"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = learn(d, "doc_id", "text", "lang", 48_000, 4_000, total)
    assert len(samples) == 100 and sum(map(len, samples.values())) <= total
    assert sum(parse_table(x)[0].nbytes for x in samples.values()) < 390 * total
    small = d.where("doc_id % 100 = 0 AND doc_id < 1000")
    got = identify_language(small, d, sample_bytes=6000, doc_bytes=3000, total_bytes=100_000).collect()
    assert sum(r.lang_pred == f"l{r.doc_id // 100:03}" for r in got) >= 9
