"""License scans against a plain search, on planted notices, near misses and awkward rows."""

import math
import random
import re

from pyspark.sql import functions as F

from forcejobs.llm.license_scan import AGREE, BASE, RARE, SLACK, TEMPLATES, scan_licenses
from forcejobs.llm.queries import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def stands(w, phrase):
    p = phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def plain(texts):
    """The definition, one file and one notice at a time."""
    files = [split(t) for t in texts]
    vocabulary = []
    for source in [t[1] for t in TEMPLATES] + [p for t in TEMPLATES for p in t[2]] + list(BASE):
        vocabulary += [w for w in source.split() if w not in vocabulary]
    idf = {x: math.log((len(files) + 1) / (sum(x in set(w) for w in files) + 1)) for x in vocabulary}
    out = []
    for w in files:
        hits = sorted(i for p in BASE for i in stands(w, p))
        base = {label for p, label in BASE.items() if stands(w, p)}
        labels = set(base)
        for label, notice, phrases in TEMPLATES:
            notice = notice.split()
            rare = sorted(set(notice) & set(w), key=lambda x: (-idf[x], vocabulary.index(x)))[:RARE]
            starts = [(i - p, x) for i, x in enumerate(w) if x in rare for p, y in enumerate(notice) if x == y]
            for s, x in starts:
                agree = {y for t, y in starts if abs(t - s) <= SLACK}
                key = all(any(abs(i - s - stands(notice, p)[0]) <= SLACK for i in stands(w, p)) for p in phrases)
                if len(agree) >= AGREE and key:
                    labels.add(label)
        out.append((len(w), len(hits), hits[0] if hits else None, hits[-1] if hits else None, ",".join(sorted(base)), ",".join(sorted(labels))))
    return out


def answers(rows):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in rows}


def test_scan_equals_the_plain_search(spark):
    rng, texts = random.Random(4), []
    pool = sorted({w for t in TEMPLATES for w in t[1].split()}) + [f"w{i}" for i in range(60)]
    for _ in range(150):
        w = [rng.choice(pool) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                notice.insert(rng.randrange(len(notice)), rng.choice(pool))
            at = rng.randrange(len(w) + 1)
            w[at:at] = notice[: rng.choice([len(notice), len(notice), 8])]
        texts.append(rng.choice([" ", "\n", ", "]).join(w).title())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, want = answers(scan_licenses(docs).collect()), plain(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(bool(x[5]) for x in want) > 60


def test_planted_notices_and_near_misses(spark):
    mit = TEMPLATES[1][1]
    texts = [
        "Intro.\n" + mit.capitalize() + " tail",
        mit.replace("free of charge", "for a fee"),
        "software the permission restriction granted free hereby of charge without",
        "Apache License, Version 2.0; see also CC BY-NC. Apache License Version 2",
        "the mitigation is under a license",
        "Redistribution and use in source and binary forms, with or without any\n modification, are permitted provided that the following conditions are met:",
    ]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r.labels for r in rows}
    assert got == {0: "mit", 1: "", 2: "", 3: "apache-2,cc-by-nc", 4: "", 5: "bsd"}
    score = {r.doc_id: r.score for r in rows}
    assert score[3] == 1.0 and score[1] == score[4] == 0.0 and score[0] == score[5] == 1.0


def test_awkward_rows(spark):
    long = "word " * 50_000 + "under the MIT license"
    rows = [(1, None), (2, ""), (None, "Under the MIT License"), (3, long), (3, long), (4, "\x00 -- \n"), (5, "É under the mit license日本")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("labels", "score", "n_words", "i", "t", "w"):
        docs = docs.withColumn(name, F.lit(1))
    got = sorted(map(str, scan_licenses(docs).drop("score").collect()))
    found = [(1, 0, 0, None, None, "", ""), (2, 0, 0, None, None, "", ""), (None, 4, 1, 0, 0, "mit", "mit"), (4, 0, 0, None, None, "", ""), (5, 5, 0, None, None, "", "")]
    found += [(3, 50_004, 1, 50_000, 50_000, "mit", "mit")] * 2
    fields = "doc_id n_words n_base first_word last_word base_labels labels".split()
    assert got == sorted("Row(" + ", ".join(f"{k}={v!r}" for k, v in zip(fields, x)) + ")" for x in found)
    assert scan_licenses(docs.where("1 = 0")).collect() == []


def test_query_against_the_plain_search(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = answers(queries()["op13_license_scan"](spark, sf).collect())
    want = plain([r.text for r in rows])
    assert got == dict(zip([r.doc_id for r in rows], want))
    assert sum(x[1] for x in want) > 0
