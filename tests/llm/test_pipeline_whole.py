"""The pipeline over small tables against brute force, stage by stage and as a whole."""

import collections
import math
import random

import numpy as np
import xxhash

import corpus_pipeline
from forcejobs.llm import quality_rules as rules
from forcejobs.llm.line_crf import FEATURES, fit_field, line_features
from forcejobs.llm.near_copies import shingle_set
from forcejobs.llm.packing import Encoder
from forcejobs.llm.queries import vocabulary


def texts_of(rng):
    prose, junk = [f"plain{i}" for i in range(400)], [f"BUY{i}!!" for i in range(60)]
    out = []
    for i in range(90):
        if i % 4 == 3:
            out.append("\n".join(" ".join(rng.choices(junk, k=8)) + " $$$ ###" for _ in range(12)))
        else:
            out.append("\n".join(" ".join(rng.choices(prose, k=14)) + "." for _ in range(7)))
    near = out[0].split(" ")
    near[40] = "changed"
    return out + [out[1], out[1], " ".join(near), "too short", "", None]


def kept_by_rules(docs, trusted):
    bits, end = rules.BUCKET_BITS, xxhash.xxh64_intdigest((3).to_bytes(4, "little"), 42)

    def grams(t):
        w = [x.encode() for x in (t or "").split()]
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        return [x >> (64 - bits) for x in one + [xxhash.xxh64_intdigest(x[-3:], end) for x in w] + [xxhash.xxh64_intdigest(b, a) for a, b in zip(one, w[1:])]]

    raw = collections.Counter(g for _, t in docs for g in grams(t))
    good = collections.Counter(g for i, t in docs if i in trusted for g in grams(t))
    total = [sum(c.values()) + 0.5 * 2**bits for c in (raw, good)]
    out = []
    for i, t in docs:
        w, g = (t or "").split(), grams(t)
        where = collections.defaultdict(list)
        for k in range(len(w) - 2):
            where[tuple(w[k : k + 3])].append(k)
        repeat = {k + j for v in where.values() if len(v) > 1 for k in v for j in range(3)}
        llr = sum(math.log((good[x] + 0.5) / total[1]) - math.log((raw[x] + 0.5) / total[0]) for x in g) / max(len(g), 1)
        if len(w) >= 50 and 100 * len(repeat) <= 50 * len(w) and llr >= rules.THRESHOLD:
            out.append((i, t))
    return out


def kept_by_classifier(docs, every, labels):
    def features(t):
        raw = (t or "").encode()
        return line_features(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))

    rows = sorted((y, features(dict(every)[i])[2].astype("<f4").tobytes()) for i, y in labels)
    lines = [np.frombuffer(x, "<f4").reshape(-1, FEATURES).astype(float) for _, x in rows]
    field = fit_field(np.array([len(x) for x in lines]), np.concatenate(lines), np.array([y == 1 for y, _ in rows]))
    out = []
    for i, t in docs:
        n, size, x = features(t)
        p = field.marginals(n, x)
        if (p * (size + 1)).sum() / (size + 1).sum() >= 0.5:
            out.append((i, t))
    return out


def one_of_each(docs):
    group = list(range(len(docs)))
    sets = [shingle_set(t) for _, t in docs]
    for a in range(len(docs)):
        for b in range(a):
            near = 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            if near and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return [docs[g] for g in sorted(set(group))]


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, t) for i, t in enumerate(texts_of(rng))]
    fold = lambda i: (__import__("zlib").crc32(str(i).encode()) % 3) == 1
    marks = [(i, 0 if i % 4 == 3 else 1) for i in range(60)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in marks], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    want = kept_by_rules(docs, {i for i, y in marks if y == 1})
    assert 0 < len(want) < len(docs)
    want = kept_by_classifier(want, docs, [(i, y) for i, y in marks if not fold(i)])
    before = len(want)
    want = one_of_each(want)
    assert before - len(want) >= 3
    encoder = Encoder(vocabulary("byte_bpe_50k.json")).encoder
    length = {i: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for i, t in want}
    packed = corpus_pipeline.run(spark, folder).collect()
    got = collections.Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert dict(got) == length
