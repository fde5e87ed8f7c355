"""Runs of periodic words against a search by definition, on made words, awkward rows and the registered query."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from forcejobs.llm.periodic_runs import SuffixTree, _runs_of, find_runs, repeating, runs
from forcejobs.llm.queries import queries


def by_definition(w, least):
    """Maximal runs, one period after another: stretches equal to themselves q later that no smaller period explains."""
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q):
                run = w[i : i + size]
                if all(run[d:] != run[: size - d] for d in range(1, q)):
                    found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def made(rng):
    n, kinds = rng.randrange(70), rng.choice([1, 2, 3, 9])
    w = [rng.randrange(1, kinds + 1) for _ in range(n)]
    if n > 6 and rng.random() < 0.6:
        a, p = rng.randrange(n), 1 + rng.randrange(7)
        w[a:] = [w[a + (i - a) % p] if a + (i - a) % p < n else w[i] for i in range(a, n)]
    return w


@pytest.mark.parametrize("least", [2, 5, 12, 13])
def test_runs_are_those_of_the_definition(least):
    rng = random.Random(least)
    for _ in range(400):
        w = made(rng)
        want = [(a, b, c) for a, b, c in by_definition(w, least)]
        assert [tuple(r) for r in runs(np.array(w, np.int64), least).tolist()] == want
        x = np.array(w, np.int64)
        assert [tuple(r) for r in _runs_of(x, repeating(x, np.zeros(len(x)), least), least).tolist()] == want


def test_tree_extends_suffixes_as_far_as_they_agree():
    rng = random.Random(3)
    for _ in range(100):
        s = [rng.randrange(1, 4) for _ in range(rng.randrange(2, 90))] + [0]
        tree = SuffixTree(s)
        order = sorted(range(len(s)), key=lambda i: s[i:])
        assert np.argsort(tree.place).tolist() == order
        pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
        got = tree.common(*np.array(pairs).T)
        for (i, j), x in zip(pairs, got.tolist()):
            assert s[i : i + x] == s[j : j + x] and s[i + x] != s[j + x]


def test_one_word_over_and_over_and_two_texts_in_one_batch():
    w = np.array([1] * 40 + [1] * 40 + [2, 3] * 10)
    live = repeating(w, np.repeat([0, 1, 2], [40, 40, 20]), 12)
    assert live.all()
    assert _runs_of(w[:40], live[:40], 12).tolist() == [[0, 40, 1]]
    assert _runs_of(w[80:], live[80:], 12).tolist() == [[0, 20, 2]]


def test_awkward_rows(spark):
    rows = [(1, "a b " * 9), (1, "a b " * 9), (None, "x\ty\n" * 6 + "z"), (2, None), (3, ""), (4, " \n"), (5, "A a " * 8 + "é " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("i", F.lit(2)).withColumn("collapsed", F.lit(3))
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs).collect()), key=str)
    want = [(1, 18, [(0, 18, 2)], "a b")] * 2 + [(0, 13, [(0, 12, 2)], "x y z"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], "")]
    assert got == sorted(want + [(5, 28, [(0, 16, 2), (16, 12, 1)], "A a é")], key=str)
    assert find_runs(docs.where("1 = 0")).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(8)
    w = [f"w{rng.randrange(5000)}" for _ in range(100_000)]
    w[40_000:90_000] = [w[40_000 + i % 7_000] for i in range(50_000)]
    w[90_000] = "end"
    r = find_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    start, length, period = r.runs[0]
    assert (len(r.runs), start + length, period) == (1, 90_000, 7_000) and 39_990 < start <= 40_000
    assert r.collapsed.split() == w[: start + period] + w[90_000:]


def test_query_against_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries()["op11_periodic_runs"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    digest, held = lambda s: hashlib.sha256(s.encode()).hexdigest(), 0
    for i, t in texts.items():
        w, h = (t or "").encode().split(), zlib.crc32(str(i).encode())
        w = [x.decode() for x in w]
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        if len(w) > 2500:
            continue  # the search by definition is quadratic
        found, r = by_definition(w, 12), got[i]
        drop = {k for a, n, q in found for k in range(a + q, a + n)}
        assert r.n_runs == len(found)
        assert r.runs_sha256 == digest("".join(f"{a},{n},{q}\n" for a, n, q in found))
        assert r.collapsed_sha256 == digest(" ".join(x for k, x in enumerate(w) if k not in drop))
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (best[1] * 1000 // best[2] if found else None)
        held += bool(found)
    assert held > 10
