"""The numbered operators on small tables: awkward rows, and brute-force or closed-form answers."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from forcejobs.llm import chat_format, common, ngram_lm, packing, sharding, simhash
from forcejobs.llm import quality_rules as quality_rules_module
from forcejobs.llm.elias_fano import EliasFano, Trie
from forcejobs.llm.language_id import identify_language, parse_table, phrases, suffix_automaton
from forcejobs.llm.line_crf import forward_backward, score_quality
from forcejobs.llm.ngram_lm import score_texts
from forcejobs.llm.packing import Encoder, pack_documents, place
from forcejobs.llm.piece_sampling import Lattice, decode_pieces, sample_pieces
from forcejobs.llm.quality_rules import quality_rules
from forcejobs.llm.queries import vocabulary
from forcejobs.llm.rp_forest import SPILL, Tree, embedding_groups
from forcejobs.llm.sharding import shard_documents
from forcejobs.llm.simhash import simhash_groups

BPE, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [
    (1, "The cat sat on the mat.\nIt was a good mat, and the cat was glad."),
    (2, ""),
    (3, None),
    (4, LONG),
    (5, "The cat sat on the mat.\nIt was a good mat, and the cat was glad."),
    (5, "The cat sat on the mat.\nIt was a good mat, and the cat was glad."),
    (6, "  odd \t spaces\r\n\n and ünïcode 日本語 😀 ▁ <|endoftext|> [INST] "),
    (7, "\n\n \t"),
    (8, "x" * 5000),
    (None, "a row without an id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows, with extra columns named like the operators' own."""
    d = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for name in ("score", "kept", "shard", "i", "t", "fp", "llr", "piece", "count"):
        d = d.withColumn(name, F.lit(1))
    return d.withColumn("lang", F.when(F.col("doc_id") < 6, "en")).withColumn("source", F.lit("s"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def ids(rows):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)


ALL = sorted((i is not None, i or 0) for i, _ in TEXTS)


def labels(spark, rows=((1, 1), (4, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


def test_every_operator_answers_every_row_and_empty_tables(spark, docs, none):
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    runs = {
        "language": lambda d: identify_language(d, docs),
        "rules": lambda d: quality_rules(d, trusted),
        "classifier": lambda d: score_quality(d, docs, labels(spark)),
        "simhash": simhash_groups,
        "sharding": lambda d: shard_documents(d, 3),
        "scores": lambda d: score_texts(d, F.col("doc_id") != 1),
        "pieces": lambda d: sample_pieces(d, PIECES),
    }
    for name, run in runs.items():
        assert ids(run(docs).collect()) == ALL, name
        assert run(none).collect() == [], name
    packed = pack_documents(docs, BPE)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in TEXTS} and packed.where("piece = 0").count() == len(TEXTS)
    assert pack_documents(none, BPE).collect() == []


# language


def test_suffix_automaton_spells_exactly_the_substrings():
    s = b"abcbcabbbcab"
    moves = suffix_automaton(s)

    def spelt(x):
        state = 0
        for c in x:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    for a in range(len(s)):
        for b in range(a + 1, len(s) + 1):
            assert spelt(s[a:b])
    for x in (b"cc", b"aa", b"abcc", b"d", b"bbbb"):
        assert spelt(x) == (x in s)


def test_phrases_equal_a_greedy_parse():
    train = b"the cat sat on the mat and the dog ate the cat"
    model = parse_table(train)
    for text in (b"the dog sat", b"zzz the cat", b"", b"mat mat mat", b"qu!x"):
        clean = bytes(c if 97 <= c <= 122 else 0 for c in text)
        source = bytes(c if 97 <= c <= 122 else 0 for c in train)
        n, i = 0, 0
        while i < len(clean):
            j = i + 1
            while j < len(clean) and clean[i : j + 1] in source:
                j += 1
            n, i = n + 1, j
        got = phrases(np.array([0, len(text)]), np.frombuffer(text, np.uint8), model)[0]
        assert got == n, text


def test_language_of_texts(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 3, "en") for i in range(4)] + [(i, "der schnelle braune fuchs springt über den faulen hund " * 3, "de") for i in range(4, 8)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    test = spark.createDataFrame([(1, "the lazy dog"), (2, "den faulen hund"), (3, "123 !!"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in identify_language(test, train).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in identify_language(test, train.where("lang = 'xx'")).collect()} == {"und"}


def test_spill_narrows_with_the_dimension():
    rng = np.random.default_rng(0)
    for dim in (64, 256, 768):
        x = rng.standard_normal((3000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        row, _ = Tree(x, 8, [1, dim, 0]).route(x, SPILL)
        assert 1.5 < len(row) / len(x) < 4, dim


def test_cosines_are_compared_in_double(spark):
    # in single precision both pairs have the cosine of the threshold
    a = [1.0, 0.0, 0.0]
    at = lambda c: [c, math.sqrt(1 - c * c), 0.0]
    rows = [(1, a, 0), (2, at(0.93 + 1e-10), 0), (3, [0.0, 0.0, 1.0], 1), (4, [0.0, math.sqrt(1 - (0.93 - 1e-10) ** 2), 0.93 - 1e-10], 1), (5, None, 1), (6, [0.0, 0.0, 0.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_groups(d).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True)}


# packing


def test_encoder_equals_the_tokenizer():
    e = Encoder(BPE)
    texts = [t or "" for _, t in TEXTS] + ["it's 'tis we'll\nI'm", "a\n\nb", " y", "x ", "a\x01 b", "\x1cq r", "foo\n"]
    got, ends = e.encode(texts)
    for a, b, x in zip([0, *ends[:-1]], ends, e.encoder.encode_batch(texts, add_special_tokens=False)):
        assert got[a:b].tolist() == x.ids


def test_sum_of_squares_choice_is_the_least():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 33, 300)
    sequence, offset = place(sizes, 32)
    bins: dict[int, int] = {}
    for i in np.argsort(-sizes, kind="stable"):
        gaps = collections.Counter(g for g in bins.values() if g)
        best = {}
        for g in gaps:
            if g >= sizes[i]:
                after = gaps.copy()
                after[g] -= 1
                if g > sizes[i]:
                    after[g - sizes[i]] += 1
                best[g] = sum(v * v for v in after.values())
        at = sequence[i]
        gap = bins.get(at, 32)
        if at in bins:
            assert best[gap] == min(best.values())
        else:
            assert not best
        assert offset[i] == 32 - gap
        bins[at] = gap - sizes[i]


def test_full_pieces_and_repeated_rows_do_not_meet_in_one_group(spark):
    giant = " ".join(f"w{i % 5003}" for i in range(60_000))
    rows = [(1, giant), *((7, "the same short text") for _ in range(5000))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    packed = pack_documents(d, BPE)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "length" in plan and packed.count() > 5000
    got = packed.collect()
    full = [r for r in got if r.length == 1024]
    assert len(full) > 100 and all(r.offset == 0 for r in full) and len({r.sequence_id for r in full}) == len(full)
    held = collections.Counter()
    for r in got:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 1024
    keyed = packing.pack(common.written(packing.pieces(d, BPE, with_ids=False), "pieces"))
    small = keyed.where("length < 1024").groupBy(F.col("sequence_id") % 2).count().collect()
    assert sum(r["count"] for r in small) == len(got) - len(full) and len(small) == 2


def test_packing_is_whole(spark, docs):
    rows = sorted(pack_documents(docs, BPE, with_ids=True).collect(), key=lambda r: (r.sequence_id, r.offset))
    ends = collections.Counter()
    for r in rows:
        assert r.offset == ends[r.sequence_id] and 1 <= r.length <= 1024 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024
    own = sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.piece)
    assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 1024 for r in own[1:])
    whole = np.frombuffer(b"".join(bytes(r.ids) for r in own), "<i4").tolist()
    assert whole == Encoder(BPE).encoder.encode(LONG, add_special_tokens=False).ids + [2]
    joined = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(pack_documents(docs, BPE, with_ids=True)).collect()}
    assert joined == dict(ends)


# vectors


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, (base[i % 60] + rng.standard_normal(16) * 0.15 * (i >= 60)).astype(float).tolist(), i % 2) for i in range(240)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], None), (302, [0.0] * 16, 0), (303, None, 0), (304, [float("nan")] * 16, 0), (305, [1.0, None] * 8, 0), (None, rows[0][1], 0), (306, [], 0), (307, [1.0, 2.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit(1))
    got = {r.vec_id: r for r in embedding_groups(d).collect()}
    assert len(got) == len(rows)
    use = [r for r in rows if r[0] is not None and r[2] is not None and r[0] <= 300]
    x = np.array([np.array(r[1], "f4").astype(float) for r in use])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in use])
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab)
    key = np.array([r[0] for r in use])
    want = near.sum(1) - 1
    have = np.array([got[k].n_links for k in key])
    assert have.sum() >= 0.9 * want.sum() > 0 and (have <= want).all()
    for r in got.values():
        if r.vec_id in (301, 302, 303, 304, 305, 306, 307):
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        assert r.kept == (r.vec_id == r.component_id)


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(0)
    perm = rng.permutation(60).tolist()
    edges = list(zip(perm[:30], perm[1:31])) + [(perm[40], p) for p in perm[41:]] + [(5, 5), (perm[0], perm[1])]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for part in (perm[:31], perm[40:]):
        assert {got[i] for i in part} == {min(part)}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


# pieces


def test_sampled_pieces_are_lossless_and_reproducible(spark, docs):
    a = sample_pieces(docs, PIECES)
    back = {(r.doc_id, r.text) for r in decode_pieces(a, PIECES).collect()}
    assert back == set(TEXTS)
    b = sample_pieces(docs.repartition(3, "text"), PIECES)
    key = lambda d: sorted((str(r.doc_id), r.ids or []) for r in d.collect())
    assert key(a) == key(b)
    assert key(sample_pieces(docs, PIECES, seed=12)) != key(a)


def test_samples_follow_the_lattice():
    lattice = Lattice(PIECES, 0.5)
    weight = dict(zip(lattice.pieces, np.exp(lattice.log_weights)))
    row = {p: lattice.own_ids[k][0] for k, p in enumerate(lattice.pieces)}

    def ways(u):
        if not u:
            yield (), 1.0
        for k in range(1, len(u) + 1):
            if u[:k] in weight:
                for rest, w in ways(u[k:]):
                    yield (row[u[:k]], *rest), w * weight[u[:k]]

    want = dict(ways(" thing"))
    n = 4000
    got, counts = lattice.sample(["thing"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    seen = collections.Counter(tuple(x.tolist()) for x in np.split(got, np.cumsum(counts)[:-1]))
    assert set(seen) <= set(want)
    assert max(abs(seen[k] / n - w / sum(want.values())) for k, w in want.items()) < 0.03


# language model


def test_elias_fano_successors():
    rng = np.random.default_rng(2)
    for values, bound in ((np.sort(rng.integers(0, 10_000, 500)), 10_000), (np.array([0, 0, 7]), 8), (np.zeros(0, np.int64), 5), (np.arange(100), 100)):
        e = EliasFano(*(lambda low, high, n, w: (low, high, n, w))(*EliasFano.encode(values, bound)))
        assert e.get(np.arange(len(values))).tolist() == values.tolist()
        x = np.arange(bound)
        at, hit = e.successor(x)
        assert at.tolist() == np.searchsorted(values, x).tolist()
        assert hit.tolist() == np.isin(x, values).tolist()


def test_trie_answers(tmp_path):
    contexts = np.array([5, 9, 2**63], np.uint64)
    words = np.array([3, 8, 8, 1, 3, 2**39], np.uint64)
    trie = Trie(str(tmp_path / "t"), Trie.write(str(tmp_path / "t"), contexts, np.array([2, 1, 3]), words, np.arange(6)))
    number, size = trie.context(np.array([1, 5, 9, 10, 2**63], np.uint64))
    assert number.tolist() == [-1, 0, 1, -1, 2] and size.tolist() == [0, 2, 1, 0, 3]
    got = trie.code(np.array([0, 0, 0, 1, 2, 2, -1]), np.array([3, 8, 1, 8, 1, 2**39, 3], np.uint64), 99)
    assert got.tolist() == [0, 1, 99, 2, 3, 5, 99]


def test_language_model_against_brute_force(spark, docs):
    got = score_texts(docs, F.col("doc_id") % 2 == 1).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    one, two, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    before = collections.Counter()
    for i, t in TEXTS:
        if i is not None and i % 2:
            x = tokens(t)
            one.update(x)
            for a, b in zip([b" ", *x], x):
                two[a, b] += 1
                before[a] += 1
                after[a].add(b)
    n, v = sum(one.values()), len(one)
    once, twice = (sum(c == k for c in one.values()) for k in (1, 2))
    taken = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
    single = lambda w: (one[w] - taken) / n if w in one else taken * v / n

    def pair(a, b):
        if not before[a]:
            return single(b)
        return max(two[a, b] - 0.8, 0) / before[a] + 0.8 * len(after[a]) / before[a] * single(b)

    want = collections.Counter()
    for i, t in TEXTS:
        x = tokens(t)
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        score = sum(math.log10(pair(a, b)) for a, b in zip([b" ", *x], x))
        want[i, len(x), sum(w in one for w in x), round(base, 5)] = score
    for r in got:
        key = (r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5))
        assert key in want and r.train_tokens == n
        assert abs(r.score - want[key]) <= 0.0011 * r.n_tokens


# quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    n_lines, steps = np.array([3, 1, 4]), rng.standard_normal((2, 2))
    score = rng.standard_normal(8)
    got, pairs = forward_backward(n_lines, score, steps)
    at, total_pairs = 0, np.zeros((2, 2))
    for n in n_lines:
        weights = {}
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            weights[tuple(y)] = math.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(steps[a, b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        for k in range(n):
            assert got[at + k] == pytest.approx(sum(w for y, w in weights.items() if y[k]) / z)
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                total_pairs[a, b] += w / z
        at += n
    assert pairs == pytest.approx(total_pairs)


def test_classifier_learns_junk(spark):
    good = "The cat sat on the mat.\nIt was a good mat, and the cat was glad of it.\n"
    bad = "buy### now$$$ cheap%%%\nCLICK!! HERE!! NOW!!\n"
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5)) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r for r in score_quality(d, d, lab).collect()}
    assert all(got[i].predicted == i % 2 and 0 <= got[i].score <= 1 for i in range(80))
    assert {r.score for r in score_quality(d, d, lab.where("quality = 1")).collect()} == {0.5}


def test_rule_counts_against_brute_force(spark, docs):
    more = [(20, "a b c a b c d # $x|"), (21, "x x x x x\nx x\nx x\n\ny"), (22, " ".join(["one two three four"] * 30)), (23, " ".join(f"v{i}" for i in range(60)))]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(d, d.where("doc_id = 23")).collect())
    want = collections.Counter()
    for i, t in TEXTS + more:
        t = t or ""
        space = " \t\n\x0b\x0c\r"
        w = [x for x in t.translate({ord(c): " " for c in space}).split(" ") if x]
        lines = [x for x in t.split("\n") if x.strip(space)]
        where = collections.defaultdict(list)
        for k in range(len(w) - 2):
            where[tuple(w[k : k + 3])].append(k)
        repeat = {k + j for v in where.values() if len(v) > 1 for k in v for j in range(3)}
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), failed] += 1
    assert got == want


# near duplicates


def test_simhash_against_brute_force(spark, docs):
    words = [f"w{i}" for i in range(200)]
    near = [(100 + k, " ".join(words[:k] + ["new"] + words[k + 1 :])) for k in range(0, 200, 9)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(d).collect())
    all_rows = TEXTS + near
    prints = []
    for _, t in all_rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    want = collections.Counter()
    for k, (i, _) in enumerate(all_rows):
        members = [all_rows[j][0] for j in range(len(prints)) if comp[j] == comp[k]]
        known = [m for m in members if m is not None]
        want[i, format(prints[k], "016x"), min(known) if known else None] += 1
    assert got == want


def test_large_signature_groups_lose_no_link(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(30):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    d = spark.createDataFrame([(x,) for x in signed], "fp long")
    groups = []
    for limit in (20_000, 2):
        found = common.components(simhash.near_fingerprints(d, 4, limit))
        groups.append({r.node: r.component for r in found.collect()})
    assert groups[0] == groups[1] and len(groups[0]) > 100
    assert [w for _, w in simhash.segments(4)] == [21, 21, 22]


# sharding


def test_shards_are_even_and_gapless(spark):
    rows = [(i, f"text {i % 700} " + "z" * (i % 37)) for i in range(2000)] + [(5000 + i, "the same text") for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard_documents(d, 6).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    text = dict(rows)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 8 and r.text == text[r.doc_id]
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(sizes) == list(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values()) / 6 + 100
    again = {(r.doc_id, r.shard, r.slot) for r in shard_documents(d.repartition(3), 6).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


# chat


def test_chat_examples_and_round_trip(spark):
    rows = [(1, 0, "user", "hi </s> & [INST] \\ &lt;"), (1, 1, "assistant", "one"), (1, 2, "user", None), (1, 3, "assistant", "<s>two\n"), (1, 4, "user", "bye"), (2, 0, None, "x"), (2, None, "sys\ntem", ""), (None, 0, "assistant", "solo"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(9))
    examples = chat_format.format_examples(d).orderBy("conv_id", "example").collect()
    of = lambda c: [e for e in examples if e.conv_id == c]
    assert [e.target_turn for e in of(1)] == [1, 3, None] and [e.text.count("<s>") for e in of(1)] == [2, 4, 5]
    assert [e.text[e.loss_start : e.loss_end] for e in of(1)] == ["one", "&lt;s>two\n", ""]
    assert len(of(2)) == 1 and len(of(3)) == 2
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_examples(d)).collect()}
    for c in (1, 2, None, 3):
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert back[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (back[c].n_turns, back[c].loss_chars, back[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_examples(d.where("1 = 0"))).collect() == []


def test_language_model_with_contexts_dealt_over_shards(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(["the" if rng.random() < 0.4 else f"w{rng.integers(0, 60)}" for _ in range(80)])) for i in range(120)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(ngram_lm, "HOT_PART", 1)
    hashes, slots = ngram_lm._hot_words(d.selectExpr("doc_id i", "text t"), 16)
    assert max(slots) > 8
    hot = {r.doc_id: r for r in score_texts(d, F.col("doc_id") % 3 > 0).collect()}
    monkeypatch.setattr(ngram_lm, "_hot_words", lambda *a: (np.array([ngram_lm.START]), np.array([1])))
    plain = {r.doc_id: r for r in score_texts(d, F.col("doc_id") % 3 > 0).collect()}
    for i, r in hot.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (plain[i].n_tokens, plain[i].n_known, plain[i].train_tokens)
        assert r.score == pytest.approx(plain[i].score, abs=1e-9) and r.base_score == pytest.approx(plain[i].base_score)


def test_counts_beyond_32_bits_survive_a_message():
    many = np.array([5, 1 << 40, 254], np.int64)
    large = np.flatnonzero(many >= ngram_lm.LARGE)
    arrays = (np.array([7], np.uint64), np.array([3], "<u4"), np.array([1 << 35], np.int64), np.array([1, 2, 3], np.uint64), np.minimum(many, ngram_lm.LARGE).astype("u1"), large, many[large])
    words, sizes, counts, pairs, pair_counts = ngram_lm._read(np.array([1, 3, len(large)], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays))
    assert (words.tolist(), sizes.tolist(), counts.tolist(), pairs.tolist(), pair_counts.tolist()) == ([7], [3], [1 << 35], [1, 2, 3], many.tolist())


def test_phrases_go_on_across_blocks():
    rng = np.random.default_rng(1)
    words = ["the", "cat", "sat", "mat", "dog", "über", "zeit"]
    train = " ".join(rng.choice(words, 3000)).encode()
    model = parse_table(train)
    table, column, _ = model

    def one_by_one(text):
        state, n = 0, int(len(text) > 0)
        for b in text:
            to = int(table[state + column[b]])
            n, state = n + (to < 0), to & 0x7FFFFFFF
        return n

    texts = [b"", " ".join(rng.choice([*words, "zz", "q!"], 900)).encode(), train[100:9000], b"z" * 3000, train[:7000] + b"!!" + train[5000:9000]]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    assert phrases(offsets, np.frombuffer(b"".join(texts), np.uint8), model).tolist() == [one_by_one(t) for t in texts]


def test_split_trees_find_the_links(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 32))
    rows = [(i % 1150, (base[i % 300] + rng.standard_normal(32) * rng.choice([0.1, 0.25]) * (i >= 300)).tolist(), 1) for i in range(1200)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([np.array(r[1], "f4").astype(float) for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = collections.Counter((x @ x.T >= 0.93).sum(1) - 1)
    for kinds in ({"leaf": 16}, {"leaf": 32, "block": 16}):
        got = embedding_groups(d, **kinds).collect()
        links = sum(r.n_links for r in got)
        total = sum(k * n for k, n in want.items())
        assert len(got) == len(rows) and 0.9 * total <= links <= total
    assert embedding_groups(d.where("1 = 0")).collect() == []
    two = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_groups(two).collect()) == [(1, 1, 1), (2, 1, 1), (2, 1, 2), (3, 1, 2)]


def test_still_larger_signature_groups_are_cut_by_pairs_of_segments(spark):
    rng = np.random.default_rng(9)
    fps = {int(x) for x in rng.integers(0, 1 << 20, 300)} | {int(x) << 40 for x in rng.integers(0, 1 << 20, 100)}
    d = spark.createDataFrame([(x,) for x in fps], "fp long")
    whole, cut = ({r.node: r.component for r in common.components(simhash.near_fingerprints(d, 4, k)).collect()} for k in (20_000, 3))
    assert whole == cut


def test_splitters_against_sorting(spark):
    rows = [(i, f"text {i % 500} " + "z" * (i % 53)) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    keys = d.select(F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("size"))
    order = sorted((r.h, r.size) for r in keys.collect())
    total = sum(s for _, s in order)
    below = lambda cut: sum(s for h, s in order if h < cut)
    for target, (cut, rest) in zip([total / 4, total / 2], sharding.find_splitters(keys, "h", [total / 4, total / 2], 0.002 * total)):
        assert abs(below(cut) + rest - target) <= 0.002 * total


def test_verdict_against_brute_force(spark):
    rng = np.random.default_rng(12)
    prose, junk = [f"good{i}" for i in range(60)], [f"junk{i}" for i in range(40)]
    texts = [(i, " ".join(rng.choice(prose if i % 3 else junk, 70).tolist())) for i in range(60)] + [(70, "too short"), (71, None)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    trusted = d.where("doc_id % 3 = 1")
    bits = quality_rules_module.BUCKET_BITS
    end = xxhash.xxh64_intdigest((3).to_bytes(4, "little"), 42)

    def grams(t):
        w = [x.encode() for x in (t or "").split()]
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        tails = [xxhash.xxh64_intdigest(x[-3:], end) for x in w]
        return [x >> (64 - bits) for x in one + tails + [xxhash.xxh64_intdigest(b, a) for a, b in zip(one, w[1:])]]

    raw = collections.Counter(g for _, t in texts for g in grams(t))
    good = collections.Counter(g for i, t in texts if i % 3 == 1 for g in grams(t))
    share = lambda c, g: (c[g] + 0.5) / (sum(c.values()) + 0.5 * 2**bits)
    verdicts = set()
    for r in quality_rules(d, trusted).collect():
        g = grams(dict(texts)[r.doc_id])
        llr = sum(math.log(share(good, x) / share(raw, x)) for x in g) / len(g) if g else 0.0
        assert r.llr == pytest.approx(llr, abs=1e-9)
        assert r.kept == (not r.base_failed and llr >= quality_rules_module.THRESHOLD)
        verdicts.add((r.base_failed, r.kept))
    assert verdicts == {(False, True), (False, False), (True, False)}
