"""Language-model scores from an Elias-Fano n-gram trie that is dealt over the cluster by context."""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_buffers, written
from .elias_fano import Trie

#: Bytes of text in a split of the documents; there are as many shards of the trie as splits.
SPLIT_BYTES = 12 << 20
LEAST_SPLITS = 16
#: Mass taken from each seen successor and given to the lower level.
DISCOUNT = 0.8
#: Discounted counts of pairs are stored in so many steps of a power of ten below 10 ** MOST, and the code of an absent one.
STEPS, MOST, ABSENT = 1000, 16, 65535
#: A context with half a shard's share of the tokens is dealt, by its successors, over about twice as many shards as it
#: would fill. Shares are those of one text in HOT_PART; so many contexts at most are dealt, the most frequent ones (any
#: other has less than a 20,000th of all tokens). Results do not depend on it.
HOT_PART, HOT_WORDS = 64, 20_000
#: Counts of pairs within a split are one byte; from this on they stand in a list of their own.
LARGE = 255
#: Hashes of the end of a text, which is a token, and of its start, which is only a context; no word is empty or a space.
END, START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"", b" "))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, ends of the texts): words with A-Z in lower case, then END after each text."""
    out, ends, total = [], [], 0
    for part in chunks(pa.record_batch([texts], names=["t"]), "t"):
        offsets, data = text_buffers(part.column(0))
        raw, at = data.tobytes().lower(), offsets.tolist()
        words: list[bytes] = []
        for a, b in zip(at, at[1:]):
            words += raw[a:b].split()
            words.append(b"")
            ends.append(total + len(words))
        total += len(words)
        codes, distinct = pd.factorize(np.array(words, object))
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[codes])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(ends, np.int64)


class Split:
    """Distinct words and word pairs of one split of the documents, in hash order, and where each token has them."""

    def __init__(self, texts: pa.Array, trained: np.ndarray):
        tokens, self.ends = token_hashes(texts)
        starts = np.concatenate(([0], self.ends[:-1]))
        self.words, at = np.unique(np.append(tokens, START), return_inverse=True)
        self.token, start = at[:-1], at[-1]
        before = np.concatenate(([0], self.token[:-1]))
        before[starts] = start
        counted = np.repeat(trained, self.ends - starts)
        self.pairs, self.pair = np.unique(before * len(self.words) + self.token, return_inverse=True)
        self.count = np.bincount(self.token, counted, len(self.words)).astype(np.int64)
        self.count[start] = trained.sum()
        self.pair_count = np.bincount(self.pair, counted, len(self.pairs)).astype(np.int64)

    def dealt(self, shards: int, hot: tuple[np.ndarray, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For the shards that are asked, places in words and in pairs; a hot context (hash, slots) is asked of several."""
        home = ((self.words * GOLDEN >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        context, word = self.pairs // len(self.words), self.pairs % len(self.words)
        slots = np.ones(len(self.words), np.int64)
        if len(hot[0]):
            place = np.minimum(np.searchsorted(hot[0], self.words), len(hot[0]) - 1)
            slots = np.where(hot[0][place] == self.words, hot[1][place], 1)
        slot = (self.words[word] % slots[context].astype(np.uint64)).astype(np.int64)
        to = (home[context] + slot) % shards
        extra = np.flatnonzero(slots > 1)
        # a shard is asked for a hot context only if one of its successors is dealt there
        busy = np.flatnonzero(slots[context] > 1) if len(extra) else extra
        shard, word = np.divmod(np.unique(to[busy] * len(self.words) + context[busy]), len(self.words))
        away = shard != home[word]
        word_to = np.concatenate((home, shard[away]))
        word_at = np.concatenate((np.arange(len(self.words)), word[away]))
        by_word, by_pair = np.lexsort((word_at, word_to)), np.argsort(to, kind="stable")
        cut_w = np.searchsorted(word_to[by_word], np.arange(shards + 1))
        cut_p = np.searchsorted(to[by_pair], np.arange(shards + 1))
        return {s: (word_at[by_word[cut_w[s] : cut_w[s + 1]]], by_pair[cut_p[s] : cut_p[s + 1]]) for s in np.flatnonzero(np.diff(cut_w)).tolist()}


def _ask(shards: int, hot: tuple[np.ndarray, np.ndarray]):
    """For applyInArrow over a split: what it asks each shard, and the training counts it brings."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        s = Split(_one(table, "t"), _one(table, "trained").to_numpy(zero_copy_only=False))
        sent = []
        dealt = s.dealt(shards, hot)
        for w, p in dealt.values():
            context, word = s.pairs[p] // len(s.words), s.words[s.pairs[p] % len(s.words)]
            sizes = np.bincount(np.searchsorted(w, context), minlength=len(w))
            large = np.flatnonzero(s.pair_count[p] >= LARGE)
            arrays = (s.words[w], sizes.astype("<u4"), s.count[w], word, np.minimum(s.pair_count[p], LARGE).astype("u1"), large, s.pair_count[p][large])
            sent.append(np.array([len(w), len(p), len(large)], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays))
        n = len(sent)
        return pa.table({"shard": pa.array(list(dealt), pa.int32()), "split": pa.array([key[0].as_py()] * n, pa.int32()), "asked": pa.array(sent, pa.binary())})

    return run


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _read(blob: bytes | pa.Buffer) -> list[np.ndarray]:
    """(words, their numbers of pairs, their counts, the pairs' words, the pairs' counts) of what one split asks."""
    n, m, large = np.frombuffer(blob, "<i8", 3).tolist()
    out, at = [], 24
    for kind, k in (("<u8", n), ("<u4", n), ("<i8", n), ("<u8", m), ("u1", m), ("<i8", large), ("<i8", large)):
        out.append(np.frombuffer(blob, kind, k, at))
        at += out[-1].nbytes
    place, many = out[5:]
    counts = out[4]
    if large:
        counts = counts.astype(np.int64 if many.max() >= 1 << 31 else np.int32)
        counts[place] = many
    return [*out[:4], counts]


def _answer(shards: int, hot: tuple[np.ndarray, np.ndarray], discount: float):
    """For applyInArrow over a shard: build its trie of all splits' training counts, then answer every split from it.

    An answer holds, for each word asked, its count and number of successors here, and for each pair its code. The count
    is whole at the word's own shard. Split -1 gets, as pairs of numbers, what is summed over all shards: -4 to -1, tokens,
    types, types seen once and twice; from 0, the successors here of each hot context.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        splits, asked = _one(table, "split"), [_read(x.as_buffer()) for x in _one(table, "asked")]
        words, sizes, counts, pair_words, pair_counts = (np.concatenate(x) for x in zip(*asked))
        known, at = np.unique(words, return_inverse=True)
        count = np.zeros(len(known), np.int64)
        np.add.at(count, at, counts)
        home = ((known * GOLDEN >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64) == key[0].as_py()
        own = count[home & (known != START) & (count > 0)]
        sums = [own.sum(), len(own), (own == 1).sum(), (own == 2).sum()]
        # the trie: distinct trained pairs by context and word
        use = pair_counts > 0
        b, c, n = np.repeat(at.astype(np.int32), sizes)[use], pair_words[use], pair_counts[use]
        del pair_words, pair_counts, use
        order = np.lexsort((c, b))
        b, c, n = b[order], c[order], n[order]
        del order
        first = np.flatnonzero(np.concatenate((b[:1] == b[:1], (b[1:] != b[:-1]) | (c[1:] != c[:-1]))))
        n = np.add.reduceat(n, first, dtype=np.int64) if len(first) else n
        b, c = b[first], c[first]
        contexts, size = np.unique(b, return_counts=True)
        contexts = known[contexts]
        codes = np.clip(np.ceil((MOST - np.log10(np.maximum(n - discount, 1e-30))) * STEPS), 0, ABSENT - 1)
        handle, path = tempfile.mkstemp(suffix=".trie")
        os.close(handle)
        try:
            trie = Trie(path, Trie.write(path, contexts, size, c, codes))
            _, followers = trie.context(known)
            busy = np.flatnonzero(np.isin(known, hot[0]))
            places = np.concatenate((np.arange(-4, 0), np.searchsorted(hot[0], known[busy])))
            sums = np.column_stack((places, np.concatenate((sums, followers[busy])))).astype("<i8").tobytes()
            out = []
            for own_words, own_sizes, _, own_pairs, _ in asked:
                number, _ = trie.context(own_words)
                code = trie.code(np.repeat(number, own_sizes), own_pairs, ABSENT)
                place = np.searchsorted(known, own_words)
                out.append(count[place].tobytes() + followers[place].astype("<i8").tobytes() + code.astype("<u2").tobytes())
            del trie
        finally:
            os.unlink(path)
        to = pa.concat_arrays([splits, pa.array([-1], pa.int32())])
        return pa.table({"split": to, "shard": pa.array([key[0].as_py()] * len(to), pa.int32()), "answer": pa.array([*out, sums], pa.binary())})

    return run


def _score(shards: int, hot: tuple[np.ndarray, np.ndarray], discount: float, sums: dict[int, int]):
    """For applyInArrow over a split's documents and the answers it got: the scores of its documents."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        s = Split(_one(docs, "t"), _one(docs, "trained").to_numpy(zero_copy_only=False))
        count, followers = np.zeros(len(s.words), np.int64), np.zeros(len(s.words), np.int64)
        code = np.full(len(s.pairs), ABSENT, np.int64)
        dealt = s.dealt(shards, hot)
        for shard, blob in zip(_one(answers, "shard").to_pylist(), _one(answers, "answer")):
            raw, (w, p) = blob.as_buffer(), dealt[shard]
            count[w] = np.maximum(count[w], np.frombuffer(raw, "<i8", len(w)))
            followers[w] += np.frombuffer(raw, "<i8", len(w), 8 * len(w))
            code[p] = np.frombuffer(raw, "<u2", len(p), 16 * len(w))
        total, types, once, twice = (sums.get(k, 0) for k in range(-4, 0))
        place = np.minimum(np.searchsorted(hot[0], s.words), len(hot[0]) - 1)
        busy = np.flatnonzero(hot[0][place] == s.words)  # their successors are dealt over more shards than were asked
        followers[busy] = [sums.get(k, 0) for k in place[busy].tolist()]
        taken = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
        seen = count.copy()
        seen[s.words == START] = 0
        # one token: a share less the discount if known; the unknown word has what was taken
        single = np.where(seen > 0, seen - taken, taken * types) / total if total else np.ones(len(seen))
        context, word = s.pairs // max(len(s.words), 1), s.pairs % max(len(s.words), 1)
        here = np.maximum(count[context], 1)
        left = np.where(count[context] > 0, discount * followers[context] / here, 1.0)
        pair = np.where(code < ABSENT, 10.0 ** (MOST - code / STEPS) / here, 0.0) + left * single[word]
        pair_score = np.log10(np.clip(pair, 1e-300, 1.0))
        base = np.log10((seen + 0.1) / (total + 0.1 * (types + 1)))
        text = np.repeat(np.arange(len(s.ends)), np.diff(np.concatenate(([0], s.ends))))
        add = lambda x: np.bincount(text, x, len(s.ends))
        return pa.table({
            "i": _one(docs, "i"), "trained": _one(docs, "trained"),
            "n_tokens": add(np.ones(len(text))).astype(np.int64), "n_known": add(seen[s.token] > 0).astype(np.int64),
            "train_tokens": np.full(len(s.ends), total, np.int64),
            "base_score": add(base[s.token]), "score": add(pair_score[s.pair]),
        })

    return run


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over the answers to split -1: their pairs of numbers."""
    for batch in batches:
        for blob in batch.column(0):
            k, v = np.frombuffer(blob.as_py(), "<i8").reshape(-1, 2).T
            yield pa.record_batch([pa.array(k), pa.array(v)], names=["k", "v"])


def _hot_words(d: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the contexts that would fill half a shard or more, and over how many shards each is dealt."""
    part = d.where(F.pmod(F.xxhash64(F.lit(1), "i"), F.lit(HOT_PART)) == 0)
    words = part.select(F.explode(F.split(F.lower("t"), r"[\x20\x09-\x0D]+")).alias("w"))
    count = F.count("*").alias("n")
    total = (words.agg(count).first()[0] or 0) + part.count()
    rows = words.where("w <> ''").groupBy("w").agg(count).where(F.col("n") >= total / (2 * shards))
    found = {xxhash.xxh64_intdigest(w.encode()): n / max(total, 1) for w, n in rows.orderBy(F.desc("n"), "w").limit(HOT_WORDS).collect()}
    found[int(START)] = part.count() / max(total, 1)
    hashes = np.array(sorted(found), np.uint64)
    slots = [min(shards, max(1, math.ceil(2 * shards * found[int(h)]))) for h in hashes]
    return hashes, np.array(slots, np.int64)


def score_texts(
    docs: DataFrame,
    trained_on,
    discount: float = DISCOUNT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Language-model score of every whole text: id, trained, n_tokens, n_known, train_tokens, base_score, score.

    trained_on is a Boolean column over docs: the rows that the model learns from (null counts as false). Tokens are
    words, A-Z in lower case, and one end per text. The model interpolates word pairs (absolute discounting) with single
    words, an unknown word sharing one class; score is the base-10 logarithm of a text's probability, base_score that
    under add-0.1 single words. Discounted counts of pairs lie quantised, in the log domain, in a trie dealt by context: every
    split of the documents asks the shards about its distinct pairs and brings their training counts (a shard it has
    nothing for gets no message, so there are no more messages than pairs); the shard builds its part of the trie in
    memory-mapped levels, answers from it, and the split adds up its documents. Words are told apart by 64 bits of
    hash. Null and empty texts are one end. Without training text, base_score and score are 0 for an
    unknown end. Repeated rows are scored, and counted, each; null ids are kept; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("i"), F.coalesce(trained_on, F.lit(False)).alias("trained"), F.coalesce(text_col, F.lit("")).alias("t"))
    size = d.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    splits = max(LEAST_SPLITS, math.ceil(size / SPLIT_BYTES))
    hot = _hot_words(d, splits)
    d = d.withColumn("split", F.pmod(F.xxhash64("i", F.octet_length("t")), F.lit(splits)).cast("int")).repartition(splits, "split")
    asked = d.groupBy("split").applyInArrow(_ask(splits, hot), "shard int, split int, asked binary")
    answered = written(asked.groupBy("shard").applyInArrow(_answer(splits, hot, discount), "split int, shard int, answer binary"), "answers")
    told = answered.where("split = -1").select("answer").mapInArrow(_numbers, "k long, v long")
    sums = {r.k: r.v for r in told.groupBy("k").agg(F.sum("v").alias("v")).collect()}  # 4 and at most one for each hot context
    kind = d.schema["i"].dataType.simpleString()
    scored = d.groupBy("split").cogroup(answered.where("split >= 0").groupBy("split")).applyInArrow(
        _score(splits, hot, discount, sums),
        f"i {kind}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored.withColumnRenamed("i", id_col)
