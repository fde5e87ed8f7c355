"""SimHash near-duplicates, linked through deletion-variant signatures of fewer segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, chunks, components, discard, text_buffers, within, written

#: Words in a shingle, seed of its hash, and differing bits up to which two fingerprints link.
WORDS, SEED, BITS = 4, 42, 4
#: Runs up to this size are compared pair by pair, all runs at once.
SMALL_RUN = 8
#: Fingerprints under one signature that are compared as they stand; a larger group is cut again by exact segments.
GROUP_LIMIT = 20_000


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hash of every word shingle of a text in order; a shorter text is one shingle, one without words has none."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(w))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.array([digest(view[a:b], seed) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of one text's word shingles: a bit is 1 if it is set in over half the shingles' hashes."""
    hashes = shingle_hashes(text, words, seed)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Id `i` and signed 64-bit fingerprint `fp` of every whole text; A-Z lower-cased, null as empty."""
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                offsets, data = text_buffers(part.column("t"))
                raw, at = data.tobytes(), offsets.tolist()
                found = [fingerprint(raw[a:b], words, seed) for a, b in zip(at, at[1:])]
                yield pa.record_batch([part.column("i"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["i", "fp"])

    return d.mapInArrow(hashed, f"i {d.schema['i'].dataType.simpleString()}, fp long")


def segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments of 64 bits such that one holds at most one of so many differing bits."""
    n = bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Index rows (key, fp): for each segment, one signature with each of its bits taken out in turn.

    Two fingerprints that differ in at most one bit of a segment share the signature without that bit (or, if they
    agree there, all of them). A key names the wildcard bit (6 bits) beside the segment's other bits.
    """
    out = None
    for shift, width in segments(bits):
        mask = (1 << width) - 1
        bit = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
        d = fps.select("fp", F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask)).alias("seg"), bit.alias("bit"))
        kept = F.lit(mask).cast("long").bitwiseXOR(F.expr("shiftleft(1L, bit)"))
        clear = F.col("seg").bitwiseAND(kept)
        d = d.select((clear * 64 + F.col("bit") + shift).alias("key"), "fp")
        out = d if out is None else out.unionByName(d)
    return out


def _forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of a group's fingerprints reachable from one another: fewer than the group has members."""
    left = np.unique(fps)
    a, b = [left[:0]], [left[:0]]
    while len(left) > 1:
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            for x in queue.pop():
                near = np.bitwise_count(left ^ x) <= bits
                if near.any():
                    a.append(np.full(near.sum(), x))
                    b.append(left[near])
                    queue.append(left[near])
                    left = left[~near]
    return np.concatenate(a), np.concatenate(b)


def group_links(key: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys: every pair of a small run, a spanning forest of a longer one."""
    start = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    long = size > SMALL_RUN
    a, b = [fps[:0]], [fps[:0]]
    small = within(start[~long], size[~long])
    k, f = key[small], fps[small]
    for off in range(1, SMALL_RUN):
        hit = (k[off:] == k[:-off]) & (np.bitwise_count(f[off:] ^ f[:-off]) <= bits)
        a.append(f[:-off][hit])
        b.append(f[off:][hit])
    for s, n in zip(start[long], size[long]):
        x, y = _forest(fps[s : s + n], bits)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _linker(bits: int):
    """For mapInArrow over rows (key, fp) sorted by key: the links of every key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = group_links(key, fps, bits)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        key, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate((key, batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            done = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            yield links(key[:done], fps[:done])
            key, fps = key[done:], fps[done:]
        yield links(key, fps)

    return run


def _finer(bits: int, parts: int):
    """For mapInArrow over rows (key, fp) of large groups: `parts` exact segments of the bits outside the key's one.

    A pair within bits of each other agrees on parts - bits of them, so with more than bits of them no link is lost.
    Keys are mixed into 64 bits; a collision only adds comparisons, as links are verified.
    """
    cut = np.array([next(i for i, (s, n) in enumerate(segments(bits)) if s <= b < s + n) for b in range(64)])
    shift, width = np.array(segments(bits)).T.astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            at = cut[key & 63]
            turn = shift[at] + width[at]  # rotated right by this, the segment is on top
            rest = np.where(turn == 64, fps, fps >> (turn % 64) | fps << (64 - turn) % 64)
            free = 64 - width[at].astype(np.int64)
            for part in range(parts):
                low, high = free * part // parts, free * (part + 1) // parts
                value = rest >> low.astype(np.uint64) & (np.uint64(1) << (high - low).astype(np.uint64)) - np.uint64(1)
                mixed = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + value) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(part)
                yield pa.record_batch([pa.array(mixed.view(np.int64)), batch.column(1)], names=["key", "fp"])

    return run


def _finer_pairs(bits: int):
    """The same by every pair of bits + 2 segments: fingerprints within bits of each other agree on two of them."""
    one = _finer(bits, bits + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in one(iter([batch]))]
            for i in range(len(keys)):
                for j in range(i):
                    mixed = (keys[i] ^ keys[j] * np.uint64(0x94D049BB133111EB)) * np.uint64(0x9E3779B97F4A7C15)
                    yield pa.record_batch([pa.array(mixed.view(np.int64)), batch.column(1)], names=["key", "fp"])

    return run


def near_fingerprints(fps: DataFrame, bits: int = BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints of fps(fp) that join exactly what pairs within bits join.

    A group over group_limit is cut by bits + 1 exact segments, and what is still over it by pairs of them: of bits + 2
    segments a linked pair shares two. Groups that are larger even then hold fingerprints that agree on over half of
    their bits, and are compared by spanning forest.
    """
    index = variants(fps, bits)
    large = index.groupBy("key").count().where(F.col("count") > group_limit).select("key")
    if not large.isEmpty():
        big = index.join(large, "key", "left_semi")
        finer = big.mapInArrow(_finer(bits, bits + 1), "key long, fp long")
        still = finer.groupBy("key").count().where(F.col("count") > group_limit).select("key")
        if not still.isEmpty():
            again = finer.join(still, "key", "left_semi").select("fp").distinct()
            pairs = big.join(again, "fp", "left_semi").select("key", "fp").mapInArrow(_finer_pairs(bits), "key long, fp long")
            finer = finer.join(still, "key", "left_anti").unionByName(pairs)
        index = index.join(large, "key", "left_anti").unionByName(finer)
    return index.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(bits), "a long, b long")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    seed: int = SEED,
    bits: int = BITS,
) -> DataFrame:
    """Near-duplicate group of every document: id, fingerprint (16 hex digits), component_id, the least id reachable.

    Fingerprints link at up to `bits` differing bits. 64 bits are cut into bits // 2 + 1 segments, so two linked ones
    differ by at most one bit in some segment; equal signatures with one bit left out find them, and the whole
    fingerprints verify them. Documents of equal fingerprints are one row of that search. Texts without words (null,
    empty) have fingerprint zero, which links like any other; equal and repeated rows share a group; a null id is never
    a component_id unless its group has no other id. An empty table gives no rows. Other columns are not read.
    """
    d = written(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    least = written(d.groupBy("fp").agg(F.min("i").alias("least")), "distinct")
    roots = written(components(near_fingerprints(least.select("fp"), bits)).select(F.col("node").alias("fp"), F.col("component").alias("root")), "roots")
    linked = least.join(roots, "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    # a large group's root is one key: its name is joined under several
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = least.join(roots.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    by_fp = written(linked.join(named, ["root", "salt"]).select("fp", "component_id").unionByName(alone), "groups")
    discard(least)
    discard(roots)
    return d.join(by_fp, "fp").select(
        F.col("i").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
