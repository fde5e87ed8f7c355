"""Sharding by histogram sort: splitters of a key order found by counting bytes, then one exchange."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

LEAST, MOST = -(1 << 63), 1 << 63
#: Candidate boundaries of the first round, and in each open interval of a later round.
FIRST_PROBES, PROBES = 4096, 64
#: A splitter may miss its share by this part of a shard's bytes.
TOLERANCE = 0.001
#: Bytes of text that a part of a shard is laid out for; parts are what tasks number on their own.
PART_BYTES = 64 << 20


def _histogram(keys: DataFrame, key: str, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """By bin between the sorted probes, of all rows: exact bytes, rows, least and greatest key. Empty bins are absent."""
    bounds = np.array(probes, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k, size = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.argsort(k, kind="stable")
            k, size = k[order], size[order]
            bins, start = np.unique(np.searchsorted(bounds, k, side="right"), return_index=True)
            end = np.append(start[1:], len(k))
            sums = np.add.reduceat(size, start)
            yield pa.record_batch([pa.array(x) for x in (bins, sums, end - start, k[start], k[end - 1])], names=["bin", "s", "n", "a", "z"])

    rows = keys.select(key, "size").mapInArrow(count, "bin long, s long, n long, a long, z long")
    return {r[0]: r[1:] for r in rows.groupBy("bin").agg(F.sum("s"), F.sum("n"), F.min("a"), F.max("z")).collect()}


def find_splitters(keys: DataFrame, key: str, targets: list[float], tolerance: float) -> list[tuple[int, float]]:
    """For each target number of bytes, a key with about so many bytes below it, and the bytes still missing.

    Every round counts the bytes below candidate boundaries over all rows and narrows each open interval to the two
    candidates around its target. A splitter is done within tolerance, or when a single key holds the target: the
    bytes still missing then lie in several rows of that key, or there are none and the nearer side of it is taken.
    """
    known = {LEAST: 0}
    held: dict[int, tuple[int, int, int, int]] = {}  # by lower boundary, the rows up to the next one
    out: list[tuple[int, float] | None] = [None] * len(targets)
    probes = {LEAST + (MOST - LEAST) // FIRST_PROBES * i for i in range(1, FIRST_PROBES)}
    while None in out:
        ordered = sorted((probes | known.keys()) - {LEAST})
        held = {}
        bins = _histogram(keys, key, ordered)
        below = 0
        for i, low in enumerate([LEAST, *ordered]):
            known[low] = below
            if i in bins:
                held[low] = bins[i]
                below += bins[i][0]
        marks, probes = sorted(known), set()
        for j, target in enumerate(targets):
            if out[j] is not None:
                continue
            at = bisect.bisect_right(marks, target, key=known.__getitem__) - 1
            low, high = marks[at], marks[at + 1] if at + 1 < len(marks) else MOST
            best = min([low, *([high] if high < MOST else [])], key=lambda m: abs(known[m] - target))
            size, rows, least, greatest = held.get(low, (0, 0, low, low))
            if abs(known[best] - target) <= tolerance or not rows:
                out[j] = (best, 0.0)
            elif least == greatest:
                missing = target - known[low]
                out[j] = (least, missing) if rows > 1 else (least + (missing > size / 2), 0.0)
            else:
                width = greatest - least
                probes |= {least, greatest, *(least + width * i // PROBES for i in range(1, PROBES))}
    return out


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    payload: tuple[str, ...] = ("text",),
    tolerance: float = TOLERANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents in shards of near equal bytes: id, size (UTF-8 bytes of the text plus 8), shard, slot and payload.

    Rows are ordered by (hash of the text, hash of the id). Splitters of that order are refined until the bytes below
    each are within tolerance of a shard, and the payload columns then move once. Equal texts are neighbours in the
    order; a splitter may fall among them, also in a small group, where no other key holds its target. slot numbers a shard's rows from 0 without gaps, by (spread of the id and text hashes, order): a
    shard is numbered in parts of about PART_BYTES. Null texts count as empty. Rows with equal id and text are
    interchangeable, share a shard, and each has its slot; null ids hash alike. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"p{i}" for i in range(len(payload))]
    d = docs.select(
        F.col(id_col).alias("i"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.lit(1), F.col(id_col)).alias("g"),
        *[F.col(c).alias(n) for c, n in zip(payload, names, strict=True)],
    )
    keys = written(d.select("h", "g", "size"), "sizes")
    total = keys.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    targets = [total * j / shards for j in range(1, shards)]
    cuts: list[tuple[int, int]] = []
    if total:
        found = find_splitters(keys, "h", targets, allowed)
        inside = {h: [r for x, r in found if x == h and r] for h, r in found if r}
        within = {h: find_splitters(keys.where(F.col("h") == h), "g", rest, allowed) for h, rest in inside.items()}
        for h, rest in found:
            cuts.append((h, within[h].pop(0)[0] if rest else LEAST))
    shard = F.lit(0)
    for h, g in cuts:
        shard = shard + F.when((F.col("h") > h) | ((F.col("h") == h) & (F.col("g") >= g)), 1).otherwise(0)
    parts = 8
    while parts * PART_BYTES * shards < total:
        parts *= 2
    part: Column = F.pmod(F.xxhash64("g", "h"), F.lit(parts)).cast("int")
    # rows of each part before it in its shard: shards x parts counts
    sizes = keys.select(shard.alias("s"), part.alias("p")).groupBy("s", "p").count().collect()
    discard(keys)
    first, at = [0] * (shards * parts), dict.fromkeys(range(shards), 0)
    for s, p, n in sorted(map(tuple, sizes)):
        first[s * parts + p], at[s] = at[s], at[s] + n
    table = F.split(F.lit(",".join(map(str, first))), ",").cast("array<bigint>")
    d = d.withColumn("shard", shard).withColumn("part", F.col("shard") * parts + part)
    place = F.row_number().over(Window.partitionBy("part").orderBy("h", "g", "i"))
    return d.select(
        F.col("i").alias(id_col),
        "size",
        "shard",
        (F.get(table, F.col("part")) + place - 1).alias("slot"),
        *[F.col(n).alias(c) for c, n in zip(payload, names, strict=True)],
    )
