"""Near-duplicate vectors: a forest of random-projection trees with spill proposes pairs, cosine verifies them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, components, discard, written

#: Cosine from which two vectors link.
COSINE = 0.93
#: Trees, and half the width of the band around a split whose vectors go to both sides, for vectors of length 1 and 64
#: dimensions: the band narrows with the square root of the dimension, as the lengths along a direction do.
TREES, SPILL = 8, 0.02
#: Vectors of the largest label that a leaf is laid out for, and depth beyond which a tree does not grow.
LEAF, DEEPEST = 32, 16
#: A tree deeper than this has a narrower band in proportion, so that copies of a vector do not multiply with depth.
WIDE_DEPTH = 6
#: Splits are fitted on about so many distinct vectors, those of the lowest hashes. Every vector is indexed.
SAMPLE = 20_000
#: A tree draws the directions of its splits from so many, so that what is broadcast has a bound: 8 x 128 vectors and
#: 8 x 65,535 thresholds for each dimension of the vectors.
DIRECTIONS = 128
#: A leaf with more vectors is compared as pairs of blocks of about this size.
BLOCK = 2048
SEED = 17


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of little-endian floats, of 4 or 8 bytes each, as unit vectors in double precision."""
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, "<f8" if len(raw) == 8 * dim * len(column) else "<f4").reshape(-1, dim).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """A full binary tree of random directions with sample medians as thresholds. A node without a sample has its parent's."""

    def __init__(self, sample: np.ndarray, depth: int, seed: list[int]):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.pool = rng.standard_normal((DIRECTIONS, sample.shape[1]))
        self.pool /= np.linalg.norm(self.pool, axis=1, keepdims=True)
        nodes = (1 << depth) - 1
        self.direction, self.thresholds = rng.integers(0, DIRECTIONS, nodes), np.zeros(nodes)
        members = [np.arange(len(sample))]
        for n in range(nodes):
            own = members[n]
            along = sample[own] @ self.pool[self.direction[n]]
            self.thresholds[n] = np.median(along) if len(own) else 0.0
            left = along < self.thresholds[n]
            for part in (own[left], own[~left]):
                members.append(part if len(part) else own)
            members[n] = own[:0]

    def route(self, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf a row reaches; within spill of a threshold it goes both ways."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        spill *= min(1.0, WIDE_DEPTH / max(self.depth, 1)) * math.sqrt(64 / x.shape[1])
        along = x @ self.pool.T if self.depth else None
        for _ in range(self.depth):
            side = along[row, self.direction[node]] - self.thresholds[node]
            left, right = side < spill, side >= -spill
            row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        return row, node


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null or empty, every component finite, and not all of them zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _met_before(codes: list[np.ndarray], here: int) -> np.ndarray:
    """Incidence of rows with the cells before this one that two rows at least are in."""
    flat = np.concatenate(codes)
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    early = flat < here
    cell, number, size = np.unique(flat[early], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(size[number] > 1)
    place = np.cumsum(size > 1) - 1
    out = np.zeros((len(codes), int((size > 1).sum())), np.float32)
    out[row[early][shared], place[number[shared]]] = 1
    return out


def _tree_of_links(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the row it was reached from (itself where it is a first one)."""
    n = len(near)
    parent, left = np.arange(n), np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(near[at] & left)
            parent[new], left[new] = at, False
            queue.extend(new.tolist())
    return parent


def _links_of(n, copies, block, p: int, q: int, cell: int, cells: pa.Array, x: np.ndarray, cosine: float) -> pa.RecordBatch:
    """Of a leaf, or two blocks of one: per vector, the copies it links to here and one link that joins it.

    A pair counts in the first cell where both meet, so that the counts of all cells add up; the links that are given
    join what all pairs of the cell join, and are fewer than its vectors.
    """
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if p != q:
        near &= block[:, None] != block[None, :]
    keep, links, parent = np.zeros(len(n), bool), np.zeros(len(n), np.int64), np.arange(len(n))
    if near.any():
        parent = _tree_of_links(near)
        met = _met_before([c.values.to_numpy() for c in cells], cell)
        links = ((near & ~(met @ met.T > 0) if met.shape[1] else near) @ copies).astype(np.int64)
        keep = (links > 0) | (parent != np.arange(len(n)))
    return pa.record_batch([pa.array(n[keep]), pa.array(links[keep]), pa.array(n[parent[keep]])], names=["a", "links", "b"])


def _compare(cosine: float):
    """For mapInArrow over rows sorted by cell and blocks: the links of every cell, one cell in memory at a time."""

    def cell_links(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        number = {c: table.column(c).to_numpy() for c in ("n", "copies", "block")}
        p, q, cell, dim = (table.column(c)[0].as_py() for c in ("p", "q", "cell", "dim"))
        cells = pa.concat_arrays(table.column("cells").chunks)
        x = _matrix(pa.concat_arrays(table.column("x").chunks), dim)
        return _links_of(number["n"], number["copies"], number["block"], p, q, cell, cells, x, cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            gid = batch.column("gid").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(gid[1:] != gid[:-1]) + 1).tolist(), len(gid)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and gid[a] != last:
                    yield cell_links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = gid[a]
        if held:
            yield cell_links(pa.Table.from_batches(held))

    return run


def near_links(reps: DataFrame, cosine: float, trees: int, spill: float, seed: int, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Rows (a, links, b) of reps(n, copies, label, dim, x): per vector and cell, counted links, and a link (or a itself)."""
    sizes = reps.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("all")).collect()
    forest = {}
    for dim, most, every in sizes:
        # by a share of the hashes: what tasks send to the driver does not grow with their number
        low = F.xxhash64(F.lit(seed), "h", "g") / 2.0**64 + 0.5 <= 1.1 * SAMPLE / every
        rows = reps.where((F.col("dim") == dim) & low).orderBy("h", "g").select("x").collect()
        sample = _matrix(pa.array([bytes(r[0]) for r in rows], pa.binary()), dim)
        depth = min(DEEPEST, max(0, math.ceil(math.log2(max(most, 1) / leaf))))
        forest[dim] = [Tree(sample, depth, [seed, dim, t]) for t in range(trees)]
    shared = reps.sparkSession.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = _matrix(own.column("x"), int(dim))
                found = [tree.route(x, spill) for tree in shared.value[int(dim)]]
                row = np.concatenate([r for r, _ in found])
                cell = np.concatenate([t << DEEPEST + 1 | at for t, (_, at) in enumerate(found)]).astype(np.int32)
                order = np.lexsort((cell, row))
                row, cell = row[order], cell[order]
                size = np.bincount(row, minlength=len(x))
                cells = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(cell))
                for at in range(0, len(row), 8192):
                    part = pa.array(row[at : at + 8192])
                    yield pa.record_batch(
                        [*own.take(part).columns, cells.take(part), pa.array(cell[at : at + 8192])], names=[*own.schema.names, "cells", "cell"]
                    )

    kind = reps.schema["label"].dataType.simpleString()
    routed = reps.select("n", "copies", "label", "dim", "x").mapInArrow(
        route, f"n long, copies long, label {kind}, dim int, x binary, cells array<int>, cell int"
    )
    key = ["dim", "label", "cell"]
    blocks = routed.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    d = routed.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    d = d.withColumn("gid", F.xxhash64(*key, "p", "q")).repartition(*key, "p", "q").sortWithinPartitions(*key, "p", "q")
    return d.drop("label").mapInArrow(_compare(cosine), "a long, links long, b long")


def embedding_groups(
    vectors: DataFrame,
    cosine: float = COSINE,
    trees: int = TREES,
    spill: float = SPILL,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    leaf: int = LEAF,
    block: int = BLOCK,
) -> DataFrame:
    """Near-duplicate vectors: id, n_links (other vectors linked directly), component_id, kept (it is the least id).

    Vectors link if their labels are equal and not null and their cosine, in double precision, is at least `cosine`.
    A forest of trees that split at random directions, both sides keeping what lies within spill of the split, is
    fitted on a bounded sample and indexes every vector; those that share a leaf of any tree are compared, so a link
    may be missed with a small probability and none is wrong. Exact copies are one vector of the search and all count.
    Vectors that are null, empty, zero or hold a null or non-finite component, or whose label or id is null, link with
    nothing. Vectors of unlike dimension do not link. The search goes by vector, so several vectors may share an id:
    each row has its own links. Repeated rows count as copies. An empty table gives no rows.
    """
    double = vectors.schema[vector_col].dataType.simpleString() != "array<float>"
    d = vectors.select(F.col(id_col).alias("i"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>" if double else "array<float>").alias("v"))
    ok = usable(F.col("v")) & F.col("label").isNotNull() & F.col("i").isNotNull()
    d = d.withColumn("h", F.when(ok, F.xxhash64("label", "v"))).withColumn("g", F.when(ok, F.xxhash64(F.lit(1), "v", "label")))
    copies = d.where("h is not null").groupBy("h", "g").agg(
        F.min("i").alias("i"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = b.column("v").flatten().to_numpy(zero_copy_only=False), b.column("v").value_lengths().to_numpy()
            ends = np.cumsum(offsets)
            x = [values[e - n : e].astype("<f8" if double else "<f4").tobytes() for e, n in zip(ends.tolist(), offsets.tolist())]
            cols = [b.column(c) for c in ("h", "g", "i", "copies", "label")]
            yield pa.record_batch([*cols, pa.array(offsets.astype(np.int32)), pa.array(x, pa.binary())], names=["h", "g", "i", "copies", "label", "dim", "x"])

    kind = d.schema["label"].dataType.simpleString()
    reps = copies.mapInArrow(packed, f"h long, g long, i long, copies long, label {kind}, dim int, x binary")
    reps = written(reps.withColumn("n", F.monotonically_increasing_id()), "vectors")
    found = written(near_links(reps, cosine, trees, spill, seed, leaf, block), "links")
    linked = found.groupBy("a").agg(F.sum("links").alias("others")).withColumnRenamed("a", "n")
    groups = components(found.select("a", "b").where("a <> b")).select(F.col("node").alias("n"), F.col("component").alias("root"))
    own = reps.select("n", "h", "g", "i", "copies").join(linked, "n", "left").join(groups, "n", "left")
    own = own.withColumn("root", F.coalesce("root", "n"))
    named = own.groupBy("root").agg(F.min("i").alias("component"))
    # a large group's root is one key: its name is joined under several
    salt = F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int")
    many = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = own.withColumn("salt", salt).join(many, ["root", "salt"]).select(
        "h", "g", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"
    )
    told = written(told, "named")
    discard(found)
    discard(reps)
    # vectors that link with nothing do not meet under one null key
    alone = d.where("h is null").select("i", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    alone = alone.withColumn("component", F.col("component").cast(d.schema["i"].dataType))
    out = d.where("h is not null").select("i", "h", "g").join(told, ["h", "g"], "left").select("i", "n_links", "component").unionByName(alone)
    component = F.coalesce("component", "i")
    return out.select(
        F.col("i").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("i") == component, F.lit(True)).alias("kept"),
    )
