"""Near copies by the Jaccard similarity of word shingles: op8's links and MinHash bands are candidates, the sets verify each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, chunks, components, discard, text_buffers, written
from .simhash import SEED, fingerprint, near_fingerprints, shingle_hashes

#: Words in a shingle, and the similarity (parts of FIFTHS of 5) from which two texts are near copies.
WORDS, FIFTHS = 5, 4
#: Bands and minima in a band: of pairs at similarity 0.8, 1 - (1 - 0.8 ** 4) ** 16 = 0.9998 share a band.
BANDS, ROWS = 16, 4
#: In a band a text's candidates are all before it while they are fewer than WHOLE, and the last NEXT after that.
WHOLE, NEXT = 16, 2
#: In a larger band whose texts are not yet one group, texts of different groups are compared by all their minima: at
#: similarity 0.8 a pair shares LIKE of them with probability 0.998. A band of over SKETCHED texts is cut before: each of
#: its texts has FINER keys of two more minima, so that of pairs at 0.8 1 - (1 - 0.8 ** 2) ** 6 = 0.998 share a cut. What
#: LEVELS cuts leave over SKETCHED is compared whole, by pairs of blocks.
LIKE, SKETCHED, FINER, LEVELS = 42, 1024, 6, 4

_MULTIPLY, _ADD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Low 32 bits of every minimum (a column each) of sets that stand one after another in hashes; no set is empty."""
    out = np.zeros((len(starts), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat(_mixed(hashes * _MULTIPLY[k] + _ADD[k]), starts) & np.uint64(0xFFFFFFFF)
    return out.view(np.int32)


def _set_hash(flat: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of every set among those that stand one after another in flat; no set is empty."""
    return _mixed(np.add.reduceat(_mixed(flat), starts) + size.astype(np.uint64)).view(np.int64)


def signatures(docs: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """row, i, hash `u` and size `n` of the text's set of shingles, fingerprint `fp` of op8, and minima (none without words)."""
    d = docs.select(F.col(key).alias("row"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                offsets, data = text_buffers(part.column("t"))
                raw, at = data.tobytes(), offsets.tolist()
                sets = [np.unique(shingle_hashes(raw[a:b], WORDS)) for a, b in zip(at, at[1:])]
                size = np.array([len(x) for x in sets], np.int64)
                u = np.zeros(len(sets), np.int64)
                least: list = [[] for _ in sets]
                held = np.flatnonzero(size)
                if len(held):
                    flat = np.concatenate(sets)
                    starts = np.concatenate(([0], np.cumsum(size[held])[:-1]))
                    u[held] = _set_hash(flat, starts, size[held])
                    for i, k in zip(held.tolist(), minima(flat, starts).tolist()):
                        least[i] = k
                fp = np.array([fingerprint(raw[a:b]) for a, b in zip(at, at[1:])], np.uint64).view(np.int64)
                cols = [part.column("row"), part.column("i"), pa.array(u), pa.array(size), pa.array(fp), pa.array(least, pa.list_(pa.int32()))]
                yield pa.record_batch(cols, names=["row", "i", "u", "n", "fp", "minima"])

    kind = d.schema["i"].dataType.simpleString()
    return d.mapInArrow(run, f"row long, i {kind}, u long, n long, fp long, minima array<int>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(u, set) of texts(t), each with words: hashes of the distinct shingles, and the hash of their set by `signatures`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                offsets, data = text_buffers(part.column("t"))
                raw, at = data.tobytes(), offsets.tolist()
                sets = [np.unique(shingle_hashes(raw[a:b], WORDS)) for a, b in zip(at, at[1:])]
                size = np.array([len(x) for x in sets], np.int64)
                u = _set_hash(np.concatenate(sets), np.cumsum(size) - size, size)
                yield pa.record_batch([pa.array(u), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["u", "set"])

    return texts.select("t").mapInArrow(run, "u long, set array<long>")


def with_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of table whose `row` is among rows(row), which are sent as bitmaps, a bit for each row of the table.

    So the table itself is not shuffled, however many rows are asked for; 12 million rows are 1.5 MB of bitmaps.
    """
    place = F.col("row") + 1  # parts number their rows from a multiple of 2 ** 33
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    bits = rows.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    held = table.select(F.struct(*table.columns).alias("held"), bucket.alias("bucket"), bit.alias("bit")).join(F.broadcast(bits), "bucket")
    return held.where(F.getbit(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1).select("held.*")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows (key, u, n) sorted by key: candidate pairs (a, b), and keys (large) of over WHOLE rows.

    Sets whose sizes alone keep their similarity under 0.8 are no candidates. Only the last WHOLE - 1 rows are held.
    """
    key = u = n = place = np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        old = len(key)
        key, u, n = (np.concatenate((x, c.to_numpy(zero_copy_only=False))) for x, c in zip((key, u, n), batch.columns))
        fresh = np.concatenate((key[:1] == key[:1], key[1:] != key[:-1]))
        start = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        begun = place[0] if old else 0  # place in its run of the first row held
        place = np.arange(len(key)) - start + np.where(start == 0, begun, 0)
        a, b = [u[:0]], [u[:0]]
        for off in range(1, WHOLE):
            hit = (key[off:] == key[:-off]) & ((place[off:] < WHOLE) | (off <= NEXT))
            hit &= 5 * np.minimum(n[off:], n[:-off]) >= FIFTHS * np.maximum(n[off:], n[:-off])
            hit[: max(0, old - off)] = False  # both rows were held before
            a.append(u[:-off][hit])
            b.append(u[off:][hit])
        a, b = np.concatenate(a), np.concatenate(b)
        large = key[old:][place[old:] == WHOLE]
        ends = pa.nulls(len(large), pa.int64())
        cols = [pa.concat_arrays([pa.array(x), ends]) for x in (np.minimum(a, b), np.maximum(a, b))]
        yield pa.record_batch([*cols, pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(large)])], names=["a", "b", "large"])
        key, u, n, place = (x[1 - WHOLE :] for x in (key, u, n, place))


def shingle_set(text: str | None, words: int = WORDS) -> set[bytes]:
    """A text's distinct shingles; A-Z lower-cased, a shorter text is one shingle."""
    w = (text or "").encode().lower().split()
    k = min(words, len(w))
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more."""
    d = pairs.join(sets.select(F.col("u").alias("a"), F.col("set").alias("x")), "a")
    d = d.join(sets.select(F.col("u").alias("b"), F.col("set").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return d.select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("n")).where(f"5 * both >= {FIFTHS} * (n - both)").select("a", "b")


def _print_pairs(prints: DataFrame) -> DataFrame:
    """Candidates from prints(fp, u): sets of one fingerprint, and those of fingerprints that op8 links."""
    # a fingerprint of many sets is one key: its first set is joined under several
    firsts = prints.groupBy("fp").agg(F.min("u").alias("b"))
    many = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
    same = salted.join(many, ["fp", "salt"]).where("u <> b").select(F.col("u").alias("a"), "b")
    near = near_fingerprints(firsts.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    near = near.join(firsts.select(F.col("fp").alias("x"), F.col("b").alias("a")), "x").join(firsts.select(F.col("fp").alias("y"), "b"), "y").select("a", "b")
    both = same.unionByName(near)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _cut(index: DataFrame, level: int) -> DataFrame:
    """Rows under FINER keys each, of two more minima that no earlier level of their band took."""
    out = []
    for j in range(FINER):
        # minima of a level lie 2 * FINER after those of the one before, the band's own are the first ROWS
        at = [F.get("minima", (F.col("band") * ROWS + ROWS + (2 * FINER * (level - 1) + 2 * j + k)) % (BANDS * ROWS)) for k in (0, 1)]
        out.append(F.xxhash64(F.lit(level), F.lit(j), "key", *at))
    return index.select(F.explode(F.array(*out)).alias("key"), "band", "u", "n", "minima", "root")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 0.8 or more."""
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 5 * both >= FIFTHS * (len(x) + len(y) - both)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows (key, u, root, side, minima, set) sorted by key: verified links between different roots.

    A row is compared with all rows of its key before it that have another side, or no side (-1): by size and minima, then
    by the sets. A key has about SKETCHED rows at most.
    """
    held: list = [None]
    for batch in batches:
        if not batch.num_rows:
            continue
        key, u, root, side = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        sketch = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(key), -1)
        ends, values = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy(zero_copy_only=False).view(np.uint64)
        n = np.diff(ends)
        starts = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
        a, b = [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
            sets = [values[ends[k] : ends[k + 1]] for k in range(s, e)]
            own = [u[s:e], root[s:e], n[s:e], sketch[s:e], side[s:e]]
            before, old_sets = (held[1:6], held[6]) if held[0] == key[s] else ([x[:0] for x in own], [])
            both, both_sets = [np.concatenate(x) for x in zip(before, own)], old_sets + sets
            first, known = len(old_sets), {}
            for at in range(0, e - s, 256):
                upto = min(at + 256, e - s)
                old = [x[: first + upto] for x in both]
                new = [x[at:upto] for x in own]
                fits = (new[1][:, None] != old[1]) & (5 * np.minimum(new[2][:, None], old[2]) >= FIFTHS * np.maximum(new[2][:, None], old[2]))
                fits &= np.arange(first + upto) < np.arange(first + at, first + upto)[:, None]
                fits &= (new[4][:, None] < 0) | (new[4][:, None] != old[4])
                if not fits.any():
                    continue
                shared = np.zeros(fits.shape, np.uint8)
                for k in range(sketch.shape[1]):
                    shared += new[3][:, k, None] == old[3][None, :, k]
                for x, y in zip(*(v.tolist() for v in np.nonzero(fits & (shared >= LIKE)))):
                    pair = (new[1][x], old[1][y])
                    if pair not in known and _linked(both_sets[y], sets[at + x]):
                        known[pair] = known[pair[::-1]] = True  # one link joins two groups
                        a.append(new[0][x])
                        b.append(old[0][y])
            held = [key[s], *(x.copy() for x in both), [x.copy() for x in both_sets]] if e == len(key) else [None]
        yield pa.record_batch([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])


def _blocks(rest: DataFrame) -> DataFrame:
    """Rows of keys of any size under a key for each pair of blocks, and the side they have in it: each two rows of a key
    meet once, so that nothing of a key is left out and no task holds much over SKETCHED rows."""
    n = F.ceil(F.col("rows") / (SKETCHED // 2)).cast("int")
    d = rest.withColumns({"n": n, "own": F.pmod(F.xxhash64(F.lit(LEVELS), "u"), n).cast("int")})
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    return d.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "u", "root", side.alias("side"), "minima")


def _across_groups(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links between different roots in rest(key, band, u, n, minima, root); keys that hold one alone are left."""
    out, held = None, []
    for level in range(1, LEVELS + 2):
        sizes = rest.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        rest = written(rest.join(sizes.select("key", "rows"), "key"), "rest")
        held.append(rest)
        last = level > LEVELS
        large = F.col("rows") > SKETCHED
        near = rest.where(~large).select("key", "u", "root", F.lit(-1).alias("side"), "minima")
        if last:
            near = near.unionByName(_blocks(rest.where(large)))
        near = near.join(sets, "u").select("key", "u", "root", "side", "minima", "set").repartition("key")
        near = near.sortWithinPartitions("key", F.xxhash64("key", "u"), "u")
        found = written(near.mapInArrow(_alike, "a long, b long").distinct(), "alike")
        out = found if out is None else out.unionByName(found)
        held.append(found)
        far = rest.where(large)
        if last or far.isEmpty():
            break
        rest = _cut(far, level)
    links = written(out.distinct(), "links")
    for table in held:
        discard(table)
    return links


def near_copy_links(units: DataFrame, sets_of, prints: DataFrame | None = None) -> DataFrame:
    """Verified links (a, b) between units(u, n, minima), which join what pairs of a similarity of 0.8 or more join.

    sets_of gives (u, set) of a table of u. Every link is verified. In a band of over WHOLE texts each is linked to those
    before it in an order of the band's own, so that a tight group becomes one; where a band holds several groups after
    that, texts of different ones are compared by all their minima.
    """
    own = F.array(*(F.xxhash64(F.lit(b), *(F.get("minima", F.lit(b * ROWS + k)) for k in range(ROWS))) for b in range(BANDS)))
    index = units.where("n > 0").select(F.posexplode(own).alias("band", "key"), "u", "n", "minima")
    # each key has an order of its own: what one key's last few miss, another's meet
    ordered = index.select("key", "u", "n").repartition("key").withColumn("at", F.xxhash64("key", "u"))
    ordered = ordered.sortWithinPartitions("key", "at", "u").select("key", "u", "n")
    found = written(ordered.mapInArrow(_candidates, "a long, b long, large long"), "candidates")
    pairs = found.where("large IS NULL").select("a", "b")
    if prints is not None:
        pairs = pairs.unionByName(_print_pairs(prints))
    # sets are sent only for pairs that share enough minima
    sketch = units.where("n > 0").select("u", "minima")
    pairs = written(pairs.distinct(), "pairs")
    like = pairs.join(sketch.select(F.col("u").alias("a"), F.col("minima").alias("x")), "a")
    like = like.join(sketch.select(F.col("u").alias("b"), F.col("minima").alias("y")), "b")
    shared = F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda same: same))
    like = written(like.where(shared >= LIKE).select("a", "b"), "like")
    large = written(found.where("large IS NOT NULL").select(F.col("large").alias("key")).distinct(), "large")
    members = written(index.select("key", "band", "u").join(large, "key"), "large_bands")
    wanted = like.select(F.explode(F.array("a", "b")).alias("u")).unionByName(members.select("u")).distinct()
    sets = written(sets_of(wanted), "sets")
    links = written(_verified(like, sets), "links")
    if not large.isEmpty():
        roots = components(links).withColumnRenamed("node", "u")
        # minima follow only the texts of large bands
        rest = members.join(roots, "u", "left").withColumn("root", F.coalesce("component", "u")).drop("component")
        links = links.unionByName(_across_groups(rest.join(units.select("u", "n", "minima"), "u"), sets))
    for table in (found, pairs, like, large, members, sets):
        discard(table)
    return links


def one_of_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without the near copies of another: of each group the row of the least id (null last) stays.

    Texts link where their sets of five-word shingles have a Jaccard similarity of at least 0.8; groups are what links
    join. Candidates share a MinHash band, or are linked by op8 (fingerprints at 4 bits or fewer); the sets themselves
    verify each. Texts of one set are one row of the search. Rows are told apart by a key that is written down once, so
    ids may be null, repeated or shared, and other columns may have any name. Texts without words are one group. Columns
    and rows come back as they are; an empty table gives no rows.
    """
    keyed = written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    texts = keyed.select("row", F.col("doc")[id_col].alias("i"), F.col("doc")[text_col].alias("t"))
    found = written(signatures(texts, "row", "i", "t"), "signatures")
    least = F.min(F.struct(F.col("i").isNull().alias("none"), "i", "row")).alias("least")
    units = written(found.groupBy("u").agg(least, F.first("n").alias("n"), F.first("minima").alias("minima")), "units")

    def sets_of(wanted: DataFrame) -> DataFrame:
        # one text of each set; the set tells its own hash again, so no text is shuffled
        return shingle_sets(with_rows(texts, units.join(wanted, "u").select("least.row")))

    links = near_copy_links(units, sets_of, found.select("fp", "u").where("u <> 0").distinct())
    joined = units.join(components(links).withColumnRenamed("node", "u"), "u", "left").select(F.coalesce("component", "u").alias("root"), "least")
    kept = written(joined.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("row")), "kept")
    for table in (found, units, links):
        discard(table)
    return with_rows(keyed, kept).select("doc.*")
