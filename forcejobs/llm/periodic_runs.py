"""Runs of periodic words: suffix trees of a text and of its reversal extend Lyndon roots to maximal repetitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_buffers, within, words

#: Fewest words of a run; a run also holds its period twice.
MIN_WORDS = 12
#: Places of an Euler tour whose least depth is kept together.
BLOCK = 16
#: Rounds that drop words without an equal stretch near them before trees are built; every number of rounds is right.
ROUNDS = 6


class SuffixTree:
    """Ukkonen's tree of symbols s, whose last symbol occurs nowhere else; children stand in order of their symbols."""

    def __init__(self, s: list[int]) -> None:
        n, base = len(s), max(s) + 1
        child: dict[int, int] = {}  # node * base + first symbol of the edge -> node below
        start, end, link, suffix = [0], [0], [0], [-1]
        node = edge = length = pending = leaves = 0
        for i, c in enumerate(s):
            pending += 1
            last = 0
            while pending:
                if not length:
                    edge = i
                key = node * base + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    suffix.append(leaves)
                    leaves += 1
                    if last:
                        link[last] = node
                        last = 0
                else:
                    first = start[below]
                    size = min(end[below], i + 1) - first
                    if length >= size:
                        node, edge, length = below, edge + size, length - size
                        continue
                    if s[first + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    child[key] = split
                    child[split * base + s[first + length]] = below
                    child[split * base + c] = split + 1
                    start += (first, i)
                    end += (first + length, n)
                    link += (0, 0)
                    suffix += (-1, leaves)
                    leaves += 1
                    start[below] = first + length
                    if last:
                        link[last] = split
                    last = split
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        below = np.fromiter(child.values(), np.int64, len(child))[order]
        del child
        first = np.searchsorted(keys[order] // base, np.arange(len(start) + 1))
        size = np.array(end, np.int64) - np.array(start, np.int64)
        self._tour(below.tolist(), first.tolist(), size.tolist(), np.array(suffix))

    def _tour(self, below: list[int], first: list[int], size: list[int], suffix: np.ndarray) -> None:
        """Euler tour: a node's length of text each time it is met, and where each suffix's leaf is met."""
        depth, met, nodes, path = [0] * len(size), [], [], [0]
        upto = first[:-1]
        while path:
            v = path[-1]
            met.append(depth[v])
            nodes.append(v)
            k = upto[v]
            if k < first[v + 1]:
                upto[v] = k + 1
                w = below[k]
                depth[w] = depth[v] + size[w]
                path.append(w)
            else:
                path.pop()
        at = suffix[np.array(nodes)]
        leaf = np.flatnonzero(at >= 0)
        self.place = np.zeros(len(leaf), np.int64)
        self.place[at[leaf]] = leaf
        met = np.array(met, np.int64)
        self.depth = np.concatenate((met, np.full(-len(met) % BLOCK, np.iinfo(np.int64).max)))
        rows = self.depth.reshape(-1, BLOCK)
        self.ahead = np.minimum.accumulate(rows, 1).ravel()
        self.behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [rows.min(1)]
        while 2 << len(self.table) - 1 <= len(rows):
            gap, low = 1 << len(self.table) - 1, self.table[-1]
            self.table.append(np.minimum(low[:-gap], low[gap:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes i and j, i <> j: the depth of their lowest common ancestor."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        found = np.minimum(self.behind[a], self.ahead[b])
        low, gap = a // BLOCK + 1, b // BLOCK - a // BLOCK - 1
        level = np.frexp(np.maximum(gap, 1).astype(float))[1] - 1
        for k in np.unique(level[gap > 0]).tolist():
            at = np.flatnonzero((gap > 0) & (level == k))
            both = np.minimum(self.table[k][low[at]], self.table[k][low[at] + gap[at] - (1 << k)])
            found[at] = np.minimum(found[at], both)
        same = np.flatnonzero(gap < 0)
        if len(same):
            x, y = a[same], b[same]
            least = self.depth[x]
            for k in range(1, BLOCK):
                least = np.minimum(least, self.depth[np.minimum(x + k, y)])
            found[same] = least
        return found


def _next_over(rank: list[int]) -> np.ndarray:
    """For each place the next one of greater rank, len(rank) where there is none."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] < r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs(symbols: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, length, period) of the maximal runs of symbols (whole numbers from 1), by start, then period.

    Each run holds a longest Lyndon word of one of two orders, the second being the first turned round, as one of its
    roots. Those words end before the next smaller (greater) suffix; extending each to both sides gives every run.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree([*symbols.tolist(), 0])
    rank = tree.place
    smaller, greater = _next_over((-rank).tolist())[:n], _next_over(rank.tolist())[:n]
    i = np.concatenate((np.arange(n), np.flatnonzero(greater <= n)))
    j = np.concatenate((smaller, greater[greater <= n]))
    right = tree.common(i, j)
    del tree
    back = SuffixTree([*symbols[::-1].tolist(), 0])
    left = back.common(n - i, n - j)
    period = j - i
    length = left + period + right
    hit = length >= np.maximum(min_words, 2 * period)
    return np.unique(np.column_stack(((i - left)[hit], length[hit], period[hit])), axis=0)


def repeating(ids: np.ndarray, owner: np.ndarray, min_words: int) -> np.ndarray:
    """Which words can lie in a run: those of stretches of min_words / 2 words that occur again in the same stretch of such.

    A run of period q has at least max(q, min_words - q) words that equal the word q later, one after another, so that each of
    its words lies in such a stretch, and the whole run in one block of them. Hashes only let more words through.
    """
    g = max(1, (min_words + 1) // 2)
    live = np.zeros(len(ids), bool)
    if len(ids) < g:
        return live
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    gram = np.zeros(len(ids) - g + 1, np.uint64)
    for k in range(g):
        gram = gram * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + len(gram)]
    at = np.flatnonzero(owner[: len(gram)] == owner[g - 1 :])
    gram, block = gram[at], owner[at]
    for turn in range(ROUNDS):
        key = (gram ^ block.astype(np.uint64) * np.uint64(0x94D049BB133111EB)) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(key, kind="stable")
        pair = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][pair]] = again[order[:-1][pair]] = True
        whole = again.all()
        at, gram = at[again], gram[again]
        # a block ends where the next repeated stretch does not touch the last one, and at the end of a text
        fresh = np.concatenate((at[:1] == at[:1], (at[1:] > at[:-1] + g) | (owner[at[1:]] != owner[at[:-1]])))
        block = np.cumsum(fresh)
        if whole and turn:
            break
    live[(at[:, None] + np.arange(g)).ravel()] = True
    return live


def _runs_of(ids: np.ndarray, live: np.ndarray, min_words: int) -> np.ndarray:
    """Runs of one text, with trees of its live words; a symbol of its own stands wherever words were left out."""
    at = np.flatnonzero(live)
    if len(at) < min_words:
        return np.zeros((0, 3), np.int64)
    gap = np.flatnonzero(at[1:] > at[:-1] + 1) + 1
    _, symbols = np.unique(ids[at], return_inverse=True)
    symbols = np.insert(symbols + 1, gap, symbols.max() + 2 + np.arange(len(gap)))
    place = np.insert(at, gap, -1)
    found = runs(symbols, min_words)
    found[:, 0] = place[found[:, 0]]
    return found


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of every whole text: id, n_words, runs (array of start, length, period by start, then period), collapsed.

    A run is a stretch of consecutive words with smallest period q (words q apart are equal) that holds at least min_words words and
    2 q, and that neither neighbouring word extends. collapsed is the text without what repeats: of each run's words
    after its first q none is kept that any run drops; words are joined by one space. Words are what ASCII white space
    separates; case and marks count. Null and empty texts have no words, no runs and an empty collapsed text; null ids
    and repeated rows are answered as they stand; an empty table gives no rows. Other columns are not read. Memory
    grows with one text's repeating words, at some 500 bytes each.
    """
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                offsets, data = text_buffers(part.column("t"))
                raw, at = data.tobytes(), offsets.tolist()
                texts = [raw[a:b].split() for a, b in zip(at, at[1:])]
                names: dict[bytes, int] = {}
                ids = np.array([names.setdefault(w, len(names)) for t in texts for w in t], np.int64)
                n = np.array([len(t) for t in texts], np.int64)
                ends = np.cumsum(n)
                live = repeating(ids, np.repeat(np.arange(len(n)), n), min_words)
                held = np.add.reduceat(np.append(live, False), ends - n) * (n > 0) if len(n) else n
                found, collapsed = [], []
                for k, (t, e) in enumerate(zip(texts, ends.tolist())):
                    own = _runs_of(ids[e - len(t) : e], live[e - len(t) : e], min_words) if held[k] else np.zeros((0, 3), np.int64)
                    found.append(own)
                    if len(own):
                        drop = np.zeros(len(t), bool)
                        drop[within(own[:, 0] + own[:, 2], own[:, 1] - own[:, 2])] = True
                        t = [w for w, gone in zip(t, drop.tolist()) if not gone]
                    collapsed.append(b" ".join(t).decode())
                flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                stops = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32))
                cols = [part.column("i"), pa.array(n), pa.ListArray.from_arrays(stops, rows), pa.array(collapsed, pa.string())]
                yield pa.record_batch(cols, names=["i", "n_words", "runs", "collapsed"])

    kind = d.schema["i"].dataType.simpleString()
    schema = f"i {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return d.mapInArrow(run, schema).withColumnRenamed("i", id_col)


def made_periodic(doc_id: Column, text: Column) -> Column:
    """Text of the registered query: of a tenth of the documents, by hash of the id, the words from one on repeat the first of them."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    w = words(text)
    n, g = F.size(w).cast("long"), F.floor(h / 10)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (g % 8 + 3))
    times = F.ceil((n - a) / p).cast("int")
    # array functions want a positive length, also where the branch is not taken
    tail = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), times))
    again = F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), F.lit(1), n.cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(again, " ")).otherwise(text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The registered query's columns of find_runs(): count, greatest run, hashes of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    d = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("b"), listed.alias("listed"), "collapsed")
    return d.select(
        id_col,
        "n_runs",
        F.col("b.s").alias("start"),
        (-F.col("b.l")).alias("length"),
        F.col("b.p").alias("period"),
        F.floor(-F.col("b.l") * 1000 / F.col("b.p")).cast("long").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
