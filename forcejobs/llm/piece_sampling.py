"""SentencePiece encoding by sampling from the piece lattice, and decoding. Forward filtering, backward sampling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, within

#: Sharpness of the sampling: a piece's weight is its probability to this power.
ALPHA = 0.5
SEED = 11
#: Lattice nodes that a worker remembers.
REMEMBERED = 3_000_000
#: A text falls into these; no piece of a vocabulary reaches across their borders.
_UNITS = re.compile(r" *[^ \n]+|\n| +")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: nearby numbers give unrelated ones."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _extended(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hashes of strings with one more character."""
    return _mixed((h ^ _mixed(code + np.uint64(1))) * GOLDEN + np.uint64(1))


class Lattice:
    """Pieces of a vocabulary, and the sampling tables of the text units met so far.

    A unit's nodes are its character boundaries. An edge into a node is a piece that ends there; with the total weight
    of the paths to its start (forward filtering), it bears the probability that a path through the node takes it. A
    node's edges share out the 32-bit numbers in proportion, so that drawing one picks the edge, the same everywhere.
    """

    def __init__(self, model_file: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = {i: sp.get_score(i) for i in plain}
        ranked = min(scores.values()) < -1000  # merge ranks, not log probabilities: weigh as a word's rank does
        weigh = (lambda s: -alpha * np.log1p(-s)) if ranked else (lambda s: alpha * s)
        pieces = {sp.id_to_piece(i).replace("▁", " "): i for i in plain}
        if any(re.search(r"[^ ] |\n.|.\n", p) for p in pieces):
            raise ValueError("a piece reaches across a word border")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.decoded = [b""] * n
        for p, i in pieces.items():
            self.decoded[i] = p.encode()
        for b, i in enumerate(self.byte_ids):
            self.decoded[i] = bytes([b])
        # every beginning of a piece by its hash, and the piece it is, if it is one
        self.pieces = list(pieces)
        self.own_ids = [[pieces[p]] for p in self.pieces]
        self.log_weights = np.array([weigh(scores[i]) for i in pieces.values()])
        self.longest = max(map(len, self.pieces))
        row = {p: k for k, p in enumerate(self.pieces)}
        begun = list(dict.fromkeys(p[:k] for p in self.pieces for k in range(1, len(p) + 1)))
        hashes = np.zeros(len(begun), np.uint64)
        for k in range(self.longest):
            longer = np.array([i for i, p in enumerate(begun) if len(p) > k], np.int64)
            hashes[longer] = _extended(hashes[longer], np.array([ord(begun[i][k]) for i in longer], np.uint64))
        order = np.argsort(hashes)
        self.begun, self.begun_piece = hashes[order], np.array([row.get(p, -1) for p in begun])[order]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.last = np.zeros(0, np.int64)  # by unit, its last node
        self.keys = np.zeros(0, np.uint64)  # by edge, node and least number drawn
        self.origin = np.zeros(0, np.int64)  # by edge, the node it comes from
        self.piece = np.zeros(0, np.int64)  # by edge, its row in `outs`
        self.first = np.zeros(0, bool)  # by edge, whether it comes from the unit's start
        self.nodes = 0
        self.outs = list(self.own_ids)  # the ids that an edge's piece stands for, or a character without a piece
        self.spelt: dict[int, int] = {}  # such a character's row in outs

    def _edges(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """(unit, first character in all units' text, length, row in outs, log weight) of every piece in every unit."""
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units)), size)
        end = np.cumsum(size)[unit]
        at, h, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for k in range(self.longest):
            inside = at + k < end[at]
            at, h = at[inside], h[inside]
            h = _extended(h, codes[at + k].astype(np.uint64))
            place = np.minimum(np.searchsorted(self.begun, h), len(self.begun) - 1)
            known = self.begun[place] == h
            at, h, row = at[known], h[known], self.begun_piece[place[known]]
            is_piece = row >= 0
            found.append((at[is_piece], np.full(is_piece.sum(), k + 1), row[is_piece], self.log_weights[row[is_piece]]))
        lone = np.ones(len(codes), bool)
        lone[found[0][0]] = False
        lone = np.flatnonzero(lone)
        for c in np.unique(codes[lone]).tolist():
            if c not in self.spelt:
                self.spelt[c] = len(self.outs)
                self.outs.append([self.byte_ids[b] for b in chr(c).encode()])
        rows = np.array([self.spelt[c] for c in codes[lone].tolist()], np.int64)
        found.append((lone, np.ones(len(lone), np.int64), rows, np.full(len(lone), self.log_weights.min())))
        start, length, row, weight = (np.concatenate(x) for x in zip(*found))
        return unit[start], start, length, row, weight

    def learn(self, units: list[str]) -> None:
        """Forward filtering of new units, all at once: node by node from their starts, sums in the log domain."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(size) - size
        unit, start, length, row, weight = self._edges(units)
        origin, to, depth = start + unit, start + length + unit, start + length - begin[unit]
        order = np.lexsort((origin, to, depth))
        reach, log_share = np.zeros(int(size.sum()) + len(units)), np.zeros(len(order))
        cuts = np.searchsorted(depth[order], np.arange(1, size.max() + 2))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            e = order[low:high]
            into = to[e]
            first = np.flatnonzero(np.concatenate(([True], into[1:] != into[:-1])))
            count = np.diff(np.append(first, len(e)))
            path = reach[origin[e]] + weight[e]
            top = np.maximum.reduceat(path, first)
            reach[into[first]] = top + np.log(np.add.reduceat(np.exp(path - np.repeat(top, count)), first))
            log_share[e] = path - reach[into]
        order = np.lexsort((origin, to))
        origin, to, row, share = origin[order], to[order], row[order], np.exp(log_share[order])
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        below = np.zeros(len(to))
        for k in range(1, self.longest + 1):  # each node's sums on their own, so that they never depend on others
            e = np.flatnonzero(rank == k)
            below[e] = below[e - 1] + share[e - 1]
        least = np.minimum(np.floor(below * 4294967296.0), 4294967295.0).astype(np.uint64)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.last = np.concatenate((self.last, self.nodes + begin + size + np.arange(len(units))))
        self.keys = np.concatenate((self.keys, (self.nodes + to).astype(np.uint64) << np.uint64(32) | least))
        self.origin = np.concatenate((self.origin, self.nodes + origin))
        self.piece = np.concatenate((self.piece, row))
        self.first = np.concatenate((self.first, np.isin(origin, begin + np.arange(len(units)))))
        self.nodes += len(reach)

    def sample(self, texts: list[str], row_seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids). A draw depends on the text's seed and the place in it alone."""
        if self.nodes > REMEMBERED:
            self.clear()
        units: list[str] = []
        counts = []
        for t in texts:
            own = _UNITS.findall(" " + t) if t else []
            units += own
            counts.append(len(own))
        if not units:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        if len(miss := np.flatnonzero(at < 0)):
            self.learn(list(dict.fromkeys(units[i] for i in miss.tolist())))
            at[miss] = [self.known[units[i]] for i in miss.tolist()]
        size = np.fromiter(map(len, units), np.int64, len(units))
        text = np.repeat(np.arange(len(texts)), counts)
        ends = np.cumsum(size)
        before = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))[:-1]]
        node, place, seed = self.last[at], ends - before[text], row_seeds[text]
        places, pieces, owners, owner = [], [], [], text
        where = ends
        while len(node):
            draw = _mixed(seed + GOLDEN * place.astype(np.uint64)) >> np.uint64(32)
            edge = np.searchsorted(self.keys, node.astype(np.uint64) << np.uint64(32) | draw, side="right") - 1
            places.append(where)
            pieces.append(self.piece[edge])
            owners.append(owner)
            on = ~self.first[edge]
            step = (node - self.origin[edge])[on]
            node, place, seed, owner, where = self.origin[edge][on], place[on] - step, seed[on], owner[on], where[on] - step
        order = np.argsort(np.concatenate(places), kind="stable")
        outs = np.concatenate(pieces)[order]
        owner = np.concatenate(owners)[order]
        lengths = np.fromiter(map(len, self.outs), np.int64, len(self.outs))
        pool = np.array([i for x in self.outs for i in x], np.int32)
        start = np.cumsum(lengths) - lengths
        ids = pool[within(start[outs], lengths[outs])]
        return ids, np.bincount(owner, lengths[outs], len(texts)).astype(np.int64)


_LATTICES: dict[tuple[str, float], Lattice] = {}


def _lattice(model_file: str, alpha: float) -> Lattice:
    """The worker's lattice of a vocabulary file, loaded once."""
    key = (model_file, alpha)
    if key not in _LATTICES:
        _LATTICES[key] = Lattice(model_file, alpha)
    return _LATTICES[key]


def sample_pieces(
    docs: DataFrame, model_file: str, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A sampled segmentation of every whole text: id, ids (array of piece ids).

    Every way to cut the text (with a space before it) into pieces has a probability in proportion to the product of its
    pieces' weights; one is drawn by forward filtering and backward sampling. Draws depend on seed, the row's id and the
    place in the text, so that the result is the same however the rows are dealt. A character without a piece is spelt in
    byte pieces. The text is not normalised, and decode_pieces() gives it back. An empty text has no ids, a null one null.
    Repeated rows are segmented alike; null ids seed alike. An empty table gives no rows. Other columns are not read.
    """
    d = docs.select(F.col(id_col).alias("i"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("s"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model_file, alpha)
        for batch in batches:
            for part in chunks(batch, "t", 1 << 20):
                texts = part.column("t")
                seeds = part.column("s").to_numpy(zero_copy_only=False).view(np.uint64)
                ids, n = lattice.sample(texts.fill_null("").to_pylist(), seeds)
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32(), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
                yield pa.record_batch([part.column("i"), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["i", "ids"])

    return d.mapInArrow(run, f"i {d.schema['i'].dataType.simpleString()}, ids array<int>").withColumnRenamed("i", id_col)


def decode_pieces(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of piece ids: id, text. Undoes sample_pieces(), whatever was drawn. Null ids give null, none the empty text."""
    d = encoded.select(F.col(id_col).alias("i"), F.col(ids_col).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _lattice(model_file, ALPHA).decoded
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [None if x is None else b"".join(map(table.__getitem__, x))[1:].decode() for x in part.column("x").to_pylist()]
                yield pa.record_batch([part.column("i"), pa.array(texts, pa.string())], names=["i", "text"])

    return d.mapInArrow(run, f"i {d.schema['i'].dataType.simpleString()}, text string").withColumnRenamed("i", id_col)


