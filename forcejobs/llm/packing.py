"""Best-fit packing: documents as token pieces in sequences, placed by the sum-of-squares rule."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import within, written

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END_ID = 1024, 2
#: Pieces that one task packs: between these, about a 32nd of all.
LEAST_GROUP, MOST_GROUP = 2048, 65536
#: Words whose ids a worker remembers.
REMEMBERED = 1_500_000
#: New words that are encoded at a time, one to a line.
LINES = 2000


class Encoder:
    """Token ids of texts. Words between single spaces or newlines are encoded once and then looked up.

    The pre-tokenizer of a byte-level vocabulary never joins characters across such a boundary (a space belongs to the
    word after it), nor does a special token, so a text's ids are those of its words. Texts with other white space are
    encoded as they stand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.line_end = self.encoder.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.offsets, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, number of each one's ids)."""
        found = [x.ids for x in self.encoder.encode_batch_fast(units, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    def _lines(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words, encoded as the lines of one text: a call costs more than a word."""
        ids, _ = self._each(["\n".join(units)])
        if len(self.line_end) == 1:
            breaks = np.flatnonzero(ids == self.line_end[0])
            if len(breaks) == len(units) - 1:
                return np.delete(ids, breaks), np.diff(np.concatenate(([-1], breaks, [len(ids)]))) - 1
        return self._each(units)

    def learn(self, units: list[str]) -> None:
        words = [u for u in units if "\n" not in u and u[-1:] != " " and len(u.split()) == 1]
        if len(words) < len(units):
            known = set(words)
            rest = [u for u in units if u not in known]
            units = words + rest
            found = [self._each(rest)]
        else:
            found = []
        found = [self._lines(words[i : i + LINES]) for i in range(0, len(words), LINES)] + found
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(np.concatenate([n for _, n in found]))))
        self.pool = np.concatenate((self.pool, *[ids for ids, _ in found]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ends of the texts among them)."""
        if len(self.known) > REMEMBERED:
            self.clear()
        units: list[str] = []
        counts = []
        for t in texts:
            if " ".join(t.split()) == t.replace("\n", " ") and "\x01" not in t:
                own = t.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01") if t else []
            else:
                own = [t]
            units += own
            counts.append(len(own))
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        if len(miss := np.flatnonzero(at < 0)):
            self.learn(list(dict.fromkeys(units[i] for i in miss.tolist())))
            at[miss] = [self.known[units[i]] for i in miss.tolist()]
        start = self.offsets[at]
        size = self.offsets[at + 1] - start
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        return self.pool[within(start, size)], ends


def pieces(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Token pieces of every whole text: `i` (its id), piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and end_id (a null or empty text is end_id alone). One over length tokens is cut into pieces
    of length tokens, the first one shorter.
    """
    d = docs.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            texts = batch.column("t")
            for a in range(0, batch.num_rows, 512):
                part = texts.slice(a, 512).to_pylist()
                ids, ends = encoder.encode(part)
                starts = np.concatenate(([0], ends[:-1]))
                rows: list[tuple] = []
                for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
                    own = np.append(ids[s:e], np.int32(end_id)).astype("<i4")
                    first = (len(own) - 1) % length + 1
                    edges = [0, *range(first, len(own) + 1, length)]
                    for n, (x, y) in enumerate(zip(edges, edges[1:])):
                        raw = own[x:y].tobytes()
                        rows.append((a + k, n, x, y - x, zlib.crc32(raw), raw if with_ids else None))
                at, n, x, size, crc, raw = zip(*rows)
                out = [batch.column("i").take(pa.array(at)), pa.array(n, pa.int32()), pa.array(x, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array(raw, pa.binary()))
                yield pa.record_batch(out, names=["i", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = d.schema["i"].dataType.simpleString()
    return d.mapInArrow(cut, f"i {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, long ones first, by the sum-of-squares rule.

    An open sequence's gap is what it has left. A piece goes to the gap g that makes the sum over gaps of the squared
    number of open sequences least (the smallest such gap on ties); a sequence is opened only when none has room.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        gap = capacity
        if s < capacity:
            here = counts[s:capacity]
            change = 1 - 2 * here + 2 * counts[: capacity - s] + 1
            change[0] -= 2 * counts[0] + 1  # a filled sequence has no gap
            j = int(np.where(here > 0, change, np.iinfo(np.int64).max).argmin())
            if here[j] > 0:
                gap = s + j
        if gap == capacity:
            at, n = n, n + 1
        else:
            at = open_at[gap].pop()
            counts[gap] -= 1
        sequence[i], offset[i] = at, capacity - gap
        if gap > s:
            open_at[gap - s].append(at)
            counts[gap - s] += 1
    return sequence, offset


def pack(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rows (with the columns of pieces(), each piece of 1 to length tokens, from a written table) plus sequence_id and offset.

    Full pieces are sequences of their own and are not grouped. The others are dealt to groups by hash, equal rows too,
    and each group is packed by itself; group sizes grow with the input up to MOST_GROUP, so that what a group leaves
    open stays a small part of it.
    """
    part = rows.where(F.col("length") < length)
    n = part.count()
    groups = max(1, n // min(MOST_GROUP, max(LEAST_GROUP, n // 32)))
    keyed = part.withColumn("row", F.monotonically_increasing_id())
    keyed = keyed.withColumn("grp", F.pmod(F.xxhash64("i", "piece", "ids_crc32", "row"), F.lit(groups)))
    schema = rows.schema.add("sequence_id", "long").add("offset", "long")

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "piece", "start", "row"], kind="stable", ignore_index=True).drop(columns=["grp", "row"])
        at, offset = place(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=at * groups + int(key[0]), offset=offset)

    whole = rows.where(F.col("length") >= length).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    whole = whole.withColumn("offset", F.lit(0).cast("long"))
    return keyed.groupBy("grp").applyInPandas(packed, schema).unionByName(whole)


def pack_documents(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every document's pieces with their place: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null and empty texts are the end id alone. Repeated rows are each packed. Null ids are kept. An empty table gives
    no rows. sequence_id is any number; a sequence's pieces have offsets without gaps from 0. Other columns are not read.
    """
    cut = written(pieces(docs, tokenizer, length, end_id, with_ids, id_col, text_col), "pieces")
    return pack(cut, length).withColumnRenamed("i", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pack_documents(with_ids=True): sequence_id and its ids, little-endian 32-bit."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


