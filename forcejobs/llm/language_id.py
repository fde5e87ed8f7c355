"""Language identification by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, crc_mod, text_buffers

#: Each language's automaton is built from so many bytes of its distinct labelled texts: the first by hash of the text.
SAMPLE_BYTES = 48_000
#: Of one document at most so many bytes enter the sample, so that a sample holds several documents.
SAMPLE_DOC_BYTES = 4_000
#: All languages together have so many bytes of samples at most. A byte of a sample takes up to two states of as many 4-byte
#: moves as its text has symbols, 160 bytes in Latin and 390 in Chinese script: 100 languages take 0.75 to 1.9 GB of a worker.
#: Lower it where workers have less.
TOTAL_BYTES = 4_800_000
#: Texts of the lowest hashes that hold about so many samples' bytes are sorted for the sample.
SPARE = 8
#: A text is parsed in blocks of so many bytes, all at once; a phrase goes on where its block ends.
BLOCK = 512
#: Sign bit of a transition: the phrase could not be extended and a new one starts with this byte.
NEW_PHRASE = -(1 << 31)


def _symbols() -> np.ndarray:
    """Byte to symbol: A-Z as a-z, bytes over 127 as they are, every other byte one separator."""
    table = np.zeros(256, np.uint8)
    for i in range(26):
        table[65 + i] = table[97 + i] = 1 + i
    table[128:] = 27 + np.arange(128)
    return table


SYMBOLS = _symbols()


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a string: every path from state 0 spells one of its substrings."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return moves


def parse_table(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(table, symbol column by byte, columns) of the parse over text's automaton.

    table[state * columns + column] is the next state times columns; where the automaton has no such move, it is the
    root's move with NEW_PHRASE set. Column 0 stands for symbols that the text lacks, which return to the root.
    """
    symbols = SYMBOLS[np.frombuffer(text, np.uint8)]
    present = np.unique(symbols)
    columns = len(present) + 1
    column = np.zeros(256, np.int32)
    column[present] = 1 + np.arange(len(present))
    moves = suffix_automaton(column[symbols].tolist())
    root = np.zeros(columns, np.int64)
    for c, to in moves[0].items():
        root[c] = to * columns
    table = np.tile((root | NEW_PHRASE).astype(np.int64), (len(moves), 1))
    state = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
    cols = np.fromiter((c for m in moves for c in m), np.int64, len(state))
    to = np.fromiter((t for m in moves for t in m.values()), np.int64, len(state))
    table[state, cols] = to * columns
    return table.astype(np.int32).ravel(), column[SYMBOLS].astype(np.int32), columns


def _settle(table: np.ndarray, cols: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per block, how many more phrases begin in it when it is entered in `state` and not at the root, and the state it ends in.

    Both parses are followed until they are in one state, from where on they are the same; -1 where they end so.
    """
    more, end = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
    live = np.flatnonzero(state != 0)
    true, plain = state[live], np.zeros(len(live), np.int32)
    for step in range(BLOCK):
        if not len(live):
            break
        col = cols[start[live] + step]
        a, b = table[true + col], table[plain + col]
        more[live] += (a < 0).astype(np.int64) - (b < 0)
        true, plain = a & 0x7FFFFFFF, b & 0x7FFFFFFF
        over = size[live] == step + 1
        end[live[over]] = np.where(true[over] == plain[over], -1, true[over])
        go = ~over & (true != plain)
        live, true, plain = live[go], true[go], plain[go]
    return more, end


def phrases(offsets: np.ndarray, data: np.ndarray, model: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Number of phrases of every text: each longest match with the automaton's text, plus the unfinished one.

    The blocks of all texts are parsed from the root at once. Then each is entered in the state that the one before it
    ends in, until that parse meets the first one; where it never does, the block after it is entered anew.
    """
    table, column, _ = model
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(lengths)), blocks)
    first = np.concatenate(([0], np.cumsum(blocks)))[:-1]
    number = np.arange(len(text)) - first[text]
    begin = offsets[:-1][text] + number * BLOCK
    length = np.minimum(BLOCK, offsets[1:][text] - begin)
    order = np.argsort(-length, kind="stable")
    start, size = begin[order], length[order]
    cols = column[data]
    state = np.zeros(len(start), np.int32)
    count = np.zeros(len(start), np.int64)
    live = np.searchsorted(-size, -np.arange(1, BLOCK + 1), side="right")
    for step in range(BLOCK):
        n = live[step]
        if not n:
            break
        to = table[state[:n] + cols[start[:n] + step]]
        count[:n] += to < 0
        state[:n] = to & 0x7FFFFFFF
    ends, plain = np.zeros(len(text), np.int32), np.zeros(len(text), np.int64)
    ends[order], plain[order] = state, count
    more, again = np.zeros(len(text), np.int64), np.flatnonzero(number > 0)
    alone = ends.copy()  # the state a block ends in when it is entered at the root
    while len(again):
        more[again], end = _settle(table, cols, begin[again], length[again], ends[again - 1])
        new = np.where(end < 0, alone[again], end).astype(np.int32)
        changed = again[new != ends[again]]
        ends[again] = new
        nxt = changed + 1
        nxt = nxt[nxt < len(text)]
        again = nxt[number[nxt] > 0]
    return np.bincount(text, plain + more, len(lengths)) + (lengths > 0)


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_bytes: int = SAMPLE_BYTES, doc_bytes: int = SAMPLE_DOC_BYTES, total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Bounded sample of text for each language, the same whatever the order or the layout of the rows."""
    d = labelled.select(
        F.col(lang_col).alias("lang"),
        F.xxhash64(F.col(text_col)).alias("h"),
        F.least(F.octet_length(text_col), F.lit(doc_bytes)).alias("n"),
        F.substring(text_col, 1, doc_bytes).alias("t"),
    ).where("lang is not null and t <> ''")
    # the share of a language's hashes that holds SPARE samples: only texts below it are sorted
    size = d.groupBy("lang", "h").agg(F.max("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("bytes"))
    each = min(sample_bytes, total_bytes // max(labelled.select(lang_col).distinct().count(), 1))
    near = d.join(F.broadcast(size), "lang").where(F.col("h") / 2.0**64 + 0.5 <= SPARE * each / F.col("bytes"))
    near = near.groupBy("lang", "h", "t").agg(F.max("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("h", "t")) - F.col("n")
    rows = near.withColumn("before", before).where(F.col("before") < each).select("lang", "h", "t").collect()
    parts: dict[str, list[bytes]] = {}
    for lang, _, t in sorted(rows):
        parts.setdefault(lang, []).append(t.encode()[:doc_bytes])
    return {lang: b"\n".join(x)[:each] for lang, x in parts.items()}


def identify_language(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_bytes: int = SAMPLE_BYTES,
    doc_bytes: int = SAMPLE_DOC_BYTES,
    total_bytes: int = TOTAL_BYTES,
) -> DataFrame:
    """Language of every whole text: id, lang_pred, score (0 to 1).

    Per language, a suffix automaton of a bounded sample of labelled text gives the longest match at each place of a
    parse; the whole text is cut greedily into such phrases. The phrases, times the logarithm of the sample's length,
    per byte, estimate the cross entropy; the least wins, ties by name. Every language is learned, from
    sample_bytes of its labelled texts, of each text doc_bytes at most; beyond total_bytes / sample_bytes (100) languages
    each sample shrinks. score is 1 minus the ratio
    of least to second least (1 where only one language is learned). Texts that are null or hold no letter, and all
    texts if nothing was learned, are `und` with score 0. Repeated rows each get a row; other columns are not read.
    """
    samples = {k: v for k, v in learn(labelled, id_col, text_col, lang_col, sample_bytes, doc_bytes, total_bytes).items() if v}
    sc = docs.sparkSession.sparkContext
    names = sorted(samples)
    models = sc.broadcast([(parse_table(samples[k]), math.log2(len(samples[k]) + 1)) for k in names])
    d = docs.select(
        F.col(id_col).alias("i"),
        F.col(text_col).alias("t"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                lang, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if names:
                    offsets, data = text_buffers(part.column("t"))
                    cost = np.stack([phrases(offsets, data, m) * bits for m, bits in models.value])
                    ok = part.column("letters").to_numpy(zero_copy_only=False)
                    best = cost.argmin(0)
                    low = cost.min(0)
                    rest = np.partition(cost, 1, axis=0)[1] if len(names) > 1 else np.full(len(low), np.inf)
                    lang = np.where(ok, np.array(names, object)[best], lang)
                    score = np.where(ok, 1 - low / np.maximum(rest, 1e-9), 0.0)
                yield pa.record_batch([part.column("i"), pa.array(lang, pa.string()), pa.array(score)], names=["i", "lang_pred", "score"])

    kind = d.schema["i"].dataType.simpleString()
    return d.mapInArrow(predict, f"i {kind}, lang_pred string, score double").withColumnRenamed("i", id_col)


def held_out(key: str = "doc_id"):
    """Fold of the registered query: crc32 of the id as text, modulo 4, is 2."""
    return crc_mod(F.col(key), 4) == 2
