"""Quality classifier: a linear-chain conditional random field labels lines, their marginals score the document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_buffers

#: The field is fitted on at most so many labelled documents, the first by hash of the id, and on so many lines of them: a
#: document is taken with all its lines, or left out where they no longer fit.
TRAIN_DOCS, TRAIN_LINES = 4000, 200_000
#: Steps and rate of the fit, and the weight of its L2 penalty.
STEPS, RATE, PENALTY = 150, 0.1, 1e-3
#: Kinds of byte that a line's features count.
SYMBOL, BANG, POINT = b"#*$%&|<>", b"!?", b".,;:'\"-()"
LOWER, UPPER, DIGIT, SPACE, SYM, EXCL, PUNCT, HIGH, OTHER = range(9)
FEATURES = 13


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = LOWER, UPPER, DIGIT, HIGH
    kind[[32, 9, 11, 12, 13]] = SPACE
    for chars, k in ((SYMBOL, SYM), (BANG, EXCL), (POINT, PUNCT)):
        kind[list(chars)] = k
    return kind


KINDS = _kinds()


def line_features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as UTF-8: lines in each text, bytes of each line, and each line's features."""
    raw, at = data.tobytes(), offsets.tolist()
    n_lines, sizes, words, distinct, again = [], [], [], [], []
    for a, b in zip(at, at[1:]):
        lines = raw[a:b].split(b"\n")
        seen: set[bytes] = set()
        n_lines.append(len(lines))
        for x in lines:
            w = x.split()
            sizes.append(len(x))
            words.append(len(w))
            distinct.append(len(set(w)))
            again.append(x in seen)
            if w:
                seen.add(x)
    n_lines, size = np.array(n_lines, np.int64), np.array(sizes, np.int64)
    words, distinct = np.array(words, float), np.array(distinct, float)
    chars = np.delete(data, np.flatnonzero(data == 10)) if len(data) else data
    line = np.repeat(np.arange(len(size)), size)
    counts = np.bincount(line * 9 + KINDS[chars], minlength=9 * len(size)).reshape(-1, 9).astype(float)
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    return n_lines, size, np.column_stack((
        np.log1p(size), np.log1p(words), words == 0, size / w / 10,
        counts[:, UPPER] / n, counts[:, DIGIT] / n, counts[:, HIGH] / n, counts[:, OTHER] / n,
        np.minimum(counts[:, SYM] / w, 3), np.minimum(counts[:, EXCL] / w, 3), np.minimum(counts[:, PUNCT] / w, 3),
        1 - distinct / w * (words > 0), np.array(again, float),
    ))


def with_neighbours(n_lines: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A line's own features and those of the lines before and after it in its text (zero at the ends), and a 1."""
    ends = np.cumsum(n_lines)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[(ends - n_lines)[n_lines > 0]] = 0
    after[ends[n_lines > 0] - 1] = 0
    return np.column_stack((x, before, after, np.ones(len(x))))


@dataclass
class Field:
    """A fitted field: scale of the features, weight of each for `good` against `bad`, and log scores of a line's label after another."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray

    def marginals(self, n_lines: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = with_neighbours(n_lines, (x - self.mean) / self.scale)
        return forward_backward(n_lines, x @ self.weights, self.steps)[0]


def forward_backward(n_lines: np.ndarray, score: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each line's probability of `good`, expected label pairs) of chains of n_lines lines each.

    score is a line's log odds by its features alone; steps[a, b] the log score of label b after label a.
    """
    order = np.argsort(-n_lines, kind="stable")
    longest = int(n_lines[order[0]]) if len(order) else 0
    first = (np.cumsum(n_lines) - n_lines)[order]
    live = np.searchsorted(-n_lines[order], -np.arange(1, longest + 1), side="right")
    odds = np.clip(score, -30, 30)
    emit = np.column_stack((np.exp(-np.maximum(odds, 0)), np.exp(np.minimum(odds, 0))))
    move = np.exp(steps - steps.max())
    ahead, back = np.empty((len(score), 2)), np.ones((len(score), 2))
    for t in range(longest):
        at = first[: live[t]] + t
        a = emit[at] if t == 0 else emit[at] * (ahead[at - 1] @ move)
        ahead[at] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: live[t + 1]] + t
        nxt = emit[at + 1] * back[at + 1]
        b = nxt @ move.T
        back[at] = b / b.sum(1, keepdims=True)
        joint = ahead[at][:, :, None] * move * nxt[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    both = ahead * back
    return both[:, 1] / both.sum(1), pairs


def fit_field(n_lines: np.ndarray, x: np.ndarray, good: np.ndarray) -> Field:
    """Field that maximises the likelihood of the lines' labels, each line bearing its text's label."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    own = with_neighbours(n_lines, (x - mean) / scale)
    y = np.repeat(good.astype(float), n_lines)
    follow = np.maximum(n_lines - 1, 0)
    seen = np.diag([follow[~good].sum(), follow[good].sum()]).astype(float)
    params = np.zeros(own.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, STEPS + 1):
        p, pairs = forward_backward(n_lines, own @ params[:-4], params[-4:].reshape(2, 2))
        slope = np.concatenate((own.T @ (y - p), (seen - pairs).ravel())) / len(y) - PENALTY * params
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        params += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(mean, scale, params[:-4], params[-4:].reshape(2, 2))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Field | None:
    """Field fitted on a bounded sample of the labelled documents; None where they are all of one label, or none."""
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    marks = marks.groupBy("i").agg(F.min("y").alias("y"))
    marks = marks.orderBy(F.xxhash64("i"), "i").limit(train_docs)
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(marks), "i")
    lines = F.length(F.coalesce("t", F.lit(""))) - F.length(F.replace(F.coalesce("t", F.lit("")), F.lit("\n"))) + 1
    # rows of one id: the text of the least hash is the one that is fitted
    sizes = d.groupBy("i").agg(F.min(F.struct(F.xxhash64("t").alias("h"), lines.alias("n"))).alias("x"))
    chosen, room = [], train_lines
    for r in sizes.orderBy(F.xxhash64("i"), "i").select("i", "x.h", "x.n").collect():  # at most TRAIN_DOCS rows
        if r.n <= room:
            chosen.append((r.i, r.h))
            room -= r.n
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.createDataFrame(chosen, f"i {kind}, h long")
    d = d.withColumn("h", F.xxhash64("t")).join(F.broadcast(held), ["i", "h"]).dropDuplicates(["i", "h"]).select("y", "t")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                n, _, x = line_features(*text_buffers(part.column("t")))
                ends = np.cumsum(n)
                rows = [x[e - k : e].astype("<f4").tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.record_batch([part.column("y"), pa.array(rows, pa.binary())], names=["y", "x"])

    rows = sorted((r.y, bytes(r.x)) for r in d.mapInArrow(features, "y int, x binary").collect())
    if len({y for y, _ in rows}) < 2:
        return None
    lines = [np.frombuffer(x, "<f4").reshape(-1, FEATURES).astype(float) for _, x in rows]
    return fit_field(np.array([len(x) for x in lines]), np.concatenate(lines), np.array([y == 1 for y, _ in rows]))


def score_quality(
    docs: DataFrame,
    labelled: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    carry: bool = False,
    train_docs: int = TRAIN_DOCS,
    train_lines: int = TRAIN_LINES,
) -> DataFrame:
    """Quality of every whole text: id, score (0 to 1, higher is better), predicted (1 if score is at least 0.5).

    With carry the whole input row stands in place of the id, as a struct `row`.

    A field over the lines of a text, with features of each line and its neighbours, is fitted on at most train_docs of
    the `labelled` documents that `labels` marks 0 or 1, the first by hash of the id, as far as train_lines hold their
    lines (of rows that share an id, on one text); forward-backward gives each line's marginal of being good, and
    their mean weighted by the line's bytes plus one is the score. A null or empty text is one empty line. Ids with
    several labels count with the least. Without labels of both kinds every score is 0.5. Repeated rows and null ids
    are scored as they stand; an empty table gives no rows. Other columns are not read.
    """
    field = docs.sparkSession.sparkContext.broadcast(learn(labelled, labels, id_col, text_col, label_col, train_docs, train_lines))
    text = F.col(text_col).alias("t")
    d = docs.select(F.struct(*docs.columns).alias("row")) if carry else docs.select(F.col(id_col).alias("i"), text)
    kept = d.columns[0]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            texts = own.field(text_col) if carry else batch.column("t")
            for part in chunks(pa.record_batch([own, texts], names=[kept, "t"]), "t"):
                score = np.full(part.num_rows, 0.5)
                if field.value is not None:
                    n, size, x = line_features(*text_buffers(part.column("t")))
                    p, owner = field.value.marginals(n, x), np.repeat(np.arange(len(n)), n)
                    score = np.bincount(owner, p * (size + 1), len(n)) / np.bincount(owner, size + 1, len(n))
                    score = np.clip(score, 0, 1)
                yield pa.record_batch([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[kept, "score", "predicted"])

    out = d.mapInArrow(scored, d.select(kept).schema.add("score", "double").add("predicted", "integer"))
    return out if carry else out.withColumnRenamed("i", id_col)
