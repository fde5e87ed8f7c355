"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted and raw text. SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import words

#: Buckets of the hashed n-grams; the two multinomials are arrays of this length, whatever the corpus.
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: A document is kept when its mean log-likelihood ratio per n-gram is at least this (natural logarithm).
THRESHOLD = -0.47
#: A text counts for the raw and the trusted multinomial with this much added to each bucket.
PRIOR = 0.5
#: Pages of trusted ids that are broadcast (some 50 bytes each on the driver).
PAGES = 1 << 20


def _buckets(x: Column, following: Column) -> list[Column]:
    """Buckets of a word's hashed n-grams: the word, the character 3-gram at its end, and its pair with the word after it (or null)."""
    bucket = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 64 - BUCKET_BITS).cast("int")
    return [bucket(x), bucket(F.lit(3), F.substring(x, -3, 3)), F.when(following.isNotNull(), bucket(x, following))]


def _followed(w: Column) -> Column:
    """Every word `a` with the one after it, `b`, null after the last."""
    return F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b"))


def _marked(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """good (1, or null) and text `t` of every document: whether its id is a trusted one.

    Whole-number ids travel as pages of 64 ids, a bit each, so that no text is shuffled while there are up to PAGES of
    them: neighbouring ids share a page, scattered ones have one each. More pages, and ids of other types, are joined as
    Spark sees fit, which may shuffle the texts once.
    """
    t = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    ids = trusted.select(F.col(id_col).alias("i")).where("i is not null")
    if not all(isinstance(d.schema["i"].dataType, IntegralType) for d in (t, ids)):
        return t.join(ids.distinct().withColumn("good", F.lit(1)), "i", "left").select("good", "t")
    page, bit = F.expr("shiftright(cast(i as long), 6)").alias("page"), F.expr("cast(i & 63 as int)")
    pages = ids.select(page, F.expr("shiftleft(1L, cast(i & 63 as int))").alias("one")).groupBy("page").agg(F.bit_or("one").alias("bits"))
    few = pages.count() <= PAGES
    t = t.select("t", page, bit.alias("bit")).join(F.broadcast(pages) if few else pages, "page", "left")
    return t.select(F.when(F.getbit("bits", F.col("bit")) == 1, 1).alias("good"), "t")


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Per bucket, log share in the trusted documents minus log share in all documents.

    Raw counts cover every whole text, trusted ones every whole text of a trusted id. BUCKETS rows reach the driver.
    """
    t = _marked(docs, trusted, id_col, text_col)
    t = t.select("good", words(F.col("t")).alias("w"))
    t = t.select("good", F.explode(_followed(F.col("w"))).alias("x"))
    t = t.select("good", F.explode(F.array(*_buckets(F.col("x.a"), F.col("x.b")))).alias("g"))
    counts = {r[0]: r[1:] for r in t.where("g is not null").groupBy("g").agg(F.count("*"), F.count("good")).collect()}
    shares = []
    for k in (0, 1):
        total = sum(c[k] for c in counts.values()) + PRIOR * BUCKETS
        shares.append([math.log((counts.get(i, (0, 0))[k] + PRIOR) / total) for i in range(BUCKETS)])
    return [good - raw for raw, good in zip(*shares, strict=True)]


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc id, with carry the whole `row`, words `w` and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("t"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    row = ["row"] if carry else []
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), *[F.struct(*docs.columns).alias(r) for r in row])
    d = d.select("i", "t", *row, words(F.col("t")).alias("w"), lines.alias("l"))
    w = F.col("w")
    n = F.size("w")
    triples = F.arrays_zip(w.alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"))
    windows = F.slice(F.transform(triples, lambda x: F.xxhash64(x)), 1, F.greatest(n - 2, F.lit(0)))
    d = d.select(
        "i",
        *row,
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        windows.alias("h"),
    )
    # only a text with a repeated window is sorted: (window, place) pairs with an equal neighbour are the repeats
    pairs = F.when(
        F.size("h") > F.size(F.array_distinct("h")),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("p")))),
    )
    d = d.withColumn("s", pairs).drop("h")
    s = F.col("s")
    again = F.filter(s, lambda x, i: (x["x"] == F.get(s, i + 1)["x"]) | ((i > 0) & (x["x"] == F.get(s, i - 1)["x"])))
    d = d.withColumn("p", F.sort_array(F.transform(again, lambda x: x["p"]))).drop("s")
    p = F.col("p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """Rule counts and verdict of every document; with carry, beside the whole input row as a struct `row`.

    trusted holds the ids of the documents that stand for good text. A document's score is the mean, over its hashed
    n-grams (words, their ends, pairs of words), of log(trusted share / corpus share); it is kept if its base rules hold and the score reaches threshold.
    Null and empty texts have no words: counts 0, score 0, base_failed true, kept false. Repeated rows are scored each;
    a null id is kept as null and never trusted. An empty table gives no rows. Without trusted documents both
    multinomials differ by the prior alone, and the base rules decide. Other input columns are not read.
    """
    ratio = fit_ratio(docs, trusted, id_col, text_col) if not trusted.isEmpty() else [0.0] * BUCKETS
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")  # one folded literal
    d = base_counts(docs, id_col, text_col, carry)
    grams = lambda x: sum((F.coalesce(F.get(table, g), F.lit(0.0)) for g in _buckets(x["a"], x["b"])), F.lit(0.0))
    total = F.aggregate(_followed(F.col("w")), F.lit(0.0), lambda s, x: s + grams(x))
    d = d.withColumn("llr", F.when(F.col("n_words") > 0, total / (3 * F.col("n_words") - 1)).otherwise(0.0))
    kept = ~F.col("base_failed") & (F.col("llr") >= threshold)
    cols = [F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr")]
    # a generator of one row: a filter on the verdict is not pushed below it, where it would repeat all of the work
    return d.select(F.col("i").alias(id_col), *(["row"] if carry else []), F.inline(F.array(F.struct(*cols, kept.alias("kept")))))
