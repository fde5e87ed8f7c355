"""License scans: rare words of license notices, looked up by place, give alignments that key phrases confirm."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_buffers, within

#: Of a template's words that a file holds, so many with the highest inverse document frequency are looked up.
RARE = 4
#: Two of them must stand as far apart as in the template, give or take so many words inserted or left out between them.
AGREE, SLACK = 2, 3

# Phrases of the registered query and the label of each.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, notice, and key phrases that must all stand at their places in it. Public wording of the licenses.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["in compliance with the license", "apache org licenses license 2"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ["neither the name of", "endorse or promote products derived from"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["authors be held liable"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain cc0 1 0 universal", ["dedicated the work to the public domain"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
]

#: Bytes that words are made of: digits, letters in lower case, and all of a character beyond ASCII.
_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def file_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z are lower-cased."""
    return text.translate(_TABLE).split()


@dataclass
class Index:
    """Positional index of templates: word ids, and for each word its places (template, position) in them."""

    names: dict[bytes, int]
    labels: list[str]
    words: list[list[int]]
    keys: list[list[tuple[int, list[int]]]]

    def document_counts(self, n: int, df: np.ndarray) -> Index:
        """The same with the inverse document frequency of every word, of n files."""
        self.idf = np.log((n + 1) / (df + 1))
        return self


def template_index(templates: list = TEMPLATES, base: dict = BASE) -> tuple[Index, list[tuple[list[int], str]]]:
    """Index of the templates, and the base phrases as word ids with their labels."""
    names: dict[bytes, int] = {}
    coded = lambda s: [names.setdefault(w, len(names)) for w in file_words(s.encode())]
    notices = [coded(text) for _, text, _ in templates]
    keys = []
    for (label, _, phrases), whole in zip(templates, notices):
        own = []
        for phrase in map(coded, phrases):
            at = [p for p in range(len(whole) - len(phrase) + 1) if whole[p : p + len(phrase)] == phrase]
            if not at:
                raise ValueError(f"a key phrase of {label} does not stand in its notice")
            own.append((at[0], phrase))
        keys.append(own)
    phrases = [(coded(p), label) for p, label in base.items()]
    return Index(names, [t[0] for t in templates], notices, keys), phrases


def places(ids: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the phrase's words stand one after another."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = ids[:n] == phrase[0]
    for k, w in enumerate(phrase[1:], 1):
        hit &= ids[k : k + n] == w
    return np.flatnonzero(hit)


def alignments(owner: np.ndarray, at: np.ndarray, word: np.ndarray, index: Index, t: int, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """(file, place of the template's first word) of each alignment of template t, from words of files by place.

    Of the template's words, a file's `rare` highest-IDF ones are looked up; a place less the word's position in the
    template is where the template would begin. AGREE different ones within SLACK of each other make an alignment.
    """
    none = np.zeros(0, np.int64)
    own = np.unique(index.words[t])
    own = own[np.lexsort((own, -index.idf[own]))]
    rank = np.full(len(index.names), -1)
    rank[own] = np.arange(len(own))
    held = rank[word] >= 0
    owner, at, r = owner[held], at[held], rank[word[held]]
    if not len(owner):
        return none, none
    # a file's rarest words are those of the least ranks it holds
    pair = np.unique(owner * len(own) + r)
    file = pair // len(own)
    first = np.concatenate((file[:1] == file[:1], file[1:] != file[:-1]))
    turn = np.arange(len(pair)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    looked = np.isin(owner * len(own) + r, pair[turn < rare])
    owner, at, r = owner[looked], at[looked], r[looked]
    spots = [[p for p, w in enumerate(index.words[t]) if w == x] for x in own.tolist()]
    count = np.array([len(s) for s in spots])
    flat, begin = np.array([p for s in spots for p in s]), np.cumsum(count) - count
    n = count[r]
    posting = within(begin[r], n)
    owner, start, r = np.repeat(owner, n), np.repeat(at, n) - flat[posting], np.repeat(r, n)
    order = np.lexsort((r, start, owner))
    owner, start, r = owner[order], start[order], r[order]
    if len(own) < AGREE:
        return owner, start
    # another word within SLACK: look at rows ahead while they are near
    good, live, k = np.zeros(len(start), bool), np.arange(len(start)), 1
    while True:
        live = live[live + k < len(start)]
        live = live[(owner[live + k] == owner[live]) & (start[live + k] - start[live] <= SLACK)]
        if not len(live):
            break
        other = live[r[live + k] != r[live]]
        good[other] = good[other + k] = True
        k += 1
    return owner[good], start[good]


def _scan(words: list[list[bytes]], index: Index, base: list) -> dict[str, list]:
    """Answers for the files of a batch, given as their words."""
    n = np.array([len(w) for w in words], np.int64)
    get = index.names.get
    pad = max([len(p) for p, _ in base] + [len(p) for k in index.keys for _, p in k])
    ids = np.full(int(n.sum()) + pad * len(n), -1, np.int64)  # a gap after each file, so that no phrase crosses over
    begin = np.cumsum(n + pad) - n - pad
    for b, w in zip(begin.tolist(), words):
        ids[b : b + len(w)] = [get(x, -1) for x in w]
    held = np.flatnonzero(ids >= 0)
    owner = np.searchsorted(begin, held, side="right") - 1
    n_base, first, last = np.zeros(len(n), np.int64), np.full(len(n), -1), np.full(len(n), -1)
    base_labels, labels, score = [set() for _ in words], [set() for _ in words], np.zeros(len(n))
    for phrase, label in base:
        hit = places(ids, phrase)
        file = np.searchsorted(begin, hit, side="right") - 1
        np.add.at(n_base, file, 1)
        for f, p in zip(file.tolist(), (hit - begin[file]).tolist()):
            base_labels[f].add(label)
            first[f] = p if first[f] < 0 else min(first[f], p)
            last[f] = max(last[f], p)
    for t, label in enumerate(index.labels):
        file, start = alignments(owner, held, ids[held], index, t)
        if not len(file):
            continue
        near = np.ones(len(file), bool)
        for p, phrase in index.keys[t]:
            spots = places(ids, phrase)
            low = np.searchsorted(spots, np.maximum(start + p - SLACK, begin[file]))
            near &= (low < len(spots)) & (np.append(spots, ids.size * 2)[low] <= start + p + SLACK)
        for f, s in set(zip(file[near].tolist(), start[near].tolist())):
            labels[f].add(label)
            score[f] = max(score[f], _share(ids, int(begin[f]), int(n[f]), s, index, t))
    for f, found in enumerate(base_labels):
        labels[f] |= found
        score[f] = 1.0 if found else score[f]
    return {
        "n_words": n,
        "n_base": n_base,
        "first_word": np.where(first < 0, -1, first),
        "last_word": last,
        "base_labels": [",".join(sorted(x)) for x in base_labels],
        "labels": [",".join(sorted(x)) for x in labels],
        "score": score,
    }


def _share(ids: np.ndarray, begin: int, n: int, start: int, index: Index, t: int) -> float:
    """Share of the template's IDF weight that stands at its place, give or take SLACK words, from 0 to 1."""
    weight = np.maximum(index.idf[index.words[t]], 0) + 1e-9
    low, high = max(begin, start - SLACK), min(begin + n, start + len(weight) + SLACK)
    view = ids[low:high]
    near = [bool((view[max(0, start + p - SLACK - low) : max(0, start + p + SLACK + 1 - low)] == w).any()) for p, w in enumerate(index.words[t])]
    return float(min(1.0, weight[near].sum() / weight.sum()))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list = TEMPLATES,
    base: dict = BASE,
) -> DataFrame:
    """Licenses of every whole text: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    base maps phrases to labels: n_base counts the places where a phrase's words stand one after another, first_word and
    last_word are the least and greatest of them (words from 0; null without one). templates are notices with key
    phrases: a file's highest-IDF words of each notice are looked up by place, two that stand as in the notice align
    it, and all of its key phrases must stand there, give or take SLACK words. labels are those of both, distinct,
    sorted and comma-joined (base_labels: of base alone), empty without any. score is 1 with a base label, else the
    greatest share of a labelled notice's IDF weight found at its places, 0 without one. Document frequencies are
    counted over all rows. Null and empty texts have no words; null ids and repeated rows are answered as they stand;
    an empty table gives no rows. Other columns are not read.
    """
    index, phrases = template_index(templates, base)
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    names = index.names

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and, for every word of the index, files that hold it, of one task."""
        known, df, n = names.keys(), np.zeros(len(names), np.int64), 0
        for batch in batches:
            for part in chunks(batch, "t"):
                offsets, data = text_buffers(part.column("t"))
                raw, at = data.tobytes(), offsets.tolist()
                for a, b in zip(at, at[1:]):
                    df[[names[w] for w in known & set(file_words(raw[a:b]))]] += 1
                n += part.num_rows
        yield pa.record_batch([pa.array(np.arange(-1, len(df))), pa.array(np.append(n, df))], names=["w", "n"])

    # one row for each word of the index, however many files there are
    rows = d.mapInArrow(counted, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(names) + 1, np.int64)
    for r in rows:
        df[r.w] = r.n
    index.document_counts(int(df[-1]), df[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                offsets, data = text_buffers(part.column("t"))
                raw, at = data.tobytes(), offsets.tolist()
                found = _scan([file_words(raw[a:b]) for a, b in zip(at, at[1:])], index, phrases)
                for k in ("first_word", "last_word"):
                    found[k] = pa.array(found[k], pa.int64(), mask=found[k] < 0)
                yield pa.record_batch([part.column("i"), *map(pa.array, found.values())], names=["i", *found])

    kind = d.schema["i"].dataType.simpleString()
    schema = f"i {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return d.mapInArrow(run, schema).withColumnRenamed("i", id_col)
