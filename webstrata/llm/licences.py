"""Licence notices in texts by a positional rare-token index.

Templates are known notices with key phrases that any use of them must hold. Their words make a vocabulary, and an index from
each word to the templates and places where it stands. Document frequencies of the vocabulary are counted over all documents
first. A file's words of the vocabulary are then looked up from the highest IDF down: a notice that holds at least COVERAGE
of a template's words can miss only so many of its places, so once more places than that have been looked up, one of them
must lie where the notice has it. Each place looked up, set against the word's places in the file, gives the position at
which the whole template would begin; these are intersected with all other postings of the template, each at its relative
position give or take SLACK words. Where enough of them meet and the key phrases stand there word for word, the file has
the licence. So the rare words save work and lose nothing: the result is that of trying every position.

Words are runs of letters and digits in lower case. Templates whose key phrases' words a file lacks are not looked up in it.
Base phrases are found word for word by the same scan, wherever they stand.

Null text is empty and has no place; equal documents get equal rows, ids may repeat or be null; of places of a template that
overlap, the one of the highest coverage counts, then of the most words exactly in place, then the first; very long texts are
scanned in pieces and judged whole; an empty table gives an empty result; without documents every IDF is the same; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .scan import ALPHANUMERIC, LOWER, Piece, pieces, same_words, texts_of, word_hashes

COVERAGE, SLACK = 0.8, 2
#: Phrases that count wherever their words stand in a row, with their labels; fixed values.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


#: Notices as their licences' publishers word them, long and short; fixed values. Other templates can be passed.
TEMPLATES = [
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("permission is hereby granted free of charge", "without restriction")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("apache license", "without warranties or conditions of any kind")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "gnu general public license")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under the creative commons attribution noncommercial license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "licensed under the creative commons attribution sharealike license", ("creative commons attribution sharealike",)),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
]


def words_of(text: str) -> list[str]:
    raw = LOWER[np.frombuffer(text.encode(), "u1")]
    return bytes(np.where(ALPHANUMERIC[raw], raw, 32).astype("u1")).decode().split()


@dataclass
class Index:
    """The vocabulary, and of each template the words by place; rebuilt from the templates where it is used."""

    templates: list[Template]
    base: list[tuple[str, str]]
    idf: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        phrases = [words_of(p) for p, _ in self.base]
        bodies = [words_of(t.text) for t in self.templates]
        keys = [[words_of(k) for k in t.keys] for t in self.templates]
        self.vocabulary = sorted({w for group in (phrases, bodies, *keys) for p in group for w in p})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        ids = lambda ws: np.array([number[w] for w in ws], "i4")
        self.phrases, self.bodies, self.keys = [ids(p) for p in phrases], [ids(b) for b in bodies], [[ids(k) for k in own] for own in keys]
        self.needs = np.zeros((len(self.templates), len(self.vocabulary)), bool)
        for i, own in enumerate(self.keys):
            for k in own:
                self.needs[i, k] = True
        weight = np.array([self.idf.get(w, 0.0) for w in self.vocabulary])
        # the places of each template from the highest IDF down; ties in the order of words and places
        self.rarest = [sorted(range(len(b)), key=lambda q, b=b: (-weight[b[q]], b[q], q)) for b in self.bodies]
        data = "".join(self.vocabulary).encode()
        self.data = np.frombuffer(data, "u1")
        size = np.array([len(w.encode()) for w in self.vocabulary], "i8")
        ends = np.cumsum(size)
        hashes = word_hashes(self.data, ends - size, ends)
        self.by_hash = np.argsort(hashes)
        self.hashes, self.starts, self.sizes = hashes[self.by_hash], (ends - size)[self.by_hash], size[self.by_hash]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two words of the vocabulary share a hash")

    def known(self, p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a piece: words of each row, and row, place (in words, from the piece's start of the row) and number of each known word."""
        data = LOWER[p.data]
        starts, ends, row = p.words_in(data, ALPHANUMERIC)
        n = np.bincount(row, minlength=len(p.at) - 1)
        place = np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
        h, size = word_hashes(data, starts, ends), ends - starts
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == h) & (self.sizes[at] == size))
        hit = hit[same_words(data, starts[hit], self.data, self.starts[at[hit]], size[hit])]
        return n, row[hit], place[hit], self.by_hash[at[hit]]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a column: words of each row, and row, place and number of each known word, by row and place."""
        data, at = texts_of(texts)
        total = np.zeros(len(at) - 1, "i8")
        found = [(np.zeros(0, "i8"),) * 3]
        for p in pieces(data, at, WORD_OR_CAPITAL):
            n, row, place, number = self.known(p)
            found.append((row + p.first, place + total[p.first + row], number))
            total[p.first : p.first + len(n)] += n
        return total, *(np.concatenate(x) for x in zip(*found, strict=True))


#: Bytes that are in a word once capitals are lowered.
WORD_OR_CAPITAL = ALPHANUMERIC[LOWER]


def stands(phrase: np.ndarray, row: np.ndarray, place: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which known words begin the phrase, all of whose words follow one after the other."""
    n = len(number) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, "i8")
    ok = (row[:n] == row[len(phrase) - 1 :]) & (place[len(phrase) - 1 :] - place[:n] == len(phrase) - 1)
    for i, w in enumerate(phrase.tolist()):
        ok &= number[i : n + i] == w
    return np.flatnonzero(ok)


def placed(index: Index, t: int, n_words: int, place: np.ndarray, number: np.ndarray, coverage: float, slack: int) -> list[tuple[int, float]]:
    """Where template t stands in one file (first word, coverage), best first among those that overlap."""
    body = index.bodies[t]
    size = len(body)
    may_miss = math.floor(size - math.ceil(coverage * size - 1e-9))
    starts, looked = [], 0
    for q in index.rarest[t]:  # rarest first; more places than a notice may miss
        starts.append(place[number == body[q]] - q)
        looked += 1
        if looked > may_miss:
            break
    around = np.unique(np.concatenate(starts))
    around = np.unique((around[:, None] + np.arange(-slack, slack + 1)).ravel())
    if not len(around):
        return []
    margin = size + 2 * slack
    at = np.full(n_words + 2 * margin, -1, "i4")  # the file's words by place, -1 if unknown
    at[place + margin] = number
    around = around[(around > -size) & (around < n_words)]
    met, exact = np.zeros(len(around), "i8"), np.zeros(len(around), "i8")
    for q in range(size):
        exact += at[around + (margin + q)] == body[q]
        hit = np.zeros(len(around), bool)
        for s in range(-slack, slack + 1):
            hit |= at[around + (margin + q + s)] == body[q]
        met += hit
    good = met >= coverage * size - 1e-9
    for key in index.keys[t]:
        first = place[stands(key, np.zeros(len(place), "i8"), place, number)]
        low, high = np.searchsorted(first, around - slack), np.searchsorted(first, around + size + slack - len(key), "right")
        good &= high > low
    out: list[tuple[int, float]] = []
    taken = np.zeros(n_words + 2 * margin, bool)
    for i in sorted(np.flatnonzero(good).tolist(), key=lambda i: (-met[i], -exact[i], around[i])):
        own = slice(int(around[i]) + margin, int(around[i]) + margin + size)
        if not taken[own].any():
            taken[own] = True
            out.append((int(around[i]), float(met[i]) / size))
    return sorted(out)


PLACES = "array<struct<label: string, method: string, first_word: long, last_word: long, coverage: double>>"


def scan_batch(index: Index, texts: pa.Array, coverage: float, slack: int) -> tuple[np.ndarray, list[list[dict]]]:
    """Words of each row, and its places: base phrases and templates, by first word."""
    total, row, place, number = index.column(texts)
    out: list[list[dict]] = [[] for _ in range(len(total))]
    for phrase, (_, label) in zip(index.phrases, index.base, strict=True):
        for i in stands(phrase, row, place, number).tolist():
            out[row[i]].append({"label": label, "method": "base", "first_word": int(place[i]), "last_word": int(place[i]) + len(phrase) - 1, "coverage": 1.0})
    has = np.zeros((len(total), len(index.vocabulary)), bool)
    has[row, number] = True
    border = np.searchsorted(row, np.arange(len(total) + 1))
    lacks = (~has).astype("f4") @ index.needs.T.astype("f4")  # key words of each template that a row lacks
    for r, t in np.argwhere(lacks == 0).tolist():
        own = slice(border[r], border[r + 1])
        size = len(index.bodies[t])
        for first, share in placed(index, t, int(total[r]), place[own], number[own], coverage, slack):
            out[r].append({"label": index.templates[t].label, "method": "template", "first_word": max(first, 0), "last_word": min(first + size, int(total[r])) - 1, "coverage": share})
    for found in out:
        found.sort(key=lambda x: (x["first_word"], x["last_word"], x["label"], x["method"]))
    return total, out


def frequencies(docs: DataFrame, index: Index, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """How many documents there are and how many hold each word of the vocabulary, over all documents: a vocabulary a task, summed."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(index.templates, index.base)
        n, df = 0, np.zeros(len(own.vocabulary), "i8")
        for batch in batches:
            total, row, _, number = own.column(batch.column(0))
            has = np.zeros((len(total), len(df)), bool)
            has[row, number] = True
            n, df = n + len(total), df + has.sum(axis=0)
        yield pa.record_batch([pa.array(["", *own.vocabulary]), pa.array([n, *df.tolist()], pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = {r.word: r.n for r in rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop("", 0), found


def find(docs: DataFrame, templates: list[Template] | None = None, base: list[tuple[str, str]] | None = None, coverage: float = COVERAGE, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words and places, each with its label, how it was found, first and last word and coverage. No shuffle of rows."""
    index = Index(TEMPLATES if templates is None else templates, BASE if base is None else base)
    n, df = frequencies(docs, index, text_col)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in index.vocabulary}
    known, phrases = index.templates, index.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(known, phrases, idf)
        for batch in batches:
            total, places = scan_batch(own, batch.column(1), coverage, slack)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(places, kind)], names=[id_col, "n_words", "places"])

    kind = pa.list_(pa.struct([("label", pa.string()), ("method", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words long, places {PLACES}")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word and last_word of the base phrases, base_labels, labels and score (the best coverage; 1 for a base phrase)."""
    base = F.filter("places", lambda p: p["method"] == "base")
    names = lambda places: F.array_join(F.sort_array(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    first = lambda places: F.transform(places, lambda p: p["first_word"])
    return find(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first(base)).alias("first_word"), F.array_max(first(base)).alias("last_word"), names(base).alias("base_labels"),
        names(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"), "places")
