"""Operator 6: licence scans with a positional index of rare words.

A first pass counts in how many documents each licence word occurs. The index holds, for each
template, the postings (template, position) of its ``INDEXED`` words of highest IDF. The second
pass looks up every occurrence of an indexed word; postings that agree on the template's start in the file (at least ``AGREEING`` words, or all that are indexed) make a
candidate. A candidate is a match if ``LEAST_COVERAGE`` of the template's words stand at their
places and its mandatory key phrases occur within it. Fixed phrases give base labels, whatever the
index says.

Defined results: null or wordless text has no words, labels or places and score 0; repeated rows
are scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .words import ALNUM, LOWER, Piece, lean, pieces, window_starts, word_hashes

#: Phrases that give base labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Licence notices in public use: label, text, mandatory key phrases.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("except in compliance with the license",)),
    ("mit", "Released under the MIT License", ("the mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related",)),
)
INDEXED = 6
AGREEING = 2
LEAST_COVERAGE = 0.7
#: Words around a candidate in which its key phrases may stand.
MARGIN = 2

SCAN = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "score double, matches array<struct<label: string, first_word: long, n_words: long, coverage: double>>"
)


def _hashes(text: str) -> np.ndarray:
    piece = next(pieces(pa.array([text], pa.string()), ALNUM))
    return word_hashes(piece.data, piece.start, piece.end, lower=True)


def _words(text: str) -> list[str]:
    piece = next(pieces(pa.array([text], pa.string()), ALNUM))
    low = LOWER[piece.data].tobytes()
    return [low[a:b].decode() for a, b in zip(piece.start, piece.end, strict=True)]


class Vocabulary:
    """Licence words, numbered."""

    def __init__(self, templates=TEMPLATES):
        self.templates = templates
        texts = [x for _, text, keys in templates for x in (text, *keys)] + [p for p, _ in BASE_PHRASES]
        self.words = sorted({w for text in texts for w in _words(text)})
        self.number = {w: i for i, w in enumerate(self.words)}
        hashes = np.array([_hashes(w)[0] for w in self.words], np.uint64)
        self._order = np.argsort(hashes)
        self._sorted = hashes[self._order]

    def ids(self, text: str) -> np.ndarray:
        return np.array([self.number[w] for w in _words(text)], np.int64)

    def look_up(self, piece: Piece) -> np.ndarray:
        """Number of each word of the piece, -1 for others."""
        hashes = piece.hashes(lower=True)
        at = np.minimum(np.searchsorted(self._sorted, hashes), len(self._sorted) - 1)
        return np.where(self._sorted[at] == hashes, self._order[at], -1)


def document_counts(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """Documents with each licence word, and all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words) + 1, np.int64)
        for batch in batches:
            for piece in pieces(batch.column(0), ALNUM):
                ids = vocabulary.look_up(piece)
                known = ids >= 0
                pairs = np.unique(piece.doc[known] * len(vocabulary.words) + ids[known])
                total[:-1] += np.bincount(pairs % len(vocabulary.words), minlength=len(vocabulary.words))
                total[-1] += piece.n_texts
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    rows = docs.select("text").mapInArrow(lean(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(vocabulary.words) + 1, np.int64)
    for word, n in rows:  # one row per licence word
        counts[word] = n
    return counts[:-1], int(counts[-1])


def _places(ids: np.ndarray, phrase: np.ndarray, starts: np.ndarray) -> np.ndarray:
    at = starts
    for k, word in enumerate(phrase):
        at = at[ids[at + k] == word]
    return at


class Index:
    """Postings of the templates' rare words, and the scan of a piece."""

    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray, n_docs: int):
        self.vocabulary = vocabulary
        self.idf = np.log((n_docs + 1) / (counts + 1))
        self.base = [(vocabulary.ids(p), label) for p, label in BASE_PHRASES]
        self.templates = [
            (label, vocabulary.ids(text), [vocabulary.ids(k) for k in keys]) for label, text, keys in vocabulary.templates
        ]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for t, (_, words, _) in enumerate(self.templates):
            rare = sorted(set(words.tolist()), key=lambda w: (-self.idf[w], w))[:INDEXED]
            self.needed.append(min(AGREEING, len(rare)))
            for position, word in enumerate(words.tolist()):
                if word in rare:
                    self.postings[word].append((t, position))
        self.indexed = np.zeros(len(vocabulary.words), bool)
        self.indexed[list(self.postings)] = True

    def _looked_up(self, ids: np.ndarray) -> np.ndarray:
        """Places of the indexed words."""
        at = np.flatnonzero(ids >= 0)
        return at[self.indexed[ids[at]]]

    def _matches(self, ids: np.ndarray, low: int, high: int, at: list[int]) -> list[tuple]:
        votes: Counter = Counter()
        for place in at:
            for template, position in self.postings[int(ids[place])]:
                votes[template, place - position] += 1
        found = []
        for (t, start), n in sorted(votes.items()):
            label, words, keys = self.templates[t]
            if n < self.needed[t]:
                continue
            inside = np.arange(max(start, low), min(start + len(words), high))
            coverage = float((ids[inside] == words[inside - start]).sum() / len(words))
            if coverage < LEAST_COVERAGE:
                continue
            first, last = max(start - MARGIN, low), min(start + len(words) + MARGIN, high)
            if all(len(_places(ids, key, np.arange(first, max(first, last - len(key) + 1)))) for key in keys):
                found.append((label, max(start, low) - low, len(inside), coverage))
        return found

    def scan(self, piece: Piece) -> Iterator[tuple]:
        ids, doc, bounds = self.vocabulary.look_up(piece), piece.doc, piece.bounds
        base: dict[int, list] = defaultdict(list)
        for phrase, label in self.base:
            for place in _places(ids, phrase, window_starts(bounds, len(phrase))).tolist():
                base[int(doc[place])].append((place - int(bounds[doc[place]]), label))
        looked: dict[int, list] = defaultdict(list)
        for place in self._looked_up(ids).tolist():
            looked[int(doc[place])].append(place)
        for i in range(piece.n_texts):
            low, high = int(bounds[i]), int(bounds[i + 1])
            own = base.get(i, [])
            found = self._matches(ids, low, high, looked[i]) if i in looked else []
            labels = sorted({label for _, label in own})
            places = [place for place, _ in own]
            score = 1.0 if own else max((x[3] for x in found), default=0.0)
            yield (
                high - low, len(own), min(places, default=None), max(places, default=None), labels,
                sorted({*labels, *(x[0] for x in found)}), score,
                [dict(zip(("label", "first_word", "n_words", "coverage"), x, strict=True)) for x in found],
            )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and ``SCAN`` of every document."""
    vocabulary = Vocabulary()
    index = docs.sparkSession.sparkContext.broadcast(Index(vocabulary, *document_counts(docs, vocabulary)))
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
    kinds.append(pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("coverage", pa.float64())])))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for piece in pieces(batch.column(1), ALNUM) for row in index.value.scan(piece)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(scan), f"doc_id {kind}, {SCAN}")


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels and places of every document."""
    scanned = scan_licenses(table(spark, sf_dir, "documents"))
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )
