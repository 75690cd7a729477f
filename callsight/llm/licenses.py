"""Licence scans by an exact set-similarity join of text blocks with templates (operator 3).

A block is a line of a text, as the set of its words; a template is the set of its words. A block is found when it holds
at least ``threshold`` of a template's words. The words of all templates are ordered by how often they occur in the whole
table, the rarest first. With o the overlap that is needed,

* prefix filter: a block that is found holds one of the template's first |T| - o + 1 words,
* length filter: it holds at least o words that occur in templates,
* positional filter: the words from the first common one on, in either order, must suffice for o,

and what passes is counted exactly.

With ``wrapped``, as registered, a block is a window of a text's words instead, across line breaks: as many words as the
template has, repeated ones too, over ``threshold``. So a notice that is wrapped over lines is found, and words that are
scattered over a long line are not. Windows that begin with a word of the template are enough; those without one of its
prefix words, or with too few of its words, are left out first, and the rest are counted exactly. Windows that overlap
are one block, named by the line on which the best one begins. The templates are a fixed list, so their index goes to every task as part of the
code; the table itself is never shuffled. Only the counts of the templates' words, one row a word, come to the driver.

Defined cases: a null or empty text has no words and no labels; a null doc_id stays null; repeated rows give repeated
rows; a very long text is scanned alone, whole; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import id_and_text
from callsight.llm.wordhash import Words, column_blocks

#: The phrases of the base rule and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Usual licence notices and their labels.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("reserved", "All rights reserved"),
]

#: Lower case for A-Z, and a space for every ASCII character that is no letter or digit.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split(b" ")


class Templates:
    """Templates and phrases over one list of words."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("a threshold above 0, 1 at most")
        sets = [(label, {w for w in words_of(t) if w}) for label, t in templates]
        self.phrases = [(label, [w for w in words_of(p) if w]) for p, label in phrases.items()]
        self.vocabulary = sorted(set().union(*(s for _, s in sets), *(p for _, p in self.phrases)))
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.spans = [int(sum(map(bool, words_of(t))) / threshold + 1e-9) for _, t in templates if any(words_of(t))]  # words of a window
        self.sets = [(label, {number[w] for w in s}, math.ceil(threshold * len(s) - 1e-9)) for label, s in sets if s]
        own = Words(self.vocabulary).hashes()
        self.order = np.argsort(own)
        self.sorted = own[self.order]
        self.hash_of = dict(zip(self.vocabulary, own))
        self.first_bits = np.zeros(1 << 16, dtype=bool)
        self.first_bits[(own >> np.uint64(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers) of the words that are in the vocabulary."""
        maybe = np.flatnonzero(self.first_bits[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        hit = self.sorted[at] == hashes[maybe]
        return maybe[hit], self.order[at[hit]]

    def ranked(self, counts: dict[int, int]) -> None:
        """Orders the words by their counts and indexes each template's prefix."""
        ranks = sorted(range(len(self.vocabulary)), key=lambda i: (counts.get(i, 0), self.vocabulary[i]))
        self.rank = np.empty(len(ranks), dtype=np.int64)
        self.rank[ranks] = np.arange(len(ranks))
        self.sorted_sets = [(label, sorted(int(self.rank[i]) for i in s), o) for label, s, o in self.sets]
        self.prefixes: dict[int, list[tuple[int, int]]] = {}  # rank -> (template, place in it)
        for t, (_, ranked, o) in enumerate(self.sorted_sets):
            for place, r in enumerate(ranked[: len(ranked) - o + 1]):
                self.prefixes.setdefault(r, []).append((t, place))
        self.is_prefix = np.zeros(len(ranks), dtype=bool)
        self.is_prefix[list(self.prefixes)] = True

    def join(self, block: list[int]) -> Iterator[tuple[int, float]]:
        """(template, containment) for a block given as the sorted ranks of its words."""
        seen = set()
        for j, r in enumerate(block):
            for t, i in self.prefixes.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)  # this is their first common word
                _, ranked, o = self.sorted_sets[t]
                if len(block) < o or min(len(ranked) - i, len(block) - j) < o:
                    continue
                overlap = len(set(ranked).intersection(block))
                if overlap >= o:
                    yield t, overlap / len(ranked)

    def windows(self, at: np.ndarray, rank: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(first word, template, containment) per run of overlapping windows; ``stop`` is the end of each word's text."""
        for t, (_, ranked, o) in enumerate(self.sorted_sets):
            of_template = np.zeros(len(self.rank), dtype=bool)
            of_template[ranked] = True
            own = of_template[rank]
            begin, word, end = at[own], rank[own], np.minimum(at[own] + self.spans[t], stop[own])
            rare = begin[np.isin(word, ranked[: len(ranked) - o + 1])]
            if not len(rare):
                continue
            enough = np.searchsorted(begin, end) - np.arange(len(begin)) >= o
            enough &= np.searchsorted(rare, end) > np.searchsorted(rare, begin)
            begin_of, end_of = begin[enough], end[enough]
            overlap = np.zeros(len(begin_of), dtype=np.int64)
            for r in ranked:
                places = np.append(begin[word == r], np.iinfo(np.int64).max)
                overlap += places[np.searchsorted(places, begin_of)] < end_of
            found = overlap >= o
            begin_of, end_of, overlap = begin_of[found], end_of[found], overlap[found]
            for run in np.split(np.arange(len(begin_of)), np.flatnonzero(begin_of[1:] >= end_of[:-1]) + 1):
                if len(run):
                    best = run[overlap[run].argmax()]
                    yield int(begin_of[best]), t, float(overlap[best] / len(ranked))


def scan(texts: pa.Array, index: Templates, wrapped: bool = False) -> Iterator[tuple]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) per text."""
    for _, some in column_blocks(texts):
        w = Words([t.translate(_PLAIN) for t in some])
        hashes, of = w.hashes(), w.texts_of()
        base: list[list[tuple[int, str]]] = [[] for _ in some]
        for label, phrase in index.phrases:
            at = np.flatnonzero((hashes == index.hash_of[phrase[0]]) & w.windows(len(phrase)))
            for k, word in enumerate(phrase[1:], 1):
                at = at[hashes[at + k] == index.hash_of[word]]
            for i in at.tolist():
                if all(w.raw[w.starts[i + k] : w.ends[i + k]] == word for k, word in enumerate(phrase)):
                    base[of[i]].append((i - int(w.first[of[i]]), label))
        found: list[list[tuple[int, int, float]]] = [[] for _ in some]
        at, number = index.find(hashes)
        if len(at):
            breaks = np.concatenate([[0], np.cumsum(np.frombuffer(b"\n".join(some), dtype=np.uint8) == 10)])
            line = breaks[w.starts[at]]  # numbered through the whole block; a text's end ends a line
            rank = index.rank[number]
            if wrapped:
                for first, t, share in index.windows(at, rank, w.first[of[at] + 1]):
                    text = int(of[first])
                    found[text].append((int(breaks[w.starts[first]] - breaks[w.text_at[text]]), t, share))
            else:
                wanted = np.unique(line[index.is_prefix[rank]])
                keep = np.isin(line, wanted)
                at, line, rank = at[keep], line[keep], rank[keep]
                cut = np.flatnonzero(np.diff(line, prepend=-1))
                for a, b in zip(cut, [*cut[1:], len(line)]):
                    text = int(of[at[a]])
                    number_in_text = int(line[a] - breaks[w.text_at[text]])
                    for t, share in index.join(sorted(set(rank[a:b].tolist()))):
                        found[text].append((number_in_text, t, share))
        for i in range(len(some)):
            starts, own = [s for s, _ in base[i]], sorted({x for _, x in base[i]})
            every = sorted({*own, *(index.sorted_sets[t][0] for _, t, _ in found[i])})
            score = max((s for _, _, s in found[i]), default=0.0)
            lines = [{"line": n, "label": index.sorted_sets[t][0], "containment": s} for n, t, s in sorted(found[i])]
            yield int(w.counts[i]), len(starts), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(every), score, lines


def license_scan(docs: DataFrame, threshold: float = 0.9, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, wrapped: bool = False) -> DataFrame:
    """One row per document. ``blocks`` holds every block found with its label and containment; ``score`` is the largest, or 0."""
    index = Templates(templates or TEMPLATES, phrases or PHRASES, threshold)
    rows = id_and_text(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(len(index.vocabulary), dtype=np.int64)
            for _, some in column_blocks(batch.column(1)):
                total += np.bincount(index.find(Words([t.translate(_PLAIN) for t in some]).hashes())[1], minlength=len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["word", "n"])

    counted = rows.mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per word of the templates
    index.ranked({r["word"]: r["n"] for r in counted})
    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "blocks array<struct<line:int,label:string,containment:double>>"
    )
    block_type = pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), block_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = zip(*scan(batch.column(1), index, wrapped))
            columns = [pa.array(c, t) for c, t in zip(got, types)]
            if columns:
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return rows.mapInArrow(run, schema)
