"""License scans by an exact set-similarity join with templates.

A text block is a line, a set of words. It carries a template's label if it holds at least ``threshold`` of the
template's words. Words are ordered by how often they stand in the whole corpus, rare ones first. Of a template of n
words, of which m are needed, one of the first n - m + 1 must be in the block (prefix filter); the block must have m
words (length filter); and what is still to come behind the first shared word, on either side, must suffice (positional
filter). What is left is compared word by word, so every block that meets the threshold is found.

A notice that is wrapped over lines is found by windows of words that cross line breaks, of a quarter more words than the
template has, so that words of a comment's margin may stand between; they are judged by the same threshold.

Besides, places of fixed phrases are counted. Words are lower-cased (A-Z) runs of letters, digits and bytes beyond ASCII.

Defined cases: a null or empty text has no words, no label and score 0; a long line is one block; texts are taken whole;
ids may be null or repeated, each row is judged; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm.arrays import PLAIN_GAP, Words, hash_of, stretches
from wardspark.llm.stage import texts as texts_of

PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
#: Label and words of well-known licence notices.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
_NEWLINE = 10


def plain(texts: pa.Array) -> Words:
    return Words(texts, PLAIN_GAP, True)


def words_of(text: str) -> list[bytes]:
    w = plain(pa.array([text]))
    return [w.word(i) for i in range(len(w.start))]


def frequencies(docs: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """How often each of these words stands in all documents. There are as many counts as words given."""
    sorted_words = sorted(set(words))
    known = np.sort(hash_of(sorted_words))
    name = {int(h): w for h, w in zip(hash_of(sorted_words), sorted_words, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for b in stretches(batch, 0):
                h = plain(b.column(0)).hashes()
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                total += np.bincount(at[known[at] == h], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], ["h", "n"])

    got = texts_of(docs.select("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    counts = {name[r.h & (1 << 64) - 1]: r.n for r in got}
    return {w: counts.get(w, 0) for w in sorted_words}


class Join:
    """Templates with their words in global order."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        order = sorted(counts, key=lambda w: (counts[w], w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.labels = [t[0] for t in templates]
        self.sets = [sorted({self.rank[w] for w in words_of(t[1])}) for t in templates]
        self.words = [{w for w in words_of(t[1])} for t in templates]
        self.reach = [math.ceil(1.25 * len(words_of(t[1]))) for t in templates]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.by_prefix: dict[int, list[int]] = {}
        for k, (s, m) in enumerate(zip(self.sets, self.need, strict=True)):
            for r in s[: len(s) - m + 1]:
                self.by_prefix.setdefault(r, []).append(k)

    def wrapped(self, w: Words, h: np.ndarray, owner: np.ndarray, lines: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Text, template and share of windows that cross lines; hit: places of prefix words, one of which such a window has."""
        for k, (words, m, reach) in enumerate(zip(self.words, self.need, self.reach, strict=True)):
            known = np.sort(hash_of(sorted(words)))
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            member = known[at] == h
            total = np.r_[0, np.cumsum(member)]
            first = np.flatnonzero(member)
            end = np.minimum(first + reach, w.bounds[owner[first] + 1])
            near = np.searchsorted(hit, end) > np.searchsorted(hit, first)
            ok = near & (total[end] - total[first] >= m) & (lines[end - 1] != lines[first])
            for a, z in zip(first[ok].tolist(), end[ok].tolist(), strict=True):
                both = len(words.intersection(w.word(i) for i in range(a, z)))
                if both >= m:
                    yield int(owner[a]), k, both / len(words)

    def prefix_words(self) -> list[bytes]:
        return [w for w, r in self.rank.items() if r in self.by_prefix]

    def matches(self, block: set[bytes]) -> dict[int, float]:
        """Templates that the block holds, and how much of each."""
        known = sorted(self.rank[w] for w in block if w in self.rank)
        found: dict[int, float] = {}
        seen: set[int] = set()
        for j, r in enumerate(known):
            for k in self.by_prefix.get(r, ()):
                s, m = self.sets[k], self.need[k]
                if k in seen or len(block) < m:
                    continue
                seen.add(k)  # r is the first word that both have, as all of the prefix before it are not in the block
                if min(len(s) - s.index(r), len(known) - j) < m:
                    continue
                both = len(set(s).intersection(known))
                if both >= m:
                    found[k] = both / len(s)
        return found


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a template that
    a block holds where it meets the threshold; 1 where a phrase stands)."""
    texts = [w for t in templates for w in words_of(t[1])]
    join = Join(templates, frequencies(docs, texts), threshold)
    phrases = [(p.split(b" "), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = np.sort(hash_of(join.prefix_words())) if join.by_prefix else np.zeros(1, np.uint64)
        hashed = [(hash_of(p), p, label) for p, label in phrases]
        for batch in batches:
            for b in stretches(batch, 1):
                w = plain(b.column(1))
                n, h, owner = b.num_rows, w.hashes(), w.owner()
                place, left = w.places(), w.left()
                base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                for hp, p, label in hashed:
                    at = np.flatnonzero((h == hp[0]) & (left >= len(p)))
                    for k in range(1, len(p)):
                        at = at[h[at + k] == hp[k]]
                    for i in at.tolist():
                        if all(w.word(i + k) == p[k] for k in range(len(p))):
                            base[owner[i]].append((int(place[i]), label))
                labels, score = [{x[1] for x in f} for f in base], [1.0 if f else 0.0 for f in base]
                k = np.searchsorted(prefix, h)
                k[k == len(prefix)] = 0
                hit = np.flatnonzero(prefix[k] == h)
                if len(hit):
                    breaks = np.flatnonzero(w.data == _NEWLINE)
                    lines = np.searchsorted(breaks, w.start) + owner  # no line goes on in the next text
                    for line in np.unique(lines[hit]).tolist():
                        a, z = np.searchsorted(lines, [line, line + 1])
                        block = {w.word(i) for i in range(a, z)}
                        for t, share in join.matches(block).items():
                            labels[owner[a]].add(join.labels[t])
                            score[owner[a]] = max(score[owner[a]], share)
                    for o, t, share in join.wrapped(w, h, owner, lines, hit):
                        labels[o].add(join.labels[t])
                        score[o] = max(score[o], share)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(np.diff(w.bounds), pa.int64()),
                        pa.array([len(f) for f in base], pa.int64()),
                        pa.array([min(f)[0] if f else None for f in base], pa.int64()),
                        pa.array([max(f)[0] if f else None for f in base], pa.int64()),
                        pa.array([",".join(sorted({x[1] for x in f})) for f in base], pa.string()),
                        pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                        pa.array(score, pa.float64()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return texts_of(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, schema)
