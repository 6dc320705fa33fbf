"""License scan: exact phrases, and an exact set-similarity join with notice templates.

A template matches a block of text when the block holds at least ``THRESHOLD`` of its
distinct words.  Template words are ordered by their frequency in the whole
corpus, rarest first, and the join is filtered exactly:

* prefix: a matching block holds one of the first t - need + 1 words of the template;
* length: it holds at least ``need`` template words in all;
* position: the words after the first shared one, on both sides, still suffice.

A block is any run of words of the whole text, lines or not, of ``BLOCK`` words or twice those of the
longest template (``across_lines``, as the query has it): the filters choose stretches around prefix words, and
in these the template words of every run are counted.  Else a block is a line, or, in a longer line, a
window of ``BLOCK`` words every ``BLOCK`` / 2 words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exchange import text_batches
from .words import ALNUM, Words, chunks, grams, rolling, find

# Phrases and labels of the base rules.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short notices of common licenses, as their publishers word them.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "released under the gnu general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
THRESHOLD = 0.8
BLOCK = 64


class Templates:
    """Templates over a common vocabulary, ordered by corpus counts once they are known."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], threshold: float):
        w = Words(pa.array([t for _, t in templates], pa.string()), ALNUM)
        self.labels, self.threshold = [n for n, _ in templates], threshold
        self.vocabulary = np.unique(w.hash)
        word = np.searchsorted(self.vocabulary, w.hash)
        self.sets = [np.unique(word[w.doc == i]) for i in range(len(templates))]
        self.longest = int(w.per_doc.max(initial=0))
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        p = Words(pa.array(list(phrases), pa.string()), ALNUM)
        self.phrases = [(label, int(p.per_doc[i]), rolling(p.hash[p.first_word[i]:p.first_word[i + 1]], int(p.per_doc[i]))[0])
                        for i, label in enumerate(phrases.values())]

    def ordered(self, counts: np.ndarray) -> "Templates":
        self.rank = np.empty(len(counts), np.int64)               # place in the global order, rarest first
        self.rank[np.lexsort((self.vocabulary, counts))] = np.arange(len(counts))
        self.sorted = [np.sort(self.rank[s]) for s in self.sets]
        self.prefixes = [s[:len(s) - n + 1] for s, n in zip(self.sorted, self.need)]
        self.any_prefix = np.zeros(len(counts), bool)
        for p in self.prefixes:
            self.any_prefix[p] = True
        return self

    def matches(self, block: np.ndarray) -> list[tuple[int, float]]:
        """(template, containment) of all templates that a block's sorted distinct ranks reach."""
        out = []
        for i, (own, need, prefix) in enumerate(zip(self.sorted, self.need, self.prefixes)):
            if len(block) < need:
                continue
            first = np.intersect1d(prefix, block, assume_unique=True)
            if not len(first):
                continue
            left = min(len(own) - np.searchsorted(own, first[0]), len(block) - np.searchsorted(block, first[0]))
            if left < need:
                continue
            shared = len(np.intersect1d(own, block, assume_unique=True))
            if shared >= need:
                out.append((i, shared / len(own)))
        return out


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, block: int = BLOCK,
                  across_lines: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters.  ``score`` is 1 where
    a base phrase stands, else the best containment of a matching block, else 0.  Null or
    empty texts have no words and empty labels; a null doc_id stays null.  ``across_lines``: see above.
    """
    t = Templates(list(templates), dict(phrases), threshold)
    text_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def count(batches):
        seen = np.zeros(len(t.vocabulary), np.int64)
        for batch in batches:
            for a, b in chunks(batch.column(0)):
                seen += np.bincount(find(Words(batch.column(0).slice(a, b - a), ALNUM).hash, t.vocabulary)[1], minlength=len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], names=["word", "n"])

    counts = np.zeros(len(t.vocabulary), np.int64)
    for r in given.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():   # one row per template word
        counts[r["word"]] = r["n"]
    t.ordered(counts)

    def scan(batches):
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), *_scan(part.column(1), t, block, across_lines)],
                                                 names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return given.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def run_matches(at: np.ndarray, rank: np.ndarray, doc: np.ndarray, t: Templates, width: int) -> list[tuple[int, int, float]]:
    """(text, template, containment) of the best run of ``width`` words of each stretch, where it reaches the template.

    ``at``, ``rank``, ``doc``: place, rank and text of all template words.  A stretch is what lies less than ``width``
    words from a prefix word, in one text; every run that can match lies in one.
    """
    out = []
    seed = np.flatnonzero(t.any_prefix[rank])
    if not len(seed):
        return out
    new = np.flatnonzero((doc[seed][1:] != doc[seed][:-1]) | (np.diff(at[seed]) >= 2 * width)) + 1
    for s in np.split(seed, new):
        low = max(np.searchsorted(at, at[s[0]] - width, side="right"), np.searchsorted(doc, doc[s[0]]))
        high = min(np.searchsorted(at, at[s[-1]] + width), np.searchsorted(doc, doc[s[0]], side="right"))
        place, r = at[low:high], rank[low:high]
        for i, _ in t.matches(np.unique(r)):                      # a run holds no more words than its stretch
            own = np.isin(r, t.sorted[i])
            p, word = place[own], r[own]
            order = np.lexsort((p, word))
            before = np.full(len(p), -1, np.int64)                # the place of the same word before
            same = word[order][1:] == word[order][:-1]
            before[order[1:][same]] = p[order[:-1][same]]
            # the word is new to the runs that begin after its last place, up to its own
            steps = np.zeros(int(p[-1] - p[0]) + width + 2, np.int64)
            base = int(p[0]) - width
            np.add.at(steps, np.maximum(p - width, before) + 1 - base, 1)
            np.add.at(steps, p + 1 - base, -1)
            shared = int(np.cumsum(steps).max())
            if shared >= t.need[i]:
                out.append((int(doc[s[0]]), i, shared / len(t.sorted[i])))
    return out


def _scan(texts: pa.Array, t: Templates, block: int, across_lines: bool) -> list[pa.Array]:
    w = Words(texts, ALNUM)
    n = w.docs
    base = [set() for _ in range(n)]
    places = np.zeros(n, np.int64)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    by_length: dict[int, tuple] = {}
    for label, length, value in t.phrases:
        if length not in by_length:
            by_length[length] = grams(w, length)
        g, ok = by_length[length]
        at = np.flatnonzero((g == value) & ok) if len(g) else np.zeros(0, int)
        doc = w.doc[at]
        np.add.at(places, doc, 1)
        np.minimum.at(first, doc, at - w.first_word[doc])
        np.maximum.at(last, doc, at - w.first_word[doc])
        for d in set(doc.tolist()):
            base[d].add(label)
    score = np.where(places > 0, 1.0, 0.0)
    more = [set(s) for s in base]
    hit, word = find(w.hash, t.vocabulary)
    rank = t.rank[word]
    if across_lines:
        for doc, i, share in run_matches(hit, rank, w.doc[hit], t, max(block, 2 * t.longest)):
            more[doc].add(t.labels[i])
            score[doc] = max(score[doc], share)
    elif t.any_prefix[rank].any():
        breaks = np.flatnonzero(w.raw == 10)
        line = np.searchsorted(breaks, w.begin) + w.doc                      # grows at every line and every text
        new = np.concatenate([[True], line[1:] != line[:-1]])
        in_line = np.arange(len(line)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        half = block // 2
        window = in_line[hit] // half
        # a word stands in the window that begins in its half and in the one before
        line2, win2, rank2 = (np.concatenate(x) for x in ((line[hit], line[hit]), (window, window - 1), (rank, rank)))
        doc2 = np.concatenate([w.doc[hit]] * 2)
        use = win2 >= 0
        line2, win2, rank2, doc2 = line2[use], win2[use], rank2[use], doc2[use]
        order = np.lexsort((rank2, win2, line2))
        line2, win2, rank2, doc2 = line2[order], win2[order], rank2[order], doc2[order]
        edge = np.flatnonzero(np.concatenate([[True], (line2[1:] != line2[:-1]) | (win2[1:] != win2[:-1])]))
        has = np.maximum.reduceat(t.any_prefix[rank2], edge)
        for s, e, ok in zip(edge, np.append(edge[1:], len(line2)), has):
            if ok:
                for i, share in t.matches(np.unique(rank2[s:e])):
                    more[doc2[s]].add(t.labels[i])
                    score[doc2[s]] = max(score[doc2[s]], share)
    none = places == 0
    return [pa.array(w.per_doc.astype(np.int64)), pa.array(places), pa.array(first, mask=none), pa.array(last.astype(np.int64), mask=none),
            pa.array([",".join(sorted(s)) for s in base], pa.string()), pa.array([",".join(sorted(s)) for s in more], pa.string()), pa.array(score)]
