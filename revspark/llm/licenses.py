r"""License scan: exact containment join of text blocks with license templates.

A block is a sentence: text between line breaks or after `.`, `!`, `?`, `;` followed by white space, and, as license texts
are hard-wrapped, every stretch of words of a sentence that runs over line breaks (to a sentence end or a line without
words; comment marks are no words), over however many lines. A template is found in a block when the block's distinct
words hold at least `THRESHOLD` of the template's distinct words; a stretch over lines may have at most `SPREAD` times as many
words as the template, or any long list would hold its common words. All such pairs are found by a prefix-filter join:

* the words that templates use are ordered by how often all documents use them, rarest first;
* a template of k words that must share t = ceil(THRESHOLD * k) of them with a block shares at least one of its first
  k - t + 1 words with it (prefix filter), so only blocks with one of those rare words are looked at;
* a block with fewer than t of the templates' words cannot match (length filter);
* once the first shared word is known at places i of the template and j of the block's ordered words, no more than
  1 + min(k - i, |block| - j) - 1 words can be shared (positional filter);
* what is left is counted exactly; in a sentence over lines a window slides over the words that it shares with the template
  (its stretches, leftmost first, do not overlap; time linear in the sentence for each template that passed).

The templates are a fixed list, so the broadcast index over their prefixes has a fixed size. The phrase labels of the
contract (`PHRASES`) are counted beside it; the join only adds labels.

Defined cases: null text is empty (no words, labels ""); first_word and last_word are null without phrases; repeated
rows and ids give a row each; of templates that tie on the same words all labels are given; other columns of the input are
ignored; an empty table gives no rows; a text is read in one pass, in memory of the order of its length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import WORD, struct_array, texts, word_bounds

#: FIXED VALUES: phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

THRESHOLD = 0.9
#: A stretch over lines has at most this many times the words of its template.
SPREAD = 3

#: Template sentences by label. Of a block's matches, one whose words are all in another match's is dropped.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work"),
    ("gpl-2", "under the GNU General Public License, version 2"),
    ("gpl-3", "under the GNU General Public License, version 3"),
    ("lgpl-3", "under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "under the GNU Affero General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
            "by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_WORDS = re.compile(WORD)
_BLOCK_END = re.compile(rb"\n|[.!?;](?=[\x20\x09-\x0d])")
_GAP = rb"[^0-9a-z\x80-\xff]+"
_EDGES = (rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])")
_PHRASES = [(re.compile(_EDGES[0] + _GAP.join(map(re.escape, p.encode().split())) + _EDGES[1]), p.encode().split(), label)
            for p, label in PHRASES.items()]


def template_sets(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(_WORDS.findall(text.encode().lower()))) for label, text in templates]


def word_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often the documents use each word of the templates: at most one row for each such word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                total.update(w for w in _WORDS.findall(text.lower()) if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                                         names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


class PrefixIndex:
    """Templates as words in global order, and the templates listed under each word of their prefixes."""

    def __init__(self, templates: list[tuple[str, frozenset[bytes]]], counts: dict[bytes, int], threshold: float,
                 lengths: list[int] | None = None):
        vocabulary = frozenset().union(*(words for _, words in templates))
        self.rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.sets = [words for _, words in templates]
        self.labels = [label for label, _ in templates]
        self.lengths = [len(words) for words in self.sets] if lengths is None else lengths
        self.needed = [max(1, math.ceil(threshold * len(words) - 1e-9)) for words in self.sets]
        self.at: dict[bytes, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.sets):
            for i, w in enumerate(sorted(words, key=self.rank.get)[:len(words) - self.needed[t] + 1]):
                self.at.setdefault(w, []).append((t, i))
        self.least = min(self.needed, default=0)

    def matches(self, block: set[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block holds, less those whose words are all in another's."""
        found = self.held(block)
        return [(t, c) for t, c in found if not any(self.sets[t] < self.sets[u] for u, _ in found)]

    def wrapped(self, words: list[bytes], lines: list[int]) -> list[tuple[int, int, int, float]]:
        """(first word, last word, template, containment) of the templates that only several lines together hold;
        `lines` is the line of every word."""
        found = []
        for t, _ in self.held(set(words)):
            own, need, reach = self.sets[t], self.needed[t], SPREAD * self.lengths[t]
            places = [k for k, w in enumerate(words) if w in own]
            held: Counter = Counter()
            left = right = 0
            while right < len(places):
                held[words[places[right]]] += 1
                right += 1
                while len(held) >= need or places[right - 1] - places[left] >= reach:
                    first = words[places[left]]
                    if held[first] == 1 and len(held) >= need and places[right - 1] - places[left] < reach:
                        last = right - 1  # the least stretch from here; it goes on while it gains words
                        for k in range(right, len(places)):
                            if places[k] - places[left] >= reach or len(held) == len(own):
                                break
                            if words[places[k]] not in held:
                                last = k
                            held[words[places[k]]] += 1
                        if lines[places[left]] != lines[places[last]]:
                            got = len({words[k] for k in places[left:last + 1]})
                            found.append((places[left], places[last], t, got / len(own)))
                        held.clear()
                        left = right = last + 1
                        break
                    held[first] -= 1
                    if not held[first]:
                        del held[first]
                    left += 1
        return [x for x in found if not any(self.sets[x[2]] < self.sets[y[2]] and x[0] <= y[1] and y[0] <= x[1] for y in found)]

    def held(self, block: set[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block holds."""
        ordered = sorted((w for w in block if w in self.rank), key=self.rank.get)
        if len(ordered) < self.least:
            return []
        found, seen = [], set()
        for j, w in enumerate(ordered):
            for t, i in self.at.get(w, ()):
                if t in seen:
                    continue
                seen.add(t)
                size = len(self.sets[t])
                if len(ordered) < self.needed[t] or min(size - i, len(ordered) - j) < self.needed[t]:
                    continue
                shared = sum(x in self.sets[t] for x in ordered)
                if shared >= self.needed[t]:
                    found.append((t, shared / size))
        return found


def scan(text: bytes, index: PrefixIndex) -> tuple:
    low = text.lower()
    starts, _ = word_bounds(low)
    firsts, lasts, base, n = [], [], set(), 0
    for pattern, words, label in _PHRASES:
        if words[0] in low and words[-1] in low:
            for m in pattern.finditer(low):
                at = int(np.searchsorted(starts, m.start()))
                firsts.append(at)
                lasts.append(at)
                base.add(label)
                n += 1
    labels, score, spans = set(base), 1.0 if base else 0.0, []
    if any(w in low for w in index.at):
        begin, words, lines, line = 0, [], [], 0

        def add(t: int, c: float, w0: int, w1: int) -> None:
            nonlocal score
            labels.add(index.labels[t])
            score = max(score, c)
            spans.append(f"{index.labels[t]}:{w0}:{w1}")

        at = 0  # words before the line at hand
        for end in [m.end() for m in _BLOCK_END.finditer(low)] + [len(low)]:
            own = _WORDS.findall(low, begin, end)
            block = set(own)
            for t, c in index.matches(block) if len(block) >= index.least else ():
                add(t, c, at, at + len(own))
            at += len(own)
            words += own
            lines += [line] * len(own)
            line += 1
            if not block or end == len(low) or low[end - 1] != 0x0A:  # the sentence ends here
                for i, j, t, c in index.wrapped(words, lines) if words and lines[0] != lines[-1] else ():
                    whole = bisect_left(lines, lines[i]), bisect_right(lines, lines[j])  # reported with its whole lines
                    add(t, c, at - len(words) + whole[0], at - len(words) + whole[1])
                words, lines = [], []
            begin = end
    return (len(starts), n, min(firsts, default=None), max(lasts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score, ",".join(spans))


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
           ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.string())]


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of `docs`: the contract's columns and `blocks` (label:first word:end word of every matched block)."""
    sets = template_sets(templates)
    counts = word_counts(docs, frozenset().union(*(words for _, words in sets)))
    index = PrefixIndex(sets, counts, threshold, [len(_WORDS.findall(text.encode().lower())) for _, text in templates])

    @F.arrow_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                 "score double, blocks string")
    def found(text: pa.Array) -> pa.Array:
        got = list(zip(*(scan(t, index) for t in texts(text)), strict=True)) or [[]] * len(_FIELDS)
        return struct_array([(n, t, list(v)) for (n, t), v in zip(_FIELDS, got, strict=True)])

    return docs.select("doc_id", found("text").alias("f")).select("doc_id", "f.*")
