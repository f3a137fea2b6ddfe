"""Licence scans with a positional index of rare words.

A template is a licence notice or text with mandatory key phrases. One pass counts in how many files each licence word
stands; a word's weight is its inverse document frequency over all files. The index has postings (template, position) of
the highest-weighted words of each template only, ``RARE`` of them, and the rarest word of each key phrase.

A file's words are looked up in it. Where a key phrase's rarest word stands, the phrase itself is verified; that gives the
places of phrases exactly, without a limit. For templates, postings whose place in the file less their place in the
template agrees up to ``DRIFT`` words are intersected: the densest stretch of such offsets must hold ``LEAST_SHARE`` of the
template's rare words by weight. Then all mandatory key phrases must stand near the places that the offset says, and the
score is the weight of all template words found there, as a share of the template's.

The templates are a parameter and are broadcast; more than ``MOST_WORDS`` words in them are an error.

Defined cases: a null or empty text has no word, no place and no label (nulls in first and last, score 0); rows are judged
each by its own text, whatever its doc_id; texts of any length are taken whole; repeated places count each; of
stretches that are equally dense the first counts; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.texts import column, pieces, raw

#: Rare words of a template, words that an offset may drift, least shares of rare words and of all words, most template words.
RARE, DRIFT, LEAST_SHARE, LEAST_SCORE, MOST_WORDS = 12, 6, 0.6, 0.6, 500_000

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z: all other bytes become blanks.
SPACED = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, places array<struct<label:string,start:long,end:long,score:double>>"


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(SPACED).split()


@dataclass(frozen=True)
class Template:
    """A licence text; ``phrases`` are mandatory."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()


#: The contract's phrases and labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Notices as their licences give them.
TEMPLATES = (
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("hereby granted free of charge", "sublicense and or sell")),
    Template("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    Template("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("source and binary forms", "must retain the above copyright")),
    Template("bsd-3-text", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license", "in compliance with the license")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license as published",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("agpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software",)),
    Template("zlib-text", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("the authors be held liable",)),
    Template("mit-notice", "Released under the MIT License", ("mit license",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
)


def vocabulary(templates: Sequence[Template], base: Sequence[tuple[str, str]]) -> list[bytes]:
    """All licence words."""
    texts = [p for p, _ in base] + [x for t in templates for x in (t.text, *t.phrases)]
    own = [words(x.encode()) for x in texts]
    if sum(map(len, own)) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    return sorted({w for x in own for w in x})


def weights(docs: DataFrame, vocab: Sequence[bytes]) -> dict[bytes, float]:
    """The inverse document frequency of each licence word over all of ``docs``."""
    place = {w: i for i, w in enumerate(vocab)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(len(place) + 1, np.int64), 0
        for batch in pieces(batches, most=4 << 20):
            for text in raw(batch, "text"):
                n += 1
                for w in place.keys() & set(words(text)):
                    held[place[w]] += 1
        held[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], ["word", "k"])

    total = np.zeros(len(vocab) + 1)
    for r in docs.select("text").mapInArrow(count, "word long, k long").groupBy("word").agg(F.sum("k").alias("k")).collect():
        total[r.word] = r.k
    return {w: math.log((total[-1] + 2) / (total[i] + 1)) for w, i in place.items()}


class Index:
    """Postings of the rare words of templates, and phrases by their rarest word."""

    def __init__(self, weight: dict[bytes, float], templates: Sequence[Template] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE):
        self.weight, self.labels = weight, [t.label for t in templates]
        self.texts = [words(t.text.encode()) for t in templates]
        self.base = [label for _, label in base]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.needed = []
        for k, text in enumerate(self.texts):
            rare = sorted(set(text), key=lambda w: (-weight[w], w))[:RARE]
            for i, w in enumerate(text):
                if w in rare:
                    self.postings.setdefault(w, []).append((k, i))
            self.needed.append(LEAST_SHARE * sum(weight[w] for w in text if w in rare))
        self.total = [sum(weight[w] for w in text) for text in self.texts]
        #: Each phrase as words, by its rarest word: (number, place of that word in it).
        self.phrases: list[list[bytes]] = []
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}
        self.mandatory: list[list[tuple[int, int]]] = [[] for _ in templates]
        for phrase, _ in base:
            self._phrase(words(phrase.encode()))
        for k, t in enumerate(templates):
            for phrase in t.phrases:
                own = words(phrase.encode())
                self.mandatory[k].append((self._phrase(own), next(i for i in range(len(self.texts[k])) if self.texts[k][i : i + len(own)] == own)))
        self.lookup = self.postings.keys() | self.anchors.keys()

    def _phrase(self, own: list[bytes]) -> int:
        if own in self.phrases:
            return self.phrases.index(own)
        self.phrases.append(own)
        at = max(range(len(own)), key=lambda i: (self.weight[own[i]], -i))
        self.anchors.setdefault(own[at], []).append((len(self.phrases) - 1, at))
        return len(self.phrases) - 1

    def phrase_places(self, text: list[bytes], where: dict[bytes, list[int]]) -> dict[int, list[int]]:
        """Starts of each phrase, from the places of its rarest word."""
        out: dict[int, list[int]] = {}
        for w, own in self.anchors.items():
            for p, at in own if w in where else ():
                phrase = self.phrases[p]
                found = [i - at for i in where[w] if i >= at and text[i - at : i - at + len(phrase)] == phrase]
                if found:
                    out[p] = found
        return out

    def offsets(self, where: dict[bytes, list[int]]) -> dict[int, list[tuple[int, int]]]:
        """For each template (offset, place in the template) of its rare words in the file, sorted."""
        out: dict[int, list[tuple[int, int]]] = {}
        for w, places in where.items():
            for k, i in self.postings.get(w, ()):
                out.setdefault(k, []).extend((p - i, i) for p in places)
        return {k: sorted(v) for k, v in out.items()}

    def stretches(self, k: int, own: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """First and last offset of the densest stretches of at most DRIFT that hold enough rare words, without overlaps."""
        text, low, held, weight = self.texts[k], 0, {}, 0.0
        best: tuple[float, int, int] | None = None
        for high, (offset, i) in enumerate(own):
            while own[low][0] < offset - DRIFT:
                j = own[low][1]
                held[j] -= 1
                weight -= self.weight[text[j]] * (held[j] == 0)
                low += 1
            if best and own[low][0] > best[2]:
                yield best[1:]
                best = None
            held[i] = held.get(i, 0) + 1
            weight += self.weight[text[i]] * (held[i] == 1)
            if weight >= self.needed[k] - 1e-9 and (best is None or weight > best[0] + 1e-9):
                best = (weight, own[low][0], own[high][0])
        if best:
            yield best[1:]

    def score(self, k: int, text: list[bytes], first: int, last: int) -> float:
        """The weight of template words found at the offsets, as a share."""
        own, found = self.texts[k], 0.0
        for i, w in enumerate(own):
            if w in text[max(0, i + first) : max(0, i + last + 1)]:
                found += self.weight[w]
        return found / self.total[k] if self.total[k] > 0 else 1.0

    def scan(self, text: list[bytes]) -> tuple[list[tuple[str, int, int, float]], list[tuple[str, int, int, float]]]:
        """Places of base phrases and of templates: label, start, end (words), score."""
        wanted = self.lookup & set(text)
        if not wanted:
            return [], []
        where: dict[bytes, list[int]] = {w: [] for w in wanted}
        for i, w in enumerate(text):
            if w in where:
                where[w].append(i)
        phrases = self.phrase_places(text, where)
        base = [(self.base[p], i, i + len(self.phrases[p]), 1.0) for p in range(len(self.base)) for i in phrases.get(p, ())]
        found = []
        for k, own in self.offsets(where).items() if phrases else ():
            if not all(p in phrases for p, _ in self.mandatory[k]):
                continue
            for first, last in self.stretches(k, own):
                near = all(any(first - DRIFT <= i - at <= last + DRIFT for i in phrases[p]) for p, at in self.mandatory[k])
                if near and (score := self.score(k, text, first, last)) >= LEAST_SCORE:
                    found.append((self.labels[k], max(0, first), min(len(text), last + len(self.texts[k])), min(1.0, score)))
        return sorted(base, key=lambda x: (x[1], x[0])), sorted(found, key=lambda x: (x[1], x[0], -x[3]))


def scanned(docs: DataFrame, index: Index) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and places."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in pieces(batches, most=4 << 20):
            out = []
            for text in raw(batch, "text"):
                own = words(text)
                base, found = index.scan(own)
                starts = [x[1] for x in base]
                labels = {x[0] for x in base}
                out.append(
                    {
                        "n_words": len(own),
                        "n_base": len(base),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": sorted(labels),
                        "labels": sorted(labels | {x[0] for x in found}),
                        "score": max((x[3] for x in found), default=0.0),
                        "places": [dict(zip(("label", "start", "end", "score"), x, strict=True)) for x in base + found],
                    }
                )
            table = pa.Table.from_pylist(out, RESULT).combine_chunks()
            for part in table.to_batches():
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *part.columns], ["doc_id", *RESULT.names])

    return docs.select("doc_id", "text").mapInArrow(scan, OUT)


RESULT = pa.schema(
    [
        *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")),
        ("base_labels", pa.list_(pa.string())),
        ("labels", pa.list_(pa.string())),
        ("score", pa.float64()),
        ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
    ]
)


def license_places(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """``scanned`` with the weights of all of ``docs``."""
    return scanned(docs, Index(weights(docs, vocabulary(templates, base)), templates, base))
