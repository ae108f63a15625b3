"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a document of at most ``WINDOW`` times a template's words, or a window of so many words that crosses line ends or lies in a
longer line: wrapped notices are found, and words scattered over a long line are not. Windows are looked at for templates that pass the same filters on the words of the whole text. A template is found in a block that holds at least ``THRESHOLD`` of the template's
distinct words. Template words are ordered by how many blocks of the whole corpus hold them, rarest first. Then a
template of n words that needs o of them (``o = ceil(THRESHOLD * n)``) is a candidate only if

* the block has one of its first ``n - o + 1`` words (prefix filter), found through an inverted list of prefix words;
* the block has at least o distinct words (length filter);
* the words found up to there and all that follow can still make o (positional filter).

Candidates are verified exactly. The templates are a table of checked size that each task holds; the documents are read
twice, once for the frequencies and once for the join, and nothing but the counts of template words is shuffled.

Next to it stands the base rule: places where a phrase's words stand consecutively.

What is found is a notice's words, not what is said about it: "not licensed under the GNU General Public License version 3" is found as well.

Cases: a null or empty text has no words, no labels and score 0; very long texts and lines are scanned whole, in windows; repeated rows and ties are scanned alike; an empty
table gives an empty result; an empty template is ignored; other columns stay, but for those named like a result column,
which are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.passes import carried, map_texts
from doclens.llm.words import ALNUM, ALNUM_TRANSLATION, pieces, released, text_bytes, words_of

THRESHOLD = 0.9
#: Words of a window over line ends, as a multiple of those of the template.
WINDOW = 2
MAX_TEMPLATES, MAX_TEMPLATE_WORDS = 20_000, 2_000_000

# Phrases of the base rule and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Well-known license notices and the labels that they stand for.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the Apache License version 2.0"),
    ("apache", "licensed under the Apache License Version 2.0 you may not use this file except in compliance with the License"),
    ("gpl", "licensed under the GNU General Public License version 3"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "subject to the terms of the Mozilla Public License v 2.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part may be reproduced without prior written permission"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "Software to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the Software and to permit persons to whom the Software is furnished to do so subject to the following conditions",
    ),
    (
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND either express or implied",
    ),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
    ),
    ("gpl", "copy of the GNU General Public License"),
    ("lgpl", "copy of the GNU Lesser General Public License"),
    ("agpl", "copy of the GNU Affero General Public License"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the GNU Free Documentation License version"),
    ("mpl", "if a copy of the MPL was not distributed with this file you can obtain one at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute "
        "it freely subject to the following restrictions",
    ),
    (
        "bsl",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license to use reproduce display distribute execute and transmit the Software",
    ),
    (
        "unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for "
        "any purpose commercial or non commercial and by any means",
    ),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("artistic", "licensed under the Artistic License 2.0"),
    ("ofl", "this Font Software is licensed under the SIL Open Font License version 1.1"),
]

RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]


def tokens(text: str | bytes) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text).translate(ALNUM_TRANSLATION).split()


def blocks(text: bytes) -> list[bytes]:
    return text.split(b"\n")


class Index:
    """Templates in the global order of their words, with an inverted list of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        self.templates, self.prefix, self.sizes = [], {}, []
        for label, text in templates:
            words = sorted(set(tokens(text)), key=lambda w: (frequency.get(w, 0), w))
            if words:
                need = max(1, math.ceil(threshold * len(words) - 1e-9))
                for at, w in enumerate(words[: len(words) - need + 1]):
                    self.prefix.setdefault(w, []).append((len(self.templates), at))
                self.templates.append((label, words, need))
                self.sizes.append(len(tokens(text)))
        self.shortest = min(self.sizes, default=0)

    def find(self, line: list[bytes]) -> list[tuple[str, float]]:
        """Label and containment of each template that the line holds, but for those whose words another found one has all and adds to, and those
        for which the line is too long to be a block."""
        found = [(*self.templates[number][:2], overlap) for number, overlap in self.held(set(line)) if len(line) <= WINDOW * self.sizes[number]]
        return [(label, overlap / len(words)) for label, words, overlap in found if not any(set(words) < set(other) and more > overlap for _, other, more in found)]

    def wrapped(self, lines: list[list[bytes]]) -> list[tuple[int, str, float]]:
        """First line, label and containment of each template in a window over line ends, or in a line that is too long to be a block."""
        every = self.held(set().union(*lines)) if len(lines) > 1 or len(lines[0]) > WINDOW * self.shortest else []
        if not every:
            return []
        words_at = [w for line in lines for w in line]
        line_at = [i for i, line in enumerate(lines) for _ in line]
        found = []
        for number, _ in every:
            if len(lines) == 1 and len(lines[0]) <= WINDOW * self.sizes[number]:
                continue
            label, words, need = self.templates[number]
            own, size = set(words), WINDOW * self.sizes[number]
            at = [i for i, w in enumerate(words_at) if w in own]
            counts, low, best, start = Counter(), 0, 0, None
            for high, i in enumerate(at):
                counts[words_at[i]] += 1
                while i - at[low] >= size or counts[words_at[at[low]]] > 1:
                    counts[words_at[at[low]]] -= 1
                    counts += Counter()
                    low += 1
                if start is not None and (at[low] > start[1] or len(counts) > best):
                    if at[low] > start[1]:
                        found.append((*start, label, own, best, size))
                    start, best = None, 0
                if len(counts) >= need and len(counts) > best:
                    start, best = (at[low], i), len(counts)
            if start is not None:
                found.append((*start, label, own, best, size))
        out = []
        for a, b, label, own, best, size in found:
            shadowed = any(own < other and more > best and x <= b and a <= y for x, y, _, other, more, _ in found)
            if (line_at[a] != line_at[b] or len(lines[line_at[a]]) > size) and not shadowed:
                out.append((line_at[a], label, best / len(own)))
        return out

    def held(self, block: set[bytes]) -> list[tuple[int, int]]:
        """Number of each template that the block holds, and how many of its words."""
        found, seen = [], set()
        for w in block & self.prefix.keys():
            for number, at in self.prefix[w]:
                label, words, need = self.templates[number]
                if number in seen or len(block) < need:
                    continue
                earlier = sum(x in block for x in words[:at])
                if earlier + len(words) - at < need:
                    continue
                seen.add(number)
                overlap = sum(x in block for x in words)
                if overlap >= need:
                    found.append((number, overlap))
        return found


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Blocks of the corpus that hold each template word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for piece in pieces(batches, "text"):
            for text in piece.column("text").to_pylist():
                for block in blocks(text or b""):
                    total.update(vocabulary.intersection(tokens(block)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(released(counted), "word binary, n long")
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns of ``docs`` by default) with the columns of RESULT. ``score`` is 1 where a phrase stands,
    else the greatest containment of a found template, else 0; ``blocks`` are the found lines, or first lines, with label and containment."""
    sizes = [len(set(tokens(t))) for _, t in templates]
    if len(templates) > MAX_TEMPLATES or sum(sizes) > MAX_TEMPLATE_WORDS:
        raise ValueError("more templates than one task holds: scan them in parts")
    index = Index(templates, frequencies(docs, {w for _, t in templates for w in tokens(t)}), threshold)
    of_phrases = [(p.split(), label) for p, label in phrases.items()]
    phrase_hashes = _phrase_hashes([p for p, _ in of_phrases])

    def scanned(texts: pa.Array) -> list:
        n_words, places = _places(texts, phrase_hashes)
        n_base, first, last, base, every, score, found = [], [], [], [], [], [], []
        for text, at in zip(texts.cast(pa.binary()).to_pylist(), places, strict=True):
            lines = [tokens(block) for block in blocks(text or b"")]
            hits = [(i, label, c) for i, line in enumerate(lines) for label, c in index.find(line)]
            hits += index.wrapped(lines)
            own = {of_phrases[k][1] for k, _ in at}
            starts = [s for _, s in at]
            n_base.append(len(at))
            first.append(min(starts, default=None))
            last.append(max(starts, default=None))
            base.append(",".join(sorted(own)))
            every.append(",".join(sorted(own | {label for _, label, _ in hits})))
            score.append(1.0 if own else max((c for _, _, c in hits), default=0.0))
            found.append([{"block": i, "label": label, "containment": c} for i, label, c in hits])
        return [n_words, n_base, first, last, base, every, score, found]

    made = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<block:int,label:string,containment:double>>"
    return map_texts(docs, carried(docs, carry, RESULT), "text", scanned, made)


def _phrase_hashes(phrases: list[list[str]]) -> list[np.ndarray]:
    return [words_of(*text_bytes(pa.array([" ".join(p).encode()], pa.binary())), ALNUM).hash for p in phrases]


def _places(column: pa.Array, phrases: list[np.ndarray]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Words of each text, and for each text the phrases and words that they start at."""
    words = words_of(*text_bytes(column), ALNUM)
    row, out = words.row, [[] for _ in range(len(column))]
    for k, phrase in enumerate(phrases):
        at = np.flatnonzero(words.hash[: max(0, len(row) - len(phrase) + 1)] == phrase[0])
        for i, h in enumerate(phrase[1:], 1):
            at = at[(words.hash[at + i] == h) & (row[at + i] == row[at])]
        for a, r in zip(at.tolist(), row[at].tolist(), strict=True):
            out[r].append((k, a - int(words.first[r])))
    return words.counts, out
