"""License scan with a positional index of rare words.

Templates are known notices and whole licence bodies. A scan counts in how many
texts each of their words occurs (a table as long as the index). Of each template
the words of highest IDF, until they hold SEEDED of its weight, are indexed: word
-> (template, position). In a text every indexed word votes with its weight for
the band of offsets at which a template would have to start; bands overlap, so
comment signs, inserted and missing words move a notice within its band. A place
where a share of at least JUDGED of the template stands must get votes of SEEDED +
JUDGED - 1 of the weight, so no such place is passed over, however common the words
are and however many notices a text holds. Those places are aligned word by word,
and a template counts if its share is high enough, its mandatory phrases stand
there, and no other licence's template explains the same words better. Beside
that, fixed base phrases are always reported.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shipped
from ._util import read_table

#: The phrases of the base labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Label, notice, mandatory phrases (divided by |).
TEMPLATES = [
    ("mit", "Released under the MIT License.", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "permission is hereby granted free of charge|deal in the software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache license|except in compliance with the license"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero general public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd style license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons attribution noncommercial"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", "permission is hereby granted free of charge|deal in the software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistribution and use in source and binary forms|redistributions in binary form must reproduce"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", "distribute this software for any purpose with or without fee"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "alter it and redistribute it freely"),
    ("boost", "Distributed under the Boost Software License, Version 1.0.", "boost software license"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited", "all rights reserved|strictly prohibited"),
]

RUN = 4096  # words of a text whose votes are held at a time
COVER = 0.7  # share of a template's weight that must stand in place
JUDGED, SEEDED = 0.5, 0.7
DRIFT = 0.5  # part of a template's length that a band of offsets is wide
SLACK = 3  # words that may stand within a mandatory phrase
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of ASCII letters, digits and all other characters beyond ASCII, A-Z lowered."""
    return text.translate(_WORDS).split()


PARSED = [(label, words_of(notice.encode()), [words_of(p.encode()) for p in phrases.split("|")]) for label, notice, phrases in TEMPLATES]
VOCABULARY = sorted({w for _, ws, _ in PARSED for w in ws})
LONGEST = max(len(ws) for _, ws, _ in PARSED)
PHRASES = [(p.encode().split(), label) for p, label in BASE]


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every base phrase."""
    out, at = [], -1
    try:
        while True:
            at = words.index(b"license", at + 1)  # the last word of every base phrase
            for phrase, label in PHRASES:
                if words[max(0, at - len(phrase) + 1) : at + 1] == phrase:
                    out.append((at - len(phrase) + 1, label))
    except ValueError:
        return out


def document_counts(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of texts, and for each word of the templates the number of texts with it: over all rows of docs."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    words = F.array_intersect(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.array(*[F.lit(w.decode()) for w in VOCABULARY]))
    each = docs.select(F.explode(F.concat(F.array(F.lit("")), words)).alias("word"))
    found = {r["word"].encode(): r["n"] for r in each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each word of the templates
    return found.pop(b"", 0), found


@dataclass(frozen=True)
class Index:
    weight: dict[bytes, float]
    total: list[float]  # of each template
    postings: dict[bytes, list[tuple[int, int]]]  # word -> (template, position)


def build_index(n: int, counts: dict[bytes, int]) -> Index:
    """The positional index for n texts, of which counts[word] hold a word."""
    weight = {w: math.log((n + 1) / (counts.get(w, 0) + 0.5)) + 0.05 for w in VOCABULARY}  # words that stand in all texts count a little
    total, postings = [sum(weight[w] for w in notice) for _, notice, _ in PARSED], defaultdict(list)
    for t, (_, notice, _) in enumerate(PARSED):
        held = 0.0
        for w in sorted(set(notice), key=lambda w: (-weight[w], w)):
            if held >= SEEDED * total[t]:
                break
            held += weight[w] * notice.count(w)
            for p, x in enumerate(notice):
                if x == w:
                    postings[w].append((t, p))
    return Index(weight, total, dict(postings))


@dataclass(frozen=True)
class Match:
    template: int
    start: int  # of the words that are aligned with the template
    end: int
    weight: float


def _rows(notice: list[bytes], words: list[bytes], index: Index) -> np.ndarray:
    """For each number of words from the start the weight of their heaviest common subsequence with the notice."""
    number = {w: i for i, w in enumerate(dict.fromkeys(notice))}
    text = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
    held = np.zeros(len(words) + 1)
    for w in notice:
        new = held.copy()
        new[1:] = np.maximum(held[1:], np.where(text == number[w], held[:-1] + index.weight[w], 0))
        held = np.maximum.accumulate(new)
    return held


def aligned(words: list[bytes], t: int, index: Index) -> tuple[float, int, int]:
    """(weight of template t that stands in the words in its order, whatever lies between; first and end of what stands there)."""
    notice = PARSED[t][1]
    held = _rows(notice, words, index)
    best = float(held[-1])
    if best < JUDGED * index.total[t]:
        return best, 0, len(words)
    end = int(np.argmax(held >= best - 1e-9))
    back = _rows(notice[::-1], words[:end][::-1], index)
    return best, end - int(np.argmax(back >= best - 1e-9)), end


def stands(phrase: list[bytes], words: list[bytes]) -> bool:
    """The phrase's words stand in order within SLACK words more than it has."""
    for at in (i for i, w in enumerate(words) if w == phrase[0]):
        i = 0
        for w in words[at : at + len(phrase) + SLACK]:
            i += i < len(phrase) and w == phrase[i]
        if i == len(phrase):
            return True
    return False


def judge(words: list[bytes], t: int, low: int, high: int, index: Index) -> tuple[float, Match | None]:
    """Share of template t that is aligned with the words from `low` to `high`, and the match if it counts as found."""
    low = max(0, low)
    weight, start, end = aligned(words[low : max(low, high)], t, index)
    share, near = weight / index.total[t], words[max(0, low + start - SLACK) : low + end + SLACK]
    found = share >= COVER and all(stands(p, near) for p in PARSED[t][2])
    return share, Match(t, low + start, low + end, weight) if found else None


def strongest(matches: set[Match]) -> set[str]:
    """Labels of the matches but those that another label's heavier match covers by more
    than half: the words of one notice also align with its shorter or plainer kin."""
    out = set()
    ordered = sorted(matches, key=lambda m: (m.start, m.end, m.template))
    reach = max((m.end - m.start for m in ordered), default=0)
    starts = [m.start for m in ordered]
    for m in ordered:
        others = ordered[bisect_left(starts, m.start - reach) : bisect_left(starts, m.end)]
        covered = lambda x: 2 * (min(x.end, m.end) - max(x.start, m.start)) > m.end - m.start  # noqa: B023, E731
        label = PARSED[m.template][0]
        if not any(x.weight > m.weight + 1e-9 and PARSED[x.template][0] != label and covered(x) for x in others):
            out.add(label)
    return out


def match_templates(words: list[bytes], index: Index) -> tuple[set[str], float]:
    """Labels of the templates found in the words, and the highest share of a
    template that is aligned among those of JUDGED or more (0 if there is none).

    Offsets are counted in bands as wide as DRIFT of the template, each reaching
    halfway into the next, and each position of the template once in a band. So
    words that were put in or left out may move what follows by half a band.
    """
    matches, best, postings, weight = set(), 0.0, index.postings, index.weight
    need = [(SEEDED + JUDGED - 1) * x - 1e-9 for x in index.total]
    step = [max(1, int(DRIFT * len(notice)) // 2) for _, notice, _ in PARSED]
    seen: dict[tuple[int, int], int] = defaultdict(int)  # (template, band): positions that voted, as bits
    votes: dict[tuple[int, int], float] = defaultdict(float)
    for lo in range(0, len(words), RUN):
        for at in [i for i, w in enumerate(words[lo : lo + RUN], lo) if w in postings]:
            x = weight[words[at]]
            for t, p in postings[words[at]]:
                band = (at - p) // step[t]
                for key in ((t, band), (t, band - 1)):
                    if not seen[key] >> p & 1:
                        seen[key] |= 1 << p
                        votes[key] += x
        done = lo + RUN if lo + RUN < len(words) else len(words) + 2 * LONGEST
        for t, band in [k for k in votes if (k[1] + 2) * step[k[0]] + len(PARSED[k[0]][1]) <= done]:
            del seen[t, band]
            if votes.pop((t, band)) >= need[t]:
                share, match = judge(words, t, band * step[t] - SLACK, (band + 2) * step[t] + len(PARSED[t][1]) + SLACK, index)
                best = max(best, share if share >= JUDGED else 0.0)
                if match:
                    matches.add(match)
    return strongest(matches), best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, labels, score) for each row of docs.

    places: (start, label) of the base phrases in order; labels: those of the
    base phrases and of the templates, distinct and sorted; score: the highest
    share of a template in place (from JUDGED on, else 0), at least 0.9 where a base
    phrase stands; labels and scores depend on all texts only through IDF. Null
    and empty texts have no words and no labels; null ids, repeated rows and
    other columns do no harm; an empty table gives an empty result.
    """
    index = build_index(*document_counts(docs, text_col))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text"):
                words = words_of(t.as_py())
                base = base_places(words)
                labels, score = match_templates(words, index)
                labels |= {label for _, label in base}
                out.append((len(words), [{"start": s, "label": x} for s, x in sorted(base)], sorted(labels), min(1.0, max(score, 0.9 if base else 0.0))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), place, pa.list_(pa.string()), pa.float64())))], ["doc_id", "n_words", "places", "labels", "score"])

    return shipped(slim).mapInArrow(run, "doc_id long, n_words long, places array<struct<start: long, label: string>>, labels array<string>, score double")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.transform("places", lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return scan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


QUERIES = {"op9_license_scan": op9_license_scan}
