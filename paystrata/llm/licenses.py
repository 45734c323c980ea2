"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts and templates are cut into words (letters and digits, lower case) and
five-word shingles. Templates are grouped by length class L (shingles, a power
of two). For a class, a text is covered by windows of 2 L shingles, L apart, so
every stretch of up to L shingles lies in one window. If a window holds a share
``contained`` of a template of t shingles, their Jaccard similarity is at least
contained t / (2 L + (1 - contained) t); the number of MinHash bands follows
from that bound and the wanted probability of meeting in a band. Windows that
meet a template in a band are verified on the shingles themselves.

Templates are a parameter, and their bands a table of bounded size that every
task holds. Documents are independent of each other: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from paystrata.llm.words import mixed

SHINGLE = 5
_WORD = re.compile(r"[^\W_]+")
_MEMO = 300_000
_TOGETHER = 256  # texts whose windows are looked up at once

# The usual wording of license notices, headers, grants and disclaimers.
TEMPLATES = {
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                       "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
                       "your option) any later version.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                             "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                             "implied. See the License for the specific language governing permissions and limitations under the "
                             "License.",
    "apache-2.0-patent-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a "
                               "perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this "
                               "section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer "
                               "the Work",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                 "following conditions are met:",
    "bsd-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                      "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
                      "conditions and the following disclaimer in the documentation and/or other materials provided with the "
                      "distribution.",
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                                "promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
                      "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
                      "PARTICULAR PURPOSE ARE DISCLAIMED.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                      "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                      "option) any later version.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                      "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                      "option) any later version.",
    "gpl-disclaimer": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
                      "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
                      "for more details.",
    "gpl-preamble": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the "
                    "GNU General Public License is intended to guarantee your freedom to share and change free software",
    "gpl-3.0-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                 "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                       "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                       "(at your option) any later version.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                       "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
                       "your option) any later version.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
                 "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
                 "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
                      "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                      "not distributed with this file, You can obtain one at",
}


def words_of(text: str | None) -> list[str]:
    text = text or ""
    lowered = text.lower()
    return _WORD.findall(lowered) if len(lowered) == len(text) else [w.lower() for w in _WORD.findall(text)]


def shingles_of(words: list[str]) -> list[tuple[str, ...]]:
    """Five-word shingles; the whole sequence where there are fewer words."""
    if not words:
        return []
    k = min(SHINGLE, len(words))
    return list(zip(*(words[i:len(words) - k + 1 + i] for i in range(k))))


def bands_needed(similarity: float, missed: float = 1e-4) -> int:
    """Bands of one MinHash each so that two sets of that similarity meet in one but for ``missed``."""
    return 1 if similarity >= 1 else int(np.ceil(np.log(missed) / np.log1p(-similarity)))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of every shingle."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    if not k:
        return h
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = mixed(total + h[i:len(h) - k + 1 + i])
    return total


@dataclass
class _Class:
    """The templates of one length class, and by band the MinHash value of each."""

    length: int
    members: list[int]
    values: np.ndarray  # bands x members


def _permuted(hashes: np.ndarray, band: int) -> np.ndarray:
    """The permutation of 64-bit values that a band takes the least of."""
    step = np.uint64(0x9E3779B97F4A7C15 * (2 * band + 1) & (1 << 64) - 1)
    return (hashes ^ (step >> np.uint64(7))) * (step | np.uint64(1))


class _Windows:
    """Where the windows of one class lie in the shingles of several texts.

    ``at`` are the starts of blocks of L shingles, a text's first block at its
    first shingle; a window is a block and the next one of the same text.
    """

    def __init__(self, begins: np.ndarray, sizes: np.ndarray, length: int):
        blocks = -(-sizes // length)
        self.text = np.repeat(np.arange(len(sizes)), blocks)
        self.at = begins[self.text] + (np.arange(len(self.text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * length
        self.paired = np.flatnonzero(self.text[1:] == self.text[:-1])

    def least(self, blocks: np.ndarray) -> np.ndarray:
        """Least value of every window, from those of the blocks."""
        low = blocks.copy()
        low[self.paired] = np.minimum(blocks[self.paired], blocks[self.paired + 1])
        return low


_FINE = 4  # blocks of longer classes are put together from blocks of this length


class LicenseIndex:
    """Templates by length class, with bands of MinHash values."""

    def __init__(self, templates: dict[str, str], contained: float = 0.8, missed: float = 1e-4):
        self.names = [n for n in sorted(templates) if words_of(templates[n])]
        self.contained = contained
        self.shingles = [frozenset(shingles_of(words_of(templates[n]))) for n in self.names]
        hashes = [np.unique(shingle_hashes(words_of(templates[n]), _WordHashes())) for n in self.names]
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.shingles):
            classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        # Templates that share at least half of the shingles of either.
        self.rivals = [{j for j, t in enumerate(self.shingles) if j != i and 2 * len(s & t) >= max(len(s), len(t))}
                       for i, s in enumerate(self.shingles)]
        self.classes = []
        for length, members in sorted(classes.items()):
            t = min(len(self.shingles[i]) for i in members)
            need = int(np.ceil(contained * t))
            bands = bands_needed(need / (2 * length + t - need), missed)
            values = np.array([[_permuted(hashes[i], band).min() for i in members] for band in range(bands)])
            self.classes.append(_Class(length, members, values))

    def candidates(self, hashes: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(text, template, first shingle, end) of the windows that meet a template in a band.

        ``hashes`` are the shingles of several texts in a row, ``sizes`` their numbers.
        """
        found: set[tuple[int, int, int, int]] = set()
        texts = np.flatnonzero(sizes)
        if not len(texts) or not self.classes:
            return found
        counts = sizes[texts]
        begins = np.cumsum(counts) - counts
        fine = _Windows(begins, counts, _FINE)
        places = [_Windows(begins, counts, c.length) for c in self.classes]
        inside = [np.searchsorted(fine.at, w.at) if c.length >= _FINE else None for c, w in zip(self.classes, places)]
        for band in range(max(len(c.values) for c in self.classes)):
            permuted = _permuted(hashes, band)
            blocks = np.minimum.reduceat(permuted, fine.at)
            for c, windows, at in zip(self.classes, places, inside):
                if band >= len(c.values):
                    continue
                low = windows.least(np.minimum.reduceat(permuted, windows.at) if at is None else np.minimum.reduceat(blocks, at))
                for template, value in zip(c.members, c.values[band]):
                    for k in np.flatnonzero(low == value).tolist():
                        text = int(windows.text[k])
                        first = int(windows.at[k] - begins[text])
                        found.add((int(texts[text]), template, first, min(int(counts[text]), first + 2 * c.length)))
        return found

    def matches(self, words: list[str], windows: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, share) of the windows of a text that hold their template, overlapping ones joined.

        A window's stretch runs from the first to the last shingle of the template in it.
        """
        spans: dict[int, list[tuple[int, int, float]]] = {}
        for template, first, end in sorted(windows):
            wanted = self.shingles[template]
            k = min(SHINGLE, len(words))
            here = [(i, tuple(words[i:i + k])) for i in range(first, end)]
            hits = [(i, s) for i, s in here if s in wanted]
            share = len({s for _, s in hits}) / len(wanted)
            if share < self.contained:
                continue
            a, b = hits[0][0], hits[-1][0] + k
            mine = spans.setdefault(template, [])
            if mine and a < mine[-1][1]:
                mine[-1] = (mine[-1][0], max(b, mine[-1][1]), max(share, mine[-1][2]))
            else:
                mine.append((a, b, share))
        return [(t, a, b, share) for t, found in sorted(spans.items()) for a, b, share in found]


    def best(self, found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Those matches that no overlapping match of a rival template beats with a larger share; equal shares all stay."""
        kept: list[tuple[int, int, int, float]] = []
        for t, a, b, share in sorted(found, key=lambda m: -m[3]):
            if not any(o in self.rivals[t] and share < other and a < y and x < b for o, x, y, other in kept):
                kept.append((t, a, b, share))
        return sorted(kept)


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = 0.8,
                    best_only: bool = False) -> DataFrame:
    """(doc_id, license, start, end, share) of every stretch that holds a template.

    ``start`` and ``end`` are character offsets, ``share`` the part of the
    template's shingles found. With ``best_only``, of templates that share half
    of their shingles (headers of two versions of a license) only those with the
    largest share of a stretch are reported for it. Null and empty texts hold
    nothing; repeated rows give repeated rows; no templates give no rows. Other
    columns are not read.
    """
    index = LicenseIndex(TEMPLATES if templates is None else templates, contained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(at, _TOGETHER)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                words = [words_of(t) for t in texts]
                hashes = [shingle_hashes(w, known) for w in words]
                windows: dict[int, list[tuple[int, int, int]]] = {}
                for text, *window in index.candidates(np.concatenate(hashes), np.array([len(h) for h in hashes])):
                    windows.setdefault(text, []).append(tuple(window))
                for i, mine in sorted(windows.items()):
                    found = index.matches(words[i], mine)
                    if found:
                        found = index.best(found) if best_only else found
                        spans = [m.span() for m in _WORD.finditer(texts[i])]
                        rows += [(ids[i], index.names[t], spans[a][0], spans[b - 1][1], share) for t, a, b, share in found]
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "license", "start", "end", "share"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, start long, end long, share double")


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against the built-in templates; of versions that share their wording, the one that fits best."""
    return license_matches(spark.read.parquet(f"{folder}/documents.parquet"), best_only=True)
