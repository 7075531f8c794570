"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Words are lower-cased runs of letters and digits, shingles five words (a template of fewer words is
one shingle of all its words). Templates are classed by shingle count, up to a power of two N, and
texts are covered by windows of 1.5 N shingles every N/4, so that a run as long as the template lies
in a window. Such a window that holds four fifths of the template's shingles has a resemblance of at
least J, known for each class; bands of one MinHash row, as many as make a miss less likely than
1 in 10000, retrieve the templates, and containment in the windows' words, counted exactly, decides.
Templates are notices of a line and whole license texts (or any table of names and texts); one of a single
shingle is found if the shingle is.

Null and empty texts have no match; matches are counted once for each document and template (best
containment, then first place). Copies of rows have rows of their own. Texts of any length are scanned
whole. Empty tables give empty ones, and so do no templates. Only id and text are read.
"""

from __future__ import annotations

from math import ceil, log
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm import common as C
from strandwise.llm.common import U64

#: The usual wordings of license notices. Whole texts are beside them.
TEMPLATES = {
    "agpl-3": "This program is licensed under the GNU Affero General Public License, version 3.",
    "all-rights": "All rights reserved.",
    "apache-2": "Licensed under the Apache License, Version 2.0.",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}



def whole_texts() -> dict[str, str]:
    """Whole license texts, by name: the files of license_texts."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_NONE = U64(2**64 - 1)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = C.LOWER[data]
    starts, ends = C.runs(_WORD[low], offs)
    return starts, ends, C.per_row(starts, offs), C.token_hashes(low, starts, ends)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words; one fewer for each further word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, U64(size))
    for k in range(size):
        h = C.mix(h * U64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.where(h == _NONE, U64(0), h)


class _Class:
    """Templates of one shingle size with more than N/2 and up to N shingles."""

    def __init__(self, size: int, top: int, templates: list[tuple[str, np.ndarray]], containment: float, miss: float, seed: int):
        self.size, self.top, self.templates = size, top, templates
        self.step = max(1, top // 4)
        self.window = -(-max(top, (3 * top) // 2 if top > 1 else 1) // self.step) * self.step
        least = min((need := ceil(containment * len(s) - 1e-9)) / (self.window + len(s) - need) for _, s in templates)
        self.bands = 1 if least >= 1 else ceil(log(miss) / log(1 - least))
        self.salts = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 62, self.bands, dtype=np.int64).view(U64) * U64(2) + U64(1)
        self.keys, self.which = [], []
        for a in self.salts:
            least_of = np.array([self.permuted(s, a).min() for _, s in templates], U64)
            order = np.argsort(least_of, kind="stable")
            self.keys.append(least_of[order])
            self.which.append(order)
        self.filters = []
        for keys in self.keys:
            seen = np.zeros(1 << 16, bool)
            seen[(keys & U64(0xFFFF)).astype(np.int64)] = True
            self.filters.append(seen)

    @staticmethod
    def permuted(h: np.ndarray, salt: np.uint64) -> np.ndarray:
        h = (h ^ (h >> U64(29))) * salt
        return h ^ (h >> U64(32))

    def candidates(self, shingles: np.ndarray, at: np.ndarray) -> set[tuple[int, int, int]]:
        """(row, window's first shingle within the row, template). at: the rows' offsets among the shingles."""
        n = np.diff(at)
        room = -(-np.maximum(n, 1) // self.step) * self.step + self.window  # windows don't run into the next row
        base = np.cumsum(room) - room
        spread = np.zeros(int(room.sum()), np.int64)
        valid = np.zeros(len(spread), bool)
        to = C.ragged(base, n)
        spread[to], valid[to] = np.arange(len(shingles)), True
        out: set[tuple[int, int, int]] = set()
        values = np.full(len(spread), _NONE)
        for salt, keys, which, seen in zip(self.salts, self.keys, self.which, self.filters, strict=True):
            values[to] = self.permuted(shingles, salt)
            least = values.reshape(-1, self.step).min(1) if self.step > 1 else values
            wide = self.window // self.step
            if wide > 1:
                slid = least.copy()
                for k in range(1, wide):
                    np.minimum(slid[:-k], least[k:], out=slid[:-k])
                least = slid
            hit = np.flatnonzero(seen[(least & U64(0xFFFF)).astype(np.int64)])
            hit = hit[C.find(keys, least[hit]) >= 0]
            if not len(hit):
                continue
            row = np.searchsorted(base, hit * self.step, "right") - 1
            for h, r in zip(hit.tolist(), row.tolist(), strict=True):
                i, j = np.searchsorted(keys, least[h]), np.searchsorted(keys, least[h], "right")
                out.update((r, h * self.step - int(base[r]), int(t)) for t in which[i:j])
        return out


class LicenseScanner:
    def __init__(self, templates: dict[str, str] | None = None, shingle: int = 5, containment: float = 0.8, miss: float = 1e-4):
        self.containment = containment
        groups: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        for name, text in sorted((TEMPLATES | whole_texts() if templates is None else templates).items()):
            data = np.frombuffer((text or "").encode(), np.uint8)
            words = word_hashes(data, np.array([0, len(data)]))[3]
            if len(words):
                size = min(shingle, len(words))
                s = np.unique(shingle_hashes(words, size))
                groups.setdefault((size, 1 << (len(s) - 1).bit_length()), []).append((name, s))
        self.classes = [_Class(size, top, found, containment, miss, k) for k, ((size, top), found) in enumerate(sorted(groups.items()))]

    def matches(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, str, float, int, int]]:
        """(row, template, containment, bytes from, bytes to), one for each row and template."""
        starts, ends, at, words = word_hashes(data, offs)
        best: dict[tuple[int, str], tuple] = {}
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for c in self.classes:
            if c.size not in made:
                n = np.maximum(np.diff(at) - c.size + 1, 0)
                all_ = shingle_hashes(words, c.size)
                made[c.size] = all_[C.ragged(at[:-1], n)], np.concatenate(([0], np.cumsum(n)))
            shingles, upto = made[c.size]
            for row, first, t in c.candidates(shingles, upto):
                name, wanted = c.templates[t]
                a = int(upto[row]) + max(first, 0)
                held = shingles[a : min(a + c.window, int(upto[row + 1]))]
                found = np.isin(held, wanted)
                share = len(np.unique(held[found])) / len(wanted)
                if share >= self.containment - 1e-9:
                    where = np.flatnonzero(found)
                    w = int(at[row]) + max(first, 0)
                    new = (share, -int(starts[w + where[0]] - offs[row]), int(ends[w + where[-1] + c.size - 1] - offs[row]))
                    if (row, name) not in best or new[:2] > best[row, name][:2]:
                        best[row, name] = new
        return sorted((row, name, share, -a, b) for (row, name), (share, a, b) in best.items())

    def scan(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, license, containment, start_byte and end_byte of every match."""
        scanner = self

        def scanned(batches):
            for batch in batches:
                for i, _, data, offs in C.text_blocks(batch):
                    if found := scanner.matches(data, offs):
                        row, name, share, a, b = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + r for r in row])), pa.array(name), pa.array(share), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "license", "containment", "start_byte", "end_byte"])

        chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        return chosen.mapInArrow(scanned, "doc_id long, license string, containment double, start_byte long, end_byte long")
