"""Licence notices by conditional compression.

Every text is covered by short overlapping blocks of words. A block is compressed on its own and with all templates as one raw
zstandard dictionary; where that saves bytes, or the block has the words of a template in any order, it is a candidate and is
compressed with each template as the dictionary. Candidates and the words around them form regions, and the templates of a region are ranked by the bytes
that they save. Each that saves any, or whose words are there, is then compared by exact wording: the words of the template that the region
lacks, in order, and the words that the region has between them. The template that explains most words is reported with
both lists, its words leave the region, and so on until no template is confirmed in what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm.common import texts_of

# The standard notice sentences of widely used licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}
#: Words of a block and from one block to the next; bytes that all templates save in a candidate; most of a template's words
#: missing. A notice of up to STEP + 1 words lies whole in some block, which is a candidate by its words whatever it saves.
BLOCK, STEP, MIN_SAVED, MAX_MISSING = 40, 20, 6, 0.1
_WORD = re.compile(r"\w+(?:[.\-]\w+)*")
_FRAME = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _with_dictionary(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=dictionary, **_FRAME)


def align(template: np.ndarray, block: np.ndarray, missing_cost: int) -> list[tuple[int, int]]:
    """Pairs (place in the template, place in the block) of the words that they share in order.

    The least ``missing_cost`` times missing words plus added words between shared ones, over all stretches of the block.
    """
    at = np.arange(len(block) + 1)
    cost = [np.zeros(len(block) + 1, dtype=np.int64)]
    for word in template:
        row = cost[-1] + missing_cost
        row[1:] = np.where(block == word, np.minimum(row[1:], cost[-1][:-1]), row[1:])
        cost.append(np.minimum.accumulate(row - at) + at)
    i, k = len(template), int(cost[-1].argmin())
    pairs = []
    while i:
        if k and block[k - 1] == template[i - 1] and cost[i][k] == cost[i - 1][k - 1]:
            i, k = i - 1, k - 1
            pairs.append((i, k))
        elif cost[i][k] == cost[i - 1][k] + missing_cost:
            i -= 1
        else:
            k -= 1
    return pairs[::-1]


class Scanner:
    """The templates as compressors and word sequences. One instance serves a task."""

    def __init__(self, templates: dict[str, str]):
        self.words = {k: w for k, t in templates.items() if (w := words_of(t))}
        # a notice may have as many words added as the template has
        self.reach = 2 * max(map(len, self.words.values()), default=0)
        self.codes: dict[str, int] = {}
        for word in (w for t in self.words.values() for w in t):
            self.codes.setdefault(word, len(self.codes))
        self.coded = {k: np.array([self.codes[w] for w in t]) for k, t in self.words.items()}
        self.counts = {k: np.bincount(c, minlength=len(self.codes)) for k, c in self.coded.items()}
        self.names = list(self.words)
        self.different = np.array([self.counts[k] > 0 for k in self.names], np.float32).reshape(len(self.names), len(self.codes))
        self.enough = np.array([len(set(w)) - int(MAX_MISSING * len(w)) for w in self.words.values()], np.float32)
        self.alone = zstandard.ZstdCompressor(level=3, **_FRAME)
        content = {k: " ".join(w).encode("utf-8", "surrogatepass") for k, w in self.words.items()}
        self.with_template = {k: _with_dictionary(c) for k, c in content.items()}
        self.with_all = _with_dictionary(b" ".join(content.values()))

    def candidates(self, words: list[str]) -> list[tuple[int, int, dict[str, int]]]:
        """(first word, end, bytes saved by each template that saves any) of each stretch of candidate blocks."""
        found: list[tuple[int, int, dict[str, int]]] = []
        there = self._there(words)
        for a in range(0, max(1, len(words) - STEP), STEP):
            block = " ".join(words[a : a + BLOCK]).encode("utf-8", "surrogatepass")
            alone, possible = len(self.alone.compress(block)), there.get(a, ())
            if not possible and alone - len(self.with_all.compress(block)) < MIN_SAVED:
                continue
            saved = {k: n for k, c in self.with_template.items() if (n := alone - len(c.compress(block))) > 0 or k in possible}
            self._join(found, max(0, a - self.reach), min(len(words), a + BLOCK + self.reach), saved)
        return found

    def _there(self, words: list[str]) -> dict[int, set[str]]:
        """Of the blocks that have (nearly) all different words of a template, the templates by the block's first word."""
        out: dict[int, set[str]] = {}
        at = [i for i, w in enumerate(words) if w in self.codes]
        if not at:
            return out
        code, step = np.array([self.codes[words[i]] for i in at]), np.array(at) // STEP
        # a block is its own step and the next one; steps without such words are skipped
        steps = np.unique(np.concatenate([step, step - 1]))
        for lo in range(0, len(steps), 4096):
            some = steps[lo : lo + 4096]
            have = np.zeros((len(some), len(self.codes)), np.float32)
            for shift in (0, 1):
                place = np.searchsorted(some, step - shift)
                hit = (place < len(some)) & (some[np.minimum(place, len(some) - 1)] == step - shift)
                have[place[hit], code[hit]] = 1
            block, template = np.nonzero(have @ self.different.T >= self.enough)
            for b, t in zip(block, template, strict=True):
                out.setdefault(max(0, int(some[b])) * STEP, set()).add(self.names[t])
        return out

    @staticmethod
    def _join(found: list[tuple[int, int, dict[str, int]]], first: int, end: int, saved: dict[str, int]) -> None:
        """Adds a stretch, as part of the last one where they meet."""
        if found and first <= found[-1][1]:
            first, _, before = found.pop()
            saved = {k: max(saved.get(k, 0), before.get(k, 0)) for k in {**before, **saved}}
        found.append((first, end, saved))

    def _possible(self, templates: list[str], block: np.ndarray) -> list[str]:
        """The templates of which the block has enough words in any order."""
        have = np.bincount(block[block >= 0], minlength=len(self.codes))
        return [k for k in templates if np.maximum(self.counts[k] - have, 0).sum() <= MAX_MISSING * len(self.words[k])]

    def _confirmed(self, block: np.ndarray, saved: dict[str, int], missing_cost: int) -> list[tuple[str, list[tuple[int, int]]]]:
        """Confirmed templates with their pairs, the one that explains most words first; its words leave ``block``."""
        found, tried = [], {}
        while True:
            for k in self._possible(list(saved), block):
                # only what shared a word with the last winner has changed
                if k not in tried or any(block[b] < 0 for _, b in tried[k]):
                    tried[k] = align(self.coded[k], block, missing_cost)
            ranked = []
            for k, pairs in tried.items():
                missing = len(self.words[k]) - len(pairs)
                if pairs and missing <= MAX_MISSING * len(self.words[k]) and all(block[b] >= 0 for _, b in pairs):
                    added = pairs[-1][1] - pairs[0][1] + 1 - len(pairs)
                    ranked.append((added + missing - len(pairs), -saved[k], k))
            if not ranked:
                return found
            best = min(ranked)[2]
            found.append((best, tried[best]))
            block[[b for _, b in tried[best]]] = -1

    def scan(self, text: str | None) -> list[dict]:
        """What is confirmed in each region, in the order of the text."""
        if not text or not self.words:
            return []
        words = words_of(text)
        found = [x for region in self.candidates(words) for x in self._notices(words, *region)]
        if found:
            places = [m.start() for m in _WORD.finditer(text)]
            for x in found:
                x["first_line"], x["last_line"] = (text.count("\n", 0, places[x[k]]) for k in ("first_line", "last_line"))
        return found

    def _notices(self, words: list[str], first: int, end: int, saved: dict[str, int]) -> list[dict]:
        """The notices of a region, in order; lines are given as words."""
        coded = np.array([self.codes.get(w, -1) for w in words[first:end]], dtype=np.int64)
        # near wording first, so that two notices are not taken for one; then with words added anywhere in the region
        hits = self._confirmed(coded, saved, 1) + self._confirmed(coded, saved, len(coded) + 1)
        out = []
        for k, pairs in sorted(hits, key=lambda x: (x[1][0][1], x[0])):
            shared, placed = {i for i, _ in pairs}, {b for _, b in pairs}
            a, b = pairs[0][1], pairs[-1][1]
            out.append({
                "first_line": first + a, "last_line": first + b, "license": k, "saved": saved[k],
                "missing": [w for i, w in enumerate(self.words[k]) if i not in shared],
                "added": [words[first + i] for i in range(a, b + 1) if i not in placed],
            })
        return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_line, last_line, license, saved, missing, added), a row for each confirmed notice.

    Every block of every text is compressed. A confirmed notice may have any words of its region between its own; they are its
    ``added`` words. Where notices overlap, the one that explains most words takes them; ties go to the one that saves more
    bytes, then by name. ``saved`` may be below 0 for short templates. Null and empty texts have no notices. Repeated rows are scanned each for
    itself. Very long texts are scanned block by block. Without templates nothing is found. An empty table gives an
    empty result. Other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "first_line", "last_line", "license", "saved", "missing", "added"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for pdf in batches:
            rows = [{"doc_id": d, **x} for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for x in scanner.scan(t)]
            yield pd.DataFrame(rows, columns=names)

    rows = texts_of(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return rows.mapInPandas(
        run, f"doc_id {kind}, first_line int, last_line int, license string, saved int, missing array<string>, added array<string>"
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "first_line", "last_line", "license", F.size("missing").alias("n_missing"), F.size("added").alias("n_added"))
