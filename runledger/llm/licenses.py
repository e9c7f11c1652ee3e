"""License scans by conditional compression.

Candidate blocks are windows of a template's number of words, laid so that a word that licenses use (a hint) stands where the template
has one.  Each window is compressed with the template as raw-content dictionary of zstandard.  What that takes off the window's
compressed size ranks all windows and templates round a hint; those above a share of the template's own compressed size are confirmed in
that order, word by word, and keep their differences in wording.  Windows are one template long, so notices next to each other can't hide
one another, and a place counts once, for the largest reduction that is confirmed.

Hints that windows of both can reach are judged together, however many they are; the results of such stretches are remembered, up to
``MEMORY_BYTES`` a task.  No rows are moved.  Null and empty texts have no findings.  Texts are read whole, however long; repeated rows
are judged alike.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow

# Common short license notices, as published.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
                   "this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or "
                "modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or "
                "modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
                "License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met:"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Licensed under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
}
HINT = r"(?i)licen[sc]e|public domain|permission|redistribut|copyright"
WORD = re.compile(r"\S+")
#: Words that may be added on either side of a place, and the bytes of remembered stretches.
SLACK, MEMORY_BYTES = 2, 16 << 20
FOUND = "ARRAY<STRUCT<license: STRING, start: INT, end: INT, reduction: DOUBLE, similarity: DOUBLE, differences: STRING>>"


class Scanner:
    """``least``: share of a template that must be compressed away; ``alike``: share of its words that must be there."""

    def __init__(self, templates: dict[str, list[str]], least: float, alike: float) -> None:
        import zstandard

        self.least, self.alike, self.hint = least, alike, re.compile(HINT)
        self.plain = zstandard.ZstdCompressor(level=6, write_content_size=False)
        self.templates, self.anchors = [], []
        for name, texts in templates.items():
            for text in texts:
                raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                found = list(WORD.finditer(text))
                at = self.hinted(text, [m.start() for m in found])
                if not at:
                    raise ValueError(f"a template of {name} has no word by which it could be found")
                self.templates.append((name, [m.group().lower() for m in found], len(self.plain.compress(text.lower().encode())),
                                       zstandard.ZstdCompressor(level=6, dict_data=raw, write_content_size=False)))
                self.anchors.append(at)
        self.reach = max((len(t[1]) for t in self.templates), default=0) + SLACK
        self.memory: dict[str, list[tuple]] = {}
        self.used = 0

    def hinted(self, text: str, starts: list[int]) -> list[int]:
        """Numbers of the words in which hints begin."""
        return sorted({max(bisect_right(starts, hit.start()) - 1, 0) for hit in self.hint.finditer(text)}) if starts else []

    def stretches(self, text: str) -> Iterator[tuple[list[tuple[int, int]], list[int]]]:
        """Words (start, end) and hints (numbers of words) of stretches whose windows touch no other stretch's."""
        words = [m.span() for m in WORD.finditer(text)]
        hints = self.hinted(text, [w[0] for w in words])
        low = 0
        for k in range(1, len(hints) + 1):
            if k == len(hints) or hints[k] - hints[k - 1] > 2 * self.reach:
                first, last = max(0, hints[low] - self.reach), min(len(words), hints[k - 1] + self.reach + 1)
                yield words[first:last], [h - first for h in hints[low:k]]
                low = k

    def reductions(self, block: str, words: list[tuple[int, int]], starts: dict[int, set[int]]) -> list[tuple]:
        """(bytes taken off, share of the template, template, start) of windows, the largest first; ``starts`` by template."""
        out, sizes = [], {}
        for i, places in starts.items():
            _, wanted, own, helped = self.templates[i]
            for start in places:
                low, high = max(start, 0), min(start + len(wanted), len(words))
                if low >= high:
                    continue
                raw = block[words[low][0]:words[high - 1][1]].lower().encode()
                if (low, high) not in sizes:
                    sizes[low, high] = len(self.plain.compress(raw))
                saved = sizes[low, high] - len(helped.compress(raw))
                if saved >= self.least * own:
                    out.append((saved, saved / max(own, 1), i, start))
        return sorted(out, key=lambda x: (-x[0], -x[1], x[2], x[3]))

    def difference(self, plain: list[str], i: int, start: int) -> tuple | None:
        """(begin, end, share of equal words, differences) of a template at about a place, if enough of its words stand there in order."""
        wanted = self.templates[i][1]
        low, high = max(0, start - len(wanted) // 4 - SLACK), min(len(plain), start + len(wanted) + len(wanted) // 4 + SLACK)
        core = difflib.SequenceMatcher(None, plain[low:high], wanted, autojunk=False).find_longest_match()
        if not core.size:
            return None
        first, last = max(low, low + core.a - core.b - SLACK), min(high, low + core.a + len(wanted) - core.b + SLACK)
        runs = [b for b in difflib.SequenceMatcher(None, plain[first:last], wanted, autojunk=False).get_matching_blocks() if b.size]
        begin, end = first + runs[0].a, first + runs[-1].a + runs[-1].size
        same = sum(b.size for b in runs) / max(len(wanted), end - begin)
        if same < self.alike:
            return None
        changes = difflib.SequenceMatcher(None, wanted, plain[begin:end], autojunk=False).get_opcodes()
        return begin, end, same, "; ".join(f"{' '.join(wanted[a:b])} -> {' '.join(plain[begin + c:begin + d])}" for kind, a, b, c, d in changes if kind != "equal")

    def confirm(self, block: str, words: list[tuple[int, int]], ranked: list[tuple]) -> list[tuple]:
        """(license, start, end, share, similarity, differences) of the ranked windows that are what they seem, without overlaps."""
        plain, kept, seen = [block[a:b].lower() for a, b in words], [], set()
        for _, share, i, start in ranked:
            place = self.difference(plain, i, start)
            if place is None or place[:2] in seen:
                continue
            seen.add(place[:2])
            begin, end, same, text = place
            if all(end <= k[0] or begin >= k[1] for k in kept):
                kept.append((begin, end, self.templates[i][0], share, same, text))
        return [(name, words[begin][0], words[end - 1][1], share, same, text) for begin, end, name, share, same, text in sorted(kept)]

    def judge(self, block: str, words: list[tuple[int, int]], hints: list[int]) -> list[tuple]:
        found = self.memory.get(block)
        if found is None:
            starts = {i: {h - a for h in hints for a in anchors} for i, anchors in enumerate(self.anchors)}
            found = self.confirm(block, words, self.reductions(block, words, starts))
            self.used += len(block) + 200 * (1 + len(found))
            if self.used > MEMORY_BYTES:
                self.memory.clear()
                self.used = len(block) + 200 * (1 + len(found))
            self.memory[block] = found
        return found

    def __call__(self, text: str) -> list[dict]:
        out = []
        for words, hints in self.stretches(text):
            low = words[0][0]
            for name, start, end, share, alike, changes in self.judge(text[low:words[-1][1]], [(a - low, b - low) for a, b in words], hints):
                out.append({"license": name, "start": low + start, "end": low + end, "reduction": share, "similarity": alike, "differences": changes})
        return out


def _scan(templates: dict[str, list[str]], least: float, alike: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least, alike)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("reduction", pa.float64()),
                                   ("similarity", pa.float64()), ("differences", pa.string())]))
        for batch in batches:
            found = [scanner(text) if text else [] for text in (x.as_py() for x in batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, kind)], ["doc_id", "found"])
    return run


def scan(documents: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.3, alike: float = 0.8) -> DataFrame:
    """doc_id and found (license, start, end, size reduction, share of equal words, differences) of each document."""
    text = F.col("text").cast("string")
    rows = documents.select(F.when(text.rlike(HINT), text).alias("text"), "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, _scan(templates or TEMPLATES, least, alike), f"doc_id {kind}, found {FOUND}")
