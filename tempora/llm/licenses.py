"""License scans by conditional compression.

Words that license notices use are marks; a block is the words around marks, as far as the longest template reaches either way,
whatever the lines are. Case, punctuation, line breaks and comment signs don't count: blocks and templates are rows of words.
A block is scanned in overlapping windows of twice that reach. Each is compressed alone and with each template as a raw
dictionary, and the templates are ranked by the bytes saved. They are compared with the window word by word in that order; the
first that is confirmed wins, and where the next ones save about as much, the one whose wording differs least. What lies before
and behind a notice is scanned again for others.
"""

from __future__ import annotations

import difflib
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import map_arrow

# The wording of public license notices.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-short": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
MARKS = ("licen", "copyright", "permission", "redistribut", "warrant")
_WORD = re.compile(r"[A-Za-z0-9.]*[A-Za-z0-9]")
#: A template is confirmed if this share of its words is in the window in their order, among at most a fifth as many others.
MIN_WORDING, OTHERS = 0.85, 5
#: A notice has a run of its template's words that is at least such a part of it, and of two words if it has two.
RUN_PART = 25
#: Templates that save so many bytes less than the best confirmed one still count as its equals.
TIE = 16
LEVEL = 12


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Words:
    """The words of a text and their places, without a copy of each."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, array("q"), array("q")
        for m in _WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def __len__(self) -> int:
        return len(self.starts)

    def part(self, a: int, b: int) -> list[str]:
        return [self.text[s:e].lower() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True)]


class Scanner:
    """Finds notices of the templates. A template without any of MARKS adds its longest word to the marks."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {k: w for k, v in templates.items() if (w := words_of(v))}
        self.counts = {k: Counter(v) for k, v in self.words.items()}
        self.marks = [*MARKS, *sorted({max(w, key=lambda x: (len(x), x)) for w in self.words.values() if not any(m in x for x in w for m in MARKS)})]
        self.mark = re.compile("|".join(map(re.escape, self.marks)), re.IGNORECASE | re.ASCII)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        self.given = {k: zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, w in self.words.items()}
        self.reach = max(map(self.span, self.words.values()), default=0)

    @staticmethod
    def span(words: list[str]) -> int:
        """How many words a notice may take up."""
        return len(words) + len(words) // OTHERS + 3

    def has_mark(self, low: bytes) -> bool:
        return any(m.encode() in low for m in self.marks)

    def ranked(self, own: list[str]) -> list[tuple[int, float, str]]:
        """Templates by the bytes that they save, with the share of the window that this is."""
        data = " ".join(own).encode()
        alone = len(self.plain.compress(data))
        saved = ((alone - len(c.compress(data)), k) for k, c in self.given.items())
        return [(n, n / alone, k) for n, k in sorted(saved, key=lambda x: (-x[0], x[1]))]

    def confirm(self, own: list[str], name: str, matcher: difflib.SequenceMatcher | None = None) -> tuple[int, int, int, int] | None:
        """The first and last word, exclusive, of the template's notice among some words, how many of its words are missing there, and how many it lacks."""
        theirs = self.words[name]
        if (self.counts[name] & Counter(own)).total() < MIN_WORDING * len(theirs):
            return None  # in no order are there enough
        if matcher is None:
            matcher = difflib.SequenceMatcher(autojunk=False)
            matcher.set_seq2(own)
        matcher.set_seq1(theirs)
        least, places = max(min(2, len(theirs)), len(theirs) // RUN_PART), [(0, len(own))]
        while places:
            low, high = places.pop()
            run = matcher.find_longest_match(0, len(theirs), low, high)
            if run.size >= least:
                if found := self._around(matcher, run, len(theirs), low, high):
                    return found
                places += [(run.b + run.size, high), (low, run.b)]
        return None

    @staticmethod
    def _around(matcher: difflib.SequenceMatcher, run: difflib.Match, n: int, low: int, high: int) -> tuple[int, int, int, int] | None:
        """The notice that a run of equal words belongs to."""
        slack = n // OTHERS + 3
        low, high = max(low, run.b - run.a - slack), min(high, run.b - run.a + n + slack)
        runs, open_ = [run], [(0, run.a, low, run.b), (run.a + run.size, n, run.b + run.size, high)]
        while open_:
            a, b, c, d = open_.pop()
            m = matcher.find_longest_match(a, b, c, d) if a < b and c < d else None
            if m and m.size:
                runs.append(m)
                open_ += [(a, m.a, c, m.b), (m.a + m.size, b, m.b + m.size, d)]
        runs.sort(key=lambda m: m.b)
        # words far off at either end are there by chance
        while len(runs) > 1 and runs[1].b - runs[0].b - runs[0].size > 2 * runs[0].size + 1:
            del runs[0]
        while len(runs) > 1 and runs[-1].b - runs[-2].b - runs[-2].size > 2 * runs[-1].size + 1:
            del runs[-1]
        matched, first, last = sum(m.size for m in runs), runs[0].b, runs[-1].b + runs[-1].size
        added = last - first - matched
        return (first, last, n - matched, added) if matched >= MIN_WORDING * n and added <= slack else None

    def winner(self, own: list[str]) -> tuple[str, float, tuple[int, int, int, int]] | None:
        """The first confirmed template in rank order or, of those that save about as much, the one that differs least."""
        matcher = difflib.SequenceMatcher(autojunk=False)
        matcher.set_seq2(own)
        best = None
        for saved, share, name in self.ranked(own):
            if best and saved < best[0] - TIE:
                break
            if (where := self.confirm(own, name, matcher)) and (best is None or (where[2] + where[3], -len(self.words[name])) < best[1]):
                best = best[0] if best else saved, (where[2] + where[3], -len(self.words[name])), name, share, where
        return best and best[2:]

    def window(self, words: Words, marks: list[int], a: int, b: int) -> list[tuple[int, int, str, float, int, int]]:
        """The notices among words a to b: first word, last word (exclusive), template, reduction, words missing, words added."""
        out, left = [], [(a, b)]
        while left:
            a, b = left.pop()
            i = bisect_left(marks, a)
            if i == len(marks) or marks[i] >= b:
                continue
            if won := self.winner(words.part(a, b)):
                name, share, (first, last, missing, added) = won
                out.append((a + first, a + last, name, share, missing, added))
                left += [(a, a + first), (a + last, b)]
        return sorted(out)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str, float, int, int]]]:
        """How many blocks there are, and (start, end, template, reduction, words missing, words added) of each notice."""
        words = Words(text)
        marks = sorted({max(0, bisect_left(words.starts, m.start() + 1) - 1) for m in self.mark.finditer(text)}) if len(words) else []
        blocks: list[list[int]] = []
        for m in marks:
            a, b = max(0, m - self.reach), min(len(words), m + self.reach)
            if blocks and a <= blocks[-1][1]:
                blocks[-1][1] = b
            else:
                blocks.append([a, b])
        out = []
        for a, b in blocks:
            while a < b:
                stop = min(b, a + 2 * self.reach)
                found = self.window(words, marks, a, stop)
                if stop < b:  # one that starts later is whole in the next window
                    found = [x for x in found if x[0] < a + self.reach]
                out += found
                a = b if stop == b else max(a + self.reach, *(x[1] for x in found), 0)
        return len(blocks), [(words.starts[x[0]], words.ends[x[1] - 1], *x[2:]) for x in out]


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_blocks, n_licenses and licenses, an array of (start, stop, license, reduction, missing, added), of each row of docs.

    start and stop are code points, stop exclusive; reduction is the share of a window that the template saves; missing and
    added count the words by which the place differs from it. Null and empty texts, and those without a mark, have no blocks. Repeated rows give the same result each; a null doc_id stays null; other
    columns are ignored; an empty table gives no rows. Whole texts are searched.
    """
    known = dict(templates or TEMPLATES)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("missing", pa.int64()), ("added", pa.int64())]))
    keys = ("start", "stop", "license", "reduction", "missing", "added")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        for b in batches:
            rows = []
            for text in b.column(1):
                data = text.as_py() or b""
                low = data.lower()
                rows.append(scanner.scan(data.decode()) if scanner.has_mark(low) else (0, []))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([len(x) for _, x in rows], pa.int64()), pa.array([[dict(zip(keys, y, strict=True)) for y in x] for _, x in rows], kind)],
                names=["doc_id", "n_blocks", "n_licenses", "licenses"],
            )

    schema = "doc_id long, n_blocks long, n_licenses long, licenses array<struct<start:long,stop:long,license:string,reduction:double,missing:long,added:long>>"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The licenses as one string, license:start:stop:missing:added by place."""
    told = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"], x["stop"], x["missing"], x["added"]))
    return found.select("doc_id", "n_blocks", "n_licenses", F.array_join(told, ",").alias("licenses"))
