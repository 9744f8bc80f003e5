"""License statements by conditional compression.

Words and names that announce a license are cues. For each template the text around its cues, 1.5 times the template's length to both sides, is cut
into overlapping pieces so that a statement with a cue lies whole in one. A piece is compressed alone and with the template as a raw Zstandard dictionary; what that
saves, as a share of what knowing the template saves on the template itself, ranks the templates. Those of GATE or more of the share are winners, and each
is confirmed by its exact wording: wherever one of its first words stands, the piece's words and the template's are aligned, and a template is found if at
least `similarity` of the words on both sides of the aligned stretch are equal and all its numbers and names of licenses occur; the words that differ are
reported. Where winners overlap, the one with the fewest different words counts. All work is linear in the text: pieces are bounded by the templates.
"""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wording of license statements, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Parts of words and names that announce a statement, and words that tell statements apart.
CUE = re.compile(r"licen[cs]|permi[ts]|redistribut|copyright|warrant|free software|(?-i:\b(?:MIT|GNU|CC|BSD|Apache|Mozilla)\b)", re.I)
NAMES = frozenset("apache bsd cc by by-nc by-sa by-nd gnu lesser affero general mit mozilla".split())
#: A template is a winner if a piece gives this share of its own bytes; a statement with four fifths of its words gives more.
GATE = 0.25
SIMILARITY, LEVEL = 0.8, 9

_WORD = re.compile(r"[^\s.,;:()\[\]\"'!?]+(?:\.[0-9]+)*")


def normal(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), *m.span()) for m in _WORD.finditer(text)]


def pieces(text: str, cues: list[int], reach: int) -> list[tuple[int, int]]:
    """Overlapping spans of at most 3 * reach characters (and whole words) around the cues; each run of `reach` characters around a cue lies in one."""
    regions: list[list[int]] = []
    for at in cues:
        if regions and at - reach <= regions[-1][1]:
            regions[-1][1] = at + reach
        else:
            regions.append([at - reach, at + reach])
    out = []
    for a, b in regions:
        for x in [a] if b - a <= 3 * reach else range(a, b - reach, reach):
            y = min(len(text), b if b - a <= 3 * reach else x + 2 * reach)
            x = edge = max(0, x)
            while 0 < x < len(text) and edge - x < 64 and not text[x - 1].isspace():
                x -= 1
            out.append((x, y))
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], similarity: float = SIMILARITY) -> None:
        make = lambda **how: zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False, **how)
        self.alone = make()
        self.given = {}
        for k, t in templates.items():
            known = zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.given[k] = make(dict_data=known)
        self.words = {k: [w for w, _, _ in normal(t)] for k, t in templates.items()}
        self.reach = {k: len(t) + len(t) // 2 + 32 for k, t in templates.items()}
        self.similarity = similarity
        self.worth = {k: self.saved(t, k) for k, t in templates.items()}

    def saved(self, piece: str, name: str) -> int:
        """Bytes of the compressed piece that knowing the template saves."""
        raw = piece.encode("utf-8", "replace")
        return len(self.alone.compress(raw)) - len(self.given[name].compress(raw))

    def rank(self, piece: str) -> list[tuple[float, str]]:
        """(share of the template's bytes that the piece gives, template), most first."""
        return sorted(((self.saved(piece, k) / self.worth[k], k) for k in self.given), key=lambda x: (-x[0], x[1]))

    def confirm(self, found: list[tuple[str, int, int]], name: str) -> list[tuple[int, int, int, int]]:
        """Places of a template in a block's words: (first word, end, words missing, words extra)."""
        want = self.words[name]
        must = {w for w in want if w in NAMES or any(c.isdigit() for c in w)}
        known, reach = set(want), len(want) + len(want) // 4 + 1
        early = set(want[: len(want) - math.ceil(self.similarity * len(want) - 1e-9) + 1])  # one of these is the first equal word
        texts = [w for w, _, _ in found]
        upto = list(accumulate((w in known for w in texts), initial=0))
        out = set()
        for at, word in enumerate(texts):
            if word not in early or upto[min(at + reach, len(texts))] - upto[at] < self.similarity * len(want):
                continue
            part = texts[at : at + reach]
            if not must <= set(part):
                continue
            same = [m for m in difflib.SequenceMatcher(None, want, part, autojunk=False).get_matching_blocks() if m.size]
            for i, first in enumerate(same):  # words that stand alone before or after the statement may be left out
                equal = 0
                for m in same[i:]:
                    equal += m.size
                    begin, end = first.b, m.b + m.size
                    if equal >= self.similarity * max(len(want), end - begin) and must <= set(part[begin:end]):
                        out.add((at + begin, at + end, len(want) - equal, end - begin - equal))
        return sorted(out)

    def scan(self, text: str) -> list[dict]:
        cues = [m.start() for m in CUE.finditer(text)]
        if not cues:
            return []
        winners: dict[tuple[str, int, int], tuple] = {}
        for name, reach in self.reach.items():
            for a, b in pieces(text, cues, reach):
                share = self.saved(text[a:b], name) / self.worth[name]
                if share >= GATE:
                    found = normal(text[a:b])
                    for first, end, missing, extra in self.confirm(found, name):
                        key = (name, a + found[first][1], a + found[end - 1][2])
                        winners[key] = max(winners.get(key, (0.0, 0, 0)), (share, missing, extra))
        starts: list[int] = []
        ends: list[int] = []
        out = []
        for (name, start, end), (share, missing, extra) in sorted(winners.items(), key=lambda x: (x[1][1] + x[1][2], x[0][1] - x[0][2], x[0])):
            k = bisect_left(starts, end)
            if not k or ends[k - 1] <= start:
                starts.insert(k, start)
                ends.insert(k, end)
                out.append({"license": name, "start": start, "end": end, "saved": share, "missing": missing, "extra": extra})
        return sorted(out, key=lambda x: x["start"])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per statement found: doc_id, license (name of the template), start, end (code points), saved (share of the template's
    bytes that the text around it gives), missing and extra (words that differ from the template).

    Null and empty texts have none; a document may have several; repeated rows give repeated rows; an empty table gives
    an empty result; extra columns are left out. Whole texts are scanned.
    """
    own = templates or TEMPLATES
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(own, similarity)
        fields = (("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()), ("missing", pa.int64()), ("extra", pa.int64()))
        for batch in batches:
            rows = [(k, found) for k, text in enumerate(batch.column(1)) for found in scanner.scan(text.as_py() or "")]
            ids = batch.column(0).take(pa.array([k for k, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[n] for _, r in rows], t) for n, t in fields)], ["doc_id", *(n for n, _ in fields)])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, license string, start long, end long, saved double, missing long, extra long")
