"""Operator 2, license scans.

A template is a set of shingles of five words (of all its words, if it has fewer).  Every text is covered with
overlapping windows of as many shingles as the template has, an eighth of that apart.  Windows and templates have
min-hash signatures of BANDS bands of one row; a window that agrees with a template in some band retrieves it.  A
passage that holds LEAST = 0.75 of a template's shingles within the template's length has a window of similarity 0.52
or more, and so is retrieved with a probability of at least 1 - 0.48**BANDS, 0.99999 for 16 bands.

What is retrieved is verified exactly: over all places of the text the share of the template's shingles within its
length is counted, and the matches are the places where it is LEAST or more, overlapping ones put together.  Of
matches of a family (near relatives, see FAMILIES) that overlap, those stay that no other beats: it holds more of its
shingles and has a better share, or a template that contains the other's.

Words are runs of letters, digits and bytes from 0x80 on, in lower case.  Defined results: null and empty texts have
no matches; a text with repeated notices has a row for each; very long texts are scanned whole; repeated rows are repeated;
other columns are ignored, whatever their names; an empty table has no matches.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.llm.common import map_batches, rows_of, table
from packframe.llm.shingles import combine, words

LEAST, BANDS, WORDS = 0.75, 16, 5
#: Bytes of text worked on at a time, but for longer texts.
AT_ONCE = 1 << 20

#: Notices by name; any others can be given.
TEMPLATES = {
    "cc-by-nc-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "mit notice": "Released under the MIT License.",
    "all rights reserved": "All rights reserved.",
    "apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "gpl-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}

_WARRANTY = (
    " is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
)


def _gnu(what: str, license: str, version: str) -> str:
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {license} as published by the Free Software Foundation, either version {version} of "
        f"the License, or (at your option) any later version. This {what}{_WARRANTY}See the GNU {license} for more details."
    )


#: More notices, near relatives of the former among them.
RELATIVES = {
    "gpl-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0 header": _gnu("program", "General Public License", "2"),
    "lgpl-2.1 header": _gnu("library", "Lesser General Public License", "2.1"),
    "lgpl-3.0 header": _gnu("program", "Lesser General Public License", "3"),
    "agpl-3.0 header": _gnu("program", "Affero General Public License", "3"),
    "bsd-3-clause": TEMPLATES["bsd-2-clause"]
    + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-2.0 header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by-4.0 notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-1.0 notice": "has waived all copyright and related or neighboring rights to",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}

#: Names that are near relatives.
FAMILIES = (
    {"gpl-3.0 notice", "gpl-2.0 notice"},
    {"gpl-3.0 header", "gpl-2.0 header", "lgpl-2.1 header", "lgpl-3.0 header", "agpl-3.0 header"},
    {"bsd-2-clause", "bsd-3-clause"},
)

_PARTS = np.ones(256, bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Template:
    name: str
    width: int  # words of a shingle
    length: int  # shingles, repeated ones counted
    shingles: np.ndarray  # sorted distinct hashes
    signature: np.ndarray  # least of each band's hashes

    @staticmethod
    def of(name: str, text: str) -> Template | None:
        h, _, _ = words(np.frombuffer(text.encode(), np.uint8), _PARTS)
        if not len(h):
            return None
        width = min(WORDS, len(h))
        own = combine(h, np.arange(len(h) - width + 1), width)
        return Template(name, width, len(own), np.unique(own), _hashes(own).min(1))


def _hashes(shingles: np.ndarray) -> np.ndarray:
    """A row of 32-bit hashes for each band."""
    return (shingles[None, :] * _SEEDS[:, None] >> np.uint64(32)).astype(np.uint32)


def _window_minima(hashes: np.ndarray, lengths: set[int]) -> dict[int, np.ndarray]:
    """For each length, the least hash of every window; windows at the end are shorter."""
    out, held, size = {}, hashes, 1
    for length in sorted(lengths):
        while 2 * size <= length:
            ahead = np.full_like(held, _FAR)
            ahead[:, :-size] = held[:, size:]
            held = np.minimum(held, ahead)
            size *= 2
        ahead = np.full_like(held, _FAR)
        skip = length - size
        ahead[:, : held.shape[1] - skip] = held[:, skip:]
        out[length] = np.minimum(held, ahead)
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], least: float = LEAST):
        found = [Template.of(*x) for x in templates.items()]
        self.templates = [t for t in found if t]
        self.least = least
        self.shingles = {t.name: frozenset(t.shingles.tolist()) for t in self.templates}
        self.widest = max((t.length for t in self.templates), default=1)

    def scan(self, texts: list[bytes | None]) -> list[list[tuple[str, int, int, float]]]:
        """For each text the matches: name, first byte, byte behind the last, best share."""
        out: list[list[tuple[str, int, int, float]]] = []
        group: list[bytes] = []
        held = 0
        for t in texts:
            group.append(t or b"")
            held += len(group[-1])
            if held > AT_ONCE:
                out += self._scan(group)
                group, held = [], 0
        return out + (self._scan(group) if group else [])

    def _scan(self, texts: list[bytes]) -> list[list[tuple[str, int, int, float]]]:
        buffer = np.frombuffer(b"\n".join(texts), np.uint8)
        h, start, end = words(buffer, _PARTS)
        byte = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        first = np.searchsorted(start, byte)
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        for width in sorted({t.width for t in self.templates}):
            own = [t for t in self.templates if t.width == width]
            count = np.maximum(0, np.diff(first) - width + 1)  # shingles of each text
            text_of = np.repeat(np.arange(len(texts)), count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            shingles = combine(h, first[text_of] + within, width)
            # texts are set so far apart that no window reaches into the next
            gap = max(t.length for t in own)
            place = np.arange(len(shingles)) + text_of * gap
            spaced = np.full((BANDS, len(shingles) + len(texts) * gap), _FAR, np.uint32)
            spaced[:, place] = _hashes(shingles)
            minima = _window_minima(spaced, {t.length for t in own})
            bounds = np.concatenate(([0], np.cumsum(count)))
            for t in own:
                step = max(1, t.length // 8)
                grid = np.flatnonzero(within % step == 0)
                agreed = (minima[t.length][:, place[grid]] == t.signature[:, None]).any(0)
                for i in np.unique(text_of[grid[agreed]]).tolist():
                    a, b = bounds[i], bounds[i + 1]
                    for lo, hi, share in self._verified(t, shingles[a:b]):
                        out[i].append((t.name, int(start[first[i] + lo] - byte[i]), int(end[first[i] + hi + width - 1] - byte[i]), share))
        return [sorted(self._best(x), key=lambda m: (m[1], m[2], m[0])) for x in out]

    def _best(self, matches: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """The matches that no overlapping one of their family beats."""
        out = [m for m in matches if not any(m[0] in family for family in FAMILIES)]
        for family in FAMILIES:
            by: dict[str, list] = {}
            for m in matches:
                if m[0] in family:
                    by.setdefault(m[0], []).append(m)  # of one template: disjoint, in order
            ends = {name: [m[2] for m in own] for name, own in by.items()}
            for name, own in by.items():
                for m in own:
                    beaten = False
                    for other in by.keys() - {name}:
                        i = bisect_right(ends[other], m[1])
                        while not beaten and i < len(by[other]) and by[other][i][1] < m[2]:
                            beaten = self._beats(by[other][i], m)
                            i += 1
                    if not beaten:
                        out.append(m)
        return out

    def _beats(self, a: tuple, b: tuple) -> bool:
        x, y = self.shingles[a[0]], self.shingles[b[0]]
        return (round(a[3] * len(x)), a[3]) > (round(b[3] * len(y)), b[3]) and (a[3] > b[3] or y < x)

    def _verified(self, t: Template, shingles: np.ndarray) -> list[tuple[int, int, float]]:
        """First and last shingle of each match, and the best share in it."""
        at = np.minimum(np.searchsorted(t.shingles, shingles), len(t.shingles) - 1)
        hits = np.flatnonzero(t.shingles[at] == shingles)
        kind, need = at[hits].tolist(), self.least * len(t.shingles)
        counts: dict[int, int] = {}
        out: list[list] = []
        left = 0
        for right, place in enumerate(hits.tolist()):
            counts[kind[right]] = counts.get(kind[right], 0) + 1
            while hits[left] <= place - t.length:
                counts[kind[left]] -= 1
                if not counts[kind[left]]:
                    del counts[kind[left]]
                left += 1
            if len(counts) >= need:
                share = len(counts) / len(t.shingles)
                if out and hits[left] <= out[-1][1]:
                    out[-1][1] = place
                    out[-1][2] = max(out[-1][2], share)
                else:
                    out.append([int(hits[left]), place, share])
        return [tuple(x) for x in out]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """A row per match: id, license, start_byte and end_byte of the text's UTF-8, share of the template's shingles."""
    chosen = TEMPLATES | RELATIVES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, least)
        for batch in batches:
            for part in rows_of(batch):
                found = scanner.scan(part.column(1).cast(pa.binary()).to_pylist())
                rows = [(i, *m) for i, ms in zip(part.column(0).to_pylist(), found, strict=True) for m in ms]
                if rows:
                    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [id_col, "license", "start_byte", "end_byte", "share"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), run, f"{id_col} long, license string, start_byte long, end_byte long, share double")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
