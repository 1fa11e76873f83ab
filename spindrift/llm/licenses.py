"""Licence notices found by conditional compression.

A candidate block is a run of words, across lines, in which some template keeps four fifths of its words within one and a half times its length; overlapping runs are one block, and a block may be of any length. Each block is compressed by zstandard alone and with each template as raw dictionary; templates are ranked by the share of the size that this saves. They are confirmed by their exact wording, all in turn: the words of the template that the block lacks or alters, in order, may be no more than a fifth, further words between no more than half as many as the template has, and numbers (versions) must all be there. Of templates that fit one place the closest goes first, by ties that which saves most; the words of a confirmed notice are taken out and the rest is matched again, until nothing is confirmed. A confirmed notice names its licence and lists its wording differences.

Defined results: null text has no blocks; ties of savings go to the template listed first; repeated rows each get their row; a null doc_id keeps its row; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import collections
import difflib
import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Notices of public licences, fixed values: (licence, wording).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain worldwide under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
WORD = re.compile(r"\w+(?:[.-]\w+)*")


@dataclass(frozen=True)
class Match:
    license: str
    gain: float
    differences: str


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, level: int = 19, most_lost: float = 0.2, most_between: float = 0.5):
        self.most_lost, self.most_between = most_lost, most_between
        plain = zstandard.ZstdCompressionParameters.from_level(level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False)
        self.alone = zstandard.ZstdCompressor(compression_params=plain)
        self.known = [(name, WORD.findall(t.lower()), zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=plain)) for name, t in templates]
        self.spelled = [(wanted, [x for w in wanted for x in w.split("-")]) if any("-" in w for w in wanted) else (wanted,) for _, wanted, _ in self.known]  # a line may end at a hyphen
        self.reach = max(self.room(len(way)) for ways in self.spelled for way in ways)
        self.match = functools.lru_cache(maxsize=10_000)(self._match)

    def gains(self, block: str) -> list[float]:
        """Share of the compressed size that each template saves."""
        data = block.encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(data))
        return [1 - len(press.compress(data)) / size for _, _, press in self.known]

    def room(self, n: int) -> int:
        """Words that a notice of n words may take."""
        return n + int(self.most_between * n)

    def least(self, n: int) -> int:
        """Words of n that a notice must keep."""
        return n - int(self.most_lost * n)

    def confirmed(self, wanted: list[str], words: list[str | None]) -> tuple[list[int], list[str], str, int] | None:
        """Places of the template's words, lost words, differences and further words between, if the words hold the notice."""
        edits = difflib.SequenceMatcher(None, wanted, words, autojunk=False).get_opcodes()
        lost = [w for kind, a, b, _, _ in edits if kind != "equal" for w in wanted[a:b]]
        if len(lost) > self.most_lost * len(wanted) or any(c.isdigit() for w in lost for c in w):
            return None
        inner = [e for e in edits if e[0] != "equal" and not (e[0] == "insert" and e[1] in (0, len(wanted)))]  # words before and after the notice are no difference of it
        differences = "; ".join(f"{' '.join(wanted[a:b])} -> {' '.join(w for w in words[c:d] if w)}" for _, a, b, c, d in inner)
        places = [k for kind, _, _, c, d in edits if kind == "equal" for k in range(c, d)]
        return places, lost, differences, places[-1] + 1 - places[0] - len(places)

    def in_order(self, wanted: list[str], words: list[str | None], since: int = 0) -> tuple[int, range, str] | None:
        """Of the first notice that starts at `since` or later: words held less words lost or between, place, differences."""
        room, least = self.room(len(wanted)), self.least(len(wanted))
        need, have, shared, best, last = collections.Counter(wanted), collections.Counter(), 0, None, len(words)
        for end in range(since + 1, len(words) + room - least + 1):
            start = end - room
            if end <= len(words):
                w = words[end - 1]
                have[w] += 1
                shared += have[w] <= need[w]
            if start > since:
                w = words[start - 1]
                shared -= have[w] <= need[w]
                have[w] -= 1
            if start > last:
                break
            if shared < least or (end < min(since + room, len(words)) and words[end - 1] not in need):
                continue
            at = max(start, since)
            if (got := self.confirmed(wanted, words[at:end])) and got[3] <= self.most_between * len(wanted):
                rank = (len(got[1]), got[3])
                if best is None:
                    last = at + len(wanted)
                if best is None or rank < best[0]:
                    best = rank, len(got[0]) - sum(rank), range(at + got[0][0], at + got[0][-1] + 1), got[2]
                if rank == (0, 0):
                    break
        return best and best[1:]

    def _match(self, block: str) -> list[tuple[Match, int]]:
        """Every notice of a block, and the place of its first word; of templates that fit one place the closest, by ties that which saves most."""
        words: list[str | None] = list(WORD.findall(block.lower()))
        out = []
        possible = self.possible(set(words))
        gains = self.gains(block)

        def first(i: int, since: int) -> tuple[int, range, str] | None:
            return max((x for way in self.spelled[i] if (x := self.in_order(way, words, since))), key=lambda x: x[0], default=None)

        held = {i: got for i in sorted(possible, key=lambda i: -gains[i]) if (got := first(i, 0))}
        while held:
            i = max(held, key=lambda i: (held[i][0], gains[i]))
            _, place, differences = held[i]
            out.append((Match(self.known[i][0], gains[i], differences), place.start))
            for k in place:
                words[k] = None
            for j in [j for j in held if held[j][1].start < place.stop and place.start < held[j][1].stop]:
                got = first(j, max(0, min(place.start, held[j][1].start) - self.reach))  # none before
                held.pop(j)
                if got:
                    held[j] = got
        return out

    def possible(self, there: set[str]) -> list[int]:
        """Templates that keep enough of their words in a text of these words."""
        return [i for i, ways in enumerate(self.spelled) if any(sum(w in there for w in way) >= self.least(len(way)) for way in ways)]

    def blocks(self, words: list[str], possible: list[int]) -> list[tuple[int, int]]:
        """First word and end of each candidate block, in order."""
        runs = []
        for way in (way for i in possible for way in self.spelled[i]):
            room, least = self.room(len(way)), self.least(len(way))
            need, have, shared, lo = collections.Counter(way), collections.Counter(), 0, 0
            at = [k for k, w in enumerate(words) if w in need]
            for k in at:
                while k - at[lo] >= room:
                    w = words[at[lo]]
                    shared -= have[w] <= need[w]
                    have[w] -= 1
                    lo += 1
                have[words[k]] += 1
                shared += have[words[k]] <= need[words[k]]
                if shared >= least:
                    runs.append((at[lo], k + 1))
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(runs):
            if out and lo < out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], hi))
            else:
                out.append((lo, hi))
        return out

    def notices(self, text: str) -> tuple[int, list[Match]]:
        """Number of candidate blocks, and the notices of a whole text."""
        possible = self.possible(set(WORD.findall(text.lower())))
        if not possible:
            return 0, []
        tokens = list(WORD.finditer(text))
        found = self.blocks([m[0].lower() for m in tokens], possible)
        return len(found), [match for lo, hi in found for match, _ in sorted(self.match(text[tokens[lo].start() : tokens[hi - 1].end()]), key=lambda x: x[1])]


@functools.lru_cache(maxsize=1)
def known() -> Templates:
    return Templates()


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_blocks, n_notices, licenses, gain, differences) of every row; licenses sorted, each once, comma-joined; gain the largest of the notices, null without any."""
    common.short_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = known()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in b.column(1).to_pylist():
                tried, found = templates.notices(text or "")
                for column, x in zip(out, (tried, len(found), ",".join(sorted({m.license for m in found})), max((m.gain for m in found), default=None), " | ".join(m.differences for m in found if m.differences)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()), strict=True))], ["doc_id", "n_blocks", "n_notices", "licenses", "gain", "differences"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n_blocks long, n_notices long, licenses string, gain double, differences string")
