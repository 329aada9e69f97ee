"""License scan by conditional compression.

A text's lines around words that license notices use are candidate blocks. Around each such word, the
wording of a window that holds any confirmable run of a template's is compressed with zstandard alone and with
the template's wording as a raw dictionary. The bytes that the template saves, as a share of those that it saves on
itself, say how much of it the window holds, and choose the templates that are compared: what saves less than
LEAST_SAVED is not looked at. A chosen template is confirmed by the exact differences of wording: the words of
the template that the window lacks, and the order of those it has; of templates equally well covered the
one that saves most of the window's size is taken. A window is no longer than its template needs, so no line is too
long. The windows reach over the block's ends, since a notice's first and last lines often have none of the words.

A notice is often one line that names a license. The templates are therefore whole notices and single
lines; each is compared with the run of block words that it lines up with best.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserae.llm.common import slices

#: Wordings of public license notices, by SPDX-like name. They are parameters of ``scan``.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: The notices, and for each license the line that names it by its identifier.
TEMPLATES = (*NOTICES, *((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in NOTICES)))

#: Words that make a line part of a candidate block.
CUE = re.compile(r"(?i)licen[sc]e|copyright|permission|redistribut|warrant|public domain|all rights reserved|spdx")
#: Share of a template's words that must stand in the block, in order, and of its figures and names: all.
COVER = 0.9
#: Least saving that lets a template be compared, as a share of what the template saves on its own wording. Windows that can be confirmed
#: save more (tests/llm/test_licenses.py), since nine tenths of the template's words stand in them.
LEAST_SAVED = 0.5
#: Words that deny what follows, and how many words before a notice they are looked for.
DENIALS = frozenset("not never cannot isn nicht".split())
BEFORE = 4
#: Distinct windows that a worker remembers; bounds its memory, not the result.
CACHE_BLOCKS = 20_000
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


@functools.lru_cache(CACHE_BLOCKS)
def _code(word: str) -> bytes:
    return hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of adjacent lines with a cue, joined over up to two lines between them."""
    if not CUE.search(text):
        return
    at, begin, end, gap = 0, -1, -1, 0
    for line in text.splitlines(keepends=True):
        if CUE.search(line):
            begin, end, gap = (at if begin < 0 else begin), at + len(line.rstrip("\r\n")), 0
        elif begin >= 0:
            gap += 1
            if gap > 2:
                yield begin, end
                begin = -1
        at += len(line)
    if begin >= 0:
        yield begin, end


def spare(template: list[str]) -> int:
    """Foreign words that may stand among a template's."""
    return max(2, len(template) // 5)


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...]) -> None:
        self.templates = templates
        self.words = [words(t) for _, t in templates]
        #: Words of the longest run that can be confirmed.
        self.reach = [len(w) + spare(w) for w in self.words]
        self.matchers = [difflib.SequenceMatcher(None, autojunk=False) for _ in templates]
        for matcher, want in zip(self.matchers, self.words, strict=True):
            matcher.set_seq2(want)
        self.alone = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
        self.given = [
            zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            for _, t in templates
        ]
        plain = [self.coded(w) for w in self.words]
        self.given_words = [zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for t in plain]
        #: Bytes that each template saves on itself.
        self.saves = [len(self.alone.compress(t)) - len(given.compress(t)) for t, given in zip(plain, self.given_words, strict=True)]
        self.size_alone = functools.lru_cache(CACHE_BLOCKS)(lambda raw: len(self.alone.compress(raw)))
        self.weigh = functools.lru_cache(CACHE_BLOCKS)(self._weigh)

    def saving(self, window: str, template: int) -> float:
        """Share of the compressed size that the template saves."""
        raw = window.encode("utf-8", "surrogatepass")
        return 1 - len(self.given[template].compress(raw)) / len(self.alone.compress(raw))

    @staticmethod
    def coded(wording: list[str]) -> bytes:
        """Words as codes of sixteen bytes, which have nothing in common: so sizes tell of words and not of letters."""
        return b"".join(map(_code, wording))

    def saved(self, window: list[str], template: int) -> float:
        """Bytes that the template's wording saves of the window's, as a share of what it saves on itself."""
        raw = self.coded(window)
        return (self.size_alone(raw) - len(self.given_words[template].compress(raw))) / self.saves[template]

    def compare(self, window: list[str], template: int) -> tuple[float, list[str], list[int], int, int]:
        """(share of the template's words found in order, the words missing, places of foreign words among those found, first and last place found).

        Of the words found in order, those are taken that have most in a run with no more foreign words than are spare.
        """
        want, matcher = self.words[template], self.matchers[template]
        matcher.set_seq1(window)
        found = [m for m in matcher.get_matching_blocks() if m.size]
        best, held = found[:0], 0
        for s in range(len(found)):
            size = 0
            for e in range(s, len(found)):
                size += found[e].size
                if found[e].a + found[e].size - found[s].a - size > spare(want):
                    break
                if size > held:
                    best, held = found[s : e + 1], size
        if not best:
            return 0.0, want, [], 0, -1
        have = {k for m in best for k in range(m.b, m.b + m.size)}
        taken = {k for m in best for k in range(m.a, m.a + m.size)}
        first, last = best[0].a, best[-1].a + best[-1].size - 1
        return held / len(want), [w for k, w in enumerate(want) if k not in have], [k for k in range(first, last + 1) if k not in taken], first, last

    def _weigh(self, window: str, template: int) -> tuple[float, float, int, int, int, int] | None:
        """(saving, cover, words missing, foreign words, first and last word's place in the window) if the template is confirmed, or none.

        The saving chooses the templates; the exact comparison of a chosen one begins with the cover that its words allow in any order.
        """
        own = words(window)
        if self.saved(own, template) < LEAST_SAVED:
            return None
        there, want = set(own), self.words[template]
        if sum(w in there for w in want) / len(want) < COVER:
            return None
        cover, missing, foreign, first, last = self.compare(own, template)
        # The words that tell licenses apart (names, figures, letters) must all be there, and no others among them.
        telling = [w for w in missing if _tells(w)]
        if foreign:
            places = [m.span() for m in _WORD.finditer(window)]
            telling += [own[k] for k in foreign if _tells(own[k]) and own[k] != "by" and own[k] not in self.words[template] and not _numbers(window, *places[k])]
        if cover < COVER or telling or self.denied(window, own, template, first, foreign):
            return None
        return self.saving(window, template), cover, len(missing), len(foreign), first, last

    def denied(self, window: str, own: list[str], template: int, first: int, foreign: list[int]) -> bool:
        """Whether the notice is said not to hold: by a denying word in it that isn't the template's, or shortly before it in its sentence."""
        if any(own[k] in DENIALS and own[k] not in self.words[template] for k in foreign):
            return True
        places = [m.span() for m in _WORD.finditer(window)]
        near = range(max(0, first - BEFORE), first)
        return any(own[k] in DENIALS and not re.search(r"[.!?;]\s|\n\s*\n", window[places[k][1] : places[first][0]]) for k in near)

    def entries(self, text: str) -> list[dict]:
        """Entries in order: for each candidate block one for each template that is confirmed around a cue in it, the best first to take its words; or one without a license.

        A block whose notice goes on beyond it is extended by the notice's lines, and what a notice took is
        not looked at again.
        """
        spans = list(blocks(text))
        if not spans:
            return []
        found = [m.span() for m in _WORD.finditer(text)]
        starts = [s for s, _ in found]
        lines = [0, *itertools.accumulate(map(len, text.splitlines(keepends=True)))]
        own = [text[s:e].lower() for s, e in found]
        out, taken = [], 0

        def best_at(i: int, least: int, most_words: int) -> tuple | None:
            """(rank, entry, first and last word) of the best template confirmed around the cue at word ``i``, among words ``least`` to ``most_words``."""
            best = None
            for k in range(len(self.templates)):
                low, high = max(least, i - self.reach[k] + 1), min(most_words, i + self.reach[k])
                # A run that doesn't hold the cue belongs to another one; what is left beside it may hold a run that does.
                while low <= i < high and (fit := self.weigh(text[starts[low] : found[high - 1][1]], k)):
                    saving, cover, missing, foreign, first, last = fit
                    if low + first <= i <= low + last:
                        rank = (len(self.words[k]) * cover, saving)
                        if best is None or rank > best[0]:
                            best = (rank, (self.templates[k][0], saving, cover, missing, foreign), low + first, low + last)
                        break
                    low, high = (low + last + 1, high) if low + last < i else (low, low + first)
            return best

        def all_in(a: int, b: int, least: int, most_words: int) -> list[tuple]:
            """Confirmed templates around the cues of text[a:b], the best first to take its words, in order.

            A cue is weighed again only if another's words have been taken from its own, so the work follows the cues.
            """
            firsts: list[int] = []
            chosen: list[tuple] = []
            waiting: list[tuple] = []

            def weigh(i: int, low: int, high: int) -> None:
                if best := best_at(i, low, high):
                    heapq.heappush(waiting, (-best[0][0], -best[0][1], i, best))

            for i in dict.fromkeys(bisect.bisect_right(starts, m.start()) - 1 for m in CUE.finditer(text, a, b)):
                weigh(i, least, most_words)
            while waiting:
                *_, i, best = heapq.heappop(waiting)
                at = bisect.bisect_right(firsts, i)
                low, high = chosen[at - 1][3] + 1 if at else least, firsts[at] if at < len(firsts) else most_words
                if i < low:
                    continue
                if low <= best[2] and best[3] < high:
                    firsts.insert(at, best[2])
                    chosen.insert(at, best)
                else:
                    weigh(i, low, high)
            return chosen

        for a, b in spans:
            a = max(a, taken)
            if a >= b or not CUE.search(text, a, b):
                continue
            confirmed = all_in(a, b, bisect.bisect_left(starts, taken), len(own))
            for n, (_, entry, first, last) in enumerate(confirmed):
                # The first reaches back to the block's start, the last on to its end; each ends with its line where no other is on it.
                begin = max(taken, lines[bisect.bisect_right(lines, starts[first]) - 1])
                begin = max(taken, min(a, begin)) if n == 0 else begin
                line = bisect.bisect_right(lines, found[last][1] - 1)
                end = lines[line - 1] + len(text[lines[line - 1] : lines[line]].rstrip("\r\n"))
                if n + 1 < len(confirmed):
                    end = min(end, starts[confirmed[n + 1][2]])
                else:
                    end = max(end, b)
                taken = end
                out.append(dict(zip(("license", "saving", "cover", "missing", "foreign"), entry, strict=True)) | {"start": begin, "end": end})
            if not confirmed:
                out.append({"license": None, "start": a, "end": b, "saving": None, "cover": None, "missing": None, "foreign": None})
        return out


#: Words that must not differ between a notice and its template.
_TELLING = frozenset("mit apache gnu gpl lesser affero general public mozilla cc by by-nc by-sa by-nd creative commons attribution attribution-sharealike sharealike noncommercial isc bsd".split())

#: What may stand before the number of a list's item, from the line's start or the sentence before.
_ITEM = re.compile(r"(?:^|[\n:;.])[^\w\n:;.]*$")


def _tells(word: str) -> bool:
    """Whether the word can tell two licenses apart; parts joined by hyphens count alone too."""
    return any(c.isdigit() for c in word) or word in _TELLING or any(w in _TELLING and w != "by" for w in word.split("-"))


def _numbers(text: str, start: int, end: int) -> bool:
    """Whether the word at a place only numbers an item of a list: ``2.`` or ``(2)`` before a space."""
    return text[start:end].isdigit() and end - start <= 2 and text[end : end + 1] in (".", ")") and text[end + 1 : end + 2].isspace() and _ITEM.search(text[max(0, start - 20) : start]) is not None


_FOUND = T.StructType(
    [
        T.StructField("license", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("saving", T.DoubleType()),
        T.StructField("cover", T.DoubleType()),
        T.StructField("missing", T.IntegerType()),
        T.StructField("foreign", T.IntegerType()),
    ]
)
_FOUND_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saving", pa.float64()), ("cover", pa.float64()), ("missing", pa.int32()), ("foreign", pa.int32())]))


def scan(df: DataFrame, text_col: str = "text", out: str = "licenses", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """All columns of ``df`` and ``out``: for each candidate block of each whole text an entry, in order.

    An entry has the block's place in code points and, if a template is confirmed, its license, what it
    saved, its cover, and how many of its words are missing and foreign; else license is null and the
    block is to be looked at. Null and empty texts have none. A column named ``out`` is replaced.
    """
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(_FOUND))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for part in slices(batches, text_col):
            found = []
            for text in part.column(text_col).to_pylist():
                found.append(scanner.entries(text or ""))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, _FOUND_ARROW)], names=schema.names)

    return df.select(*keep).mapInArrow(run, schema)
