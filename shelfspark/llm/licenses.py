"""License scans by conditional compression.

Texts are read in overlapping stretches of STRETCH bytes. A stretch is compressed alone and with all templates together as one raw
zstandard dictionary; where that saves at least CANDIDATE_BYTES it may hold a notice, and such stretches that touch make one
candidate block, a stretch longer at each side. A candidate block is then compressed with each template as raw dictionary. The
templates are ranked by the bytes they save, and those that save a fair share of what they save of themselves are winners.
Winners are confirmed by the exact differences of wording within windows of about the template's length: few words may differ, names,
modifiers and versions not at all (another version of a family is that version's license), and no negation may stand by. Where confirmed
windows overlap the closest wording counts, and of equals the one that saves more bytes.

No list of words decides on candidates, and each text is scanned in the task that reads it: nothing is shuffled. Blocks that come
again (a notice at the head of each file) are found in a bounded memory of the worker.
"""

from __future__ import annotations

import difflib
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Public license notices and texts, as their publishers word them, and the short wordings in use.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MIT-whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
    "All-rights-reserved-short": "All rights reserved.",
    "CC0-1.0-short": "Licensed under CC0 1.0.",
} | {f"CC-{kind}-4.0-short": f"Licensed under CC {kind} 4.0." for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")}
#: Further public wordings: what whole license texts open with, notices of databases and scripts, and short forms.
FURTHER = {
    "AGPL-3.0-opening": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0-opening": "Apache License Version 2.0, January 2004",
    "GPL-2.0-opening": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-opening": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1-opening": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-opening": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MPL-2.0-opening": "Mozilla Public License Version 2.0",
    "Artistic-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "ODbL-1.0": "This database is made available under the Open Database License.",
    "CC0-1.0-dedication": "CC0 1.0 Universal Public Domain Dedication",
    "MIT-title": "The MIT License (MIT)",
}
#: How notices call licenses, and what they say of them; one template for each of both.
CALLED = {
    "AGPL-3.0": ("GNU Affero General Public License version 3", "GNU AGPL v3"), "Apache-2.0": ("Apache License 2.0", "Apache 2.0 license"), "Artistic-2.0": ("Artistic License 2.0",), "BSD": ("BSD License",), "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",), "BSL-1.0": ("Boost Software License 1.0",), "EPL-2.0": ("Eclipse Public License 2.0",), "GPL-3.0": ("GNU General Public License version 3", "GNU General Public License v3", "GNU GPL v3", "GPL v3"), "ISC": ("ISC License",),
    "LGPL-3.0": ("GNU Lesser General Public License version 3", "GNU LGPL v3"), "MIT": ("MIT License",), "MPL-2.0": ("Mozilla Public License 2.0",), "Unlicense": ("Unlicense",), "Zlib": ("zlib License",),
}
_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CALLED |= {f"CC-{kind}-4.0": tuple(f"Creative Commons {long} 4.0 {license}" for license in ("International License", "License")) for kind, long in _KINDS.items()}
SAID = ("Licensed under the {}.", "Available under the terms of the {}.")
FURTHER |= {f"{name}-said-{i}{j}": said.format(call) for name, calls in CALLED.items() for i, call in enumerate(calls) for j, said in enumerate(SAID)}
#: Identifiers of the public list that tags in source files name.
TAGS = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
FURTHER |= {f"{tag}-tag": f"SPDX-License-Identifier: {tag}" for tag in TAGS}
# of equal stretches the compressor finds the last, so the notices above stay at the end
TEMPLATES = FURTHER | TEMPLATES
#: Words that tell licenses apart: names and modifiers anywhere, and those of Creative Commons in its notices. A difference in them is no match.
NAMES = frozenset("affero apache agpl artistic boost bsd bsl cc cc0 cddl clause commons creative database eclipse epl expat gpl isc json lesser lgpl mit mozilla mpl ncsa ofl openssl php python unlicense wtfpl x11 zlib 0bsd only later".split())
CC_WORDS = frozenset("by sa nc nd attribution sharealike noncommercial noderivatives noderivs".split())
#: Versions that a family has; a notice of another version than its template's is one of that version. Names begin with the family.
VERSIONS = {"AGPL": ("1.0", "3.0"), "Apache": ("1.0", "1.1", "2.0"), "Artistic": ("1.0", "2.0"), "BSL": ("1.0",), "CC-": ("1.0", "2.0", "2.5", "3.0", "4.0"), "CC0": ("1.0",), "EPL": ("1.0", "2.0"), "GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "MPL": ("1.0", "1.1", "2.0")}
#: Words that turn a notice around: within it, or among the BEFORE words before it and those that lead up to it.
NEGATIONS, BEFORE = frozenset("not never no cannot isn aren wasn neither nor longer".split()), 3
LEADING = frozenset("a an and are as available be been by code covered distributed governed is it made of offered program project published released software source terms the this to under was were work licensed".split())
#: Bytes of a stretch, and by how many the next one overlaps it: more than the longest notice that saves little.
STRETCH, OVERLAP = 256, 96
#: Shortest match that counts as saved.
MIN_MATCH = 7
#: Bytes that all templates together must save of a stretch; the shortest notice, three words, saves more.
CANDIDATE_BYTES = 7
#: A winner saves at least this share of what it saves of itself.
WIN_SHARE = 0.5
#: Templates, of about the same saving, that are tried together before each of them is.
GROUP = 6
#: Share of the least saving of its templates that a heap must save; in large dictionaries the compressor may find a shorter match.
HEAP_SHARE = 0.5
#: Bytes of a block that is ranked at once; longer ones are ranked in pieces that overlap by twice the longest template.
BLOCK = 8_192
#: Least share of a template's words that the block must have, in order, and most further words within the matched span.
MIN_COVER, MAX_EXTRA = 0.8, 0.2
_WORD = re.compile(r"\w+(?:\.\w+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def few(n: int, share: float) -> int:
    """The most words of n that a share allows."""
    return int(share * n + 1e-9)


def version_of(word: str) -> str | None:
    """A version in the form 2.0: v2, 2 and 2.0 are the same; None for other words."""
    found = re.fullmatch(r"v?(\d{1,2})(?:\.(\d{1,2}))?", word)
    return f"{int(found[1])}.{int(found[2] or 0)}" if found else None


def differences(block: list[str], template: list[str]) -> tuple[list[str], list[str], range]:
    """Template words that the block lacks, block words put in between matched ones, and where the match lies in the block."""
    runs = [r for r in difflib.SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if r.size]
    have = {i for r in runs for i in range(r.b, r.b + r.size)}
    used = {i for r in runs for i in range(r.a, r.a + r.size)}
    between = range(runs[0].a, runs[-1].a + runs[-1].size) if runs else range(0)
    return [w for i, w in enumerate(template) if i not in have], [block[i] for i in between if i not in used], between


class Scanner:
    """Compressors for all templates and one with a dictionary that holds nothing, made once a worker; a bounded memory of blocks that were judged."""

    NONE = (None, 0, 0.0, [], [])
    LIMIT = 20_000

    def __init__(self, templates: dict[str, str]) -> None:
        import zstandard

        self.templates = {name: words(t) for name, t in templates.items()}
        self.versions = {name: self._version(name, t) for name, t in self.templates.items()}
        plain = {name: " ".join(t).encode() for name, t in self.templates.items()}
        # with a target length the fast strategy leaves literals as they are, so that what is saved is what the template holds
        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=MIN_MATCH, hash_log=15, window_log=17, write_content_size=False, write_dict_id=False)

        def given(raw: bytes, size: int):
            """A compressor with raw, after filler that no text has, as dictionary of size bytes: only equally large ones compare."""
            filler = hashlib.shake_128(b"filler").digest(size - len(raw)).translate(bytes(range(128, 256)) * 2)
            return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(filler + raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

        every = b" . ".join(plain.values())
        self.margin = max(map(len, plain.values()))
        self.none, self.given = given(b"", self.margin), {name: given(raw, self.margin) for name, raw in plain.items()}
        self.all, self.all_none = given(every, len(every)), given(b"", len(every))
        self.least = {name: WIN_SHARE * self.gain(name, raw) for name, raw in plain.items()}
        by = sorted(self.least, key=lambda n: (self.least[n], n))
        self.groups = []
        for names in (by[i : i + GROUP] for i in range(0, len(by), GROUP)):
            raw = b" . ".join(plain[n] for n in names)
            self.groups.append((names, given(raw, GROUP * self.margin), min(self.least[n] for n in names)))
        self.group_none = given(b"", GROUP * self.margin)
        # as many groups again are tried together before each of them is
        parts = [self.groups[i : i + GROUP] for i in range(0, len(self.groups), GROUP)]
        raws = [b" . ".join(plain[n] for names, *_ in groups for n in names) for groups in parts]
        size = max(map(len, raws))
        self.heaps = [(groups, given(raw, size), min(least for *_, least in groups)) for groups, raw in zip(parts, raws, strict=True)]
        self.heap_none = given(b"", size)
        self.known: dict[bytes, list] = {}

    @staticmethod
    def _version(name: str, template: list[str]) -> tuple[str, tuple[str, ...]] | None:
        """The version that a template's name and wording have, and those that its family has; None for a template without."""
        family = next((f for f in sorted(VERSIONS, key=len, reverse=True) if name.startswith(f)), None)
        own = re.search(r"\d+\.\d+", name)
        return (own[0], VERSIONS[family]) if family and own and own[0] in map(version_of, template) else None

    def decided(self, mine: list[str], name: str, span: tuple[int, int], missing: list[str], extra: list[str]) -> str | None:
        """The license that a wording close to a template stands for: the template's, the same in another version, or None.

        Names and modifiers must be the template's own, a version one of the family, and no negation may stand in the wording or right before it.
        """
        start, stop = span
        lead = start
        while lead and start - lead < 2 * BEFORE and mine[lead - 1] in LEADING:
            lead -= 1
        if not NEGATIONS.isdisjoint([*extra, *mine[max(0, min(start - BEFORE, lead - 1)) : start]]):
            return None
        if "clause" in mine[stop : stop + 2] and "clause" not in self.templates[name]:
            return None  # BSD 4-Clause is not BSD
        telling = NAMES | CC_WORDS if name.startswith("CC-") else NAMES
        version = self.versions[name]
        lacking = [w for w in missing if w in telling or (version is None and version_of(w))]
        if lacking or any(w in telling for w in extra):
            return None
        if version and version[0] in map(version_of, missing):
            # the word of the version differs: it is within the wording, or behind it where the template ends with one
            there = [v for v in map(version_of, [*extra, *mine[stop : stop + 1]]) if v in version[1]]
            return name.replace(version[0], there[0]) if there else None
        return name

    def stretches(self, raw: bytes) -> list[bytes]:
        """raw in overlapping stretches. The fast strategy steps over more and more bytes the longer it finds nothing, so they are short."""
        return [raw[i : i + STRETCH] for i in range(0, max(1, len(raw) - OVERLAP), STRETCH - OVERLAP)]

    def sizes(self, parts: list[bytes], given) -> list[int]:
        return [len(given.compress(part)) for part in parts]

    def saved(self, parts: list[bytes], given, bare: list[int]) -> int:
        """Bytes that a dictionary saves of stretches; bare: their sizes with one as large that holds nothing."""
        return sum(max(0, n - m) for n, m in zip(bare, self.sizes(parts, given), strict=True))

    def gain(self, name: str, raw: bytes) -> int:
        """Bytes that a template saves of raw."""
        parts = self.stretches(raw)
        return self.saved(parts, self.given[name], self.sizes(parts, self.none))

    def blocks(self, text: str) -> list[str]:
        """Candidate blocks of a whole text, in words: runs of stretches of which the templates save enough, and one stretch more at each side."""
        raw = " ".join(words(text)).encode()
        starts = range(0, max(1, len(raw) - OVERLAP), STRETCH - OVERLAP)
        saved = [len(self.all_none.compress(part)) - len(self.all.compress(part)) for part in self.stretches(raw)]
        out, at = [], 0
        while at < len(saved):
            if saved[at] < CANDIDATE_BYTES:
                at += 1
                continue
            end = at
            while end + 1 < len(saved) and saved[end + 1] >= CANDIDATE_BYTES:
                end += 1
            lo, hi = max(0, starts[at] - STRETCH), starts[end] + 2 * STRETCH
            lo = raw.rfind(b" ", 0, lo) + 1 if lo else 0  # whole words
            hi = raw.find(b" ", hi) if 0 <= raw.find(b" ", hi) else len(raw)
            if out and lo <= out[-1][1]:
                lo = out.pop()[0]
            out.append((lo, hi))
            at = end + 1
        return [raw[lo:hi].decode() for lo, hi in out]

    def windows(self, mine: list[str], name: str):
        """(start, end) of every window of mine that may hold the template: it begins with a word of it and has enough of them.

        A confirmed span has at most the template's words and the extra ones it may have, so no other window can pass.
        """
        template = self.templates[name]
        spare = self.versions[name] is not None  # a version may differ besides
        known, need, width = set(template), len(template) - few(len(template), 1 - MIN_COVER) - spare, len(template) + few(len(template), MAX_EXTRA) + spare
        at = [i for i, w in enumerate(mine) if w in known]
        last = 0
        for k, start in enumerate(at):
            while last < len(at) and at[last] < start + width:
                last += 1
            if last - k >= need:
                yield start, at[last - 1] + 1

    def confirm(self, mine: list[str], name: str, start: int, end: int):
        """The closest confirmed wording of the template from start to end at most: (differences, first word, end, missing, extra, license), or None."""
        template = self.templates[name]
        best = None
        for stop in sorted({end, min(end, start + len(template)), min(end, start + len(template) - few(len(template), 1 - MIN_COVER))}):
            missing, extra, span = differences(mine[start:stop], template)
            version = self.versions[name]
            spare = version is not None and version[0] in map(version_of, missing)
            if len(missing) <= few(len(template), 1 - MIN_COVER) + spare and len(extra) <= few(len(template), MAX_EXTRA) + spare:
                if best is None or len(missing) + len(extra) < best[0]:
                    license = self.decided(mine, name, (start + span.start, start + span.stop), missing, extra)
                    best = (len(missing) + len(extra), start + span.start, start + span.stop, missing, extra, license) if license else best
        return best

    def find(self, block: str) -> list[tuple[str, int, float, list[str], list[str]]]:
        """License, bytes that its template saves, share of bytes, missing and extra words: one of each confirmed license.

        The license of the closest wording comes first. A block that is too long for one ranking is ranked in overlapping pieces.
        """
        mine, out = words(block), {}
        raw = " ".join(mine).encode()
        if len(raw) <= BLOCK:
            pieces = [mine]
        else:
            pieces, lo = [], 0
            while lo < len(raw):
                hi = raw.find(b" ", lo + BLOCK)
                pieces.append(raw[lo : hi if hi >= 0 else len(raw)].decode().split())
                lo = raw.rfind(b" ", 0, hi - 2 * self.margin) + 1 if hi >= 0 else len(raw)
        for piece in pieces:
            for found in self._winners(piece):
                if found[0] not in out or len(found[3]) + len(found[4]) < len(out[found[0]][3]) + len(out[found[0]][4]):
                    out[found[0]] = found
        return [f[:5] for f in sorted(out.values(), key=lambda f: (len(f[3]) + len(f[4]) - (f[5] - len(f[3])), -f[1], f[0]))]

    def _winners(self, mine: list[str]) -> list[tuple]:
        raw, found = " ".join(mine).encode(), []
        if (before := self.known.get(raw)) is not None:
            return before
        # templates of which a whole group saves less than its least one must are not tried one by one
        parts = self.stretches(raw)
        bare, apart = self.sizes(parts, self.none), self.sizes(parts, self.group_none)
        together = self.sizes(parts, self.heap_none)
        tried = [group for groups, given, least in self.heaps if self.saved(parts, given, together) >= HEAP_SHARE * least for group in groups]
        able = [name for names, given, least in tried if self.saved(parts, given, apart) >= least for name in names]
        ranked = sorted((-self.saved(parts, self.given[name], bare), name) for name in able)
        for less, name in ranked:
            if -less < self.least[name]:
                continue
            for window in self.windows(mine, name):
                if sure := self.confirm(mine, name, *window):
                    n, start, stop, missing, extra, license = sure
                    found.append((n + len(missing) - len(self.templates[name]), less, name, start, stop, missing, extra, license))
        out, taken = {}, set()
        for _, _, name, start, stop, missing, extra, license in sorted(found, key=lambda x: x[:5]):
            if taken.isdisjoint(range(start, stop)):
                taken.update(range(start, stop))
                if license not in out:
                    part = " ".join(mine[start:stop]).encode()
                    saves = self.gain(name, part)
                    out[license] = (license, saves, saves / len(self.none.compress(part)), missing, extra, len(self.templates[name]))
        if len(self.known) >= self.LIMIT:
            self.known.clear()
        self.known[raw] = list(out.values())
        return self.known[raw]

    def judge(self, block: str) -> tuple[str | None, int, float, list[str], list[str]]:
        """The first of find(), or nulls and nothing saved."""
        return next(iter(self.find(block)), self.NONE)


def notices(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of docs: key, n_candidates (blocks) and found, an array of each block's licenses.

    An element of found has license, saved_bytes, saved_share, missing and extra (words that differ from the template).
    """
    templates = templates or TEMPLATES
    small_batches(docs.sparkSession)

    def judge(batches):
        import pyarrow as pa

        scanner = Scanner(templates)
        names = ["license", "saved_bytes", "saved_share", "missing", "extra"]
        kind = pa.list_(pa.struct(list(zip(names, [pa.string(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())], strict=True))))
        for batch in batches:
            blocks = [scanner.blocks(t) if t else [] for t in batch.column(1).to_pylist()]
            found = [[dict(zip(names, f, strict=True)) for b in bs for f in scanner.find(b)] for bs in blocks]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, blocks), pa.int64()), pa.array(found, kind)], names=["_key", "n_candidates", "found"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("t"))
    out = rows.mapInArrow(judge, f"_key {rows.schema['_key'].dataType.simpleString()}, n_candidates long, found array<struct<license:string,saved_bytes:bigint,saved_share:double,missing:array<string>,extra:array<string>>>")
    return out.withColumnRenamed("_key", key)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of docs: key, n_candidates, n_confirmed, licenses, saved_bytes, n_differences.

    n_confirmed counts every license of every block; licenses has their names, sorted and comma-joined, empty for none; saved_bytes the most that a confirmed
    template saves; n_differences the fewest words that differ. Null and empty texts have no candidates. Repeated rows and
    rows with one or no key are scanned one by one; equal blocks get equal verdicts; other columns are ignored.
    """
    each = lambda f: F.transform("found", f)
    return notices(docs, key, text, templates).select(
        key, "n_candidates", F.size("found").cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(each(lambda x: x["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(each(lambda x: x["saved_bytes"])), F.lit(0)).cast("long").alias("saved_bytes"),
        F.array_min(each(lambda x: F.size(x["missing"]) + F.size(x["extra"]))).cast("long").alias("n_differences"),
    )
