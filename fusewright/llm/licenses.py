"""Licence scans by sentence rules.

A text's sentences are normalised and mapped to identifiers of known licence sentences; the
identifiers, in order, are matched against ordered licence rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, tenant

#: Known sentences, as patterns over normalised text (lower case, words and digits, one blank between).
SENTENCES = (
    ("mit-ref", r"(?:.* )?(?:released|licensed|distributed|available)(?: under)? (?:the )?(?:terms of the )?mit licen[sc]e"),
    ("mit-title", r"(?:the )?mit licen[sc]e(?: mit)?"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software .*"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies .*"),
    ("isc-disclaimer", r"the software is provided as is and the author disclaims all warranties.*"),
    ("zlib-disclaimer", r"this software is provided as is without any express or implied warranty"),
    ("as-is", r"(?:the|this) software is provided as is .*"),
    ("as-is", r"(?:the|this) software is provided by .* as is .*"),
    ("apache-ref", r"(?:.* )?(?:released|licensed|distributed)(?: under)? (?:the )?(?:terms of the )?apache licen[sc]e(?: version)? 2(?: 0)?(?: the license)?"),
    ("apache-terms", r"you may not use this file except in compliance with the license"),
    ("apache-terms", r"you may obtain a copy of the license at .*"),
    ("gpl2-ref", r".*(?:licensed|released|distributed|redistribute it|modify it) under (?:the )?(?:terms of the )?gnu (?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?: 0)?(?: .*)?"),
    ("gpl3-ref", r".*(?:licensed|released|distributed|redistribute it|modify it) under (?:the )?(?:terms of the )?gnu (?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?(?: .*)?"),
    ("agpl-ref", r".*under (?:the )?(?:terms of the )?(?:gnu affero general public licen[sc]e|agpl).*"),
    ("lgpl21-ref", r".*under (?:the )?(?:terms of the )?gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2 1(?: .*)?"),
    ("lgpl3-ref", r".*under (?:the )?(?:terms of the )?gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: .*)?"),
    ("lgpl-ref", r".*under (?:the )?(?:terms of the )?gnu lesser general public licen[sc]e.*"),
    ("gpl-title", r"gnu general public licen[sc]e(?: version| v)? ?3(?: 29 june 2007)?"),
    ("gpl2-title", r"gnu general public licen[sc]e(?: version| v)? ?2(?: june 1991)?"),
    ("agpl-title", r"gnu affero general public licen[sc]e(?: version| v)? ?3(?: 19 november 2007)?"),
    ("lgpl3-title", r"gnu lesser general public licen[sc]e(?: version| v)? ?3(?: 29 june 2007)?"),
    ("lgpl21-title", r"gnu lesser general public licen[sc]e(?: version| v)? ?2 1(?: february 1999)?"),
    ("gpl-warranty", r"this (?:program|library) is distributed in the hope that it will be useful but without any warranty.*"),
    ("apache-title", r"apache licen[sc]e(?: version)? 2 0(?: january 2004)?"),
    ("apache-as-is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided .*"),
    ("0bsd-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-ref", r"(?:.* )?(?:released|licensed|distributed|available)(?: under)? (?:the )?(?:terms of the )?isc licen[sc]e"),
    ("bsd-ref", r"(?:.* )?(?:released|licensed|distributed|available)(?: under)? (?:the |a )?(?:terms of the )?(?:new |modified |simplified )?(?:bsd(?: [23] clause)?|[23] clause bsd)(?: style)? licen[sc]e"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications .*"),
    ("unlicense-release", r"this is free and unencumbered software released into the public domain"),
    ("unlicense-grant", r"anyone is free to copy modify publish use compile sell or distribute this software .*"),
    ("boost-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation .*"),
    ("boost-ref", r"(?:.* )?(?:released|licensed|distributed)(?: under)? (?:the )?boost software licen[sc]e(?: version)? 1 0"),
    ("epl1-ref", r".*(?:under|terms of) (?:the )?(?:terms of the )?eclipse public licen[sc]e(?: v| version)? ?1 0.*"),
    ("epl2-ref", r".*(?:under|terms of) (?:the )?(?:terms of the )?eclipse public licen[sc]e(?: v| version)? ?2 0.*"),
    ("artistic2-ref", r"(?:.* )?(?:released|licensed|distributed)(?: under)? (?:the )?(?:terms of the )?artistic licen[sc]e(?: version)? 2(?: 0)?"),
    ("eupl-ref", r".*under (?:the )?(?:terms of the )?(?:european union public licen[sc]e|eupl)(?: v| version)? ?1 2.*"),
    ("mpl-notice", r"if a copy of the mpl was not distributed with this file you can obtain one at .*"),
    ("wtfpl", r"(?:.* )?do what the f\w+ you want to public licen[sc]e.*"),
    ("cc-by-nd", r"(?:.* )?(?:licensed|released)(?: under)?(?: a| the)? (?:cc by nd|creative commons attribution no ?derivatives)(?: \d \d)?(?: international)?(?: license)?"),
    ("cc-by-sa", r"(?:.* )?(?:licensed|released)(?: under)?(?: a| the)? (?:cc by sa|creative commons attribution share ?alike)(?: \d \d)?(?: international)?(?: license)?"),
    ("bsd-grant", r"redistribution and use in source and binary forms .* are permitted .*"),
    ("bsd-endorse", r".*neither the name of .* may be used to endorse or promote products .*"),
    ("mpl-ref", r".*(?:subject to|under) the (?:terms of the )?mozilla public licen[sc]e v(?:ersion)?"),
    ("mpl-ref", r".*(?:subject to|under) the (?:terms of the )?mozilla public licen[sc]e v(?:ersion)? ?2 0.*"),
    ("cc-by-nc", r"(?:.* )?(?:licensed|released)(?: under)?(?: a| the)? (?:cc by nc|creative commons attribution non ?commercial)(?: (?:sa|nd))?(?: \d \d)?(?: international)?(?: license)?"),
    ("cc-by", r"(?:.* )?(?:licensed|released)(?: under)?(?: a| the)? (?:cc by|creative commons attribution)(?: sa)?(?: \d \d)?(?: international)?(?: license)?"),
    ("cc0", r"(?:.* )?(?:licensed|released|dedicated)(?: under)?(?: to)? (?:cc0|the public domain).*"),
    ("reserved", r".*all rights reserved"),
)
#: Ordered rules. A rule's sentences must follow each other, with at most GAP other known sentences between.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "as-is")),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-title",)),
    ("Apache-2.0", ("apache-ref", "apache-terms", "apache-as-is")),
    ("Apache-2.0", ("apache-ref", "apache-terms")),
    ("Apache-2.0", ("apache-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-endorse", "as-is")),
    ("BSD-2-Clause", ("bsd-grant", "as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-endorse")),
    ("BSD", ("bsd-ref",)),
    ("ISC", ("isc-grant", "isc-disclaimer")),
    ("ISC", ("isc-ref",)),
    ("0BSD", ("0bsd-grant", "isc-disclaimer")),
    ("Zlib", ("zlib-disclaimer", "zlib-grant")),
    ("Unlicense", ("unlicense-release", "unlicense-grant")),
    ("Unlicense", ("unlicense-release",)),
    ("BSL-1.0", ("boost-grant", "as-is")),
    ("BSL-1.0", ("boost-ref",)),
    ("EPL-1.0", ("epl1-ref",)),
    ("EPL-2.0", ("epl2-ref",)),
    ("Artistic-2.0", ("artistic2-ref",)),
    ("EUPL-1.2", ("eupl-ref",)),
    ("WTFPL", ("wtfpl",)),
    ("Apache-2.0", ("apache-title",)),
    ("AGPL-3.0", ("agpl-ref",)),
    ("AGPL-3.0", ("agpl-title",)),
    ("GPL-2.0", ("gpl2-ref", "gpl-warranty")),
    ("GPL-3.0", ("gpl3-ref", "gpl-warranty")),
    ("GPL-3.0", ("gpl-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("LGPL-2.1", ("lgpl21-ref",)),
    ("LGPL-3.0", ("lgpl3-ref",)),
    ("LGPL", ("lgpl-ref",)),
    ("MPL-2.0", ("mpl-ref", "mpl-notice")),
    ("MPL-2.0", ("mpl-ref",)),
    ("CC-BY-ND", ("cc-by-nd",)),
    ("CC-BY-SA", ("cc-by-sa",)),
    ("CC-BY-NC", ("cc-by-nc",)),
    ("CC-BY", ("cc-by",)),
    ("CC0", ("cc0",)),
    ("Proprietary", ("reserved",)),
)
GAP = 2
#: Licence identifiers as tags and references name them, by family.
IDENTIFIERS = {
    "permissive": "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC Zlib Unlicense BSL-1.0 WTFPL CC-BY-3.0 CC-BY-4.0 CC0-1.0 Artistic-2.0 PostgreSQL Python-2.0 X11 MIT-0 NCSA OFL-1.1",
    "copyleft": "GPL-2.0-only GPL-2.0-or-later GPL-2.0 GPL-2.0+ GPL-3.0-only GPL-3.0-or-later GPL-3.0 GPL-3.0+ LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1 LGPL-2.1+ LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 CDDL-1.0 CC-BY-SA-3.0 CC-BY-SA-4.0",
    "restricted": "CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 BUSL-1.1 SSPL-1.0",
}
#: What a licence allows: free for any use, free with conditions on derived works, or not for every use.
FAMILY = {
    "MIT": "permissive", "Apache-2.0": "permissive", "BSD-3-Clause": "permissive", "BSD-2-Clause": "permissive", "CC-BY": "permissive", "CC0": "permissive", "GPL-2.0": "copyleft", "GPL-3.0": "copyleft", "LGPL": "copyleft", "MPL-2.0": "copyleft", "CC-BY-NC": "restricted", "Proprietary": "restricted",
    "BSD": "permissive", "ISC": "permissive", "0BSD": "permissive", "Zlib": "permissive", "Unlicense": "permissive", "BSL-1.0": "permissive", "WTFPL": "permissive", "AGPL-3.0": "copyleft", "CC-BY-SA": "copyleft", "CC-BY-ND": "restricted",
}
FAMILY |= {"LGPL-2.1": "copyleft", "LGPL-3.0": "copyleft", "EPL-1.0": "copyleft", "EPL-2.0": "copyleft", "Artistic-2.0": "permissive", "EUPL-1.2": "copyleft"}
_FAMILIES = {k: family for family, ids in IDENTIFIERS.items() for k in ids.split()} | FAMILY
_SENTENCE_END, _LINE_END = re.compile(r"[.!?;:](?=\s|$)|\n\s*\n"), re.compile(r"\n(?=\S)")


class Known:
    """A known sentence over normalised lines: what stands between its pattern's wildcards is searched from left to right, so a reading is linear."""

    def __init__(self, pattern: str):
        lead = next(x for x in (".*", "(?:.* )?", "") if pattern.startswith(x))
        segments = [x.replace(" ", "[ \n]") for x in pattern[len(lead) :].split(".*")]
        # a wildcard that is optional with its blank ends the sentence: (?: .*)?
        if segments[-1] == ")?" and segments[-2].endswith("(?:[ \n]"):
            segments[-2:] = [segments[-2][: -len("(?:[ \n]")] + "(?![^ \n])", ""]
        self.open = segments[-1] == "" and len(segments) > 1
        if self.open:
            segments.pop()
        before = {".*": "", "(?:.* )?": "(?:(?<=[ \n])|^)", "": "(?:(?<=\n)|^)"}[lead]
        segments[0] = before + segments[0]
        if not self.open:
            segments[-1] += r"\Z"
        self.segments = [re.compile(x) for x in segments]

    def starts(self, text: str) -> int | None:
        """Where the known part begins, if the text is such a sentence."""
        first = m = self.segments[0].search(text)
        for p in self.segments[1:]:
            m = m and p.search(text, m.end())
        return first.start() if m else None


_KNOWN = tuple((k, Known(p)) for k, p in SENTENCES)
#: Each known sentence has one of these words.
_HINT = re.compile(r"licen[sc]|permission|software is provided|redistribution|notice|obtain a copy|compliance|endorse|rights reserved|cc0|public domain|cc by|creative commons|\b(?:[al]?gpl|mpl|epl|eupl|cddl|bsd|isc|mit)\b|anyone is free|hope that it|software for any purpose|any express".replace(" ", "[^a-z0-9]+"), re.IGNORECASE)
_NOISE = re.compile(r"[^a-z0-9]+")
_TAG = re.compile(r"\b(?:SPDX-License-Identifier|Licen[sc]e(?:-Expression)?)[\x20\t]*[:=][\x20\t]*[\"']?(\(?[A-Za-z0-9][A-Za-z0-9.+-]*(?:[\x20()]+(?:AND|OR|WITH)[\x20()]+[A-Za-z0-9][A-Za-z0-9.+-]*)*)", re.IGNORECASE)
_ID = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?")
_UNDER = re.compile(r"(?:^| )(?:released|licensed|distributed|available)(?: under)? (?:the )?(?:terms of the )?(?=(?:mit|apache|bsd|0bsd|isc|zlib|unlicense|bsl|wtfpl|cc|cc0|artistic|postgresql|python|x11|ncsa|ofl|a?gpl|lgpl|mpl|epl|eupl|cddl|busl|sspl)(?: |$))")


def normalised(sentence: str) -> str:
    return _NOISE.sub(" ", sentence.lower()).strip()


_BY_NAME = {k.lower(): k for ids in IDENTIFIERS.values() for k in ids.split()}
_BY_WORDS = {normalised(k): k for k in _BY_NAME.values() if not k.endswith("+")}
#: Plain names as prose has them keep the rules' names for them.
for _k in ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", *(f"CC-{k}-{v}.0" for k in ("BY", "BY-SA", "BY-NC", "BY-ND") for v in "34")):
    del _BY_WORDS[normalised(_k)]


def pieces(text: str, end: re.Pattern[str], a: int, b: int) -> Iterator[tuple[int, int]]:
    """Start and end of each piece of text[a:b] that isn't blank."""
    at = a
    for m in end.finditer(text, a, b):
        if text[at : m.start()].strip():
            yield at, m.start()
        at = m.end()
    if text[at:b].strip():
        yield at, b


def known_line(text: str, a: int, b: int) -> str | None:
    """The first known sentence that text[a:b] is, read as one line from its beginning or from a lead-in."""
    s = text[a:b]
    if not _HINT.search(s):
        return None
    n = normalised(s)
    return referred(n) or next((k for k, p in _KNOWN if p.starts(n) is not None), None)


def known_wrapped(text: str, a: int, b: int) -> tuple[str, int] | None:
    """The first known sentence that the lines of text[a:b] joined are, and the start of the line where what is known begins."""
    starts, lines, at = [], [], a
    for line in text[a:b].split("\n"):
        n = normalised(line)
        if n:
            starts.append(at)
            lines.append(n)
        at += len(line) + 1
    if len(lines) < 2:
        return None
    joined = "\n".join(lines)
    for k, p in _KNOWN:
        m = p.starts(joined)
        if m is not None:
            return k, starts[joined.count("\n", 0, m)]
    return None


def tags(text: str) -> list[tuple[str, int, int]]:
    """Tags that name licences by identifier: one entry for each identifier of the tag's expression."""
    return [(f"id:{x}", m.start(1) + y.start(), m.start(1) + y.end()) for m in _TAG.finditer(text) for y in _ID.finditer(m.group(1)) if (x := _BY_NAME.get(y.group().lower()))]


def referred(sentence: str) -> str | None:
    """The identifier that a normalised sentence ends with after "licensed under" and the like."""
    m = _UNDER.search(sentence)
    if not m:
        return None
    name = sentence[m.end() :].removesuffix(" license").removesuffix(" licence")
    k = _BY_WORDS.get(name)
    return f"id:{k}" if k else None


def identify(text: str) -> list[tuple[str, int, int]]:
    """(sentence id, start, end) of the known sentences, in order; the first pattern that fits a sentence counts.

    Sentences end at sentence ends and blank lines. A sentence of more lines is read joined and line by
    line; on the line where the joined reading begins, it takes the place of that line's other reading.
    """
    if not _HINT.search(text):
        return []
    found = []
    for a, b in pieces(text, _SENTENCE_END, 0, len(text)):
        if _HINT.search(text, a, b):
            own = [(k, p, q) for p, q in pieces(text, _LINE_END, a, b) if (k := known_line(text, p, q))]
            whole = known_wrapped(text, a, b)
            if whole and not any(k == whole[0] and p <= whole[1] < q for k, p, q in own):
                own = sorted([x for x in own if not x[1] <= whole[1] < x[2]] + [(*whole, b)], key=lambda x: x[1])
            found += own
    named = tags(text)
    # a tag's line can read as a sentence too: the tag stands for both
    return sorted([x for x in found if not any(x[1] <= a < x[2] for _, a, _ in named)] + named, key=lambda x: x[1]) if named else found


def match(ids: list[str], rules: tuple = RULES, gap: int = GAP) -> list[tuple[str, int, int]]:
    """(licence, first, last) over positions of ids: at each position the first rule that fits, then on after it."""
    out, i = [], 0
    while i < len(ids):
        if ids[i].startswith("id:"):
            out.append((ids[i][3:], i, i))
            i += 1
            continue
        for name, wanted in rules:
            at = i if ids[i] == wanted[0] else None
            for w in wanted[1:]:
                if at is not None:
                    at = next((j for j in range(at + 1, min(len(ids), at + gap + 2)) if ids[j] == w), None)
            if at is not None:
                out.append((name, i, at))
                i = at
                break
        i += 1
    return out


SCHEMA = "doc_id bigint, n_sentences bigint, n_licenses bigint, licenses string, family string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, known sentences, licences found, their distinct names in order, the strictest family, spans.

    family: restricted, copyleft, permissive, or none. Null and empty texts: none. Very long texts are
    read whole. Of patterns and rules that fit alike the first listed counts. Repeated rows give equal
    results; null doc_id stays null. Empty table: empty result. Other columns are ignored, whatever
    their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("licenses")
        for b in slices(batches, 1):
            rows = []
            for t in b.column(1).to_pylist():
                known = identify(t or "")
                found = match([k for k, _, _ in known])
                names = list(dict.fromkeys(n for n, _, _ in found))
                kinds = {_FAMILIES[n] for n in names}
                family = next((f for f in ("restricted", "copyleft", "permissive") if f in kinds), "none")
                rows.append((len(known), len(found), ",".join(names), family, ",".join(f"{n}:{known[i][1]}:{known[j][2]}" for n, i, j in found)))
            kinds_ = [pa.int64()] * 2 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds_))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
