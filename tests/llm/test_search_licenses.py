import pytest
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from fusewright.llm import hamming_search, licenses

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, rank int"


def code(v):
    return [bool(x is not None and x > 0) for x in v[:64]] + [False] * (64 - len(v[:64]))


def brute_force(rows, queries, k):
    items = sorted({(i, tuple(code(v))) for i, v in rows if i is not None and v is not None})
    out = []
    for q in sorted({(i, tuple(code(v))) for i, v in queries if i is not None and v is not None}):
        near = sorted((sum(a != b for a, b in zip(q[1], c)), i) for i, c in items if i != q[0])[:k]
        out += [(q[0], n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_search(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(200)]
    base = rng.normal(size=64)
    rows += [(200 + i, (base + rng.normal(size=64) * 0.2).tolist()) for i in range(60)]
    rows += [(300 + i, rows[5][1]) for i in range(70)]  # one code of many ids
    rows += [(400, None), (None, rows[0][1]), (401, [None] * 64), (402, [1.0, 2.0]), (403, []), rows[7]]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    ask = df.where("vec_id % 10 = 0")
    got = sorted(tuple(r) for r in hamming_search.search(df, ask, 5).collect())
    assert got == brute_force(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0], 5)
    assert hamming_search.search(df.limit(0), ask.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert sorted(tuple(r) for r in hamming_search.search(few, few, 5).collect()) == brute_force(rows[:3], rows[:3], 5)


def test_code_bits(spark):
    v = [(-1.0) ** i for i in range(64)]
    df = spark.createDataFrame([(1, v, 0, "", 0), (2, [-x for x in v], 0, "", 0)], SCHEMA)
    got = {r.vec_id: r.c for r in df.select("vec_id", hamming_search.code_of(F.col("embedding")).alias("c")).collect()}
    assert got[1] == 0x5555555555555555 and got[2] == 0xAAAAAAAAAAAAAAAA - (1 << 64)


def slow_match(ids, rules, gap):
    """The ordered rules by trying all subsequences."""
    def fits(i, wanted):
        places = [i] if ids[i] == wanted[0] else []
        for w in wanted[1:]:
            places = places and (lambda p: [j for j in range(p + 1, min(len(ids), p + gap + 2)) if ids[j] == w][:1])(places[0])
        return places[0] if places else None

    out, i = [], 0
    while i < len(ids):
        for name, wanted in rules:
            last = fits(i, wanted)
            if last is not None:
                out.append((name, i, last))
                i = last
                break
        i += 1
    return out


def test_rules():
    rng = random.Random(2)
    kinds = [k for k, _ in licenses.SENTENCES]
    for _ in range(2000):
        ids = [rng.choice(kinds) for _ in range(rng.randint(0, 12))]
        assert licenses.match(ids) == slow_match(ids, licenses.RULES, licenses.GAP)


CASES = {
    "Prose.\nReleased under the MIT License.": ("MIT", "permissive"),
    "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.": ("Apache-2.0,GPL-3.0", "copyleft"),
    "Licensed under CC BY-NC 4.0.": ("CC-BY-NC", "restricted"),
    "All rights reserved.": ("Proprietary", "restricted"),
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and more. Words. The above copyright notice and this permission notice shall be included in all copies or so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT ANY.': ("MIT", "permissive"),
    "A license to drive. Notice the change.": ("", "none"),
    "": ("", "none"),
    None: ("", "none"),
    "x " * 50_000 + "\nReleased under the MIT License.": ("MIT", "permissive"),
}


def test_licenses(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(CASES)] + [(None, "All rights reserved", "", 0)], "doc_id bigint, text string, spans string, family int")
    out = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, (t, want) in enumerate(CASES.items()):
        assert (out[i].licenses, out[i].family) == want
        for x in filter(None, out[i].spans.split(",")):
            _, a, b = x.split(":")
            assert licenses.identify(t[int(a) : int(b)] + ".")
    assert licenses.scan(df.limit(0)).count() == 0


MIT_BODY = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD_BODY = """Copyright (c) 2020, Some One
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
{endorse}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_BODY = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing.
"""
WRAPPED = {
    MIT_BODY: "MIT",
    "".join(f"# {x}".rstrip() + "\n" for x in MIT_BODY.splitlines()): "MIT",
    BSD_BODY.format(endorse=ENDORSE): "BSD-3-Clause",
    BSD_BODY.format(endorse=""): "BSD-2-Clause",
    APACHE_BODY: "Apache-2.0",
    "".join(f" * {x}".rstrip() + "\n" for x in APACHE_BODY.splitlines()): "Apache-2.0",
    "This project is licensed under the MIT License.": "MIT",
    "This software is released under the MIT License.": "MIT",
    "Some words. This project is\nreleased under\nthe MIT License.": "MIT",
    "Code is distributed under the Apache License, Version 2.0.": "Apache-2.0",
    "The data are licensed under the Creative Commons Attribution\nNonCommercial 4.0 International License.": "CC-BY-NC",
    "All rights\nreserved.": "Proprietary",
    "This program is licensed under the GNU GPL version 3\nReleased under the MIT License\nLicensed under CC BY 4.0": "GPL-3.0,MIT,CC-BY",
    "Words wrapped\nover lines of a notice\nwith no license.": "",
}


def test_wrapped_texts():
    for t, want in WRAPPED.items():
        known = licenses.identify(t)
        assert [a for _, a, _ in known] == sorted(a for _, a, _ in known)
        assert ",".join(dict.fromkeys(n for n, _, _ in licenses.match([k for k, _, _ in known]))) == want, (t, known)


MORE = {
    "AGPL-3.0": "This program is free software under the terms of the GNU Affero General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, in any form.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0": "All content is made available under the terms of the Eclipse Public License v2.0.",
    "BSD": "This code is released under the BSD 3-Clause License.",
    "CC-BY-SA": "This text is licensed under CC BY-SA 4.0.",
    "CC-BY-ND": "This text is licensed under Creative Commons Attribution-NoDerivatives 4.0.",
    "CC-BY": "This text is licensed under CC BY 4.0.",
    "CC-BY-NC": "This text is licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This program is licensed under the GNU General Public License version 3.",
    "Apache-2.0": "Apache License\nVersion 2.0, January 2004",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


@pytest.mark.parametrize("name", MORE)
def test_more_licences(name):
    text = f"Some words before.\n\n{MORE[name]}\n\nAnd after."
    found = licenses.match([k for k, _, _ in licenses.identify(text)])
    assert [n for n, _, _ in found] == [name], licenses.identify(text)


def test_every_licence_has_a_family():
    assert {n for n, _ in licenses.RULES} == set(licenses.FAMILY) and {w for _, ws in licenses.RULES for w in ws} <= {k for k, _ in licenses.SENTENCES}


TAGGED = {
    "# SPDX-License-Identifier: MIT": "MIT",
    "License: BSD-3-Clause\nmore words": "BSD-3-Clause",
    "/* SPDX-License-Identifier: (GPL-2.0-or-later OR MIT) */": "GPL-2.0-or-later,MIT",
    "This file is licensed under GPL-2.0-or-later.": "GPL-2.0-or-later",
    "Released under the Artistic License 2.0.": "Artistic-2.0",
    "Licensed under the EUPL version 1.2 or later.": "EUPL-1.2",
    "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0",
    "Distributed under the GNU Lesser General Public License version 2.1.": "LGPL-2.1",
    "Distributed under the GNU Lesser General Public License version 3.": "LGPL-3.0",
    "made available under the Eclipse Public License 2.0": "EPL-2.0",
    "made available under the Eclipse Public License v1.0": "EPL-1.0",
    "Code under the terms of the LGPL-2.1-only is fine": "",
    "My driving license: B. The license: none. License: see below.": "",
    "It was released under pressure 3 times; mitigation is simple.": "",
}


def test_tags_and_references_by_identifier():
    for t, want in TAGGED.items():
        known = licenses.identify(t)
        assert ",".join(n for n, _, _ in licenses.match([k for k, _, _ in known])) == want, t
        assert all(0 <= a < b <= len(t) for _, a, b in known)


def slow_identify(text):
    """Each sentence and line against the patterns as they are written, by full matches of all readings."""
    wrapped = [(k, re.compile(next(f"{lead}({p[len(own):].replace(' ', '[ ' + chr(10) + ']')})" for own, lead in ((".*", ".*?"), ("(?:.* )?", "(?:.*?[ \n])??"), ("", "(?:.*?\n)??")) if p.startswith(own)), re.DOTALL)) for k, p in licenses.SENTENCES]
    plain = [(k, re.compile(p)) for k, p in licenses.SENTENCES]
    found = []
    for a, b in licenses.pieces(text, re.compile(r"[.!?;:](?=\s|$)|\n\s*\n"), 0, len(text)):
        own = []
        for p, q in licenses.pieces(text, re.compile(r"\n(?=\S)"), a, b):
            k = next((k for k, x in plain if x.fullmatch(licenses.normalised(text[p:q]))), None)
            own += [(k, p, q)] if k else []
        starts, lines, at = [], [], a
        for line in text[a:b].split("\n"):
            if licenses.normalised(line):
                starts.append(at)
                lines.append(licenses.normalised(line))
            at += len(line) + 1
        joined = "\n".join(lines)
        hit = next(((k, m) for k, x in wrapped if (m := x.fullmatch(joined))), None) if len(lines) > 1 else None
        if hit:
            whole = (hit[0], starts[joined.count("\n", 0, hit[1].start(1))], b)
            if not any(k == whole[0] and p <= whole[1] < q for k, p, q in own):
                own = sorted([x for x in own if not x[1] <= whole[1] < x[2]] + [whole], key=lambda x: x[1])
        found += own
    return found


def test_identify_by_full_matches():
    rng = random.Random(8)
    bits = ["Released under the MIT License", "the software is provided", "as is", "by someone", "without any", "Permission is hereby granted free of charge to any person obtaining a copy of this software", "and more", "All rights reserved",
            "redistribution and use in source and binary forms", "with changes are permitted provided", "This program is distributed in the hope that it will be useful but without any warranty", "gnu general public license version 2", "licensed under the", "GNU General Public License version 3 of it", "Apache License", "2 0",
            "You may obtain a copy of the license at", "You may not use this file except in compliance with the license", "Mozilla Public License v 2 0", "subject to the terms of the", "dedicated to the public domain", "words"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) + rng.choice([" ", " ", "\n", "\n", ". ", "\n\n", ": "]) for _ in range(rng.randint(1, 9)))
        assert licenses.identify(text) == slow_identify(text), text


def test_a_long_passage_without_sentence_ends_is_linear():
    began = time.time()
    for text in ("this software is provided by x\n" * 33_000, "this software is provided by x " * 33_000, "licensed under the " * 55_000):
        licenses.identify(text)
    assert time.time() - began < 20
