"""Licence recognition by sentences and ordered rules.

Texts are cut into segments at line ends and behind sentence marks. A segment is normalised: ASCII letters folded, every run of
other characters one blank. Known licence sentences have identifiers; as sentences may be wrapped over lines, neighbouring
segments are joined while what they spell begins a known sentence, and the longest sentence that is spelt counts. A
rule names the identifiers of a licence in their order; it matches where they follow each other in a document with at most
`gap` other segments between two of them. Sentences that several rules share count for each of them; a rule that has all
sentences of a shorter one reports beside it.

Cases. Null and empty texts have no segments and no licences. Whole texts of any length. Repeated rows get a row each; an empty
table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Licence sentences by identifier.
SENTENCES = {
    "apache2-short": "Licensed under the Apache License, Version 2.0.",
    "apache2-head": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "mit-short": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-short": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "epl2-head": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-head": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "artistic2-head": "This program is free software; you can redistribute it and/or modify it under the terms of the the Artistic License (2.0).",
    "wtfpl-do": "You just DO WHAT THE FUCK YOU WANT TO.",
    "cc0-waive": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "mpl2-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-get": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
#: Licences as ordered sentence identifiers.
RULES = [
    ("Apache-2.0", ("apache2-short",)),
    ("Apache-2.0", ("apache2-head", "apache2-copy", "apache2-basis", "apache2-see")),
    ("GPL-3.0", ("gpl3-short",)),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-see")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-see")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("BSL-1.0", ("bsl-short",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("EPL-2.0", ("epl2-head",)),
    ("EPL-1.0", ("epl1-head",)),
    ("Artistic-2.0", ("artistic2-head",)),
    ("WTFPL", ("wtfpl-do",)),
    ("CC0-1.0", ("cc0-waive",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-long",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("MPL-2.0", ("mpl2-head",)),
    ("Unlicense", ("unlicense",)),
    ("all-rights-reserved", ("reserved",)),
]
#: Names that stand alone in identifier lines only.
MORE_NAMES = ("Apache-1.1", "BSD-4-Clause", "CDDL-1.0", "CECILL-2.1", "EUPL-1.2", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "MS-PL", "MulanPSL-2.0", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "UPL-1.0", "X11")
# a line that names a licence by its identifier is a known sentence and a rule of its own, for every name
for _name in sorted({name for name, _ in RULES if name != "all-rights-reserved"} | set(MORE_NAMES)):
    SENTENCES[f"spdx:{_name}"] = f"SPDX-License-Identifier: {_name}"
    RULES.append((_name, (f"spdx:{_name}",)))
CUT = re.compile(r"\n+|(?<=[.!?:])[ \t\r]+")
OTHER = re.compile(r"[^a-z0-9\u0080-\U0010ffff]+")


def normal(s: str) -> str:
    """Folded letters and digits; other ASCII characters become single blanks."""
    return OTHER.sub(" ", s.translate(LOWER)).strip()


LOWER = {c: c + 32 for c in range(65, 91)}


class SentenceRules:
    """Known sentences, what begins one, and the ordered rules."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES, gap: int = 3):
        self.known = {normal(s): i for i, s in sentences.items()}
        self.starts = {" ".join(w[:n]) for s in self.known for w in [s.split(" ")] for n in range(1, len(w) + 1)}
        self.rules, self.gap = rules, gap

    def sentences(self, text: str) -> tuple[int, list[tuple[int, int, str]]]:
        """Number of segments, and (first, last segment, identifier) of the known sentences in order."""
        parts = [p for p in map(normal, CUT.split(text)) if p]
        out, i = [], 0
        while i < len(parts):
            best, spelt, j = None, parts[i], i
            while spelt in self.starts:
                if spelt in self.known:
                    best = (i, j, self.known[spelt])
                j += 1
                if j == len(parts):
                    break
                spelt = f"{spelt} {parts[j]}"
            if best:
                out.append(best)
                i = best[1]
            i += 1
        return len(parts), out

    def licenses(self, found: list[tuple[int, int, str]]) -> list[str]:
        """Licences whose rule the sentences meet, sorted."""
        got = set()
        for name, order in self.rules:
            # the last segment at which the first k sentences of the rule end: the latest of all reaches furthest
            ends = [-(self.gap + 2)] * len(order)
            for first, last, s in found:
                for k in range(len(order) - 1, -1, -1):
                    if order[k] == s and (k == 0 or 0 < first - ends[k - 1] <= self.gap + 1):
                        ends[k] = last
            if ends[-1] >= 0:
                got.add(name)
        return sorted(got)


def scan_licenses(docs: DataFrame, rules: SentenceRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_sentences (segments), n_known, sentence_ids in order, licenses (sorted)."""
    matcher = rules or SentenceRules()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, known, names = [], [], []
            for t in b.column(1):
                count, found = matcher.sentences(t.as_py() or "")
                n.append(count)
                known.append([x[2] for x in found])
                names.append(matcher.licenses(found) if found else [])
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([len(x) for x in known], pa.int64()), pa.array(known, strings), pa.array(names, strings)], names=[id_col, "n_sentences", "n_known", "sentence_ids", "licenses"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(scan, f"`{id_col}` {kind}, n_sentences long, n_known long, sentence_ids array<string>, licenses array<string>")
