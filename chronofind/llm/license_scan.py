"""License scans by sentence rules.

A text is cut into sentences, each is normalised (lower case, letter and digit runs joined by one
space, so comment marks, indents and line ends don't count) and looked up among the known licence
sentences, which gives a sequence of sentence identifiers with their places. Known are the sentences of
common notices, templates with a part that varies (a holder's name), and, made by rule, every grant
(`LEADS` before `NAMES`) and SPDX tag. A known sentence may itself hold such cuts ('free software; you can',
'v. 2.0', an SPDX tag): pieces are joined for as long as a known sentence goes on like that. Ordered licence rules are matched against that sequence: a rule is a
list of identifiers that must follow each other with at most `max_gap` other known sentences or
`max_chars` normalised characters between two. Longer rules go first and use up their sentences, so a full
notice is reported once and not again by its first line.

Texts are cut at the ends of lines as well, so wrapped notices, headings and notices without a full stop
are all seen; of the known sentences that begin at a place the longest counts. The tables travel with the tasks
(they are constants); texts are read once and never shuffled.

Defined cases: null or empty texts give no row. Sentences of any length are looked up. Repeated rows are each reported, and so is a licence
that a text names twice. Rules of equal length go by name. An empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Known licence sentences, as normalised text, by identifier.
SENTENCES = {
    "mit.grant": "released under the mit license",
    "mit.grant2": "this project is licensed under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.distributed": "distributed under the mit license",
    "mit.name": "the mit license mit",
    "mit.title": "mit license",
    "mit.permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit.liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache2.grant": "licensed under the apache license version 2 0",
    "apache2.grant2": "licensed under the apache license version 2 0 the license",
    "apache2.released": "released under the apache license version 2 0",
    "apache2.short": "licensed under the apache license 2 0",
    "apache2.use": "you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at",
    "apache2.basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2.see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl3.licensed": "licensed under the gnu general public license version 3",
    "gpl3.released": "released under the gnu general public license version 3",
    "gpl2.work": "this work is licensed under the gnu general public license version 2",
    "gpl2.licensed": "licensed under the gnu general public license version 2",
    "gpl3.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.details": "see the gnu general public license for more details",
    "lgpl3.licensed": "licensed under the gnu lesser general public license version 3",
    "agpl3.licensed": "licensed under the gnu affero general public license version 3",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd3.licensed": "licensed under the bsd 3 clause license",
    "bsd2.licensed": "licensed under the bsd 2 clause license",
    "bsd.warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc.permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc.warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "zerobsd.permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib.warranty": "this software is provided as is without any express or implied warranty",
    "zlib.liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib.permission": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl.permission": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "lgpl21.redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3.redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "unlicense.anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "isc.licensed": "licensed under the isc license",
    "mpl2.subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2.licensed": "licensed under the mozilla public license version 2 0",
    "ccbync4.licensed": "licensed under cc by nc 4 0",
    "ccby4.licensed": "licensed under cc by 4 0",
    "ccbysa4.licensed": "licensed under cc by sa 4 0",
    "ccbysa3.licensed": "licensed under cc by sa 3 0",
    "ccby4.work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4.work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4.work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0.dedicated": "this work is dedicated to the public domain under cc0 1 0",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "reserved.all": "all rights reserved",
    "spdx.mit": "spdx license identifier mit",
    "spdx.apache2": "spdx license identifier apache 2 0",
    "spdx.gpl2": "spdx license identifier gpl 2 0 only",
    "spdx.gpl3": "spdx license identifier gpl 3 0 only",
    "spdx.bsd3": "spdx license identifier bsd 3 clause",
    "spdx.bsd2": "spdx license identifier bsd 2 clause",
    "spdx.mpl2": "spdx license identifier mpl 2 0",
}

#: Sentences with a part that varies, as regular expressions over normalised text; the first word is fixed.
TEMPLATES = {
    "bsd.names_of": r"neither the names? of (?:\S+ ){1,20}may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.warranty_by": r"this software is provided by (?:\S+ ){1,20}as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache2.work_of": r"licensed to (?:\S+ ){1,20}under one or more contributor license agreements",
    "copyright.line": r"copyright (?:c )?(?:\d{4} )+(?:\S+ ?){1,12}",
}

#: What grants say before the name of the licence, and the names, normalised, by SPDX identifier.
LEADS = (
    "licensed under", "released under", "distributed under", "available under", "published under", "covered by", "made available under",
    "this project is licensed under", "this work is licensed under", "this software is licensed under", "this software is released under",
    "this project is released under", "this program is licensed under", "this file is licensed under", "this code is licensed under", "this library is licensed under",
)
NAMES = {
    "MIT": ("the mit license", "mit license", "the mit licence", "an mit license", "the mit license mit"),
    "Apache-2.0": ("the apache license version 2 0", "the apache license 2 0", "apache license 2 0", "apache 2 0", "the apache 2 0 license"),
    "GPL-2.0": ("the gnu general public license version 2", "the gnu general public license v2", "the gnu gpl v2", "gpl v2", "gplv2", "the gplv2"),
    "GPL-3.0": ("the gnu general public license version 3", "the gnu general public license v3", "the gnu gpl v3", "gpl v3", "gplv3", "the gplv3"),
    "LGPL-2.1": ("the gnu lesser general public license version 2 1", "the lgpl v2 1", "lgpl 2 1"),
    "LGPL-3.0": ("the gnu lesser general public license version 3", "the lgpl v3", "lgplv3"),
    "AGPL-3.0": ("the gnu affero general public license version 3", "the agpl v3", "agplv3"),
    "BSD-2-Clause": ("the bsd 2 clause license", "bsd 2 clause license", "the simplified bsd license", "the 2 clause bsd license"),
    "BSD-3-Clause": ("the bsd 3 clause license", "bsd 3 clause license", "the new bsd license", "the 3 clause bsd license", "the modified bsd license"),
    "ISC": ("the isc license", "isc license"),
    "MPL-2.0": ("the mozilla public license version 2 0", "the mozilla public license 2 0", "mpl 2 0"),
    "EPL-2.0": ("the eclipse public license 2 0", "the eclipse public license version 2 0"),
    "Zlib": ("the zlib license", "zlib license"),
    "BSL-1.0": ("the boost software license version 1 0", "the boost software license"),
    "Unlicense": ("the unlicense",),
    "CC0-1.0": ("cc0 1 0", "cc0", "the creative commons zero license", "creative commons cc0 1 0 universal"),
    **{
        f"CC-{code}-{version}": tuple(
            name
            for v in (version.replace(".", " "),)
            for name in (f"cc {code.lower().replace('-', ' ')} {v}", f"a creative commons {words} {v} international license", f"the creative commons {words} {v} license", f"a creative commons {words} {v} license")
        )
        for code, words in (("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"), ("BY-ND", "attribution noderivatives"), ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives"))
        for version in ("3.0", "4.0")
    },
}
#: Licences that have an SPDX tag of their own name, and the forms of those that are tagged with a suffix.
_SUFFIXED = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")


def by_rule() -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...]], ...]]:
    """The sentences, and one rule for each, of all grants and tags."""
    known, rules = {}, []
    for licence, names in NAMES.items():
        for i, name in enumerate(names):
            for j, lead in enumerate(LEADS):
                known[f"{licence}.{i}.{j}"] = f"{lead} {name}"
                rules.append((licence, (f"{licence}.{i}.{j}",)))
        for suffix in ("", "-only", "-or-later") if licence in _SUFFIXED else ("",):
            known[f"{licence}.tag{suffix}"] = normalise(f"SPDX-License-Identifier: {licence}{suffix}")
            rules.append((licence + suffix.replace("-only", ""), (f"{licence}.tag{suffix}",)))
    return known, tuple(rules)


#: Licence rules: (licence, identifiers in order).
RULES = (
    ("MIT", ("mit.title", "mit.permission", "mit.notice", "mit.warranty")),
    ("MIT", ("mit.permission", "mit.notice", "mit.warranty")),
    ("MIT", ("mit.permission", "mit.notice", "mit.warranty", "mit.liability")),
    ("MIT", ("mit.title", "mit.permission", "mit.notice", "mit.warranty", "mit.liability")),
    *(("MIT", (x,)) for x in ("mit.permission", "mit.grant", "mit.grant2", "mit.licensed", "mit.distributed", "mit.name", "mit.title", "spdx.mit")),
    ("Apache-2.0", ("apache2.grant2", "apache2.use", "apache2.copy", "apache2.basis", "apache2.see")),
    ("Apache-2.0", ("apache2.use", "apache2.basis", "apache2.see")),
    *(("Apache-2.0", (x,)) for x in ("apache2.grant", "apache2.grant2", "apache2.released", "apache2.short", "spdx.apache2")),
    ("GPL-3.0-or-later", ("gpl3.redistribute", "gpl.hope", "gpl.details")),
    ("GPL-3.0-or-later", ("gpl3.redistribute",)),
    ("GPL-2.0-or-later", ("gpl2.redistribute", "gpl.hope", "gpl.details")),
    ("GPL-2.0-or-later", ("gpl2.redistribute",)),
    *(("GPL-3.0", (x,)) for x in ("gpl3.work", "gpl3.licensed", "gpl3.released", "spdx.gpl3")),
    *(("GPL-2.0", (x,)) for x in ("gpl2.work", "gpl2.licensed", "spdx.gpl2")),
    ("LGPL-3.0", ("lgpl3.licensed",)),
    ("AGPL-3.0", ("agpl3.licensed",)),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary")),
    *(("BSD-3-Clause", (x,)) for x in ("bsd3.licensed", "spdx.bsd3")),
    *(("BSD-2-Clause", (x,)) for x in ("bsd2.licensed", "spdx.bsd2")),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.names_of")),
    *((n, (*r, w)) for w in ("bsd.warranty", "bsd.warranty_by") for n, r in (("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.names")), ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.names_of")), ("BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary")))),
    *(("ISC", x) for x in (("isc.permission", "isc.warranty"), ("isc.permission",), ("isc.licensed",))),
    ("0BSD", ("zerobsd.permission", "isc.warranty")),
    *(("Zlib", x) for x in (("zlib.warranty", "zlib.liability", "zlib.permission"), ("zlib.permission",))),
    ("BSL-1.0", ("bsl.permission",)),
    ("LGPL-2.1-or-later", ("lgpl21.redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl3.redistribute",)),
    ("AGPL-3.0-or-later", ("agpl3.redistribute",)),
    ("Apache-2.0", ("apache2.work_of", "apache2.use", "apache2.basis", "apache2.see")),
    *(("Unlicense", x) for x in (("unlicense.free", "unlicense.anyone"),)),
    *(("MPL-2.0", (x,)) for x in ("mpl2.subject", "mpl2.licensed", "spdx.mpl2")),
    *(("CC-BY-NC-4.0", (x,)) for x in ("ccbync4.licensed", "ccbync4.work")),
    *(("CC-BY-4.0", (x,)) for x in ("ccby4.licensed", "ccby4.work")),
    *(("CC-BY-SA-4.0", (x,)) for x in ("ccbysa4.licensed", "ccbysa4.work")),
    ("CC-BY-SA-3.0", ("ccbysa3.licensed",)),
    ("CC0-1.0", ("cc0.dedicated",)),
    ("Unlicense", ("unlicense.free",)),
    ("All-rights-reserved", ("reserved.all",)),
)

#: Every known sentence holds one of these; texts without any are not cut up.
TRIGGER = re.compile(r"licen[sc]|copyright|software|domain|reserved|redistribut|permission|warrant|damages|(?:released|distributed|available|published)[\W_]+under|covered[\W_]+by", re.IGNORECASE)

#: Lines without a word, such as those of a comment mark alone, part paragraphs.
_PARAGRAPH = re.compile(r"\n[^\w\n]*\n")
_HINTS = ("licen", "copyright", "software", "domain", "reserved", "redistribut", "permission", "warrant", "damages", "under", "covered")
#: A sentence ends, or a line does.
_CUT = re.compile(r"(?<=[.;:!?])\s+|\n")
_WORD = re.compile(r"[^\W_]+")


def normalise(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


def _pieces(text: str, cut: re.Pattern, start: int, end: int) -> Iterator[tuple[int, int]]:
    at = start
    for m in cut.finditer(text, start, end):
        yield at, m.start()
        at = m.end()
    yield at, end


def pieces(text: str) -> Iterator[list[tuple[int, int]]]:
    """Places of the pieces between the ends of sentences and lines, a list for each paragraph."""
    for a, b in _pieces(text, _PARAGRAPH, 0, len(text)):
        yield list(_pieces(text, _CUT, a, b))


class Scanner:
    def __init__(self, known: dict[str, str] | None = None, rules=None, templates: dict[str, str] = TEMPLATES, max_gap: int = 2, max_chars: int = 400):
        made, more = by_rule()
        # of one sentence the identifier that is given by hand counts
        self.known = {s: k for k, s in (made | SENTENCES if known is None else known).items()}
        used = set(self.known.values())
        rules = [*RULES, *more] if rules is None else rules
        self.ordered = sorted(self.known)
        self.templates: dict[str, list[tuple[str, re.Pattern]]] = {}
        for k, t in templates.items():
            self.templates.setdefault(t.split()[0], []).append((k, re.compile(t)))
        self.first = {s.split()[0] for s in self.known} | set(self.templates)
        self.rules = sorted(dict.fromkeys(r for r in rules if all(k in used or k in templates for k in r[1])), key=lambda r: (-len(r[1]), r))
        self.max_gap, self.max_chars = max_gap, max_chars

    def identify(self, text: str) -> list[tuple[int, int, str]]:
        """(first, end, identifier) of the known sentences, in order."""
        found = []
        for places in pieces(text):
            i = 0
            while i < len(places):
                n, k = self.longest_at(text, places, i)
                if k:
                    a, b = places[i][0], places[i + n - 1][1]
                    found.append((a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip()), k))
                i += n
        return found

    def longest_at(self, text: str, places: list[tuple[int, int]], i: int) -> tuple[int, str | None]:
        """(pieces, identifier) of the longest known sentence that starts at a piece; (1, None) if none does."""
        best, words = (1, None), ""
        begins = _WORD.search(text, *places[i])
        if begins is None or (first := begins[0].lower()) not in self.first:
            return best
        templates, open_ = self.templates.get(first, ()), True
        for j in range(i, len(places)):
            a, b = places[j]
            part = normalise(text[a:b])
            words = f"{words} {part}" if words and part else words or part
            if part and (k := self.known.get(words)):
                best = (j - i + 1, k)
            elif templates and open_ and (k := next((k for k, t in templates if t.fullmatch(words)), None)):
                best = (j - i + 1, k)
            ended = j + 1 == len(places) or text[b - 1 : b] in ".;:!?"
            # a template goes as far as its sentence
            open_ &= not ended or text[b - 1 : b] == "." and part[-4:].rpartition(" ")[2] in ("inc", "ltd", "co", "corp")
            at = bisect_left(self.ordered, words + " ")
            if (at == len(self.ordered) or not self.ordered[at].startswith(words + " ")) and not (templates and open_):
                break
        return best

    def scan(self, text: str | None) -> list[tuple[str, str, int, int, int]]:
        """(licence, first identifier, sentences, first character, end) of the matches, in order."""
        if not text:
            return []
        low = text.lower()
        if not any(w in low for w in _HINTS) or not TRIGGER.search(low):
            return []
        known, used, out = self.identify(text), set(), []
        for name, ids in self.rules:
            for i, (_, _, k) in enumerate(known):
                if k != ids[0] or i in used:
                    continue
                got = [i]
                for want in ids[1:]:
                    last = got[-1]
                    nxt = next((j for j in range(last + 1, min(len(known), last + 2 + self.max_gap)) if known[j][2] == want and j not in used), None)
                    if nxt is None or known[nxt][0] - known[last][1] > self.max_chars and len(normalise(text[known[last][1] : known[nxt][0]])) > self.max_chars:
                        break
                    got.append(nxt)
                if len(got) == len(ids):
                    used.update(got)
                    out.append((name, ids[0], len(ids), known[got[0]][0], known[got[-1]][1]))
        return sorted(out, key=lambda r: (r[3], r[4], r[0]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, license, rule, n_sentences, first_char, end_char): one row per licence notice."""
    scanner = scanner or Scanner()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i.as_py(), *x) for i, t in zip(b.column(0), b.column(1), strict=True) for x in scanner.scan(t.as_py())]
            if found:
                cols = list(zip(*found, strict=True))
                types = [b.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "license", "rule", "n_sentences", "first_char", "end_char"])

    return rows.mapInArrow(run, f"doc_id {kind}, license string, rule string, n_sentences long, first_char long, end_char long")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
