"""Licence recognition by sentence rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoryloom.llm.shared import steps

#: Sentences of public licence texts and notices in normal form, by identifier.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "gnu-gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gnu-lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "gnu-v2-later": "either version 2 of the license or at your option any later version",
    "gnu-v2-only": "version 2 of the license",
    "gnu-v21-later": "either version 2 1 of the license or at your option any later version",
    "gpl2-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "agpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-notice": "distributed under the boost software license version 1 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "lgpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "cddl-subject": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "eupl12-notice": "licensed under the eupl version 1 2",
    "wtfpl-terms": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "artistic2-terms": "you can redistribute it and or modify it under the terms of the artistic license version 2 0",
    "psf-grant": "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation",
    "cc0-notice": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}
#: What END leaves of genuine texts where it cuts or words a sentence differently, in normal form, and the
#: sentence it counts as. The SQL knows SENTENCES alone.
VARIANTS = {
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "you may obtain a copy of the license at https www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-redistribute",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-obtain",
}
#: A licence is found where these sentences follow each other, other sentences between them or not, none
#: further than FAR from the one before. Rules of more sentences go first and use theirs up for the others.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "as-is"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-notice", "apache-use", "apache-basis"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-redistribute"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gnu-gpl-terms", "gnu-v2-later"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("GPL-2.0-only", ["gnu-gpl-terms", "gnu-v2-only"]),
    ("LGPL-2.1-or-later", ["gnu-lgpl-terms", "gnu-v21-later"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-obtain"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("Unlicense", ["unlicense-domain"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("BSL-1.0", ["boost-notice"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute"]),
    ("CDDL-1.0", ["cddl-subject"]),
    ("EUPL-1.2", ["eupl12-notice"]),
    ("WTFPL", ["wtfpl-terms"]),
    ("Artistic-2.0", ["artistic2-terms"]),
    ("PSF-2.0", ["psf-grant"]),
]
#: Names that count in a line of SPDX-License-Identifier, in which they stand alone or in an expression.
SPDX = [
    *dict.fromkeys(name for name, _ in RULES), "Apache-1.1", "BSD-4-Clause", "0BSD", "GPL-1.0-or-later", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only",
    "AGPL-3.0-only", "MPL-1.1", "EPL-1.0", "CDDL-1.1", "CC-BY-3.0", "CC-BY-SA-3.0", "Artistic-1.0", "OFL-1.1", "MIT-0", "MS-PL", "PostgreSQL", "Python-2.0",
]
#: A sentence ends at a line's end, or at a full stop, colon or semicolon before white space.
END = r"[.!?:;]+[ \t\r]+|\n[ \t\r]*\n|\n"
#: Words that every sentence above has one of; texts and sentences without them need no further look.
HINT = r"(?i)licen|redistribut|permission|warrant|copyright|endorse|mozilla|unencumbered"
NOISE = r"[^a-z0-9]+"
#: Code points between the starts of two sentences of one rule at most.
FAR = 5000


_ENDS, _HINT, _NOISE = re.compile(END), re.compile(HINT, re.A), re.compile(NOISE)
_WRAP, _ALNUM = re.compile(r"(?<!\n)\n(?!\n)"), re.compile(r"[A-Za-z0-9]")
_TAG, _NAME = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)"), re.compile(r"[A-Za-z0-9.+-]+")
_KNOWN = {v: k for k, v in SENTENCES.items()} | VARIANTS
#: Older names of the same licences.
_SPDX = {x.lower(): f"spdx-{x}" for x in SPDX} | {f"{x[:-9].lower()}+": f"spdx-{x}" for x in SPDX if x.endswith("-or-later")} | {x[:-5].lower(): f"spdx-{x}" for x in SPDX if x.endswith("-only")}
_ORDER = {f"spdx-{x}": i for i, x in enumerate(SPDX)}
_BY_LENGTH = sorted(enumerate(RULES), key=lambda r: -len(r[1][1]))


def normal(sentence: str) -> str:
    """ASCII lower case, every other run one space, none at the ends."""
    return _NOISE.sub(" ", sentence.lower()).strip(" ")


def _sentences(text: str) -> Iterator[tuple[int, str]]:
    """Place of the first letter or digit, and identifier, of the known sentences of one reading."""
    start = 0
    for end in (*_ENDS.finditer(text), None):
        part = text[start : end.start() if end else len(text)]
        if _HINT.search(part) and (name := _KNOWN.get(normal(part))):
            yield start + _ALNUM.search(part).start(), name
        start = end.end() if end else 0


def sentences(text: str) -> list[tuple[int, str]]:
    """Places and identifiers, in order, of the known sentences of both readings and of SPDX names; each once."""
    if not text or not _HINT.search(text):
        return []
    # An SPDX line ends a sentence, wherever it stands.
    found = {*_sentences(text), *_sentences(_WRAP.sub(" ", _TAG.sub(lambda m: "." * len(m[0]), text)))}
    for tag in _TAG.finditer(text):
        found |= {(tag.start(1) + x.start(), name) for x in _NAME.finditer(tag[1]) if (name := _SPDX.get(x[0].lower()))}
    return sorted(found)


def recognised(found: list[tuple[int, str]]) -> list[str]:
    """Licences, by rule order, that the sentences make.

    Rules of more sentences go first. A rule takes the first of its sentences that is still free, then the first of
    the next one after it and so on; what stands between is left for other rules. It starts anew where two known
    sentences lie over FAR apart. An earlier start finds whatever a later one does, so one pass a rule suffices, and
    only rules all of whose sentences occur are passed.
    """
    free: list[str | None] = [name for _, name in found]
    there, rules = set(free), set()
    cut = [i > 0 and found[i][0] - found[i - 1][0] > FAR for i in range(len(found))]
    for number, (_, rule) in _BY_LENGTH:
        if not there.issuperset(rule):
            continue
        taken: list[int] = []
        for i, name in enumerate(free):
            if cut[i]:
                taken = []
            if name == rule[len(taken)]:
                taken.append(i)
                if len(taken) == len(rule):
                    rules.add(number)
                    for k in taken:
                        free[k] = None
                    taken = []
    tags = sorted((name for name in there if name in _ORDER), key=_ORDER.get)
    return list(dict.fromkeys([*(RULES[k][0] for k in sorted(rules)), *(x.removeprefix("spdx-") for x in tags)]))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, sentence_ids (in order, / before and after each) and licences (names by rule order, then by SPDX lines, comma-joined).

    Null or empty texts have none, repeated rows repeat, an empty table gives none and no other column is read. A text
    is read by sentences as they stand, and once more with single line ends as spaces, since sentences wrap; a
    sentence that both find begins at the same letter and counts once. Only texts that hold a word of some known
    sentence leave the JVM. Time and memory grow with a text's length, however many sentences it holds.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            found = [sentences(t) for t in texts]
            ids = ["/" + "".join(f"{name}/" for _, name in x) if x else "" for x in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.string()), pa.array([",".join(recognised(x)) for x in found], pa.string())], ["doc_id", "sentence_ids", "licences"])

    t = docs[text].cast("string")
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.when(t.rlike(HINT), t).alias("text")).mapInArrow(run, "doc_id long, sentence_ids string, licences string")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    table = ", ".join(f"'{v}': '{k}'" for k, v in SENTENCES.items())
    rules = ", ".join("case when regexp_matches(s, '/" + "/(?:.*/)?".join(r) + f"/') then '{n}' end" for n, r in RULES)
    # RE2 has no look-around: double line ends are set aside while single ones become spaces.
    pick = lambda t: f"list_filter(list_transform(list_filter(regexp_split_to_array({t}, '{END}'), lambda x: regexp_matches(x, '{HINT}')), lambda x: known[trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))]), lambda x: x is not null)"
    wrapped = "replace(regexp_replace(replace(regexp_replace(t, '\\n(\\n+)', chr(1) || '\\1', 'g'), chr(1) || chr(10), chr(1)), '\\n', ' ', 'g'), chr(1), chr(10) || chr(10))"
    return f"""
with k as (select map {{{table}}} as known),
d as (select doc_id, coalesce(text, '') as t from documents),
i as (select doc_id, {pick('t')} as a, {pick(wrapped)} as b from d, k),
s as (select doc_id, '/' || array_to_string(case when len(b) > len(a) then b else a end, '/') || '/' as s from i),
r as (select doc_id, s, list_filter([{rules}], lambda x: x is not null) as found from s)
select doc_id, case when s = '//' then '' else s end as sentence_ids,
       array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') as licences
from r
"""


ORACLE_SQL = _sql()
