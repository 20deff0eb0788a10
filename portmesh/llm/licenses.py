"""License scans by ordered signature rules.

Rules are regular expressions made from a table of licenses and a few forms in which licenses are named:
an SPDX tag, an address, a grant ("licensed under the …"), a name with a version, a bare name. Further
rules, written by hand, are the wording of license texts and standard notices themselves. A rule is tried
only on texts that hold its keyword. Detections are taken by priority, then place, then length; one
that lies within the interval of a detection already taken is suppressed, so that "GNU General Public
License" inside a grant of "GNU General Public License, version 3" isn't a second license.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.llm.common import table

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, SPDX id, keywords (one of them is in every text that names it), name, address
# ('-' for none).
LICENSES = r"""
mit | mit | mit | (?:the )?mit license | opensource\.org/licenses?/mit
apache-2.0 | apache-2\.0 | apache | apache license,? (?:version |v\.? ?)2(?:\.0)? | apache\.org/licenses/license-2\.0
apache-1.1 | apache-1\.1 | apache | apache (?:software )?license,? (?:version |v\.? ?)1\.1 | apache\.org/licenses/license-1\.1
apache-1.0 | apache-1\.0 | apache | apache (?:software )?license,? (?:version |v\.? ?)1\.0 | apache\.org/licenses/license-1\.0
gpl-1.0 | gpl-1\.0(?:-only|-or-later)? | gpl/general | gnu general public license,? (?:version |v\.? ?)1(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
gpl-2.0 | gpl-2\.0(?:-only|-or-later)? | gpl/general | (?:gnu general public license|gnu gpl|gpl),?-? ?(?:version |v\.? ?)?2(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | gpl-3\.0(?:-only|-or-later)? | gpl/general | (?:gnu general public license|gnu gpl|gpl),?-? ?(?:version |v\.? ?)?3(?:\.0)? | gnu\.org/licenses/gpl-3\.0
gpl | gpl | gpl/general | (?:gnu )?general public license | gnu\.org/licenses/gpl
lgpl-2.0 | lgpl-2\.0(?:-only|-or-later)? | lgpl/general | (?:gnu library general public license|lgpl),?-? ?(?:version |v\.? ?)?2(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
lgpl-2.1 | lgpl-2\.1(?:-only|-or-later)? | lgpl/general | (?:gnu lesser general public license|lgpl),?-? ?(?:version |v\.? ?)?2\.1 | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | lgpl-3\.0(?:-only|-or-later)? | lgpl/general | (?:gnu lesser general public license|lgpl),?-? ?(?:version |v\.? ?)?3(?:\.0)? | gnu\.org/licenses/lgpl-3\.0
lgpl | lgpl | lgpl/general | (?:gnu )?(?:lesser|library) general public license | gnu\.org/licenses/lgpl
agpl-3.0 | agpl-3\.0(?:-only|-or-later)? | agpl/affero | (?:gnu affero general public license|agpl),?-? ?(?:version |v\.? ?)?3(?:\.0)? | gnu\.org/licenses/agpl-3\.0
agpl | agpl | agpl/affero | (?:gnu )?affero general public license | gnu\.org/licenses/agpl
gfdl-1.2 | gfdl-1\.2(?:-only|-or-later)? | documentation | gnu free documentation license,? (?:version |v\.? ?)1\.2 | gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2
gfdl-1.3 | gfdl-1\.3(?:-only|-or-later)? | documentation | gnu free documentation license,? (?:version |v\.? ?)1\.3 | gnu\.org/licenses/fdl-1\.3
bsd-0-clause | 0bsd | bsd | (?:zero-clause bsd|bsd zero[- ]clause)(?: license)? | opensource\.org/licenses?/0bsd
bsd-2-clause | bsd-2-clause | bsd | (?:bsd 2[- ]clause|2[- ]clause bsd|simplified bsd|freebsd)(?: license)? | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | bsd-3-clause | bsd | (?:bsd 3[- ]clause|3[- ]clause bsd|new bsd|modified bsd|revised bsd)(?: license)? | opensource\.org/licenses?/bsd-3-clause
bsd-4-clause | bsd-4-clause | bsd | (?:bsd 4[- ]clause|4[- ]clause bsd|original bsd)(?: license)? | -
bsd | bsd | bsd | bsd(?:-style)? license | -
cc0-1.0 | cc0-1\.0 | cc0/creative | (?:cc0(?: 1\.0)?|creative commons zero)(?: universal)? | creativecommons\.org/publicdomain/zero/1\.0
cc-by-2.0 | cc-by-2\.0 | cc/creative | (?:cc[- ]by|creative commons attribution) ?2\.0 | creativecommons\.org/licenses/by/2\.0
cc-by-2.5 | cc-by-2\.5 | cc/creative | (?:cc[- ]by|creative commons attribution) ?2\.5 | creativecommons\.org/licenses/by/2\.5
cc-by-3.0 | cc-by-3\.0 | cc/creative | (?:cc[- ]by|creative commons attribution) ?3\.0 | creativecommons\.org/licenses/by/3\.0
cc-by-4.0 | cc-by-4\.0 | cc/creative | (?:cc[- ]by|creative commons attribution) ?4\.0 | creativecommons\.org/licenses/by/4\.0
cc-by-sa-2.0 | cc-by-sa-2\.0 | cc/creative | (?:cc[- ]by[- ]sa|creative commons attribution[- ]share ?alike) ?2\.0 | creativecommons\.org/licenses/by-sa/2\.0
cc-by-sa-2.5 | cc-by-sa-2\.5 | cc/creative | (?:cc[- ]by[- ]sa|creative commons attribution[- ]share ?alike) ?2\.5 | creativecommons\.org/licenses/by-sa/2\.5
cc-by-sa-3.0 | cc-by-sa-3\.0 | cc/creative | (?:cc[- ]by[- ]sa|creative commons attribution[- ]share ?alike) ?3\.0 | creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-4.0 | cc-by-sa-4\.0 | cc/creative | (?:cc[- ]by[- ]sa|creative commons attribution[- ]share ?alike) ?4\.0 | creativecommons\.org/licenses/by-sa/4\.0
cc-by-nc-2.0 | cc-by-nc-2\.0 | cc/creative | (?:cc[- ]by[- ]nc|creative commons attribution[- ]non-?commercial) ?2\.0 | creativecommons\.org/licenses/by-nc/2\.0
cc-by-nc-3.0 | cc-by-nc-3\.0 | cc/creative | (?:cc[- ]by[- ]nc|creative commons attribution[- ]non-?commercial) ?3\.0 | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-4.0 | cc-by-nc-4\.0 | cc/creative | (?:cc[- ]by[- ]nc|creative commons attribution[- ]non-?commercial) ?4\.0 | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nd-3.0 | cc-by-nd-3\.0 | cc/creative | (?:cc[- ]by[- ]nd|creative commons attribution[- ]no ?derivatives) ?3\.0 | creativecommons\.org/licenses/by-nd/3\.0
cc-by-nd-4.0 | cc-by-nd-4\.0 | cc/creative | (?:cc[- ]by[- ]nd|creative commons attribution[- ]no ?derivatives) ?4\.0 | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-sa-3.0 | cc-by-nc-sa-3\.0 | cc/creative | (?:cc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]non-?commercial[- ]share ?alike) ?3\.0 | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-sa-4.0 | cc-by-nc-sa-4\.0 | cc/creative | (?:cc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]non-?commercial[- ]share ?alike) ?4\.0 | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-nd-3.0 | cc-by-nc-nd-3\.0 | cc/creative | (?:cc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]non-?commercial[- ]no ?derivatives) ?3\.0 | creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-nc-nd-4.0 | cc-by-nc-nd-4\.0 | cc/creative | (?:cc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]non-?commercial[- ]no ?derivatives) ?4\.0 | creativecommons\.org/licenses/by-nc-nd/4\.0
creative-commons | cc | creative | creative commons(?: licen[cs]e)? | creativecommons\.org/licenses
mpl-1.1 | mpl-1\.1 | mpl/mozilla | (?:mozilla public license|mpl),?-? ?(?:version |v\.? ?)?1\.1 | mozilla\.org/mpl/1\.1
mpl-2.0 | mpl-2\.0 | mpl/mozilla | (?:mozilla public license|mpl),?-? ?(?:version |v\.? ?)?2\.0 | mozilla\.org/(?:en-us/)?mpl/2\.0
epl-1.0 | epl-1\.0 | epl/eclipse | (?:eclipse public license|epl),?-? ?(?:version |v\.? ?)?1\.0 | eclipse\.org/legal/epl-v10
epl-2.0 | epl-2\.0 | epl/eclipse | (?:eclipse public license|epl),?-? ?(?:version |v\.? ?)?2\.0 | eclipse\.org/legal/epl-(?:v20|2\.0)
cddl-1.0 | cddl-1\.0 | cddl/development | (?:common development and distribution license|cddl),? ?(?:version |v\.? ?)?1\.0 | opensource\.org/licenses?/cddl-1\.0
cddl-1.1 | cddl-1\.1 | cddl/development | (?:common development and distribution license|cddl),? ?(?:version |v\.? ?)?1\.1 | -
eupl-1.1 | eupl-1\.1 | eupl/european | (?:european union public licen[cs]e|eupl),? ?(?:version |v\.? ?)?1\.1 | -
eupl-1.2 | eupl-1\.2 | eupl/european | (?:european union public licen[cs]e|eupl),? ?(?:version |v\.? ?)?1\.2 | -
isc | isc | isc | isc license | opensource\.org/licenses?/isc
zlib | zlib | zlib | zlib(?:/libpng)? license | zlib\.net/zlib_license
boost-1.0 | bsl-1\.0 | boost | boost software license(?:,? (?:version |- version |v)1\.0)? | boost\.org/license_1_0
artistic-1.0 | artistic-1\.0(?:-perl)? | artistic | artistic license,? (?:version |v\.? ?)?1\.0 | -
artistic-2.0 | artistic-2\.0 | artistic | artistic license,? (?:version |v\.? ?)?2\.0 | opensource\.org/licenses?/artistic-2\.0
python-2.0 | (?:python|psf)-2\.0 | psf/python | (?:python software foundation|psf) license(?:,? (?:agreement|version 2))? | -
postgresql | postgresql | postgresql | postgresql license | opensource\.org/licenses?/postgresql
openssl | openssl | openssl | openssl license | -
ofl-1.1 | ofl-1\.1 | ofl/font | (?:sil open font license|open font license),? ?(?:version |v\.? ?)?1\.1 | (?:scripts\.sil\.org/ofl|openfontlicense\.org)
odbl-1.0 | odbl-1\.0 | odbl/database | (?:open database license|odbl)(?: v?1\.0)? | opendatacommons\.org/licenses/odbl
odc-by-1.0 | odc-by-1\.0 | commons | open data commons attribution license | opendatacommons\.org/licenses/by
pddl-1.0 | pddl-1\.0 | pddl/dedication | (?:public domain dedication and license|pddl) | opendatacommons\.org/licenses/pddl
wtfpl | wtfpl | wtfpl/what | (?:wtfpl|do what the f\w* you want to public license) | wtfpl\.net
unlicense | unlicense | unlicense | the unlicense | unlicense\.org
ms-pl | ms-pl | microsoft | microsoft public license | -
ms-rl | ms-rl | microsoft | microsoft reciprocal license | -
public-domain | public-domain | domain | (?:dedicated to|in|into) the public domain | -
proprietary | licenseref-proprietary | reserved/proprietary | (?:all rights reserved|proprietary and confidential) | -
""".strip()  # noqa: E501

# Label, keyword (a word of the wording), and wording of a license's text or its standard notice. A blank is white
# space and what stands before comment lines; the first that fits an interval counts, so texts that hold
# others go first.
BODIES = r"""
bsd-4-clause | advertising | redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:.{0,900}?all advertising materials mentioning features or use of this software must display
bsd-3-clause | redistribution | redistribution and use in source and binary forms, with or without modification, are permitted(?: \(subject to the limitations in the disclaimer below\))? provided that the following conditions are met:.{0,1200}?endorse or promote products derived from
bsd-2-clause | redistribution | redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:.{0,500}?redistributions in binary form must reproduce
bsd | redistribution | redistribution and use in source and binary forms
bsd | bsd-style | (?:governed by|under) a bsd-style license that can be found in the license file
bsd-0-clause | hereby | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.
isc | hereby | permission to use, copy, modify, (?:and/or|and) distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
postgresql | hereby | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
boost-1.0 | hereby | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
ofl-1.1 | hereby | permission is hereby granted, free of charge, to any person obtaining a copy of the font software
mit | hereby | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
zlib | warranty | this software is provided ['`"]?as[- ]is['`"]?, without any express or implied warranty\. in no event will the authors be held liable
apache-2.0 | apache | apache license version 2\.0, january 2004
apache-2.0 | apache | licensed under the apache license, version 2\.0 \(the ['`"]*license['`"]*\); you may not use this file except in compliance with the license
apache-1.1 | apache | this product includes software developed by the apache software foundation
gpl-2.0 | gnu | under the terms of the gnu general public license as published by the free software foundation[;,] either version 2(?: of the license)?
gpl-3.0 | gnu | under the terms of the gnu general public license as published by the free software foundation[;,] either version 3(?: of the license)?
gpl-2.0 | gnu | gnu general public license,? version 2, june 1991
gpl-3.0 | gnu | gnu general public license,? version 3, 29 june 2007
gpl | gnu | under the terms of the gnu general public license as published by the free software foundation
lgpl-2.0 | gnu | under the terms of the gnu library general public license as published by the free software foundation[;,] either version 2(?: of the license)?(?!\.)
lgpl-2.1 | gnu | under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 2\.1(?: of the license)?
lgpl-3.0 | gnu | under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 3(?: of the license)?
lgpl-2.1 | gnu | gnu lesser general public license,? version 2\.1, february 1999
lgpl-3.0 | gnu | gnu lesser general public license,? version 3, 29 june 2007
agpl-3.0 | gnu | under the terms of the gnu affero general public license as published by the free software foundation[;,] either version 3(?: of the license)?
agpl-3.0 | gnu | gnu affero general public license,? version 3, 19 november 2007
gfdl-1.2 | gnu | under the terms of the gnu free documentation license, version 1\.2
gfdl-1.3 | gnu | under the terms of the gnu free documentation license, version 1\.3
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1\.1
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license, v\. 2\.0
epl-1.0 | eclipse | made available under the terms of the eclipse public license v1\.0
epl-2.0 | eclipse | made available under the terms of the eclipse public license (?:v\. ?)?2\.0
cddl-1.0 | license | the contents of this file are subject to the terms of the common development and distribution license
eupl-1.2 | eupl | licensed under the eupl,? version 1\.2
unlicense | unencumbered | this is free and unencumbered software released into the public domain
cc0-1.0 | waived | has waived all copyright and related or neighboring rights
wtfpl | verbatim | everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed
artistic-1.0 | artistic | the intent of this document is to state the conditions under which a package may be copied, such that the copyright holder maintains some semblance of artistic control
artistic-2.0 | redistributed | this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed
python-2.0 | license | this license agreement is between the python software foundation
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ms-pl | license | this license governs use of the accompanying software\. if you use the software, you accept this license
""".strip()  # noqa: E501

_GRANT = r"(?:(?:re)?licen[sc]ed|released|distributed|available|provided|published|redistribut\w+)(?: only)? under"
_TERMS = r"(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the)?(?: version \d(?:\.\d)? of the)?"


class Rule(NamedTuple):
    label: str
    keywords: tuple[bytes, ...]
    priority: int
    score: float
    pattern: re.Pattern


def _spaced(pattern: str) -> str:
    """A blank of a pattern is any white space of the text, ``[- ]`` a hyphen or white space."""
    blank = r"[\x09-\x0d\x20]"
    return (
        pattern.replace("[- ]", "\0").replace(" ?", f"{blank}*").replace(" ", f"{blank}+").replace("\0", f"(?:-|{blank}+)")
    )


def _body(wording: str) -> re.Pattern:
    """A blank in the wording of a license is white space or the marks of comment lines, which hold the
    hyphen of ``[- ]``."""
    return re.compile(wording.replace("[- ]", " ").replace(" ?", "\0?").replace(" ", "\0").replace("\0?", r"[\s*#/;>|%-]*").replace("\0", r"[\s*#/;>|%-]+").encode(), re.S)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """Every license in every form, in order of priority."""
    out = []
    for line in LICENSES.splitlines():
        label, spdx, keyword, name, url = (x.strip() for x in line.split(" | "))
        forms = [
            (100, 1.0, "spdx-license-identifier", rf"spdx-license-identifier: ?{spdx}(?![0-9a-z.+-])"),
            (80, 0.95, "under", rf"\b{_GRANT}{_TERMS} (?:an? |the )?{name}(?![0-9a-z]|\.[0-9])"),
            (70, 0.9, "licen", rf"\blicen[sc]e: ?(?:the )?(?:{name}|{spdx})(?![0-9a-z]|[.-][0-9a-z])"),
            (50, 0.6, keyword, rf"(?<![0-9a-z])(?:{name})(?![0-9a-z]|\.[0-9])"),
        ]
        if url != "-":
            forms.append((90, 0.98, "://", rf"https?://(?:www\.)?{url}(?![0-9])"))
        # of a license and its versions, the one named more exactly goes first
        exact = 5 * bool(re.search(r"\d$", label))
        out += [
            Rule(label, tuple(k.encode().split(b"/") if p == 50 else [k.encode()]), p + exact, s, re.compile(_spaced(x).encode()))
            for p, s, k, x in forms
        ]
    # above grants, addresses and 'all rights reserved'
    for line in BODIES.splitlines():
        label, keyword, wording = line.split(" | ")
        exact = bool(re.search(r"\d|clause", label))
        out.append(Rule(label, (keyword.encode(),), 96 + exact, 0.97, _body(wording)))
    return tuple(sorted(out, key=lambda r: -r.priority))


def detections(low: bytes) -> list[tuple[int, int, str, float]]:
    """Start, end, label and score of what the rules find in a lower-cased text and don't suppress."""
    present: dict[bytes, bool] = {}
    found = []
    for order, rule in enumerate(rules()):
        for word in rule.keywords:
            if word not in present:
                present[word] = word in low
        if any(present[word] for word in rule.keywords):
            found += [
                (-rule.priority, m.start(), m.start() - m.end(), order, m.end(), rule)
                for m in rule.pattern.finditer(low)
            ]
    # of the intervals taken, those that lie in no other one: their starts and ends both rise
    starts: list[int] = []
    ends: list[int] = []
    taken: list[tuple[int, int, str, float]] = []
    for _, start, _, _, end, rule in sorted(found, key=lambda x: x[:4]):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        taken.append((start, end, rule.label, rule.score))
        at = bisect_left(starts, start)
        inside = bisect_right(ends, end)  # those from ``at`` on that end here at the latest lie in this one
        starts[at : max(at, inside)] = [start]
        ends[at : max(at, inside)] = [end]
    return sorted(taken)


_WORD = rb"[0-9a-z\x80-\xff]"
_GAP = rb"[^0-9a-z\x80-\xff]+"
_PHRASES = [
    (label, re.compile(rb"(?<!" + _WORD + rb")" + _GAP.join(w.encode() for w in phrase.split()) + rb"(?!" + _WORD + rb")"))
    for phrase, label in PHRASES.items()
]
_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True
#: Every rule and phrase holds one of these, a blank being any white space; texts without any are only counted.
_ANY = re.compile(
    rb"licen|gpl|bsd|cc0|cc(?:-|[ \t-\r]+)by|creative|mpl|epl|cddl|eupl|psf|odbl|pddl|wtfpl|public[ \t-\r]+domain|"
    rb"all[ \t-\r]+rights|proprietary|://|affero|"
    + b"|".join(sorted({re.escape(line.split(" | ")[1].encode()) for line in BODIES.splitlines()}))
)


def scan(text: str | None) -> dict:
    """What a text says about its license; see ``license_scan``."""
    low = (text or "").encode("utf-8", "replace").lower()  # bytes.lower() changes A-Z only
    inside = _IS_WORD[np.frombuffer(low, np.uint8)]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    out = {"n_words": int(opens.sum()), "n_base": 0, "first_word": None, "last_word": None}
    base, method, score = set(), [], 0.0
    if _ANY.search(low):
        places = []
        for label, pattern in _PHRASES:
            at = [m.start() for m in pattern.finditer(low)]
            places += at
            if at:
                base.add(label)
        if places:
            out["n_base"] = len(places)
            out["first_word"] = int(opens[: min(places)].sum())
            out["last_word"] = int(opens[: max(places)].sum())
        method = detections(low)
        score = max([0.5 * bool(base), *(s for _, _, _, s in method)])
    out["base_labels"] = ",".join(sorted(base))
    out["labels"] = ",".join(sorted(base | {label for _, _, label, _ in method}))
    out["score"] = score
    out["spans"] = [{"start": a, "end": b, "label": label} for a, b, label, _ in method]
    return out


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
     ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])))]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scan(x.as_py()) for x in batch.column(1)]
        columns = [batch.column(0)] + [pa.array([f[n] for f in found], t) for n, t in zip(_SCHEMA.names[1:], _SCHEMA.types[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def license_scan(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (``doc_id`` and ``text`` are read): ``n_words``; ``n_base``,
    ``first_word``, ``last_word`` (places of the base phrases, as words from 0; null without any);
    ``base_labels``; ``labels`` (with those of the rules; both distinct, sorted, comma-joined); ``score``
    (0 without any, to 1 for an SPDX tag); ``spans`` of the rules' detections (bytes of the text in
    UTF-8). Null is empty; rows given twice give two rows; an empty table gives none.
    """
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    return rows.mapInArrow(
        _scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<start: long, end: long, label: string>>",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scan": op4_license_scan}
SQL: dict[str, str] = {}
