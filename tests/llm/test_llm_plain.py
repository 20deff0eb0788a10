"""Each operator that SQL can't express against a plain version of it."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from llm_cases import near_groups, odd_docs, shingle_set, template_hits
from pyspark.sql import functions as F

from portmesh.llm import chunk_dedup, html_blocks, jaccard_join, licenses, mixing, templates, token_shards, wavelet, word_pieces
from portmesh.llm.common import stored, table, word_hashes

FOLDER = "/root/testdata/sf0.001"


def read(name, columns, folder=FOLDER):
    return duckdb.sql(f"select {columns} from '{folder}/{name}.parquet'").fetchall()


# 1 ------------------------------------------------------------------------------------------------------


def greedy(word, known):
    n = i = 0
    while i < len(word):
        j = len(word)
        while tuple(word[i:j]) not in known:
            j -= 1
        i, n = j, n + 1
    return n


def test_word_pieces(spark):
    path = word_pieces.default_vocabulary()
    known = set(word_pieces.vocabulary(path))
    got = {r.doc_id: r for r in word_pieces.op1_word_pieces(spark, FOLDER).collect()}
    for doc_id, text in read("documents", "doc_id, text"):
        each = [greedy(word_pieces.symbols(w.encode()), known) for w in word_pieces.words(text)]
        r = got[doc_id]
        assert (r.n_words, r.n_pieces, r.longest_word) == (len(each), sum(each), max(each, default=0))


def test_automaton_on_random_vocabularies():
    rng = random.Random(7)
    for _ in range(200):
        pieces = {(s,) for s in range(512)}
        pieces |= {tuple(rng.choice((97, 98, 99)) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(0, 12))}
        auto = word_pieces.Automaton(sorted(pieces))
        for _ in range(30):
            word = [rng.choice((97, 98, 99)) for _ in range(rng.randint(0, 14))]
            assert auto.count(word) == greedy(word, pieces)


def test_automaton_needs_single_symbols():
    with pytest.raises(ValueError, match="no piece"):
        word_pieces.Automaton([(97,)])


# 4 ------------------------------------------------------------------------------------------------------


def base_places(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), found


def test_license_base(spark):
    extra = [
        "MIT\n license mit-license xmit license MIT LICENSEs Mit.license", "the apache  license, GENERAL public\tlicense",
        "émit license", "general public license general public license", None, "",
    ]
    rows = read("documents", "doc_id, text") + [(10**6 + i, t) for i, t in enumerate(extra)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = 0
    for doc_id, text in rows:
        n, found = base_places(text)
        r = got[doc_id]
        places = [i for i, _ in found]
        base = sorted({label for _, label in found})
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(base)
        assert set(base) <= set(r.labels.split(",")) or not base
        assert 0 <= r.score <= 1
        hits += bool(places)
    assert hits > 3


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0", 1.0),
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0", 0.95),
        ("distributed under the terms of the GNU Lesser General Public\nLicense, version 2.1", "gpl,lgpl-2.1", 0.95),
        ("released under CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0", 0.95),
        ("see https://creativecommons.org/licenses/by/4.0/", "cc-by-4.0", 0.98),
        ("code: MPL 2.0; docs: EPL-2.0", "epl-2.0,mpl-2.0", 0.6),
        ("the mitigation licensee", "", 0.0),
    ],
)
def test_license_rules(text, labels, score):
    found = licenses.scan(text)
    assert (found["labels"], found["score"]) == (labels, score)


BSD = """Copyright (c) 2001 A. Author. All rights reserved.
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright notice.
 * 2. Redistributions in binary form must reproduce the above copyright notice."""


@pytest.mark.parametrize(
    ("text", "label"),
    [
        (BSD, "bsd-2-clause"),
        (BSD + "\n * 3. The name may not be used to endorse or promote products derived from it.", "bsd-3-clause"),
        ("# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that the above\n"
         "# copyright notice and this permission notice appear in all copies.", "isc"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files", "mit"),
        ("under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License", "gpl-2.0"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("put  into\nthe  public \t domain", "public-domain"),
        ("text of cc  by 4.0", "cc-by-4.0"),
    ],
)
def test_license_bodies(text, label):
    found = licenses.scan(text)
    assert label in found["labels"].split(",")
    if label not in ("public-domain", "cc-by-4.0"):
        assert found["score"] == 0.97
    assert max(found["spans"], key=lambda s: s["end"] - s["start"])["label"] == label


#: A text for each of the wordings of ``licenses.BODIES``, in their order, written out by hand.
BODY_TEXTS = """
bsd-4-clause | Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. keep the notice. 3. All advertising materials mentioning features or use of this software must display the acknowledgement.
bsd-3-clause | Redistribution and use in source and binary forms, with or without modification, are permitted (subject to the limitations in the disclaimer below) provided that the following conditions are met: neither name may be used to endorse or promote products derived from this software.
bsd-2-clause | Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 2. Redistributions in binary form must reproduce the above notice.
bsd | Redistribution and use in source and binary forms is granted.
bsd | Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.
bsd-0-clause | Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
isc | Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
postgresql | Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
boost-1.0 | Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
ofl-1.1 | Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software
mit | Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
zlib | This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
apache-2.0 | Apache License Version 2.0, January 2004
apache-2.0 | Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
apache-1.1 | This product includes software developed by the Apache Software Foundation
gpl-2.0 | under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License
gpl-3.0 | under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License
gpl-2.0 | GNU GENERAL PUBLIC LICENSE Version 2, June 1991
gpl-3.0 | GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
gpl | under the terms of the GNU General Public License as published by the Free Software Foundation.
lgpl-2.0 | under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License
lgpl-2.1 | under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License
lgpl-3.0 | under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License
lgpl-2.1 | GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999
lgpl-3.0 | GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007
agpl-3.0 | under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License
agpl-3.0 | GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007
gfdl-1.2 | under the terms of the GNU Free Documentation License, Version 1.2
gfdl-1.3 | under the terms of the GNU Free Documentation License, Version 1.3
mpl-1.1 | The contents of this file are subject to the Mozilla Public License Version 1.1
mpl-2.0 | This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
epl-1.0 | made available under the terms of the Eclipse Public License v1.0
epl-2.0 | made available under the terms of the Eclipse Public License v. 2.0
cddl-1.0 | The contents of this file are subject to the terms of the Common Development and Distribution License
eupl-1.2 | Licensed under the EUPL, version 1.2
unlicense | This is free and unencumbered software released into the public domain.
cc0-1.0 | the person has waived all copyright and related or neighboring rights
wtfpl | Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
artistic-1.0 | The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control
artistic-2.0 | This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.
python-2.0 | This LICENSE AGREEMENT is between the Python Software Foundation
openssl | This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit
ms-pl | This license governs use of the accompanying software. If you use the software, you accept this license.
""".strip()  # noqa: E501


def test_every_body_is_found_behind_its_keyword():
    texts = [tuple(line.split(" | ")) for line in BODY_TEXTS.splitlines()]
    assert [label for label, _ in texts] == [line.split(" | ")[0] for line in licenses.BODIES.splitlines()]
    for label, text in texts:
        assert label in licenses.scan(text)["labels"].split(","), (label, text)


def test_license_rules_are_hundreds_and_priorities_hold():
    assert len(licenses.rules()) > 200
    spans = [(a, b) for a, b, _, _ in licenses.detections(b"licensed under the gnu general public license, version 3.0")]
    assert len(spans) == 1


def test_suppression_equals_all_pairs():
    names = [line.split(" | ")[1] for line in BODY_TEXTS.splitlines()] + ["MIT License", "GPL-3.0", "apache license, version 2.0", "x", "cc by-sa 4.0"]
    rng = random.Random(3)
    for _ in range(150):
        low = " ".join(rng.choices(names, k=rng.randint(1, 25))).encode().lower()
        found = sorted(
            (-rule.priority, m.start(), m.start() - m.end(), order, m.end(), rule.label, rule.score)
            for order, rule in enumerate(licenses.rules()) if any(k in low for k in rule.keywords) for m in rule.pattern.finditer(low)
        )
        taken = []
        for _, start, _, _, end, label, score in found:
            if not any(a <= start and end <= b for a, b, _, _ in taken):
                taken.append((start, end, label, score))
        assert licenses.detections(low) == sorted(taken)


# 6 ------------------------------------------------------------------------------------------------------


def plain_chunks(text):
    """Word tuples of the chunks, by the rule as the docstring says it."""
    low = (text or "").lower()
    found = list(re.finditer(r"[^\x20\x09-\x0d]+", low))
    numbers = [int(chunk_dedup.mix(word_hashes(m[0].encode())[0] + chunk_dedup._ODD)[0]) for m in found]
    out, chunk, h = [], [], 0
    for i, m in enumerate(found):
        h = (h << 1) + numbers[i]
        chunk.append(m[0])
        if h % chunk_dedup.SPACE < chunk_dedup.CUTS or i + 1 == len(found) or len(chunk) == chunk_dedup.LONGEST:
            out.append(tuple(chunk))
            chunk = []
    return out


def plain_passages(rows, least=chunk_dedup.LEAST_WORDS):
    first, stretches, out = {}, {}, set()
    for d, t in sorted(set(rows)):
        chunks, stretches[d, t] = plain_chunks(t), []
        for no in range(len(chunks)):
            upto, n = no, 0
            while upto < len(chunks) and n < least:
                n += len(chunks[upto])
                upto += 1
            if n >= least:
                at = sum(len(c) for c in chunks[:no])
                stretch = tuple(chunks[no:upto])
                first.setdefault(stretch, (d, t, no))
                stretches[d, t].append((no, upto, at, at + n, stretch))
    for (d, t), found in stretches.items():
        passages = []
        for no, upto, start, end, stretch in found:
            if first[stretch] == (d, t, no):
                continue
            one = first[stretch][0]
            if passages and start <= passages[-1][3]:
                passages[-1][1], passages[-1][3], passages[-1][4] = upto, end, min(one, passages[-1][4])
            else:
                passages.append([no, upto, start, end, one])
        out |= {(d, start, end - start, upto - no, one) for no, upto, start, end, one in passages}
    return out


def test_chunks_follow_the_rule():
    rng = random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice(["alpha ", "be ", "gam\n", "Delta\t", "é "]) for _ in range(rng.randint(0, 300)))
        bounds, one, two = chunk_dedup.chunks_of(text)
        assert np.diff(bounds).tolist() == [len(c) for c in plain_chunks(text)]
        assert len(one) == len(two) == len(bounds) - 1


def test_repeated_passages(spark):
    rows = read("documents", "doc_id, text")
    got = chunk_dedup.op6_chunk_dedup(spark, FOLDER).collect()
    # of places that tie in doc_id none are here: ids are distinct
    assert {(r.doc_id, r.start_word, r.n_words, r.n_chunks, r.first_doc_id) for r in got} == plain_passages(rows)
    assert got


def test_passages_of_over_fifty_words_are_found_and_cut(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    fill = lambda n: " ".join(word() for _ in range(n))
    passages = [fill(rng.randint(51, 80)) for _ in range(60)]
    rows = [(i, f"{fill(40)} {p} {fill(40)}") for i, p in enumerate(passages * 2)]
    rows += [(1000 + i, fill(100)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = stored(chunk_dedup.repeated_passages(docs), "found")
    got = {r.doc_id: r.first_doc_id for r in found.collect()}
    assert len(got) >= 59 and all(d - first == 60 for d, first in got.items())
    cut = {r.doc_id: r.text for r in chunk_dedup.without_passages(docs, found).collect()}
    for d, text in rows:
        if d not in got:
            assert cut[d] == text
        else:
            assert len(cut[d].split()) < len(text.split()) - 15 and cut[d].split()[:30] == text.split()[:30]


def wrapped(text, width):
    words = text.split()
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


@pytest.mark.parametrize(("n_words", "width"), [(55, 8), (55, 12), (80, 8), (80, 12)])
def test_passages_with_other_line_breaks_are_found(n_words, width):
    rng = random.Random(n_words + width)
    fill = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    found = 0
    for _ in range(300):
        passage = fill(n_words)
        one = f"{fill(rng.randint(0, 40))} {passage} {fill(30)}"
        two = wrapped(f"{fill(rng.randint(0, 40))} {passage} {fill(30)}", width)
        found += bool(set(chunk_dedup.stretches_of(one)[4]) & set(chunk_dedup.stretches_of(two)[4]))
    assert found >= 290


def test_chunks_of_different_places_make_no_passage(spark):
    rng = random.Random(7)
    fill = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    common = [" ".join(c) for _ in range(40) for c in plain_chunks(fill(60))[1:-1]]
    # each common chunk stands in a text of its own, and many behind one another in the last ones
    rows = [(i, f"{fill(8)} {c} {fill(8)}") for i, c in enumerate(common)]
    rows += [(10_000 + i, " ".join(rng.sample(common, 60))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    windows = Counter()
    for _, text in rows:
        words = text.split()
        windows.update({tuple(words[i : i + 16]) for i in range(len(words) - 15)})
    for r in chunk_dedup.repeated_passages(docs).collect():
        words = dict(rows)[r.doc_id].split()[r.start_word : r.start_word + r.n_words]
        assert windows[tuple(words[:16])] > 1


def test_repeats_within_a_text(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 29}" for i in range(400))), (2, "same " * 300)], "doc_id long, text string")
    found = stored(chunk_dedup.repeated_passages(docs), "found")
    got = {(r.doc_id, r.start_word, r.n_words, r.n_chunks, r.first_doc_id) for r in found.collect()}
    assert got == plain_passages([(r.doc_id, r.text) for r in docs.collect()]) and {x[0] for x in got} == {1, 2}
    assert all(r.text.split() for r in chunk_dedup.without_passages(docs, found).collect())


# 7 ------------------------------------------------------------------------------------------------------


def test_templates(spark):
    got = templates.op7_templates(spark, FOLDER).collect()
    want = template_hits(read("documents", "doc_id, text"), read("benchmark", "item_id, text"), set(templates.UNITS))
    assert sorted((r.doc_id, r.item_id, r.n_windows, r.n_item_windows, r.n_slots) for r in got) == sorted(
        (d, i, *v) for (d, _, i), v in want.items()
    )
    assert got


ITEM = "A farmer has 12 cows and 7 goats, and a neighbour called Tom Smith buys 7 goats for 90 dollars in May."


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        (ITEM, True),
        ("so a farmer has 31 cows and 5 goats, and a neighbour called Ann Lee buys 5 goats for 64 euros in June. End", True),
        (f"Copied in capitals: {ITEM.upper()}", True),
        # 7 goats became 5 in one place and 6 in the other
        ("a farmer has 31 cows and 5 goats, and a neighbour called Ann buys 6 goats for 64 euros in June", False),
        ("a farmer has 12 cows and some sheep, which he feeds every day", False),
    ],
)
def test_template_slots(spark, text, hit):
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [r.item_id for r in templates.contaminated(docs, items).collect()] == [1] * hit
    assert templates.decontaminate(docs, items).count() == 1 - hit


PERCENT = "What is 15% of 240 plus 36?"
DENSE = "1 2 4 8 16 32 64 128 256 512 1024 2048 4096 what is next"
CLIPS = "Natalia sold clips to 48 friends. Natalia then sold 24 more."


@pytest.mark.parametrize(
    ("item", "text", "hit"),
    [
        (PERCENT, f"Question one. {PERCENT} Answer: 72", True),
        (PERCENT, "What is 10% of 240 plus 36?", False),
        (DENSE, f"The row {DENSE}", True),
        (DENSE, DENSE.replace(" ", "1 "), False),
        (CLIPS, "Weng sold clips to 31 friends. Weng then sold 17 more.", True),
        (CLIPS, "So Weng sold clips to 31 friends. Weng then sold 17 more.", True),
        # another person
        (CLIPS, "Weng sold clips to 31 friends. Paula then sold 17 more.", False),
    ],
)
def test_templates_of_few_plain_words_and_of_names_that_open(spark, item, text, hit):
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for most in (1000, 0):
        assert [r.item_id for r in templates.contaminated(docs, items, most).collect()] == [1] * hit


def test_templates_without_broadcast(spark):
    docs, items = table(spark, FOLDER, "documents"), table(spark, FOLDER, "benchmark")
    key = lambda df: sorted((r.doc_id, r.item_id, r.n_windows) for r in df.collect())
    assert key(templates.contaminated(docs, items, most_broadcast=3)) == key(templates.contaminated(docs, items))


def test_short_items_are_found_as_they_stand(spark):
    docs = spark.createDataFrame(
        [(1, "Well, compute 12 * 7 now"), (2, "Compute 12 * 8"), (3, "What is 3 + 4? I ask"), (4, "Tuesday"), (5, ""), (6, None)],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, "Compute 12 * 7"), (2, "What is 3 + 4?"), (3, "tuesday"), (4, ""), (5, "?!"), (6, None)], "item_id long, text string")
    got = templates.contaminated(docs, items).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (3, 2), (4, 3)]


# 8 ------------------------------------------------------------------------------------------------------

LONG = "the river runs from the hills to the sea and it is said that the town was built on the bank of it in the year of the flood. "
PAGES = [
    (None, ""),
    ("", ""),
    ("<p>just a line", "just a line"),
    (
        f"<nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>{LONG}<p>A  short\n one.<br>Next"
        "<ul><li>first<li>second</ul><div class='ad'>Buy</div><p>a&lt;b&gt;c &copy;</article><footer>&copy; me</footer>",
        f"Title & more\n{LONG.strip()}\nA short one. Next\nfirst\nsecond\na<b>c ©",
    ),
    (
        f"<div id=menu><a>Home</a><a>Shop</a></div><div><h2>Heading</h2><p>{LONG * 3}</p><p>Short.</p><p>{LONG * 2}</p></div>"
        f"<div class='comment-list'><p>{LONG * 2}</p></div><aside>{LONG * 3}</aside><script>if (a < b) {{}}</script>",
        f"Heading\n{(LONG * 3).strip()}\nShort.\n{(LONG * 2).strip()}",
    ),
    (f"<main><p>{LONG}</p><form><p>{LONG}</p></form><section class=related><p>{LONG}</p></section>", LONG.strip()),
    ("<article><p>x < y and a <b>bold</b><i>it</i></p><!-- not <p>this --><style>p{}</style>&nbsp;z</article>", "x < y and a boldit\nz"),
    ("<article><p>cut off in a tag</p><div clas", "cut off in a tag"),
    (
        f"<title>Site</title><div class='site-header'><h1>Site</h1></div><div class='layout sidebar-left'><div id=sideBar><p>{LONG}</p></div>"
        f"<article class='post has-sidebar'><header><h1>News</h1></header><p>{LONG}<div class=ad-slot>{LONG}</div><p title='x>Odd</p></article>"
        f"<div id=userComments><article><p>{LONG}</p></article></div></div><div class='cookieNotice'>{LONG}</div>",
        f"News\n{LONG.strip()}\nOdd",  # a quote that doesn't end is not taken as one
    ),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    assert html_blocks.main_text(page) == text


TEASER = "<article><p>Read more of what the others have to say about it, and of what is new in the town.</p></article>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<p>{LONG * 2}one <svg class="i"/> two</p><p>{LONG * 2}</p>', f"{LONG * 2}one two\n{(LONG * 2).strip()}"),
        (f"<p>{LONG * 2}<math/>end</p><p>{LONG * 2}<svg><text>no</text></svg></p>", f"{LONG * 2}end\n{(LONG * 2).strip()}"),
        (f"<svg-icon></svg-icon><p>{LONG * 2}</p><template-x><p>{LONG * 2}</p>", "\n".join([(LONG * 2).strip()] * 2)),
        (f"<div><svg><path d=x><p>{LONG * 2}</p></div>", (LONG * 2).strip()),
        (f"<html><head><title>Site</title><meta charset=x><body><p>{LONG * 2}</p>", (LONG * 2).strip()),
        (f"<html><head><title>Site</title><p>{LONG * 2}</p>", (LONG * 2).strip()),
        (f"<html><head><title>Site</title>{LONG * 2}<p>{LONG * 2}</p>", "\n".join([(LONG * 2).strip()] * 2)),
        (f"<head><title>Site</title></head><aside>{TEASER}</aside><div><p>{LONG * 2}</p></div>", (LONG * 2).strip()),
        (f"<nav>{TEASER}</nav><main><p>{LONG * 2}</p></main>", (LONG * 2).strip()),
        (f"<div><p>{LONG * 4}</p></div><div class=teaser>{TEASER}</div>", (LONG * 4).strip()),
        # nothing else than an article in an aside
        (f"<aside><article><p>{LONG}</p></article></aside>", LONG.strip()),
    ],
)
def test_pages_keep_what_follows(page, text):
    got = html_blocks.main_text(page)
    if "class=teaser" in page:
        assert text in got.split("\n")  # an article of little text doesn't make the page's text go
    else:
        assert got == text


def test_extract(spark):
    rows = read("pages", "page_id, url, html")
    got = {r.page_id: r for r in html_blocks.op8_html_blocks(spark, FOLDER).collect()}
    import html

    for page_id, url, page in rows:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", body)))
        want = "\n".join(" ".join(html.unescape(x).split()) for x in body.split("\0") if x.strip())
        r = got[page_id]
        assert (r.url, r.text, r.n_chars) == (url, want, len(want))


TEXT = (LONG * 2).strip()
RUSSIAN = ("Река течёт с холмов к морю, и говорят, что город был построен на её берегу в год наводнения. " * 3).strip()
CHINESE = "这条河从山上流到海里，据说这座城市是在洪水那一年建在河岸上的。" * 4
MARK = "The mark \xa9 was used by the town in the year of the flood and it is said that it is on the wall of the hall."


@pytest.mark.parametrize(
    "opening",
    ['div class="content overflow-hidden"', 'article class="post overflow-hidden"', 'div title="the hidden city"',
     'article title="the hidden city"', 'div class="elementor-widget-container"', 'div class="widget-text"',
     'article class="widget-text"', 'div id="privacy-policy"', 'div class="market-share-report"',
     'div class="layout sidebar-right"', 'div class="comments-on-policy"', 'div class=hidden-gems', "div data-hidden=1"],
)
def test_names_of_containers_that_hold_the_text(opening):
    end = opening.split()[0]
    assert html_blocks.main_text(f"<{opening}><p>{TEXT}</p></{end}>") == TEXT
    many = f"<{opening}><p>{TEXT}</p></{end}>" * 3 if end == "div" else ""
    assert not many or html_blocks.main_text(f"<p>{TEXT}</p>{many}") == "\n".join([TEXT] * 4)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><fieldset><p>{TEXT}</p></fieldset></article>", [TEXT]),
        (f'<article><p>{TEXT}</p><section id="related-work"><p>{TEXT}</p></section></article>', [TEXT] * 2),
        (f"<article><p>{TEXT}</p><p><a href=x>{TEXT}</a></p><p>{TEXT}</p></article>", [TEXT] * 3),
        (f"<p>{TEXT}</p><p>{MARK}</p><p>{TEXT}</p>", [TEXT, MARK, TEXT]),
        (f"<p>{TEXT}</p><p>\xa9 2020 The Town. All rights reserved.</p>", [TEXT]),
        (f"<ul><li><a>один</a><li><a>два</a></ul><p>{RUSSIAN}</p><ul><li><a>три</a></ul>", [RUSSIAN]),
        (f"<ul><li><a>一</a><li><a>二</a></ul><p>{CHINESE}</p><ul><li><a>三</a></ul>", [CHINESE]),
        # what isn't the article's
        (f'<article><p>{LONG}<span class="ad-label">Advert</span></p><p><span hidden>no</span>{TEXT}</p></article>', [LONG.strip(), TEXT]),
        (f'<article><p>{LONG}<span hidden><b>a <span>b</span> c</b></span>end</p></article>', [f"{LONG}end"]),
        (f'<article><p>{TEXT}</p><div style="display: none"><p>{TEXT}</p></div><p hidden=until-found>{TEXT}</p></article>', [TEXT] * 2),
        (f'<article><p>{TEXT}</p><div class="comment-list"><p>{LONG * 9}</p></div></article>', [TEXT]),
        (f'<article><p>{TEXT}</p><div class="related-posts"><p>{LONG}</p><a>one</a></div><div class="newsletter-box"><p>{TEXT}</p></div></article>', [TEXT]),
        (f'<div class=post><p>{TEXT}</p></div><div id="user-comments"><p>{LONG * 9}</p></div><div class="site-sidebar"><p>{TEXT}</p></div>', [TEXT]),
        (f'<div class="layout sidebar-right"><p>{TEXT}</p><div class="sidebar-box"><p>{TEXT}</p></div></div>', [TEXT]),
        (f'<div class="has-sidebar"><p>{TEXT}</p></div><div class="sidebar"><p>{LONG * 9}</p></div>', [TEXT]),
    ],
)
def test_names_and_attributes(page, text):
    assert html_blocks.main_text(page) == "\n".join(text)


def test_given_pages_without_article_elements_and_names():
    lost = more = n = 0
    for _, page in read("pages", "page_id, html", "/root/testdata/sf0.01"):
        plain = re.sub(r"<(/?)article\b[^>]*>", r"<\1div>", page)
        want = html_blocks.main_text(page)
        assert html_blocks.main_text(plain) == want
        # nothing but the two passes can tell menus, footers and adverts from the text
        bare = re.sub(r"<(/?)(?:nav|aside|header|footer)\b[^>]*>", r"<\1div>", plain)
        bare = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|[^\s>]+)", "", bare)
        has, got = Counter(want.split("\n")), Counter(html_blocks.main_text(bare).split("\n"))
        n += len(want)
        lost += sum(len(x) * k for x, k in (has - got).items())
        more += sum(len(x) * k for x, k in (got - has).items())
    assert lost < 0.03 * n and more < 0.01 * n


# 9 ------------------------------------------------------------------------------------------------------


def test_jaccard_join(spark):
    rows = sorted(read("documents", "doc_id, text"))
    links, groups = near_groups(rows)
    got = {r.doc_id: r for r in jaccard_join.op9_jaccard_join(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, _) in enumerate(rows):
        assert (got[doc_id].class_id, got[doc_id].n_links) == (rows[groups[i]][0], links[i])
    assert sum(links.values()) > 0


def edited(words, share, rng):
    return [w if rng.random() > share else f"new{rng.random()}" for w in words]


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 20_000)
    rng = random.Random(5)
    base = [f"word{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = [(i, " ".join(edited(base, rng.choice([0, 0.01, 0.02, 0.04]), rng))) for i in range(160)]
    rows += [(500 + i, rows[i][1].upper()) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id: r for r in jaccard_join.near_duplicates(docs).collect()}
    links, groups = near_groups(rows)
    assert [near[d].n_links for d, _ in rows] == [links[i] for i in range(len(rows))]
    assert len({near[d].group for d, _ in rows}) == len(set(groups))
    assert jaccard_join.one_of_each(docs).count() == len(set(groups))


def test_pruning_keeps_what_reaches_the_threshold():
    need = jaccard_join.least_matches(0.8, 1e-6)
    assert need == sorted(need) and all(n < 16 * (i + 1) * 0.8 for i, n in enumerate(need))
    rng = np.random.default_rng(1)
    lost = 0
    for _ in range(300):
        pool = rng.integers(0, 2**63, 180, dtype=np.uint64)
        a, b = pool[:162], pool[18:]  # 144 of 180 shared
        same = jaccard_join.minhash(a, 128, 2) == jaccard_join.minhash(b, 128, 2)
        lost += any(same[: 16 * (i + 1)].sum() < n for i, n in enumerate(need))
    assert lost == 0


def test_shingles_match_words():
    for text in ("", "a", "a b c d", "a b c d e", "A  b\nc d e f g a b c d e"):
        assert len(jaccard_join.shingles(text)) == len(shingle_set(text))


# 10 -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 1000, wavelet.BLOCK + 13])
def test_wavelet(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 300, n) * rng.integers(0, 3, n)).astype(np.uint32)
    shard = wavelet.WaveletMatrix(wavelet.write(ids, np.array([4, 0]), np.array([False, True]), np.array([n, 0])))
    assert shard.tokens().tolist() == ids.tolist()
    assert (shard.docs.tolist(), shard.nulls.tolist(), shard.counts.tolist()) == ([4, 0], [False, True], [n, 0])
    for i in rng.integers(0, n, min(n, 40)).tolist():
        token = int(ids[i])
        places = np.flatnonzero(ids == token)
        assert shard.access(i) == token
        assert shard.count(token) == len(places)
        assert shard.rank(token, i) == (places < i).sum()
        k = int(rng.integers(0, len(places)))
        assert shard.select(token, k) == places[k]
    assert shard.count(299 * 2 + 1) == 0 and shard.count(1 << 20) == 0


def test_encoder_agrees_with_the_library():
    encode = token_shards.encoder(token_shards.default_tokenizer())
    assert encode.model is not None
    texts = [t for (t,) in read("documents", "text")] + [
        "", " ", "Don't we'LL 'tis it's\x0b\x0c\r\n x", "a b\x85c", "ÀÉ ẞ İ ΑΣ σς", "<|endoftext|> x<|startoftext|>",
        "é Å", "漢字 🙂 ½ ² 3rd ---,,,", "\x00 \x1c \x7f a\x1fb", "ſ ŉ ǆ",
    ]
    for text in texts:
        want = encode.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode.ids(text), "<u4").tolist() == want, text


def test_token_shards(spark):
    whole = token_shards.encoder(token_shards.default_tokenizer()).whole
    docs = odd_docs(spark)
    folder = token_shards.scratch_folder(spark, "shards")
    files = token_shards.write_shards(docs, token_shards.default_tokenizer(), folder, shard_tokens=5000, range_chars=100_000)
    assert files.count() > 3
    got = token_shards.read_shards(files, folder).orderBy("start").collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    start, pool = 0, [(d, np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")) for d, t in rows]
    for r in got:
        assert r.start == start
        start += r.n_tokens
        i = next(i for i, (d, x) in enumerate(pool) if d == r.doc_id and (len(x), zlib.crc32(x.tobytes())) == (r.n_tokens, r.ids_crc32))
        pool.pop(i)
    assert not pool


# 5 ------------------------------------------------------------------------------------------------------


def plain_schedule(units, slots, stretch):
    """Blocks in order: stretches by the tree's rounding, each earliest deadline first."""
    total = sum(units.values())
    at, before = {}, 0
    for s in sorted(units, key=lambda s: (-units[s].bit_length(), [-int(c) for c in f"{units[s]:b}"[:3]], hashlib.md5(s.encode()).hexdigest()[:15], s)):
        at[s] = ((2 * before + units[s]) << 32) // (2 * total)
        before += units[s]
    weight = Counter()
    for s in units:
        for level in range(33):
            weight[level, at[s] >> (32 - level)] += units[s]
    stretches = defaultdict(list)
    for s in units:
        k = 0
        while True:
            n = k
            for level in range(32, 0, -1):
                node = at[s] >> (32 - level)
                w, whole = weight[level, node], weight[level - 1, node >> 1]
                if w < whole:
                    n = -(-(2 * n + 1) * whole // (2 * w)) - 1 if node % 2 == 0 else (2 * n + 1) * whole // (2 * w)
            if n >= slots:
                break
            stretches[n // stretch].append((-(-(k + 1) * total // units[s]), s, k * total // units[s], k))
            k += 1
    out = []
    for j in sorted(stretches):
        jobs = sorted(stretches[j])
        for i in range(len(jobs)):
            now = [x for x in jobs if x[2] <= j * stretch + i] or [min(jobs, key=lambda x: x[2])]
            jobs.remove(now[0])
            out.append((j * stretch + i, *now[0]))
    return out


@pytest.mark.parametrize(("sources", "slots", "stretch"), [(2, 1024, 256), (20, 1024, 256), (20, 256, 256), (400, 2048, 256), (5000, 8192, 512)])
def test_every_prefix_follows_the_weights(spark, sources, slots, stretch):
    rng = random.Random(sources)
    units = {f"s{i}": 1 + int((rng.random() ** 3 * 1000 + 1) ** 0.7 * 10_000) for i in range(sources)}
    total, want = sum(units.values()), plain_schedule(units, slots, stretch)
    blocks = spark.createDataFrame([(x[2], x[4]) for x in want], "src string, block long")
    weights = spark.createDataFrame(list(units.items()), "src string, units long")
    got = mixing.schedule(blocks, weights, sources, stretch).select("slot", "deadline", "src", "release", "block").collect()
    assert sorted(map(tuple, got)) == want
    assert [x[0] for x in want] == list(range(slots))
    late = sum(not release <= slot < deadline for slot, deadline, _, release, _ in want)
    done, most = dict.fromkeys(units, 0), 0
    for slot, _, s, _, k in want:
        assert k == done[s]
        done[s] += 1
        if slot % 7 == 0:
            most = max(most, max(abs(done[s] - (slot + 1) * u / total) for s, u in units.items()))
    assert late <= slots // 500 and most < (1.15 if late else 1)


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 1.0, "c": 0.3, "d": 2.2, "f": 0.0, "none": 3.0}])
def test_mix_takes_every_document(spark, weights):
    rng = random.Random(2)
    sizes = {"a": 700, "b": 300, "c": 90, "d": 1000, "e": 16, "f": 5}
    rows = [(i, s) for s, n in sizes.items() for i in [rng.random() for _ in range(n)]]
    docs = spark.createDataFrame([(k, s, "x") for k, (_, s) in enumerate(rows)], "doc_id long, source string, text string")
    got = mixing.mixed(docs, weights, block=4, stretch=64).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    blocks = {}
    for r in got:
        assert blocks.setdefault(r.slot, (r.src, r.block)) == (r.src, r.block)
    after = {s for slot, (s, _) in blocks.items() if slot >= mixing.AFTER_ALL}
    assert after == ({"e", "f"} if weights else set())
    share = {s: n**0.7 for s, n in sizes.items()} if weights is None else {s: w for s, w in weights.items() if s in sizes and w}
    last, done = {s: -(-n // 4) for s, n in sizes.items()}, Counter()
    for slot in sorted(blocks):
        done[blocks[slot][0]] += 1
        if any(done[s] == last[s] for s in share):
            break  # a source has run out
        assert all(abs(done[s] - (slot + 1) * w / sum(share.values())) < 1.1 for s, w in share.items())
    assert slot > 50


def test_half_the_slots_for_half_the_weight(spark):
    """Also with many sources, and with as many sources as documents."""
    for n in (19, 399):
        units = {"big": 1 << 20} | {f"s{i}": (1 << 20) // n for i in range(n)}
        order = plain_schedule(units, 1000, 256)
        assert abs(sum(x[2] == "big" for x in order) - 500) <= 1
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.lit("x").alias("text"))
    got = mixing.mixed(docs).select("slot", "place").collect()
    assert sorted(r.slot for r in got) == list(range(3000)) and all(r.place == 0 for r in got)
