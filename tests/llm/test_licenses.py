import re
from dataclasses import replace

from pyspark.sql import functions as F

from tessera.llm import licenses
from tessera.llm.queries import op9_licenses

from .conftest import SF01

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text):
    """The contract's columns by looking at every word and every rule."""
    w = words(text)
    places = [(i, label) for i in range(len(w)) for p, label in PHRASES.items() if tuple(w[i : i + len(p)]) == p]
    starts = [i for i, _ in places]
    body = " " + " ".join(w) + " "
    found = []
    if any(g in body for g in licenses.GATES):
        begins = [0] + [m.end() for m in re.finditer(" ", body)][:-1]
        begins = sorted({m.end() for m in re.finditer(" ", body[:-1])})
        own = [(k, r) for k, r in enumerate(licenses.rules()) if r.keyword in body]
        for n, at in enumerate(begins):
            for k, r in own:
                if (m := re.compile(f"(?:{r.expression})(?= )").match(body, at)):
                    found.append((n, r.priority, -len(m[0]), k, n + m[0].count(" ") + 1, r))
    kept, seen = [], []
    for n, p, _, _, end, r in sorted(found, key=lambda d: d[:4]):
        if not any(q <= p and e >= end for q, e in seen):
            seen.append((p, end))
            kept.append(r)
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(r.label for r in kept)})
    score = max([r.confidence for r in kept] + [0.6 if places else 0.0])
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score)


def rows(df):
    return [tuple(r)[1:8] for r in df.collect()]


def test_query_equals_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op9_licenses(spark, SF01).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:8] == plain(texts[r.doc_id]), texts[r.doc_id][:300]
    assert sum(bool(r.labels) for r in got) > 10


NOTICES = [
    "SPDX-License-Identifier: Apache-2.0 and more", "CC-BY cc by CC BY-NC 4.0", "all rights reserved all rights reserved",
    "Licensed under the MIT License. Released under the GNU General Public License, version 3.", "This is a limit of mitten licence",
    "cc by cc by", "General  Public\nLicense", "The MIT license", "mit", "License: BSD 3-clause", "Copyright (c) 2001-2004 somebody",
    "placed in the public domain", "ALL RIGHTS RESERVED", "cc byte", "Kcc by", "é cc by é licence", "Provided AS IS basis without warranty of any kind",
]


def test_notices_and_odd_texts(spark, odd_docs, no_docs):
    texts = NOTICES + ["x " * 9000 + "licensed under CC BY 4.0 " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(licenses.scan(df)) == [plain(t) for t in texts]
    odd = odd_docs.withColumn("base", F.lit(1)).withColumn("body", F.lit(2))
    assert sorted(map(str, rows(licenses.scan(odd)))) == sorted(str(plain(r.text)) for r in odd.collect())
    assert licenses.scan(no_docs).collect() == []


def test_rules():
    own = licenses.rules()
    assert len(own) > 200 and max(r.priority for r in own) < licenses.N_PRIORITIES
    assert plain("released under the mit license")[5] == "mit"


def test_no_python_in_the_plan(spark):
    plan = op9_licenses(spark, SF01)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Notices in which the words of the old prefilters do not occur, and others.
PLAIN_NOTICES = [
    ("released under the WTFPL", "wtfpl"), ("distributed under CDDL", "cddl-1.0"), ("provided on an as is basis", "as-is"), ("proprietary and confidential", "proprietary"), ("proprietary medicine is sold", ""), ("our own proprietary license", "proprietary"),
    ("may not be reproduced in any form without prior written permission", "no-redistribution"), ("no part of it without the permission", "no-redistribution"),
    ("common development and distribution license", "cddl-1.0"), ("CDDLv1.1", "cddl-1.0"), ("released under the expat license", "mit"), ("Ms-PL", "ms-pl"), ("Microsoft Public License", "ms-pl"),
    ("without warranties of any kind", "no-warranty"), ("published under GNU GPL", "gpl"), ("available under GPLv2", "gpl-2.0"), ("subject to the Apache2.0", "apache-2.0"),
    ("LGPLv3", "lgpl"), ("AGPL3", "agpl"), ("under the MIT/X11 licence", "x11"), ("free under the FreeBSD BSD", "bsd-2-clause"), ("Open Data Commons Open Database Licence 1.0", "odbl-1.0"),
    ("limit of committees", ""), ("mit Freunden im Haus", ""), ("expat, licence of", "mit"), ("as is the case", ""), ("with permission", ""),
]


def test_prefilters_lose_nothing(spark, docs, monkeypatch):
    texts = [t for t, _ in PLAIN_NOTICES] + NOTICES + [t for t, _ in TEXTS] + [r.text for r in docs.orderBy("doc_id").limit(4).collect()]
    got = rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    every = [r if r.beside else replace(r, keyword="") for r in licenses.rules()]
    monkeypatch.setattr(licenses, "GATES", ("",))
    monkeypatch.setattr(licenses, "rules", lambda: every)
    for text, g in zip(texts, got):
        assert g == plain(text), text[:200]
    for (text, label), g in zip(PLAIN_NOTICES, got):
        assert label in g[5].split(","), text


def test_no_match_is_longer_than_what_is_read():
    """The scan reads LONGEST characters from a place on: every rule is narrower."""
    widths = [re._parser.parse(r.expression).getwidth()[1] for r in licenses.rules()]
    assert max(widths) < licenses.LONGEST


# The wording of license texts that need not name their license.
TEXTS = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal", "mit"),
    ("The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.", "mit"),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "no-liability"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that", "isc"),
    ("Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that", "bsd"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived", "bsd-3-clause"),
    ("3. All advertising materials mentioning features or use of this software must display the following acknowledgement:", "bsd-4-clause"),
    ("1. Redistributions of source code must retain the above copyright notice, this list", "retain-notice"),
    ("each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce", "apache-2.0"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", "apache-2.0"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2.0-or-later"),
    ("the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "lgpl-3.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify it", "free-software"),
    ("but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY", "no-warranty"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("The origin of this software must not be misrepresented; you must not claim", "zlib"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative-commons"),
    ("By exercising the Licensed Rights (defined below), You accept and agree to be bound by", "creative-commons"),
    ("for personal and non-commercial use only", "noncommercial"),
]


def test_license_texts_are_known_by_their_wording(spark):
    long = " word " * 300 + " ".join(t for t, _ in TEXTS) + " word" * 300
    texts = [t for t, _ in TEXTS] + [long, long + long]
    got = rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert got == [plain(t) for t in texts]
    for (text, label), g in zip(TEXTS, got):
        assert label in g[5].split(","), text
    assert {label for _, label in TEXTS} <= set(got[-1][5].split(","))
    # the longer notice holds the shorter one, which goes
    assert "gpl-2.0" not in got[10][5].split(",")
