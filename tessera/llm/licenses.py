"""Operator 9: license scan by ordered signature rules, in DataFrame functions.

A text is reduced to its words: A-Z lower-cased, everything between words one
space.  Rules are regular expressions over words.  They come from families
(a label, a keyword and the forms of the license's name) and templates (how a
notice is worded), each with a priority: 0 is the strongest.  A text is
prefiltered by keywords: a rule runs only if its keyword occurs, and no text is
scanned that holds none of them (``GATES``).  Every text that a rule matches
holds its keyword, so the prefilter changes no result.  Bare names that are also
everyday words or names of software (``ALSO_WORDS``; "mit" is German for "with")
are a rule only beside a word of ``CONTEXT`` somewhere in the text.  License texts
that name no license are known by the wording of their grants, conditions and
disclaimers (``CLAUSES``).

All rules that are left look for the places where one of them matches, from left
to right.  At a place every matching rule gives a detection, an interval of
words.  A detection is suppressed if it lies within the interval of a detection
of the same or a stronger priority.  What remains gives the labels and, by the
strongest one, the score.

Base phrases are looked up beside the rules, and their labels always stay.

Everything is one projection over the rows: no shuffle, no join, no Python.
A detection is held in a state whose size depends on the rules, not on the text,
so that a text of any length with any number of notices is scanned in one go.

Defined results: null, empty and wordless texts have no words, no places (first
and last null) and score 0; repeated rows get equal results; an empty table gives
an empty result; columns beside the id and the text are not read, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 400  # characters; no rule's match is longer

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_V = r"(?: (?:version|v) ?)?"
# label, keyword that every form holds (with the spaces around its words), forms of the name
FAMILIES = (
    ("mit", " mit ", r"mit"),
    ("mit", " expat ", r"expat"),
    ("x11", " x11 ", r"x11|mit x11"),
    ("isc", " isc ", r"isc"),
    ("apache-1.1", " apache", rf"apache(?: software)?(?: license)?{_V} ?1 1"),
    ("apache-2.0", " apache", rf"apache(?: software)?(?: licen[sc]e)?{_V} ?2(?: 0)?"),
    ("bsd-2-clause", " bsd ", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause|bsd two clause"),
    ("bsd-3-clause", " bsd ", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause|bsd three clause"),
    ("bsd-4-clause", " bsd ", r"(?:original|4 clause|four clause) bsd|bsd 4 clause"),
    ("bsd", " bsd ", r"bsd"),
    ("gpl-1.0", " gpl", r"gpl ?v?1(?: 0)?"),
    ("gpl-2.0", " gpl", r"(?:gnu )?gpl(?: version)? ?v?2(?: 0)?"),
    ("gpl-3.0", " gpl", r"(?:gnu )?gpl(?: version)? ?v?3(?: 0)?"),
    ("gpl-2.0", " general public ", r"(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?: 0)?"),
    ("gpl-3.0", " general public ", r"(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?"),
    ("gpl", " general public ", r"gnu general public"),
    ("gpl", " gpl ", r"gnu gpl"),
    ("lgpl-2.1", " lesser general public ", r"(?:gnu )?lesser general public licen[sc]e(?: (?:version|v) ?2 1)"),
    ("lgpl-3.0", " lesser general public ", r"(?:gnu )?lesser general public licen[sc]e(?: (?:version|v) ?3(?: 0)?)"),
    ("lgpl", " lgpl", r"(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?"),
    ("agpl-3.0", " affero general public ", r"(?:gnu )?affero general public licen[sc]e(?: (?:version|v) ?3(?: 0)?)?"),
    ("agpl", " agpl", r"(?:gnu )?agpl(?: ?v?3(?: 0)?)?"),
    ("mpl-1.1", " mozilla public ", rf"mozilla public licen[sc]e{_V} ?1 1"),
    ("mpl-2.0", " mozilla public ", rf"mozilla public licen[sc]e{_V} ?2(?: 0)?"),
    ("epl-1.0", " eclipse public ", rf"eclipse public licen[sc]e{_V} ?1(?: 0)?"),
    ("epl-2.0", " eclipse public ", rf"eclipse public licen[sc]e{_V} ?2(?: 0)?"),
    ("cddl-1.0", " cddl", r"cddl(?: ?v?1(?: [01])?)?"),
    ("cddl-1.0", " common development and distribution ", r"common development and distribution licen[sc]e"),
    ("eupl-1.2", " european union public ", rf"european union public licen[sc]e{_V}(?: 1 [12])?"),
    ("artistic-2.0", " artistic licen", rf"(?:perl )?artistic licen[sc]e{_V}(?: ?[12](?: 0)?)?"),
    ("bsl-1.0", " boost software ", rf"boost software licen[sc]e{_V}(?: 1(?: 0)?)?"),
    ("zlib", " zlib ", r"zlib(?: libpng)?"),
    ("unlicense", " unlicense ", r"(?:the )?unlicense"),
    ("wtfpl", " wtfpl ", r"wtfpl"),
    ("python-2.0", " python ", rf"python(?: software foundation)? licen[sc]e{_V}(?: 2(?: 0)?)?"),
    ("postgresql", " postgresql ", r"postgresql"),
    ("ofl-1.1", " open font ", rf"(?:sil )?open font licen[sc]e{_V}(?: 1 1)?"),
    ("odbl-1.0", " database licen", rf"open (?:data commons )?(?:open )?database licen[sc]e{_V}(?: 1(?: 0)?)?"),
    ("cc0-1.0", " cc0 ", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", " cc by ", r"cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", " cc by ", r"cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc", " cc by ", r"cc by nc(?: [1-4] 0)?"),
    ("cc-by-nd", " cc by ", r"cc by nd(?: [1-4] 0)?"),
    ("cc-by-sa", " cc by ", r"cc by sa(?: [1-4] 0)?"),
    ("cc-by-4.0", " cc by ", r"cc by 4 0"),
    ("cc-by-3.0", " cc by ", r"cc by 3 0"),
    ("creative-commons", " creative commons ", r"creative commons(?: attribution)?(?: (?:non ?commercial|share ?alike|no ?derivatives|no ?derivs)){0,6}(?: [1-4] 0)?(?: international| unported)?"),
    ("ms-pl", " microsoft public ", r"microsoft public"),
    ("ms-pl", " ms pl ", r"ms pl"),
    ("proprietary", " proprietary ", r"proprietary"),
)

BARE = r"{n}"
# priority, confidence, wording, word that the wording holds; {n} is the family's name
TEMPLATES = (
    (0, 1.0, r"spdx licen[sc]e identifier (?:{n})", "spdx licen"),
    (1, 0.95, r"(?:licen[sc]ed|released|distributed|published|provided|available|made available|free) (?:to you )?under(?: the)?(?: terms of)?(?: the)?(?: conditions of the)? (?:{n})(?: licen[sc]e)?", " under "),
    (1, 0.95, r"subject to(?: the)?(?: terms of)?(?: the)? (?:{n})(?: licen[sc]e)?", " subject to "),
    (2, 0.9, r"licen[sc]e (?:{n})|licen[sc]ing terms (?:{n})", "licen"),
    (3, 0.8, r"(?:the )?(?:{n}) licen[sc]e", "licen"),
    (4, 0.5, BARE, ""),
)

ALSO_WORDS = ("mit", "expat", "x11|mit x11", "isc", "bsd", "zlib(?: libpng)?", "postgresql", "proprietary")
CONTEXT = ("licen", "copyright", "copyleft", "rights reserved", "public domain", "cc by", "cc0", "spdx", "general public", "creative commons", "gpl", "without warrant")

# Notices of no one family: label, keyword, priority, confidence, expression.
NOTICES = (
    ("public-domain", " public domain ", 1, 0.9, r"(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain"),
    ("public-domain", " public domain ", 4, 0.5, r"public domain"),
    ("copyright", " copyright ", 3, 0.7, r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
    ("copyright", " copyright ", 4, 0.4, r"copyright (?:notice|holders?|owners?)"),
    ("no-warranty", " without warrant", 2, 0.6, r"without warrant(?:y|ies)(?: or conditions)? of any kind"),
    ("as-is", " as is ", 2, 0.6, r"(?:provided|distributed) (?:on an )?as is(?: basis)?"),
    ("no-redistribution", " permission ", 2, 0.7, r"(?:no part|may not be reproduced)[a-z ]{0,80} without (?:the )?(?:prior )?(?:written )?permission"),
    ("proprietary", " proprietary ", 2, 0.8, r"proprietary and confidential|confidential and proprietary|proprietary (?:software|source code|rights)"),
)

_FSF = r"as published by the free software foundation either version"
_LATER = r"(?: of the licen[sc]e)? or(?: at your option)? any later version"
_ANY = r"[a-z0-9 ]{1,80}"
# Wording of license texts, fixed values: label, words that every match holds, priority, confidence, expression.
CLAUSES = (
    ("mit", " hereby granted free of charge ", 1, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", " this permission notice ", 2, 0.8, r"above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("x11", " except as contained in this notice ", 1, 0.95, rf"except as contained in this notice the names? of {_ANY} shall not be used in advertising"),
    ("ofl-1.1", " hereby granted free of charge ", 1, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("bsl-1.0", " hereby granted free of charge ", 1, 0.95, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", " with or without fee ", 1, 0.95, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", " without a written agreement ", 1, 0.95, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", " redistribution and use ", 1, 0.9, r"redistribution and use(?: of this software)? in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", " to endorse or promote ", 1, 0.95, rf"neither the names? of {_ANY} nor the names of (?:its|their) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", " all advertising materials ", 1, 0.95, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("retain-notice", " must retain the above copyright ", 3, 0.7, r"redistributions? of source code must retain the above copyright notice"),
    ("retain-notice", " must reproduce the above copyright ", 3, 0.7, r"redistributions? in binary form must reproduce the above copyright notice"),
    ("apache-2.0", " no charge royalty free irrevocable ", 1, 0.95, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) licen[sc]e"),
    ("apache-2.0", " agreed to in writing software ", 2, 0.8, r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-1.1", " the end user documentation ", 2, 0.8, r"the end user documentation included with the redistribution if any must include the following acknowledge?ment"),
    ("gpl-2.0-or-later", " any later version ", 0, 1.0, rf"(?:gnu )?general public licen[sc]e {_FSF} 2{_LATER}"),
    ("gpl-3.0-or-later", " any later version ", 0, 1.0, rf"(?:gnu )?general public licen[sc]e {_FSF} 3{_LATER}"),
    ("lgpl-2.1-or-later", " any later version ", 0, 1.0, rf"(?:gnu )?lesser general public licen[sc]e {_FSF} 2 1{_LATER}"),
    ("lgpl-3.0-or-later", " any later version ", 0, 1.0, rf"(?:gnu )?lesser general public licen[sc]e {_FSF} 3{_LATER}"),
    ("agpl-3.0-or-later", " any later version ", 0, 1.0, rf"(?:gnu )?affero general public licen[sc]e {_FSF} 3{_LATER}"),
    ("free-software", " is free software you can redistribute it ", 3, 0.7, r"(?:this )?(?:program|library|software|file|it) is free software you can redistribute it and or modify it"),
    ("no-warranty", " without any warranty ", 2, 0.6, r"without any warranty without even the implied warranty of merchantability"),
    ("no-warranty", " express or implied warrant", 2, 0.6, r"any express or implied warrant(?:y|ies)"),
    ("no-liability", " in no event ", 2, 0.6, rf"in no event (?:shall|will) {_ANY} be (?:held )?liable for any"),
    ("mpl-2.0", " source code form is subject to ", 1, 0.95, r"this source code form is subject to the terms of the mozilla public licen[sc]e v ?2 0"),
    ("mpl-1.1", " the contents of this file are subject to ", 1, 0.95, r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("epl", " accompanying program ", 1, 0.9, r"the accompanying program is provided under the terms of this eclipse public licen[sc]e"),
    ("unlicense", " free and unencumbered ", 1, 0.95, r"this is free and unencumbered software released into the public domain"),
    ("zlib", " must not be misrepresented ", 1, 0.9, r"the origin of this software must not be misrepresented"),
    ("cc0-1.0", " associated a work with this deed ", 1, 0.95, r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", " unconditionally waives ", 1, 0.9, r"overtly fully permanently irrevocably and unconditionally waives"),
    ("creative-commons", " creative commons ", 1, 0.95, r"(?:this|the) work is licen[sc]ed under a creative commons(?: (?:attribution|non ?commercial|share ?alike|no ?derivatives)){0,4}(?: [1-4] 0)?(?: international| unported)? licen[sc]e"),
    ("creative-commons", " exercising the licensed rights ", 1, 0.9, r"by exercising the licensed rights(?: defined below)? you accept and agree to be bound"),
    ("python-2.0", " psf hereby grants ", 1, 0.95, r"psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e"),
    ("noncommercial", "commercial use only ", 2, 0.6, r"for (?:personal )?(?:and )?non ?commercial use only"),
)


@dataclass(frozen=True)
class Rule:
    keyword: str
    label: str
    priority: int
    confidence: float
    expression: str
    beside: bool = False  # the keyword is a word of CONTEXT, not one of the match
    needs: str = ""  # another word of every match


def rules() -> list[Rule]:
    """All rules, in their order."""
    out = []
    for p, c, wording, needs in TEMPLATES:
        for label, keyword, name in FAMILIES:
            if wording == BARE and name in ALSO_WORDS:
                out += [Rule(word, label, p, c, name, True) for word in CONTEXT]
            else:
                out.append(Rule(keyword, label, p, c, wording.format(n=name), needs=needs))
    out += [Rule(keyword, label, p, c, expression) for label, keyword, p, c, expression in NOTICES + CLAUSES]
    return sorted(out, key=lambda r: r.priority)


GATES = tuple(sorted({r.keyword for r in rules()}))
N_PRIORITIES = 5


def _match(text: Column, expression: Column) -> Column:
    return F.call_function("regexp_extract", text, expression, F.lit(0))


def _words_in(text: Column) -> Column:
    """Words of a text that starts or ends every word with one space."""
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _places(body: Column, expression: Column) -> Column:
    """``body`` cut before every word at which ``expression`` matches."""
    return F.split(body, F.concat(F.lit("(?<= )(?=(?:"), expression, F.lit(") )")))


def base_places(body: Column) -> Column:
    """struct<n, first, last, labels> of the base phrases in the spaced words."""
    phrases = "|".join(BASE)
    label_of = F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv])
    pieces = _places(body, F.lit(phrases))
    start = F.struct(
        F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"),
        F.array().cast("array<string>").alias("labels"), F.lit(-1).cast("long").alias("at"),
    )

    def step(acc: Column, piece: Column) -> Column:
        found = _match(piece, F.lit(f"^(?:{phrases})(?= )"))
        is_place = (acc["at"] >= 0) & (F.length(found) > 0)
        here = F.when(is_place, acc["at"])
        return F.struct(
            (acc["n"] + is_place.cast("long")).alias("n"), F.coalesce(acc["first"], here).alias("first"), F.coalesce(here, acc["last"]).alias("last"),
            F.when(is_place, F.array_union(acc["labels"], F.array(label_of[found]))).otherwise(acc["labels"]).alias("labels"),
            (acc["at"] + _words_in(piece)).alias("at"),
        )

    return F.aggregate(pieces, start, step, lambda acc: F.struct(acc["n"], acc["first"], acc["last"], acc["labels"]))


def detections(body: Column, live: Column) -> Column:
    """struct<labels, score> of the rules ``live`` over the spaced words."""
    pieces = _places(body, F.array_join(F.array_distinct(F.transform(live, lambda r: r["expression"])), "|"))
    start = F.struct(
        F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"),
        F.array_repeat(F.lit(-1).cast("long"), N_PRIORITIES).alias("ends"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("chars"),
    )

    def keep(acc: Column, d: Column) -> Column:
        """One detection: suppressed within one as strong, else kept."""
        inside = F.exists(F.slice(acc["ends"], F.lit(1), d["priority"] + 1), lambda e: e >= d["end"])
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == d["priority"], F.greatest(e, d["end"])).otherwise(e))
        return F.struct(
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], d["confidence"])).alias("score"),
            F.when(inside, acc["ends"]).otherwise(ends).alias("ends"),
            acc["at"].alias("at"), acc["chars"].alias("chars"),
        )

    def step(acc: Column, piece: Column) -> Column:
        rest = F.substring(body, (acc["chars"] + 1).cast("int"), F.lit(LONGEST))
        tried = F.transform(
            live,
            lambda r: F.struct(
                r["priority"].alias("priority"), (-F.length(_match(rest, F.concat(F.lit("^(?:"), r["expression"], F.lit(")(?= )"))))).alias("longest"), r["place"].alias("place"),
                r["label"].alias("label"), r["confidence"].alias("confidence"),
                (acc["at"] + _words_in(_match(rest, F.concat(F.lit("^(?:"), r["expression"], F.lit(")(?= )")))) + 1).alias("end"),
            ),
        )
        # strongest first, and the longest of equals: what they contain is dropped
        here = F.array_sort(F.filter(tried, lambda d: d["longest"] < 0))
        kept = F.aggregate(here, acc, keep)
        return F.struct(kept["labels"], kept["score"], kept["ends"], (acc["at"] + _words_in(piece)).alias("at"), (acc["chars"] + F.length(piece)).alias("chars"))

    return F.aggregate(pieces, start, step, lambda acc: F.struct(acc["labels"], acc["score"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    own = rules()
    table = F.array(*[
        F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.needs).alias("needs"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(i).alias("place"), F.lit(r.expression).alias("expression"))
        for i, r in enumerate(own)
    ])
    keywords = F.array(*[F.lit(k) for k in sorted({*GATES, *(r.needs for r in own if r.needs)})])
    # lower() is right beyond A-Z too: it moves no word boundary, and the only
    # other character that becomes a plain ASCII letter is the Kelvin sign.
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(col(text_col), F.lit(""))), SEPARATORS, " "))
    # explode() of one element keeps what follows from computing the words anew
    spaced = docs.select(col(id_col).alias("id"), F.explode(F.array(F.concat(F.lit(" "), words, F.lit(" ")))).alias("body"))
    body = F.col("body")
    present = F.filter(keywords, lambda k: F.contains(body, k))
    live = F.filter(table, lambda r: F.array_contains(F.col("present"), r["keyword"]) & ((r["needs"] == "") | F.array_contains(F.col("present"), r["needs"])))
    keyed = spaced.select("id", "body", F.explode(F.array(present)).alias("present"))
    lively = keyed.select("id", "body", F.explode(F.array(F.when(F.size("present") > 0, live))).alias("live"))
    base = F.when(
        F.contains(body, F.lit(" cc by ")) | F.contains(body, F.lit(" general public license ")) | F.contains(body, F.lit(" all rights reserved ")), base_places(body)
    )
    found = F.when(F.size("live") > 0, detections(body, F.col("live")))
    both = lively.select("id", "body", F.explode(F.array(F.struct(base.alias("base"), found.alias("found")))).alias("r"))
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.col("r.base.labels"), none)
    labels = F.array_union(base_labels, F.coalesce(F.col("r.found.labels"), none))
    n_base = F.coalesce(F.col("r.base.n"), F.lit(0).cast("long"))
    return both.select(
        F.col("id").alias(id_col),
        F.when(F.length(body) <= 2, F.lit(0)).otherwise(_words_in(body) - 1).cast("long").alias("n_words"),
        n_base.alias("n_base"),
        F.col("r.base.first").alias("first_word"),
        F.col("r.base.last").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("r.found.score"), F.lit(0.0)), F.when(n_base > 0, 0.6).otherwise(0.0)).alias("score"),
    )
