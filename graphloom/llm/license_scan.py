"""Licence scans: ordered signature rules behind a keyword prefilter.

A rule is a regular expression over the words of a text (lower case, one space between words)
with a label, a priority and a confidence. The ways in which a licence is named are written once
and filled in for each family and version; signatures of licence texts and notices are written
one by one. A rule is tried only where its keyword stands in the text. Of overlapping
detections, one whose interval lies within that of a detection of higher priority (or of the
same priority and greater length) is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import mapped

#: The contract's phrases and labels.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    priority: int
    keyword: str
    label: str
    confidence: float
    pattern: str


def _v(*numbers: str) -> str:
    """A version in words: `2.0` reads `2 0`, and a trailing zero may be missing."""
    return "(?:" + "|".join(n.removesuffix(".0").replace(".", " ") + ("(?: 0)?" if n.endswith(".0") else "") for n in numbers) + ")"


def family(label: str, name: str, keyword: str, spdx: str, versions: tuple[str, ...] = (), url: str = "") -> list[Rule]:
    """The forms in which one licence family is named, most specific first."""
    out = []
    for version in versions:
        own, v = f"{label}-{version}", _v(version)
        out += [
            Rule(90, keyword, own, 1.0, rf"(?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:{name}),? (?:version |v ?)?{v}(?: or (?:any )?later(?: version)?)?"),
            Rule(80, keyword, own, 0.95, rf"(?:{name}) (?:as published by the free software foundation )?(?:either )?(?:version |ver |v ?){v}"),
            Rule(70, spdx.split(" ")[0], own, 0.95, rf"spdx license identifier {spdx} {v}(?: (?:only|or later))?"),
            Rule(60, spdx.split(" ")[0], own, 0.7, rf"{spdx} v?{v}(?: (?:only|or later))?"),
        ]
    out += [
        Rule(50, keyword, label, 0.95, rf"(?:licensed|released|distributed|available|published|covered|provided) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})"),
        Rule(45, spdx.split(" ")[0], label, 0.9, rf"spdx license identifier {spdx}"),
        Rule(40, keyword, label, 0.85, rf"(?:subject to|under|see|governed by) (?:the )?(?:terms of )?(?:the )?(?:{name})(?: agreement| text| file)?"),
        Rule(30, keyword, label, 0.6, rf"(?:{name})"),
    ]
    if url:
        out.append(Rule(55, url.split(" ")[0], label, 0.9, rf"(?:https? )?(?:www )?{url}"))
    return out


#: Licence families: label, name in words, keyword, SPDX words, versions, url in words.
FAMILIES = (
    ("gpl", r"gnu general public licen[sc]e|gnu gpl", "gnu", "gpl", ("1.0", "2.0", "3.0"), r"gnu org licenses (?:old licenses )?gpl"),
    ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e|gnu lgpl", "gnu", "lgpl", ("2.0", "2.1", "3.0"), r"gnu org licenses (?:old licenses )?lgpl"),
    ("agpl", r"gnu affero general public licen[sc]e|gnu agpl", "gnu", "agpl", ("1.0", "3.0"), r"gnu org licenses agpl"),
    ("gfdl", r"gnu free documentation licen[sc]e", "gnu", "gfdl", ("1.1", "1.2", "1.3"), r"gnu org licenses fdl"),
    ("apache", r"apache (?:software )?licen[sc]e", "apache", "apache", ("1.0", "1.1", "2.0"), r"apache org licenses"),
    ("mit", r"(?:mit(?: x11)?|expat) licen[sc]e", "licen", "mit", (), r"opensource org licenses mit"),
    ("bsd", r"bsd (?:style )?licen[sc]e", "bsd", "bsd", (), r"opensource org licenses bsd"),
    ("bsd-2-clause", r"(?:simplified|2 clause|two clause|freebsd) bsd licen[sc]e|bsd 2 clause(?: licen[sc]e)?", "bsd", "bsd 2 clause", (), r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", r"(?:new|revised|modified|3 clause|three clause) bsd licen[sc]e|bsd 3 clause(?: licen[sc]e)?", "bsd", "bsd 3 clause", (), r"opensource org licenses bsd 3 clause"),
    ("mpl", r"mozilla public licen[sc]e", "mozilla", "mpl", ("1.0", "1.1", "2.0"), r"mozilla org (?:en us )?mpl"),
    ("epl", r"eclipse public licen[sc]e", "eclipse", "epl", ("1.0", "2.0"), r"eclipse org (?:legal )?epl"),
    ("cddl", r"common development and distribution licen[sc]e", "common", "cddl", ("1.0", "1.1"), r"opensource org licenses cddl"),
    ("cpl", r"common public licen[sc]e", "common", "cpl", ("1.0",), ""),
    ("isc", r"isc licen[sc]e", "isc", "isc", (), r"opensource org licenses isc"),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", "zlib", "zlib", (), ""),
    ("artistic", r"artistic licen[sc]e", "artistic", "artistic", ("1.0", "2.0"), ""),
    ("ofl", r"sil open font licen[sc]e", "font", "ofl", ("1.0", "1.1"), r"scripts sil org ofl"),
    ("eupl", r"european union public licen[sc]e", "european", "eupl", ("1.1", "1.2"), ""),
    ("psf", r"python software foundation licen[sc]e", "python", "psf", ("2.0",), ""),
    ("boost", r"boost software licen[sc]e", "boost", "bsl", ("1.0",), r"boost org licen[sc]e"),
    ("unlicense", r"the unlicense", "unlicense", "unlicense", (), r"unlicense org"),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e", "fuck", "wtfpl", ("2.0",), r"wtfpl net"),
    ("ms-pl", r"microsoft public licen[sc]e", "microsoft", "ms pl", (), ""),
    ("odbl", r"open (?:data commons open )?database licen[sc]e", "database", "odbl", ("1.0",), r"opendatacommons org licenses odbl"),
    ("openrail", r"openrail m? ?licen[sc]e|responsible ai licen[sc]e", "licen", "openrail", (), ""),
    ("postgresql", r"postgresql licen[sc]e", "postgresql", "postgresql", (), ""),
    ("osl", r"open software licen[sc]e", "software", "osl", ("2.1", "3.0"), ""),
    ("upl", r"universal permissive licen[sc]e", "universal", "upl", ("1.0",), ""),
)
#: Creative Commons forms: label, words after `attribution`, words after `cc`.
CC_FORMS = (
    ("cc-by-nc-sa", r"non ?commercial share ?alike", "by nc sa"),
    ("cc-by-nc-nd", r"non ?commercial no ?deriv(?:atives|s)", "by nc nd"),
    ("cc-by-nc", r"non ?commercial", "by nc"),
    ("cc-by-sa", r"share ?alike", "by sa"),
    ("cc-by-nd", r"no ?deriv(?:atives|s)", "by nd"),
    ("cc-by", "", "by"),
)


#: Signatures of licence texts, file headers and notices: priority, keyword, label, confidence, pattern.
SIGNATURES = (
    (96, "compliance", "apache-2.0", 1.0, r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    (91, "apache", "apache-2.0", 0.95, r"you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0"),
    (90, "derivative", "apache-2.0", 0.85, r"you must give any other recipients of the work or derivative works a copy of this license"),
    (88, "apache", "apache-1.1", 0.9, r"this product includes software developed by the apache software foundation"),
    (94, "mozilla", "mpl-2.0", 1.0, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    (93, "mozilla", "mpl-1.1", 0.95, r"the contents of this file are subject to the mozilla public license version 1 1"),
    (92, "licen", "mpl", 0.85, r"the contents of this file are subject to the (?:mozilla|netscape) public license"),
    (94, "redistribute", "gpl", 0.95, r"this (?:program|file|package) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (94, "redistribute", "lgpl", 0.95, r"this (?:library|program|file) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    (94, "redistribute", "agpl", 0.95, r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    (89, "gnu", "gpl", 0.8, r"you should have received a copy of the gnu general public license along with this (?:program|file|package)"),
    (89, "gnu", "lgpl", 0.8, r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)"),
    (89, "gnu", "agpl", 0.8, r"you should have received a copy of the gnu affero general public license along with this program"),
    (88, "version", "gpl-2.0", 0.8, r"either version 2 of the license or at your option any later version"),
    (88, "version", "gpl-3.0", 0.8, r"either version 3 of the license or at your option any later version"),
    (88, "version", "lgpl-2.1", 0.8, r"either version 2 1 of the license or at your option any later version"),
    (87, "exception", "gpl-with-classpath-exception", 0.9, r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    (87, "exception", "gpl-with-gcc-exception", 0.9, r"gcc runtime library exception"),
    (86, "invariant", "gfdl", 0.9, r"with no invariant sections no front cover texts and no back cover texts"),
    (95, "document", "gfdl", 0.95, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (91, "substantial", "mit", 0.9, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (86, "merchantability", "mit", 0.6, r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    (93, "advertising", "x11", 0.9, r"except as contained in this notice the name of (?:the x consortium|the open group) shall not be used in advertising"),
    (92, "evil", "json", 1.0, r"the software shall be used for good not evil"),
    (91, "redistributions", "bsd", 0.85, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (90, "redistributions", "bsd", 0.8, r"redistributions in binary form must reproduce the above copyright notice"),
    (89, "provided", "bsd", 0.7, r"this software is provided by the (?:copyright holders|regents|author)(?: and contributors)? as is"),
    (93, "acknowledg", "bsd-4-clause", 0.95, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (92, "granted", "0bsd", 0.9, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    (92, "misrepresented", "zlib", 0.95, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (88, "altered", "zlib", 0.85, r"altered source versions must be plainly marked as such and must not be misrepresented"),
    (94, "organization", "boost-1.0", 1.0, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (92, "eclipse", "epl", 0.95, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    (92, "distribution", "cddl", 0.95, r"the contents of this file are subject to the terms of the common development and distribution license"),
    (91, "intent", "artistic", 0.85, r"the intent of this document is to state the conditions under which a package may be copied"),
    (91, "verbatim", "artistic", 0.75, r"you may make and give away verbatim copies of the source form of the standard version of this package"),
    (92, "reserved", "ofl", 0.9, r"with reserved font names? .{1,80}? this font software is licensed under the sil open font license"),
    (90, "font", "ofl", 0.8, r"neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    (92, "licensee", "psf", 0.95, r"psf is making python available to licensee on an as is basis"),
    (93, "documentation", "postgresql", 0.9, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    (92, "compile", "unlicense", 0.95, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    (93, "fuck", "wtfpl", 1.0, r"you just do what the fuck you want to"),
    (92, "beer", "beerware", 1.0, r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    (91, "openssl", "openssl", 0.95, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    (91, "php", "php", 0.9, r"this product includes php software freely available from"),
    (91, "zend", "zend", 0.9, r"this product includes the zend engine"),
    (91, "jpeg", "ijg", 0.9, r"this software is based in part on the work of the independent jpeg group"),
    (91, "freetype", "ftl", 0.9, r"portions of this software are copyright .{1,40}? the freetype project"),
    (91, "unicode", "unicode", 0.9, r"unicode (?:data files and software|license agreement data files and software|inc license agreement)"),
    (91, "illinois", "ncsa", 0.95, r"university of illinois ncsa open source license"),
    (91, "latex", "lppl", 0.95, r"this work may be distributed and or modified under the conditions of the latex project public license"),
    (91, "w3c", "w3c", 0.9, r"w3c software (?:and document )?notice and license"),
    (91, "ruby", "ruby", 0.8, r"ruby is copyrighted free software by yukihiro matsumoto"),
    (91, "vim", "vim", 0.8, r"vim is charityware"),
    (91, "curl", "curl", 0.8, r"curl and libcurl are licensed under"),
    (91, "icu", "icu", 0.8, r"icu license icu 1 8 1 and later"),
    (85, "server", "sspl", 0.9, r"server side public license(?: version 1)?"),
    (85, "business", "busl", 0.9, r"business source license(?: 1 1)?"),
    (85, "elastic", "elastic", 0.9, r"elastic license(?: 2 0| version 2)?"),
    (85, "commons", "commons-clause", 0.9, r"commons clause license condition"),
    (85, "polyform", "polyform", 0.9, r"polyform (?:noncommercial|shield|strict|small business|free trial|perimeter) license"),
    (85, "llama", "llama", 0.9, r"llama (?:[0-9] )?(?:[0-9] )?community license(?: agreement)?"),
    (85, "gemma", "gemma", 0.85, r"gemma terms of use"),
    (85, "bigscience", "bigscience-rail", 0.9, r"bigscience (?:bloom )?rail license"),
    (90, "deed", "cc0", 0.9, r"the person who associated a work with this deed has dedicated the work to the public domain"),
    (87, "remix", "cc-by-sa", 0.85, r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    (87, "remix", "cc-by-nd", 0.85, r"if you remix transform or build upon the material you may not distribute the modified material"),
    (86, "commercial", "cc-by-nc", 0.75, r"you may not use the material for commercial purposes"),
    (86, "redistribute", "cc-by", 0.6, r"copy and redistribute the material in any medium or format"),
    (84, "commons", "cc-by-sa", 0.8, r"text is available under the creative commons attribution share ?alike licen[sc]e"),
    (84, "ogl", "ogl", 0.8, r"(?:uk )?ogl v[123](?: 0)?"),
    (84, "government", "ogl", 0.9, r"contains public sector information licensed under the open government licen[sc]e"),
    (84, "government", "ogl", 0.85, r"open government licen[sc]e(?: v[123](?: 0)?| version [123](?: 0)?)?"),
    (84, "opendatacommons", "pddl", 0.85, r"opendatacommons org licenses pddl"),
    (60, "prohibited", "proprietary", 0.9, r"unauthori[sz]ed copying of this (?:file|software) via any medium is strictly prohibited"),
    (60, "reproduced", "proprietary", 0.8, r"no part of this (?:publication|book|document|work) may be reproduced"),
    (60, "trade", "proprietary", 0.75, r"contains (?:confidential|proprietary) (?:information and )?trade secrets"),
    (60, "internal", "proprietary", 0.6, r"for internal use only"),
    (60, "redistributed", "proprietary", 0.6, r"may not be (?:copied|reproduced) or redistributed without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)"),
)


def _rules() -> tuple[Rule, ...]:
    out: list[Rule] = []
    for f in FAMILIES:
        out += family(*f)
    for i, (label, words, short) in enumerate(CC_FORMS):
        long = f"creative commons attribution {words}".strip()
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out.append(Rule(88 - i, "commons", f"{label}-{v}", 1.0, rf"{long} {_v(v)}(?: (?:international|unported|generic))?"))
            out.append(Rule(78 - i, "cc", f"{label}-{v}", 0.95, rf"cc {short} {_v(v)}"))
        out.append(Rule(58 - i, "commons", label, 0.9, long))
        out.append(Rule(48 - i, "cc", label, 0.75, rf"cc {short}"))
        out.append(Rule(68 - i, "creativecommons", label, 0.95, rf"creativecommons org licenses {short}"))
    out += [
        Rule(66, "cc0", "cc0", 0.95, r"cc0(?: 1 0)?(?: universal)?"),
        Rule(66, "publicdomain", "cc0", 0.95, r"creativecommons org publicdomain zero"),
        Rule(35, "domain", "public-domain", 0.7, r"(?:in|into|to) the public domain"),
        Rule(95, "permission", "mit", 1.0, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
        Rule(95, "permission", "isc", 0.95, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        Rule(94, "redistribution", "bsd", 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
        Rule(93, "contributors", "bsd-3-clause", 0.95, r"neither the name of .{1,80}? nor the names of its contributors may be used"),
        Rule(92, "applicable", "apache-2.0", 0.8, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
        Rule(92, "warranty", "gpl", 0.8, r"this program is distributed in the hope that it will be useful but without any warranty"),
        Rule(91, "unencumbered", "unlicense", 1.0, r"this is free and unencumbered software released into the public domain"),
        Rule(20, "rights", "all-rights-reserved", 0.4, r"all rights reserved"),
        Rule(20, "confidential", "proprietary", 0.5, r"(?:proprietary and )?confidential(?: and proprietary)?"),
        Rule(20, "proprietary", "proprietary", 0.5, r"proprietary licen[sc]e"),
    ]
    out += [Rule(*r) for r in SIGNATURES]
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.pattern)))


RULES = _rules()


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    priority: int
    confidence: float


class Scanner:
    """Rules by keyword; remembers of at most `most` distinct words which keywords they hold."""

    def __init__(self, rules: tuple[Rule, ...] = RULES, most: int = 300_000):
        self.by_keyword: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for r in rules:
            self.by_keyword.setdefault(r.keyword, []).append((r, re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])")))
        # no keyword holds a space, so each stands within a word
        self.gate = re.compile("|".join(sorted(map(re.escape, self.by_keyword), key=len, reverse=True)))
        self.most, self.known, self.holding = most, set(), {}

    def keywords(self, words: list[str]) -> set[str]:
        """The keywords that stand within any of the words."""
        own = set(words)
        if len(self.known) > self.most:
            self.known, self.holding = set(), {}
        new = own - self.known
        self.known |= new
        for w in new:
            if self.gate.search(w):  # keywords may contain one another (gpl, lgpl): any hit tests all
                self.holding[w] = [k for k in self.by_keyword if k in w]
        return {k for w in own & self.holding.keys() for k in self.holding[w]}

    def detect(self, line: str, words: list[str] | None = None) -> list[Detection]:
        """Detections over words joined by single spaces, overlaps resolved."""
        keywords = self.keywords(line.split(" ") if words is None else words)
        found = [Detection(m.start(), m.end(), r.label, r.priority, r.confidence) for k in keywords for r, p in self.by_keyword[k] for m in p.finditer(line)]
        return resolve(found)


@cache
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    """A scanner, its patterns compiled once in each process."""
    return Scanner(rules)


def resolve(found: list[Detection]) -> list[Detection]:
    """Drop a detection whose interval lies within that of a stronger one.

    Stronger: higher priority, then longer, then the smaller label. Of all kept detections that
    start no later, a tree of prefix maxima (Fenwick's) over the starts has the farthest end, so
    each test takes a logarithm of the detections.
    """
    kept: list[Detection] = []
    starts = sorted({d.start for d in found})
    far = [0] * (len(starts) + 1)
    for d in sorted(set(found), key=lambda d: (-d.priority, d.start - d.end, d.label, d.start)):
        k, farthest = bisect_right(starts, d.start), 0
        while k:
            farthest = max(farthest, far[k])
            k &= k - 1
        if farthest >= d.end:
            continue
        kept.append(d)
        k = bisect_left(starts, d.start) + 1
        while k < len(far):
            far[k] = max(far[k], d.end)
            k += k & -k
    return sorted(kept)


def base_places(line: str) -> list[tuple[int, str]]:
    """(word index, label) of all places of the base phrases in words joined by spaces."""
    out = []
    padded = f" {line} "
    for phrase, label in BASE_PHRASES:
        key = f" {phrase} "
        at, before, words = padded.find(key), 0, 0
        while at >= 0:
            words += padded.count(" ", before, at)
            before = at
            out.append((words, label))
            at = padded.find(key, at + 1)
    return out


def scan(text: str | None, scanner: Scanner) -> dict:
    words = _WORD.findall((text or "").translate(_LOWER) if text and not text.isascii() else (text or "").lower())
    line = " ".join(words)
    found = scanner.detect(line, words)
    base = base_places(line) if any(p in line for p, _ in BASE_PHRASES) else []
    places = [p for p, _ in base]
    base_labels = sorted({label for _, label in base})
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(base_labels),
        "labels": ",".join(sorted({*base_labels, *(d.label for d in found)})),
        "score": max([0.0, *(d.confidence for d in found), *(0.6 for _ in places)]),
        "n_detections": len(found),
    }


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of df: doc_id, n_words, base places, labels and score.

    A null or empty text has no words and no labels, score 0 and null first_word and last_word.
    Null ids stay null, repeated rows give repeated results, an empty table gives none; other columns of df are not read.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"

    def make():
        scanner = scanner_of(rules)

        def work(columns):
            ids, texts = columns
            rows = [scan(t, scanner) for t in texts]
            return {"doc_id": ids} | {k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")}

        return work

    return mapped(df, [id_col, text_col], schema, make)
