"""License scans by ordered signature rules.

A rule is a regular expression over a text's words (lower case, one space
between them), with a priority, a relevance and the words that every match
holds.  A text's words are looked up in the set of those words first; only the
rules whose words are all there are tried.  Detections are then resolved: one
that lies within the interval of another of higher priority (or of the same
priority that begins earlier, reaches further or is listed first) is
suppressed.  The base rules count all their places before that.

The rules are made from the tables below: every licence family by its name,
its notices, its SPDX identifier and its link, and signatures by hand.  SPDX
expressions are read word by word.  One narrow pass over the documents, no
shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clausefold.llm.common import WORD_BYTES, append_columns, binary

# Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Label, SPDX identifiers, keywords, name as a pattern over words.
# Keywords: a match holds one word of each group.
FAMILIES = (
    ("gpl-1", "GPL-1.0-only GPL-1.0-or-later", "gpl|general", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? v?1(?: 0)?"),
    ("gpl-2", "GPL-2.0-only GPL-2.0-or-later GPL-2.0", "gpl|general", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? v?2(?: 0)?"),
    ("gpl-3", "GPL-3.0-only GPL-3.0-or-later GPL-3.0", "gpl|general", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)? v?3(?: 0)?"),
    ("lgpl", "LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later", "lgpl|general", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)(?: version)?(?: v?[23](?: [01])?)?"),
    ("agpl", "AGPL-3.0-only AGPL-3.0-or-later", "agpl|affero", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: version)?(?: v?3(?: 0)?)?"),
    ("gfdl", "GFDL-1.1-only GFDL-1.2-only GFDL-1.3-only", "gfdl|documentation", r"(?:gnu )?(?:gfdl|free documentation licen[sc]e)(?: version)?(?: 1 [123])?"),
    ("gpl", "GPL", "gnu", r"gnu (?:gpl|general public licen[sc]e)"),
    ("apache-1", "Apache-1.0 Apache-1.1", "apache license|licence", r"apache (?:software )?licen[sc]e(?: version)? 1 [01]"),
    ("apache-2", "Apache-2.0", "apache license|licence", r"apache (?:software )?licen[sc]e(?: version)? v?2(?: 0)?"),
    ("apache", "Apache", "apache license|licence", r"apache (?:software )?licen[sc]e"),
    ("mit", "MIT", "mit|expat license|licence", r"(?:the )?(?:mit|expat) licen[sc]e"),
    ("mit-0", "MIT-0", "mit attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("x11", "X11", "x11 license|licence", r"x11 licen[sc]e"),
    ("bsd-4", "BSD-4-Clause", "bsd", r"(?:4|four) clause bsd(?: licen[sc]e)?"),
    ("bsd-3", "BSD-3-Clause", "bsd", r"(?:(?:3|three) clause|new|modified|revised) bsd(?: licen[sc]e)?"),
    ("bsd-2", "BSD-2-Clause", "bsd", r"(?:(?:2|two) clause|simplified) bsd(?: licen[sc]e)?"),
    ("bsd-0", "0BSD", "bsd|0bsd", r"(?:zero clause bsd|0bsd)(?: licen[sc]e)?"),
    ("bsd", "BSD", "bsd", r"bsd licen[sc]e"),
    ("isc", "ISC", "isc license|licence", r"isc licen[sc]e"),
    ("zlib", "Zlib", "zlib license|licence", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng-2.0", "libpng license|licence", r"libpng licen[sc]e"),
    ("boost", "BSL-1.0", "boost", r"boost software licen[sc]e(?: version)?(?: 1 0)?"),
    ("mpl-1", "MPL-1.0 MPL-1.1", "mozilla", r"mozilla public licen[sc]e(?: version)? 1 [01]"),
    ("mpl-2", "MPL-2.0", "mozilla", r"mozilla public licen[sc]e(?: version)? 2(?: 0)?"),
    ("mpl", "MPL", "mozilla", r"mozilla public licen[sc]e"),
    ("epl", "EPL-1.0 EPL-2.0", "eclipse", r"eclipse public licen[sc]e(?: version)?(?: v?[12](?: 0)?)?"),
    ("edl", "EDL-1.0", "eclipse", r"eclipse distribution licen[sc]e(?: version)?(?: v?1(?: 0)?)?"),
    ("cddl", "CDDL-1.0 CDDL-1.1", "distribution license|licence", r"common development and distribution licen[sc]e(?: version)?(?: 1 [01])?"),
    ("cpl", "CPL-1.0", "common license|licence", r"common public licen[sc]e(?: version)?(?: 1 0)?"),
    ("ipl", "IPL-1.0", "ibm", r"ibm public licen[sc]e(?: version)?(?: 1 0)?"),
    ("eupl", "EUPL-1.1 EUPL-1.2", "european", r"european union public licen[sc]e(?: version)?(?: 1 [012])?"),
    ("cecill", "CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C", "cecill", r"cecill(?: [bc])?(?: free software)? licen[sc]e"),
    ("osl", "OSL-3.0", "software license|licence", r"open software licen[sc]e(?: version)?(?: [123] [01])?"),
    ("afl", "AFL-3.0", "academic", r"academic free licen[sc]e(?: version)?(?: [123] [012])?"),
    ("artistic-1", "Artistic-1.0", "artistic", r"artistic licen[sc]e(?: version)? 1(?: 0)?"),
    ("artistic-2", "Artistic-2.0", "artistic", r"artistic licen[sc]e(?: version)? 2(?: 0)?"),
    ("artistic", "Artistic", "artistic", r"artistic licen[sc]e"),
    ("unlicense", "Unlicense", "unlicense", r"the unlicense"),
    ("wtfpl", "WTFPL", "wtfpl|fuck", r"(?:wtfpl|do what the fuck you want to public licen[sc]e)"),
    ("cc0", "CC0-1.0", "cc0|creative", r"(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0", "cc|creative", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1234] 0)?"),
    ("cc-by-nc-sa", "CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0", "cc|creative", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234] 0)?"),
    ("cc-by-nc", "CC-BY-NC-3.0 CC-BY-NC-4.0", "cc|creative", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1234] 0)?"),
    ("cc-by-nd", "CC-BY-ND-3.0 CC-BY-ND-4.0", "cc|creative", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: [1234] 0)?"),
    ("cc-by-sa", "CC-BY-SA-3.0 CC-BY-SA-4.0", "cc|creative", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1234] 0)?"),
    ("cc-by", "CC-BY-3.0 CC-BY-4.0", "cc|creative", r"(?:cc by|creative commons attribution)(?: [1234] 0)?"),
    ("odbl", "ODbL-1.0", "odbl|database", r"(?:odbl|(?:open data commons )?open database licen[sc]e)(?: v?1 0)?"),
    ("odc-by", "ODC-By-1.0", "attribution license|licence", r"open data commons attribution licen[sc]e"),
    ("pddl", "PDDL-1.0", "pddl|dedication", r"(?:pddl|public domain dedication and licen[sc]e)"),
    ("ofl", "OFL-1.0 OFL-1.1", "font", r"(?:sil )?open font licen[sc]e(?: version)?(?: 1 [01])?"),
    ("ms-pl", "MS-PL", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "MS-RL", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("python", "Python-2.0 PSF-2.0", "python", r"python software foundation licen[sc]e(?: version)?(?: 2(?: 0)?)?"),
    ("php", "PHP-3.0 PHP-3.01", "php license|licence", r"php licen[sc]e(?: version)?(?: 3(?: 01?)?)?"),
    ("ruby", "Ruby", "ruby license|licence", r"ruby licen[sc]e"),
    ("postgresql", "PostgreSQL", "postgresql license|licence", r"postgresql licen[sc]e"),
    ("openssl", "OpenSSL", "openssl license|licence", r"openssl licen[sc]e"),
    ("ncsa", "NCSA", "ncsa license|licence", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("upl", "UPL-1.0", "permissive", r"universal permissive licen[sc]e(?: version)?(?: 1 0)?"),
    ("w3c", "W3C", "w3c license|licence", r"w3c(?: software)?(?: notice and)? licen[sc]e"),
    ("zpl", "ZPL-2.1", "zope", r"zope public licen[sc]e(?: version)?(?: [12] [01])?"),
    ("qpl", "QPL-1.0", "q license|licence", r"q public licen[sc]e"),
    ("sleepycat", "Sleepycat", "sleepycat license|licence", r"sleepycat licen[sc]e"),
    ("vim", "Vim", "vim license|licence", r"vim licen[sc]e"),
    ("tcl", "TCL", "tcl license|licence", r"tcl(?: tk)? licen[sc]e"),
    ("curl", "curl", "curl license|licence", r"curl licen[sc]e"),
    ("icu", "ICU", "icu license|licence", r"icu licen[sc]e"),
    ("unicode", "Unicode-DFS-2016 Unicode-3.0", "unicode license|licence", r"unicode(?: inc)? licen[sc]e(?: agreement)?"),
    ("mulan", "MulanPSL-1.0 MulanPSL-2.0", "mulan", r"mulan permissive software licen[sc]e(?: v[12])?"),
    ("blueoak", "BlueOak-1.0.0", "oak", r"blue oak model licen[sc]e(?: 1 0 0)?"),
    ("bsl", "BUSL-1.1", "business", r"business source licen[sc]e(?: 1 1)?"),
    ("sspl", "SSPL-1.0", "server license|licence", r"server side public licen[sc]e"),
    ("elastic", "Elastic-2.0", "elastic license|licence", r"elastic licen[sc]e(?: 2 0)?"),
    ("polyform", "PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0", "polyform", r"polyform [a-z]+(?: [a-z]+)? licen[sc]e"),
    ("beerware", "Beerware", "beerware|beer", r"(?:beerware|beer ware) licen[sc]e"),
    ("json", "JSON", "json license|licence", r"json licen[sc]e"),
    ("proprietary", "LicenseRef-Proprietary", "confidential", r"proprietary and confidential"),
    ("public-domain", "LicenseRef-Public-Domain", "domain", r"(?:dedicated to|released into|in) the public domain"),
    ("all-rights-reserved", "LicenseRef-All-Rights-Reserved", "reserved", r"all rights reserved"),
    ("permissive-text", "LicenseRef-Permission-Notice", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("redistribution-text", "LicenseRef-Redistribution-Notice", "redistribution", r"redistribution and use in source and binary forms with or without modification"),
)

# How a family is spoken of; kind, priority (low wins),
# relevance, what precedes and follows the name.
NOTICES = (
    ("notice", 1, 0.95, r"(?:licen[sc]ed|released|distributed|available|provided|published|made available|redistribute it) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?", ""),
    ("see", 2, 0.9, r"(?:see|read|governed by|subject to|covered by|compatible with) (?:the )?(?:terms of )?(?:the )?", ""),
    ("name", 3, 0.8, "", ""),
)
BASE_PRIORITY, BASE_RELEVANCE = 4, 0.7

# Signatures written by hand; label, kind, keywords, pattern.  A
# bare name counts behind a notice only, a declared one behind "license".
_V = r"(?: or (?:any )?later(?: version)?)?"
SIGNATURES = (
    *((f"bsd-{n}", "name", "bsd", rf"bsd (?:licen[sc]e )?(?:{n}|{word}) clause(?: licen[sc]e)?") for n, word in ((4, "four"), (3, "three"), (2, "two"), (0, "zero"))),
    *((f"gpl-{n}", "name", f"gplv{n}|gpl{n}", rf"gplv?{n}(?: 0)?{_V}") for n in (1, 2, 3)),
    ("lgpl", "name", "lgplv2|lgplv3|lgpl2|lgpl3", rf"lgplv?[23](?: [01])?{_V}"),
    ("agpl", "name", "agplv3|agpl3", rf"agplv?3(?: 0)?{_V}"),
    ("apache-2", "name", "apache|apachev2", r"(?:apache v?2 0|apachev2)"),
    *((label, "bare", word, word) for label, word in (
        ("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("gfdl", "gfdl"), ("mit", "mit"), ("bsd", "bsd"), ("apache", "apache"), ("isc", "isc"),
        ("zlib", "zlib"), ("mpl", "mpl"), ("epl", "epl"), ("cddl", "cddl"), ("eupl", "eupl"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"))),
    *((label, "declared", "license|licence", word) for label, word in (
        ("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("mit", "mit"), ("bsd", "bsd"), ("isc", "isc"), ("zlib", "zlib"), ("mpl", "mpl"), ("epl", "epl"),
        ("unlicense", "unlicense"), ("wtfpl", "wtfpl"))),
    ("mpl-1", "name", "mpl", r"mpl (?:version )?v?1 [01]"),
    ("mpl-2", "name", "mpl", r"mpl (?:version )?v?2(?: 0)?"),
    ("epl", "name", "epl", r"epl (?:version )?v?[12](?: 0)?"),
    ("cddl", "name", "cddl", r"cddl (?:version )?v?1(?: [01])?"),
    ("eupl", "name", "eupl", r"eupl (?:version )?v?1(?: [012])?"),
    ("isc", "text", "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    *((f"gpl-{n}", "text", "general", rf"gnu general public licen[sc]e as published by the free software foundation (?:either )?version {n}(?: of the licen[sc]e)?{_V}") for n in (1, 2, 3)),
    ("lgpl", "text", "general", rf"gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation (?:either )?version [23](?: [01])?(?: of the licen[sc]e)?{_V}"),
    ("agpl", "text", "affero", rf"gnu affero general public licen[sc]e as published by the free software foundation (?:either )?version 3(?: of the licen[sc]e)?{_V}"),
    *((f"gpl-{n}", "link", "gnu", rf"gnu org licen[sc]es (?:old licen[sc]es )?gpl {n} 0") for n in (1, 2, 3)),
    ("gpl", "link", "gnu", r"gnu org (?:licen[sc]es|copyleft) gpl"),
    ("lgpl", "link", "gnu", r"gnu org (?:licen[sc]es|copyleft) (?:old licen[sc]es )?(?:lgpl|lesser)(?: [23] [01])?"),
    ("agpl", "link", "gnu", r"gnu org licen[sc]es agpl(?: 3 0)?"),
    ("gfdl", "link", "gnu", r"gnu org (?:licen[sc]es|copyleft) (?:old licen[sc]es )?fdl(?: 1 [123])?"),
    ("apache-2", "link", "apache", r"apache org licen[sc]es licen[sc]e 2 0"),
    ("apache-1", "link", "apache", r"apache org licen[sc]es licen[sc]e 1 [01]"),
    *((f"cc-{kind}", "link", "creativecommons", rf"creativecommons org licen[sc]es {kind.replace('-', ' ')} [1234] [05]")
      for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")),
    ("cc0", "link", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int
    relevance: float
    #: None: the rule of an expression's later identifiers
    pattern: re.Pattern[bytes] | None
    #: sets of words; a match holds a word of each
    needs: tuple[frozenset[bytes], ...]


def _needs(keywords: str) -> tuple[frozenset[bytes], ...]:
    return tuple(frozenset(w.encode() for w in group.split("|")) for group in keywords.split())


def _rule(label: str, kind: str, priority: int, relevance: float, pattern: str, needs: tuple[frozenset[bytes], ...]) -> Rule:
    return Rule(label, kind, priority, relevance, re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])"), needs)


def signature_rules() -> tuple[Rule, ...]:
    """All rules in their order: identifiers, notices, names, links, base."""
    rules = []
    for label, ids, _, _ in FAMILIES:
        for spdx in ids.split():
            words = spdx.lower().replace("-", " ").replace(".", " ")
            rules.append(_rule(label, "identifier", 0, 1.0, f"spdx license identifier {words}", _needs("spdx")))
            rules.append(_rule(label, "link", 2, 0.9, f"(?:opensource org licen[sc]es|spdx org licen[sc]es) {words}(?: html| php)?", _needs("opensource|spdx")))
    for kind, priority, relevance, before, after in NOTICES:
        for label, _, keywords, name in FAMILIES:
            rules.append(_rule(label, kind, priority, relevance, before + name + after, _needs(keywords)))
    # an expression's later identifiers, each in its own place
    rules.extend(Rule(label, "identifier", 0, 1.0, None, _needs("spdx")) for label, *_ in FAMILIES)
    for label, how, keywords, pattern in SIGNATURES:
        for kind, priority, relevance, before, _ in NOTICES:
            if how == "link" and kind == "name":
                rules.append(_rule(label, "link", 2, 0.9, pattern, _needs(keywords)))
            elif how == "declared" and kind == "name":
                rules.append(_rule(label, kind, priority, relevance, f"licen[sc]e (?:type |name )?{pattern}", _needs(keywords)))
            elif how == "text" and kind == "name":
                rules.append(_rule(label, kind, priority, relevance, pattern, _needs(keywords)))
            elif how == "name" or how == "bare" and kind == "notice":
                rules.append(_rule(label, kind, priority, relevance, before + pattern, _needs(keywords)))
    for phrase, label in BASE:
        rules.append(_rule(label, "base", BASE_PRIORITY, BASE_RELEVANCE, phrase, _needs(phrase)))
    return tuple(rules)


RULES = signature_rules()
KEYWORDS = frozenset(w for r in RULES for need in r.needs for w in need)


@dataclass(frozen=True)
class Detection:
    begin: int
    end: int
    rule: int


#: Label of every identifier's words, and the most words one has.
IDENTIFIERS = {tuple(i.lower().replace("-", " ").replace(".", " ").encode().split()): label for label, ids, _, _ in FAMILIES for i in ids.split()}
LONGEST = max(map(len, IDENTIFIERS))

#: Words that a reference's or an exception's name may have.
NAME_WORDS = 6


def expressions(words: list[bytes]) -> Iterator[tuple[int, int, str]]:
    """(begin, end, label) of the identifiers after the first in every SPDX
    expression, read once from left to right: the longest known identifier or
    a reference, perhaps an exception, an operator, and so on."""
    linked = (b"or", b"and")

    def name(at: int, stops: tuple[bytes, ...]) -> int:
        end = at
        while end < len(words) and end - at < NAME_WORDS and words[end] not in stops:
            end += 1
        return end

    at = 0
    while True:
        try:
            at = words.index(b"spdx", at)
        except ValueError:
            return
        at += 1
        if words[at : at + 2] != [b"license", b"identifier"]:
            continue
        at += 2
        first = True
        while True:
            size = next((n for n in range(min(LONGEST, len(words) - at), 0, -1) if tuple(words[at : at + n]) in IDENTIFIERS), 0)
            if size:
                if not first:
                    yield at, at + size, IDENTIFIERS[tuple(words[at : at + size])]
                at += size
            elif words[at : at + 1] == [b"licenseref"] and (end := name(at + 1, (*linked, b"with"))) > at + 1:
                at = end
            else:
                break
            if words[at : at + 1] == [b"with"]:
                at = name(at + 1, linked)
            if at >= len(words) or words[at] not in linked:
                break
            at, first = at + 1, False


def detect(words: list[bytes], rules: tuple[Rule, ...] = RULES, keywords: frozenset[bytes] = KEYWORDS) -> list[Detection]:
    """All detections, in words (end exclusive), by rule, then place."""
    there = keywords.intersection(words)
    if not there:
        return []
    line, out = None, []
    later: dict[str, list[tuple[int, int]]] = {}
    for begin, end, label in expressions(words) if b"spdx" in there else ():
        later.setdefault(label, []).append((begin, end))
    for number, rule in enumerate(rules):
        if rule.pattern is None:
            out.extend(Detection(begin, end, number) for begin, end in later.get(rule.label, ()))
        elif all(not need.isdisjoint(there) for need in rule.needs):
            line = line or b" ".join(words)
            word, at = 0, 0
            for m in rule.pattern.finditer(line):
                word += line.count(b" ", at, m.start())
                at = m.start()
                out.append(Detection(word, word + m[0].count(b" ") + 1, number))
    return out


def resolve(found: list[Detection], rules: tuple[Rule, ...] = RULES) -> list[Detection]:
    """The detections that none of the same or a higher priority contains; of
    equal ones the first rule's stays."""
    reach: dict[int, int] = {}
    kept = []
    for d in sorted(found, key=lambda d: (d.begin, -d.end, rules[d.rule].priority, d.rule)):
        own = rules[d.rule].priority
        if not any(end >= d.end for priority, end in reach.items() if priority <= own):
            kept.append(d)
        reach[own] = max(reach.get(own, 0), d.end)
    return kept


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = text.translate(WORD_BYTES).split()
    found = detect(words)
    base = [d for d in found if RULES[d.rule].kind == "base"]
    base_labels = {RULES[d.rule].label for d in base}
    kept = [RULES[d.rule] for d in resolve(found)]
    places = [d.begin for d in base]
    return (
        len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | {r.label for r in kept})), max((r.relevance for r in kept), default=0.0))


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_base, first_word,
    last_word, base_labels, labels and score, the relevance of the strongest
    detection that stays.

    A null text is an empty one: no words, no places (null), no labels (empty)
    and score 0.  Repeated rows are scanned one by one.  The new names replace
    columns of the same name.
    """

    def work(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        for (text,) in batches:
            rows = list(zip(*(scan(t or b"") for t in binary(text)), strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield [pa.array(values, kind) for values, kind in zip(rows, kinds, strict=True)]

    return append_columns(docs, ["text"], FIELDS, work)


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id and the scan's columns of every row, repeated ones too; null and
    empty texts as in ``scan_licenses``, no rows for an empty table."""
    return scan_licenses(docs.select("doc_id", "text")).drop("text")
