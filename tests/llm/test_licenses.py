import re

from clausefold.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", "!!", "MIT License", "mit-license. Mit\nLicense mit  licenses", "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "CC BY-SA 4.0, cc by", "GNU General Public License v3 or GNU GENERAL PUBLIC LICENSE", "SPDX-License-Identifier: LGPL-2.1-or-later",
    "ccby cc_by cc by", "mit die license", "word " * 5000 + "apache license",
]


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        x = phrase.split()
        own = [i for i in range(len(w)) if w[i : i + len(x)] == x]
        places += own
        labels |= {label} if own else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns_against_brute_force(spark):
    rows = [(i, t, 3) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 3), (None, "cc by", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = licenses.license_digest(docs).collect()
    assert sorted((str(r[0]), *map(str, r[1:6])) for r in got) == sorted((str(i), *map(str, base(t))) for i, t, _ in rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert (r["labels"] == "") == (r["score"] == 0)
    assert licenses.license_digest(docs.limit(0)).count() == 0


def labels(text):
    return licenses.scan(text.encode())[5]


def test_rules_find_and_suppress():
    assert len(licenses.RULES) >= 300
    assert labels("Licensed under the Apache License, Version 2.0") == "apache,apache-2"
    # the longer name holds the shorter one's interval; the base label stays
    assert labels("CC-BY-NC-SA 4.0") == "cc-by,cc-by-nc-sa"
    assert labels("new BSD licence") == "bsd-3"
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == "gpl-2"
    assert labels("the mitigation licensee of bsdlicense") == ""


def test_keywords_never_gate_a_match():
    """Without the prefilter the same detections are found."""
    open_rules = tuple(licenses.Rule(r.label, r.kind, r.priority, r.relevance, r.pattern, ()) for r in licenses.RULES)
    names = ["the " + n.replace("licen[sc]e", w) for _, _, _, n in licenses.FAMILIES for w in ("license", "licence")]
    texts = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??|\[[^\]]*\]", r"\1", n).replace("?", "") for n in names]
    for t in [*texts, *filter(None, TEXTS), "permission is hereby granted, free of charge, to any person obtaining a copy", "four clause BSD", "expat licence"]:
        w = t.lower().encode().translate(licenses.WORD_BYTES).split()
        every = licenses.detect(w, open_rules, frozenset(w)) if w else []
        assert licenses.detect(w) == every, t


def test_resolve_against_all_pairs():
    import random

    rnd = random.Random(4)
    for _ in range(200):
        found = []
        for _ in range(rnd.randrange(12)):
            a = rnd.randrange(10)
            found.append(licenses.Detection(a, a + 1 + rnd.randrange(6), rnd.randrange(len(licenses.RULES))))
        found = list(dict.fromkeys(found))

        def rank(d):
            return licenses.RULES[d.rule].priority, d.begin, -d.end, d.rule

        def hidden(d):
            return any(e != d and e.begin <= d.begin and e.end >= d.end and rank(e) < rank(d) for e in found)

        assert set(licenses.resolve(found)) == {d for d in found if not hidden(d)}


def test_common_forms_by_hand():
    for text, want in {
        "BSD 3-Clause License": "bsd-3", "BSD-2-Clause": "bsd-2", "GPLv2": "gpl-2", "GPLv3 or later": "gpl-3", "LGPLv3": "lgpl", "LGPLv2.1": "lgpl", "AGPLv3": "agpl",
        "released under the GPL": "gpl", "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2,mit",
        "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 AND BSD-3-Clause) OR MIT": "bsd-3,gpl-2,mit",
        "https://www.gnu.org/licenses/gpl-3.0.html": "gpl-3", "http://www.apache.org/licenses/LICENSE-2.0": "apache-2",
        "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa", "the GPL is long": "",
    }.items():
        assert labels(text) == want, text


def test_forms_by_hand_of_declarations_and_texts():
    for text, want in {
        "Open Database License": "odbl", "Open Data Commons Open Database License v1.0": "odbl", "MPL 2.0": "mpl-2", "EPL-2.0": "epl", "license: MIT": "mit",
        "License = \"ISC\"": "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version": "gpl,gpl-3",
        "SPDX-License-Identifier: LicenseRef-Foo-1 OR MIT": "mit", "SPDX-License-Identifier: MIT OR nothing": "mit",
    }.items():
        assert labels(text) == want, text


def test_hostile_and_long_texts_take_linear_time():
    import time

    for piece, repeats in (("LicenseRef a OR ", 60_000), ("MIT OR ", 100_000), ("SPDX-License-Identifier: MIT WITH a AND ", 25_000), ("licensed under the terms of the ", 30_000),
                           ("see the ", 100_000), ("creative commons attribution non ", 25_000), ("gnu general public license version ", 25_000)):
        text = ("SPDX-License-Identifier: " + piece * repeats + "zzz").encode()
        start = time.process_time()
        licenses.scan(text)
        assert time.process_time() - start < 20, piece
    # twice the text takes about twice the time, not a multiple of it
    for piece in ("LicenseRef a OR ", "LicenseRef a b c OR "):
        taken = []
        for n in (10_000, 40_000):
            start = time.process_time()
            licenses.scan(("SPDX-License-Identifier: " + piece * n + "zzz").encode())
            taken.append(time.process_time() - start)
        assert taken[1] < 12 * taken[0] + 1
