import re

from pyspark.sql import functions as F

from sitewright.llm.licenses import BASE, NAMES, rules, scan

TEXTS = [
    None, "", "   \n", "plain words only", "MIT License", "mit-license, MIT\nLICENSE mit licenses", "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "éMIT license émit license mit licenseé", "SPDX-License-Identifier: LGPL-2.1-or-later",
    "mit license " * 50, "x " * 3000 + "general public license " + "y " * 3000, "all rights reserved", "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "apache license mit license apache license", "BSD 3-Clause License or the MIT license, at your option",
    "Licensed under the GNU Affero General Public License version 3 or later",
]


def words(t):
    t = re.sub("[A-Z]", lambda m: m.group(0).lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(t):
    w = words(t)
    places = sorted((i, label) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    norm = " " + " ".join(w) + " "
    found = sorted(
        (m.start(), -m.end(), r["priority"], r["label"], r["confidence"]) for r in rules() for m in re.finditer(r["pattern"], norm) if m.end() > m.start()
    )
    kept = []
    for d in found:
        if kept and -d[1] <= -kept[-1][1]:
            continue
        if not kept or d[0] >= -kept[-1][1]:
            kept.append(d)
        elif d[2] < kept[-1][2]:
            kept[-1] = d
    base = sorted({x for _, x in places})
    score = max([x[4] for x in kept] + ([0.5] if places else [0.0]))
    return (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, base, sorted({*base, *(x[3] for x in kept)}), score)


def test_rules_are_hundreds_and_ordered():
    r = rules()
    assert len(r) > 200 and [x["priority"] for x in r] == sorted(x["priority"] for x in r)
    for x in r:
        re.compile(x["pattern"])


def test_scan_equals_brute_force_and_keeps_other_columns(spark):
    rows = [(i, t, "gate", i) for i, t in enumerate([*TEXTS, TEXTS[4]])] + [(1, TEXTS[7], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license_note string, n_words long")
    got = scan(df)
    assert got.columns == [*df.columns, "license"]
    out = got.select("text", *(F.col("license")[k].alias(f"l_{k}") for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert tuple(r)[1:] == brute(r["text"]), r["text"]


def test_plan_is_native_and_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "MIT License")], "doc_id long, text string")
    plan = scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert scan(df.limit(0)).count() == 0


BARE = {
    "afl-3.0": "Academic Free License version 3.0", "agpl-3.0": "GNU Affero General Public License\nVersion 3, 19 November 2007", "apache-1.1": "Apache Software License, Version 1.1",
    "apache-2.0": "Apache License\nVersion 2.0, January 2004", "artistic-1.0": "The Artistic License 1.0", "artistic-2.0": "The Artistic License 2.0", "blueoak-1.0.0": "Blue Oak Model License Version 1.0.0",
    "bsd-2-clause": "BSD 2-Clause License", "bsd-3-clause": "BSD 3-Clause License", "bsd-4-clause": "BSD 4-Clause License", "bsl-1.0": "Boost Software License - Version 1.0",
    "busl-1.1": "Business Source License 1.1", "cc-by-3.0": "Creative Commons Attribution 3.0 Unported", "cc-by-4.0": "Creative Commons Attribution 4.0 International",
    "cc-by-nc-4.0": "Creative Commons Attribution-NonCommercial 4.0 International", "cc-by-nc-nd-4.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International",
    "cc-by-nc-sa-4.0": "CC BY-NC-SA 4.0", "cc-by-nd-4.0": "Creative Commons Attribution-NoDerivatives 4.0 International", "cc-by-sa-3.0": "CC-BY-SA 3.0",
    "cc-by-sa-4.0": "Creative Commons Attribution-ShareAlike 4.0 International", "cc0-1.0": "CC0 1.0 Universal", "cddl-1.0": "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",
    "cecill-2.1": "CeCILL FREE SOFTWARE LICENSE AGREEMENT\n\nVersion 2.1 dated 2013-06-21", "cpl-1.0": "Common Public License Version 1.0", "curl": "curl License",
    "ecl-2.0": "Educational Community License, Version 2.0", "elastic-2.0": "Elastic License 2.0", "epl-1.0": "Eclipse Public License - v 1.0", "epl-2.0": "Eclipse Public License - v 2.0",
    "eupl-1.2": "EUROPEAN UNION PUBLIC LICENCE v. 1.2", "gpl-2.0": "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "gpl-3.0": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "isc": "ISC License",
    "lgpl-2.1": "GNU Lesser General Public License Version 2.1", "lgpl-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "lppl-1.3c": "LaTeX Project Public License Version 1.3c",
    "mit": "MIT License", "mit-0": "MIT No Attribution", "mpl-1.1": "Mozilla Public License Version 1.1", "mpl-2.0": "Mozilla Public License Version 2.0", "ms-pl": "Microsoft Public License (Ms-PL)",
    "ms-rl": "Microsoft Reciprocal License (Ms-RL)", "mulan-psl-2.0": "Mulan Permissive Software License, Version 2", "ncsa": "University of Illinois/NCSA Open Source License",
    "odbl-1.0": "Open Database License (ODbL) v1.0", "ofl-1.1": "SIL OPEN FONT LICENSE Version 1.1", "osl-3.0": "Open Software License v. 3.0", "php-3.01": "The PHP License, version 3.01",
    "postgresql": "PostgreSQL License", "psf-2.0": "Python Software Foundation License Version 2", "sspl-1.0": "Server Side Public License\nVERSION 1", "unlicense": "The Unlicense",
    "upl-1.0": "The Universal Permissive License (UPL), Version 1.0", "vim": "Vim License", "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "x11": "X11 License", "zlib": "zlib License",
    "zpl-2.1": "Zope Public License (ZPL) Version 2.1",
}
BASE_OF = {"apache-2.0": {"apache"}, "mit": {"mit"}} | dict.fromkeys(["agpl-3.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0"], {"gpl"})
OTHER = {
    "provided under the terms of this Eclipse Public License v. 2.0": {"epl-2.0"}, "subject to this Mozilla Public License, version 2.0": {"mpl-2.0"},
    "GNU Library General Public License Version 2": {"gpl"}, "creative people and a mozilla public meeting": set(),
}


def test_bare_titles_of_every_name(spark):
    assert BARE.keys() == NAMES.keys()
    want = {t: {x} | BASE_OF.get(x, set()) for x, t in BARE.items()} | OTHER
    for r in scan(spark.createDataFrame([(t,) for t in want], "text string")).collect():
        assert set(r["license"]["labels"]) == want[r["text"]], r["text"]
        assert r["license"]["labels"] == brute(r["text"])[5] and r["license"]["score"] == brute(r["text"])[6]


BSD_HEAD = """Copyright (c) 1998, The Authors. All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
"""
BSD_ADVERTS = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n"
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so"""
CONDITIONS = """, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
FULL = {
    BSD_HEAD + BSD_TAIL: "bsd-2-clause", BSD_HEAD + "3. " + BSD_NAMES + BSD_TAIL: "bsd-3-clause", BSD_HEAD + BSD_ADVERTS + "4. " + BSD_NAMES + BSD_TAIL: "bsd-4-clause",
    BSD_HEAD + "3. The name of the author may not be used to endorse or promote products derived from this software.\n" + BSD_TAIL: "bsd-3-clause",
    BSD_HEAD[:180] + BSD_TAIL: "bsd", GRANT + CONDITIONS: "mit", GRANT + '.\n\nTHE SOFTWARE IS PROVIDED "AS IS".': "mit-0",
    GRANT + CONDITIONS + "\nExcept as contained in this notice, the name of the consortium shall not be used in advertising.": "x11",
    GRANT.replace("deal in", "deal with") + CONDITIONS: "ncsa", GRANT.replace("this software and associated documentation files", "the Font Software"): "ofl-1.1",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that": "isc",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "isc",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted": "postgresql",
    "Altered source versions must be plainly marked as such, and must not be misrepresented": "zlib",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.": "wtfpl",
    "This is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
    "This is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": "agpl",
    "The GNU General Public License is a free, copyleft license for software and other kinds of works.": "gpl-3.0",
    "Activities other than copying, distribution and modification are not covered by this License; they are outside its scope. The act of running the Program is not restricted": "gpl-2.0",
    "they are outside. Activities other than copying, distribution and modification are not covered by this License; they are outside its scope. The act of running a program using the Library": "lgpl-2.1",
    "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: under intellectual property rights": "mpl-2.0",
    "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE": "epl",
    "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.": "artistic-2.0",
    "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control": "artistic-1.0",
    "Certain owners wish to permanently relinquish those rights to a Work": "cc0-1.0",
    "You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License": "cc-by-4.0",
    "released under the MIT license": "mit", "distributed under vim license terms": "vim", "published under a zlib style license": None,
}
BY_THE_WAY = {"proprietary", "warranty-disclaimer", "gpl"}
TOOLS = ("vim", "curl", "MIT", "X11", "zlib", "PostgreSQL", "ISC", "NCSA", "PSF")
SENTENCES = (
    "This plugin is available under {} and emacs.", "The course is offered under {} professors.", "Reports were published under {} last year.",
    "All of this is subject to {} rules.", "The images, released under {}, are large.", "Logs are provided under {} and other tools.",
)


def test_license_texts_by_their_clauses(spark):
    for r in scan(spark.createDataFrame([(t,) for t in FULL], "text string")).collect():
        labels, want = r["license"]["labels"], FULL[r["text"]]
        assert labels == brute(r["text"])[5], r["text"]
        if want is not None:
            assert want in labels and set(labels) - {want} <= BY_THE_WAY, (labels, r["text"])


def test_sentences_that_name_tools_have_no_license(spark):
    texts = [s.format(t) for s in SENTENCES for t in TOOLS]
    assert len(texts) > 50
    for r in scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert r["license"]["labels"] == [], r["text"]


def test_an_older_license_column_is_replaced(spark):
    df = spark.createDataFrame([(1, "MIT License", "old")], "doc_id long, text string, license string")
    assert scan(df).columns == df.columns and scan(df).first()["license"]["labels"] == ["mit"]
