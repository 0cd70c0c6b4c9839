"""License scan by ordered signature rules, in DataFrame functions only.

Every rule is a regular expression over the normalised text (lower-case words, one blank apart), has a keyword without which
it is not tried, a priority (lower wins) and a confidence. A detection inside a longer one is suppressed; of two that overlap
partly, the better priority stays. All of it happens inside the row: no shuffle, no join, no Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import free_name

#: label: (keywords of which one must occur, pattern of the name in normalised text)
NAMES: dict[str, tuple[str, str]] = {
    "afl-3.0": ("academic", r"academic free license(?: version| v)? ?3(?: 0)?"),
    "agpl-3.0": ("affero|agpl", r"(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    "apache-1.1": ("apache", r"apache(?: software)?(?: license)?(?: version| v)? ?1 1"),
    "apache-2.0": ("apache", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    "artistic-1.0": ("artistic", r"artistic(?: license)?(?: version)? 1(?: 0)?"),
    "artistic-2.0": ("artistic", r"artistic(?: license)?(?: version)? 2(?: 0)?"),
    "blueoak-1.0.0": ("blue", r"blue oak model(?: license)?(?: 1 0 0)?"),
    "bsd-2-clause": ("bsd", r"(?:simplified bsd|bsd (?:2|two) clause|(?:2|two) clause bsd)"),
    "bsd-3-clause": ("bsd", r"(?:new bsd|modified bsd|revised bsd|bsd (?:3|three) clause|(?:3|three) clause bsd)"),
    "bsd-4-clause": ("bsd", r"(?:original bsd|bsd (?:4|four) clause|(?:4|four) clause bsd)"),
    "bsl-1.0": ("boost", r"boost(?: software)?(?: license)?(?: version)? 1(?: 0)?"),
    "busl-1.1": ("business", r"business source license(?: version)? 1 1"),
    "cc-by-3.0": ("cc by|creative", r"(?:cc by|creative commons attribution) 3 0(?: unported)?"),
    "cc-by-4.0": ("cc by|creative", r"(?:cc by|creative commons attribution) 4 0(?: international)?"),
    "cc-by-nc-4.0": ("cc by|creative", r"(?:cc by nc|creative commons attribution non ?commercial) 4 0(?: international)?"),
    "cc-by-nc-nd-4.0": ("cc by|creative", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?derivatives) 4 0(?: international)?"),
    "cc-by-nc-sa-4.0": ("cc by|creative", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0(?: international)?"),
    "cc-by-nd-4.0": ("cc by|creative", r"(?:cc by nd|creative commons attribution no ?derivatives) 4 0(?: international)?"),
    "cc-by-sa-3.0": ("cc by|creative", r"(?:cc by sa|creative commons attribution share ?alike) 3 0(?: unported)?"),
    "cc-by-sa-4.0": ("cc by|creative", r"(?:cc by sa|creative commons attribution share ?alike) 4 0(?: international)?"),
    "cc0-1.0": ("cc0|cc zero|creative", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?"),
    "cddl-1.0": ("cddl|common development", r"(?:common development and distribution license|cddl)(?: version)?(?: 1 0)?"),
    "cecill-2.1": ("cecill", r"cecill(?: version)? 2 1"),
    "cpl-1.0": ("common", r"common public license(?: version)?(?: 1 0)?"),
    "curl": ("curl", r"curl"),
    "ecl-2.0": ("educational", r"educational community license(?: version)? 2 0"),
    "elastic-2.0": ("elastic", r"elastic(?: license)?(?: version)? 2(?: 0)?"),
    "epl-1.0": ("eclipse|epl", r"(?:eclipse public license|epl)(?: version| v)? ?1 0"),
    "epl-2.0": ("eclipse|epl", r"(?:eclipse public license|epl)(?: version| v)? ?2 0"),
    "eupl-1.2": ("eupl|european", r"(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2"),
    "gpl-2.0": ("general public|gpl", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?(?: only| or later)?"),
    "gpl-3.0": ("general public|gpl", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    "isc": ("isc", r"isc"),
    "lgpl-2.1": ("lesser|lgpl", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?2 1(?: only| or later)?"),
    "lgpl-3.0": ("lesser|lgpl", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    "lppl-1.3c": ("latex|lppl", r"(?:latex project public license|lppl)(?: version)? 1 3c?"),
    "mit": ("mit|expat", r"(?:mit|expat)"),
    "mit-0": ("mit", r"(?:mit no attribution|mit 0)"),
    "mpl-1.1": ("mozilla|mpl", r"(?:mozilla public license|mpl)(?: version| v)? ?1 1"),
    "mpl-2.0": ("mozilla|mpl", r"(?:mozilla public license|mpl)(?: version| v)? ?2 0"),
    "ms-pl": ("microsoft|ms pl", r"(?:microsoft public|ms pl)"),
    "ms-rl": ("microsoft|ms rl", r"(?:microsoft reciprocal|ms rl)"),
    "mulan-psl-2.0": ("mulan", r"mulan(?: permissive software license| psl)(?: version| v)? ?2(?: 0)?"),
    "ncsa": ("ncsa", r"(?:university of illinois ncsa|ncsa)(?: open source)?"),
    "odbl-1.0": ("open database|odbl", r"(?:open database license|odbl)(?: version| v)?(?: 1 0)?"),
    "ofl-1.1": ("open font|ofl", r"(?:sil )?(?:open font license|ofl)(?: version)? 1 1"),
    "osl-3.0": ("open", r"open software license(?: version| v)? ?3 0"),
    "php-3.01": ("php", r"php(?: license)?(?: version)? 3 01"),
    "postgresql": ("postgresql", r"postgresql"),
    "psf-2.0": ("python|psf", r"(?:python software foundation|psf)(?: license)?(?: version)?(?: 2(?: 0)?)?"),
    "sspl-1.0": ("server side|sspl", r"(?:server side public license|sspl)(?: version| v)?(?: 1(?: 0)?)?"),
    "unlicense": ("unlicense", r"unlicense"),
    "upl-1.0": ("universal permissive|upl", r"(?:universal permissive license|upl)(?: version| v)?(?: 1 0)?"),
    "vim": ("vim", r"vim"),
    "wtfpl": ("what the fuck|wtfpl", r"(?:do what the fuck you want to public license|wtfpl)"),
    "x11": ("x11", r"x11"),
    "zlib": ("zlib", r"(?:zlib libpng|zlib)"),
    "zpl-2.1": ("zope|zpl", r"(?:zope public license|zpl)(?: version)? 2 1"),
}

#: kind: (keyword, pattern around the name, priority, confidence)
FORMS: dict[str, tuple[str, str, int, float]] = {
    "identifier": ("identifier", r"spdx license identifier {name}", 10, 1.0),
    "grant": ("under", r"(?:licensed|released|distributed|redistributed|published|available|provided|covered|offered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |this )?{name}(?: licen[cs]e)?", 20, 0.95),
    "subject": ("subject", r"subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the |this )?{name}(?: licen[cs]e)?", 30, 0.9),
    "field": ("licen", r"licen[cs]ed? (?:type )?(?:is )?(?:the )?{name}", 40, 0.8),
    "title": ("licen", r"{name} (?:public )?licen[cs]e", 50, 0.7),
}

#: names that are ordinary words or tools besides: a sentence must go on with "license" (or another license) to mean these
WORDS_TOO = ("curl", "isc", "mit", "ncsa", "postgresql", "psf-2.0", "vim", "x11", "zlib")
GOES_ON = r"(?: style)?(?: public)?(?: licen[cs]es?| or (?:the )?(?:apache|bsd|gpl|gnu|mpl)| and (?:the )?(?:apache|bsd|gpl|gnu|mpl))"

#: bare titles of names that hold "license" themselves, or are used without it: label and pattern; {v} stands before a version
TITLES: dict[str, str] = {
    "afl-3.0": r"academic free licen[cs]e{v}3(?: 0)?",
    "agpl-3.0": r"(?:gnu )?affero general public licen[cs]e{v}3(?: 0)?",
    "apache-1.1": r"apache(?: software)? licen[cs]e{v}1 1",
    "apache-2.0": r"apache(?: software)? licen[cs]e{v}2(?: 0)?",
    "artistic-1.0": r"artistic licen[cs]e{v}1(?: 0)?",
    "artistic-2.0": r"artistic licen[cs]e{v}2(?: 0)?",
    "blueoak-1.0.0": r"blue oak model licen[cs]e{v}1 0 0",
    "bsl-1.0": r"boost software licen[cs]e{v}1(?: 0)?",
    "busl-1.1": r"business source licen[cs]e{v}1 1",
    **{label: NAMES[label][1] for label in NAMES if label.startswith("cc-by")},
    "cc0-1.0": r"(?:cc0|cc zero|creative commons zero){v}1 0(?: universal)?",
    "cddl-1.0": r"common development and distribution licen[cs]e(?: cddl)?{v}1 0",
    "cecill-2.1": r"cecill (?:free software )?licen[cs]e(?: agreement)?{v}2 1",
    "cpl-1.0": r"common public licen[cs]e{v}1 0",
    "ecl-2.0": r"educational community licen[cs]e{v}2(?: 0)?",
    "elastic-2.0": r"elastic licen[cs]e{v}2(?: 0)?",
    "epl-1.0": r"eclipse public licen[cs]e{v}1 0",
    "epl-2.0": r"eclipse public licen[cs]e{v}2 0",
    "eupl-1.2": r"european union public licen[cs]e(?: eupl)?{v}1 2",
    "gpl-2.0": r"(?:gnu )?(?<!affero )(?<!lesser )(?<!library )general public licen[cs]e{v}2(?: 0)?",
    "gpl-3.0": r"(?:gnu )?(?<!affero )(?<!lesser )(?<!library )general public licen[cs]e{v}3(?: 0)?",
    "lgpl-2.1": r"(?:gnu )?lesser general public licen[cs]e{v}2 1",
    "lgpl-3.0": r"(?:gnu )?lesser general public licen[cs]e{v}3(?: 0)?",
    "lppl-1.3c": r"latex project public licen[cs]e(?: lppl)?{v}1 3c?",
    "mit-0": r"mit no attribution",
    "mpl-1.1": r"mozilla public licen[cs]e{v}1 1",
    "mpl-2.0": r"mozilla public licen[cs]e{v}2 0",
    "mulan-psl-2.0": r"mulan (?:permissive software licen[cs]e|psl){v}2(?: 0)?",
    "odbl-1.0": r"open database licen[cs]e(?: odbl)?{v}1 0",
    "ofl-1.1": r"(?:sil )?open font licen[cs]e{v}1 1",
    "osl-3.0": r"open software licen[cs]e{v}3 0",
    "php-3.01": r"php licen[cs]e{v}3 01",
    "psf-2.0": r"python software foundation licen[cs]e{v}2(?: 0)?",
    "sspl-1.0": r"server side public licen[cs]e{v}1(?: 0)?",
    "unlicense": r"the unlicense",
    "upl-1.0": r"universal permissive licen[cs]e(?: upl)?{v}1 0",
    "wtfpl": r"do what the fuck you want to public licen[cs]e",
    "zpl-2.1": r"zope public licen[cs]e(?: zpl)?{v}2 1",
}
BEFORE_VERSION = "(?: version| ver| v)? ?"

#: the sentence all BSD texts share, and at most so many words to the clause that tells them apart
BSD = r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
BSD_ENDORSE = r"(?:neither the names? of|the names? of (?:the )?(?:[^ ]+ ){1,12}?may not be used to endorse)"
PERMIT = r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "

#: texts that stand for a license or a notice: (label, keyword, pattern, priority, confidence)
NOTICES: list[tuple[str, str, str, int, float]] = [
    ("mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy", 5, 1.0),
    ("mit-0", "granted", PERMIT + r"the software is provided", 4, 1.0),
    ("x11", "advertising", PERMIT + r"subject to the following conditions (?:[^ ]+ ){20,200}?except as contained in this notice the names? of", 4, 1.0),
    ("ncsa", "granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", 4, 1.0),
    ("ofl-1.1", "granted", r"permission is hereby granted free of charge to any person obtaining a copy of the font software", 4, 1.0),
    ("bsl-1.0", "granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy", 5, 1.0),
    ("bsd-4-clause", "redistribution", BSD + r"(?:[^ ]+ ){20,120}?all advertising materials mentioning (?:[^ ]+ ){5,80}?" + BSD_ENDORSE, 3, 1.0),
    ("bsd-3-clause", "redistribution", BSD + r"(?:[^ ]+ ){20,120}?" + BSD_ENDORSE, 4, 1.0),
    ("bsd-2-clause", "redistribution", BSD + r"(?:[^ ]+ ){20,80}?materials provided with the distribution this software is provided", 4, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 5, 0.8),
    ("isc", "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 5, 1.0),
    ("postgresql", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 5, 1.0),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 5, 0.9),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 5, 1.0),
    ("wtfpl", "permitted", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 5, 1.0),
    ("apache-2.0", "apache", r"you may not use this file except in compliance with the license", 5, 0.9),
    ("apache-2.0", "contributor", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 5, 1.0),
    ("gpl", "redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu general public license", 5, 1.0),
    ("agpl", "redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu affero general public license", 5, 1.0),
    ("lgpl", "redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 5, 1.0),
    ("gpl-2.0", "activities", r"activities other than copying distribution and modification are not covered by this license they are outside its scope the act of running the program", 5, 1.0),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 5, 1.0),
    ("agpl-3.0", "copyleft", r"the gnu affero general public license is a free copyleft license for software and other kinds of works", 5, 1.0),
    ("lgpl-2.1", "library", r"activities other than copying distribution and modification are not covered by this license they are outside its scope the act of running a program using the library", 5, 1.0),
    ("lgpl-3.0", "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", 5, 1.0),
    ("mpl-2.0", "contributor", r"each contributor hereby grants you a world wide royalty free non exclusive license under intellectual property rights", 5, 1.0),
    ("epl", "accompanying", r"the accompanying program is provided under the terms of this eclipse public license", 5, 0.9),
    ("artistic-1.0", "package", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", 5, 1.0),
    ("artistic-2.0", "package", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 5, 1.0),
    ("cc0-1.0", "relinquish", r"certain owners wish to permanently relinquish those rights to a work", 5, 1.0),
    ("cc-by-4.0", "creative", r"you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license", 5, 1.0),
    ("public-domain", "domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 25, 0.9),
    ("proprietary", "reserved", r"all rights reserved", 60, 0.5),
    ("warranty-disclaimer", "warrant", r"without (?:any )?warrant(?:y|ies) (?:of any kind|express or implied)", 60, 0.3),
]

#: base: phrase and label, as the contract fixes them
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: a text without any of these can't hold a rule's or base phrase's words; looked for in the raw text, ASCII case ignored
GATE = r"(?i)licen[cs]e|(?<![a-z0-9])(?:identifier|under|subject|granted|redistribution|redistribute|permission|altered|unencumbered|activities|package|relinquish|domain|reserved|warrant|creative|mit[^a-z0-9]+no|cc0|cc[^a-z0-9]+(?:by|zero))"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_TYPE = "array<struct<label: string, any: array<string>, form: string, pattern: string, priority: int, confidence: double>>"


def rules() -> list[dict]:
    """Every form of every name, bare titles and notices: hundreds of rules in order of priority."""
    out = []
    for kind, (form, around, priority, confidence) in FORMS.items():
        for label, (keyword, name) in NAMES.items():
            if label in WORDS_TOO and kind in ("grant", "subject"):
                name = f"(?:{name}){GOES_ON}"
            out.append({"label": label, "any": keyword.split("|"), "form": form, "pattern": around.replace("{name}", name), "priority": priority, "confidence": confidence})
    for label, title in TITLES.items():
        out.append({"label": label, "any": NAMES[label][0].split("|"), "form": " ", "pattern": title.replace("{v}", BEFORE_VERSION), "priority": 50, "confidence": 0.7})
    out += [{"label": a, "any": [k], "form": k, "pattern": p, "priority": n, "confidence": c} for a, k, p, n, c in NOTICES]
    for r in out:
        r["pattern"] = f"(?<= )(?:{r['pattern']})(?= )"
    return sorted(out, key=lambda r: (r["priority"], r["label"]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once."""
    return F.transform(F.array(value), body)[0]


def _places(norm: Column, rule: Column) -> Column:
    """Detections of one rule: (start, -end, priority, label, confidence), characters of the normalised text."""
    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast("array<struct<start: int, neg_end: int, priority: int, label: string, confidence: double>>")).otherwise(
        let(F.split(norm, rule["pattern"], -1), lambda gaps: F.aggregate(
            F.arrays_zip(gaps.alias("gap"), m.alias("hit")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("out")),
            lambda acc, x: let(acc["at"] + F.length(x["gap"]), lambda s: F.struct(
                (s + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
                F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(s.alias("start"), (s + F.length(x["hit"])).alias("end"))))).alias("out"),
            )),
            lambda acc: F.transform(acc["out"], lambda p: F.struct(
                p["start"].alias("start"), (-p["end"]).alias("neg_end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"),
            )),
        ))
    ))


def _resolve(detections: Column) -> Column:
    """Sweep over detections by (start, longest first, priority): what is contained goes, of partial overlaps the better stays.

    Returns struct(labels, confidence, n): distinct labels that stay, their best confidence, their number.
    """
    none = F.struct(
        F.lit(-1).alias("end"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("pending"),
        F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("confidence"), F.lit(0).alias("n"),
    )

    def settle(acc: Column) -> dict[str, Column]:
        open_ = acc["label"].isNotNull()
        return {
            "labels": F.when(open_, F.array_union(acc["labels"], F.array(acc["label"]))).otherwise(acc["labels"]),
            "confidence": F.greatest(acc["confidence"], acc["pending"]), "n": acc["n"] + open_.cast("int"),
        }

    def step(acc: Column, d: Column) -> Column:
        done = settle(acc)
        opened = [(-d["neg_end"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["confidence"].alias("pending")]
        apart = F.struct(*opened, *(v.alias(k) for k, v in done.items()))
        instead = F.struct(*opened, *(acc[k].alias(k) for k in done))
        contained = -d["neg_end"] <= acc["end"]
        return F.when(contained, acc).when(d["start"] >= acc["end"], apart).when(d["priority"] < acc["priority"], instead).otherwise(acc)

    return F.aggregate(F.array_sort(detections), none, step, lambda acc: F.struct(*(v.alias(k) for k, v in settle(acc).items())))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds struct column ``license`` (an older one is replaced): n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted), score.

    n_base counts the places of the base phrases, first_word and last_word are their smallest and largest word index. labels
    holds the base labels and those of the rules' detections that stay; score is the best confidence among them (a base phrase
    alone: 0.5), 0 without any. Null and empty texts have 0 words and no labels. Repeated rows and other columns stay as they
    are. The whole text is read, however long.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    base = " (?=(?:" + "|".join(p for p, _ in BASE) + ") )"
    rule_list = F.from_json(F.lit(json.dumps(rules())), RULE_TYPE)
    empty = F.array().cast("array<string>")

    def detail(norm: Column) -> Column:
        tried = F.filter(rule_list, lambda r: F.contains(norm, r["form"]) & F.exists(r["any"], lambda k: F.contains(norm, k)))
        kept = _resolve(F.flatten(F.transform(tried, lambda r: _places(norm, r))))
        labels = F.filter(F.array(*(F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE)), lambda x: x.isNotNull())
        return let(F.split(norm, F.lit(base), -1), lambda parts: let(kept, lambda k: F.struct(
            (F.size(parts) - 1).cast("bigint").alias("n_base"),
            F.when(F.size(parts) > 1, F.regexp_count(parts[0], F.lit("[^ ]+"))).cast("bigint").alias("first_word"),
            F.when(F.size(parts) > 1, F.regexp_count(F.element_at(parts, -1), F.lit("[^ ]+"))).cast("bigint").alias("tail_words"),
            F.array_sort(labels).alias("base_labels"), F.array_sort(F.array_distinct(F.concat(labels, k["labels"]))).alias("labels"),
            F.greatest(k["confidence"], F.when(F.size(parts) > 1, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
        )))

    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(raw, UPPER, LOWER), SEPARATORS, " ")), F.lit(" "))
    number, found = free_name(docs, "__n"), free_name(docs, "__d")
    seen = docs.withColumns({number: F.regexp_count(raw, F.lit(WORD)).cast("bigint"), found: F.when(raw.rlike(GATE), let(norm, detail))})
    n, d = F.col(number), F.col(found)
    return seen.withColumn("license", F.struct(
        n.alias("n_words"), F.coalesce(d["n_base"], F.lit(0).cast("bigint")).alias("n_base"), d["first_word"].alias("first_word"),
        (n - d["tail_words"]).alias("last_word"), F.coalesce(d["base_labels"], empty).alias("base_labels"),
        F.coalesce(d["labels"], empty).alias("labels"), F.coalesce(d["score"], F.lit(0.0)).alias("score"),
    )).drop(number, found)
