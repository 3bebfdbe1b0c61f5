"""License detection with ordered signature rules.

A text is brought to words (A-Z lower-cased, runs of other ASCII characters one
space), so that a signature is a regular expression over whole words.  Work is
gated twice, both times over the words themselves: a text that holds none of ``GATE`` holds no
signature, and a family's signatures run only where one of its keywords occurs.

A family has a label and signatures in order; their order and that of the families is their priority.  Its
signatures are one expression, so a family's places are found in one scan, and at each place the first
signature that fits counts.  All places of all families are intervals of words.  An interval inside another one is suppressed; of
equal ones the signature with the better priority stays.  Intervals are sorted by start,
longer ones first, and one scan that remembers the furthest end decides.

``BASE`` phrases are counted apart, at all their places, and their labels always stay.

Defined results: null and empty texts have no words, no labels and score 0; the
score is the best confidence of what stays (1 for a base phrase).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import ascii_lower

#: Phrase and label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Family:
    """A license: its label, the keywords that gate its rules, how its name is written, its identifiers, and sentences of its text.

    Keywords stand in one string, with bars between them; every name, identifier and sentence holds one of them.
    """

    label: str
    keyword: str
    names: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()


#: More specific licenses come first.
FAMILIES = (
    Family("agpl-3", "affero", (r"(?:gnu )?affero general public licen[cs]e(?: agpl)?(?: version| v)? ?3(?: 0)?(?: or(?: any)? later)?",)),
    Family("agpl-3", "agpl", (r"(?:gnu )?agpl(?: v| version)? ?3(?: 0)?",), (r"agpl 3 0(?: only| or later)?",)),
    Family("agpl", "affero", (r"(?:gnu )?affero general public licen[cs]e",)),
    Family("lgpl-3", "lesser", (r"(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version| v)? ?3(?: 0)?(?: or(?: any)? later)?",)),
    Family("lgpl-2", "lesser|library general", (r"(?:gnu )?(?:lesser|library) general public licen[cs]e(?: lgpl)?(?: version| v)? ?2(?: [01])?(?: or(?: any)? later)?",)),
    Family("lgpl", "lgpl", (r"(?:gnu )?lgpl(?: ?v ?[23](?: [01])?)?",), (r"lgpl [23] [01](?: only| or later)?",)),
    Family("lgpl", "lesser|library general", (r"(?:gnu )?(?:lesser|library) general public licen[cs]e",)),
    Family("gpl-3", "general public", (r"(?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? ?3(?: 0)?(?: or(?: any)? later)?",)),
    Family("gpl-2", "general public", (r"(?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? ?2(?: 0)?(?: or(?: any)? later)?",)),
    Family("gpl-3", "gpl", (r"(?:gnu )?gpl ?v ?3(?: 0)?(?: or(?: any)? later)?", r"gnu gpl 3(?: 0)?"), (r"gpl 3 0(?: only| or later)?",)),
    Family("gpl-2", "gpl", (r"(?:gnu )?gpl ?v ?2(?: 0)?(?: or(?: any)? later)?", r"gnu gpl 2(?: 0)?"), (r"gpl 2 0(?: only| or later)?",)),
    Family("gpl", "general public", (r"gnu general public licen[cs]e",)),
    Family("gfdl", "free documentation|gfdl", (r"(?:gnu )?free documentation licen[cs]e(?: version)?(?: 1 [123])?",), (r"gfdl 1 [123]",)),
    Family("apache-2", "apache", (r"apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?", r"apache 2(?: 0)?(?: licen[cs]e)?"), (r"apache 2 0",)),
    Family("apache-1", "apache", (r"apache(?: software)? licen[cs]e(?: version| v)? ?1(?: [01])?",), (r"apache 1 [01]",)),
    Family("apache", "apache", (r"apache(?: software)? licen[cs]e",)),
    Family("mit-0", "no attribution|mit 0", (r"mit no attribution(?: licen[cs]e)?",), (r"mit 0",)),
    Family("mit", "mit", (r"mit(?: x11)? licen[cs]e",), (r"mit",)),
    Family("mit", "expat", (r"expat(?: mit)? licen[cs]e",)),
    Family("bsd-4", "bsd", (r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[cs]e)?",), (r"bsd 4 clause",)),
    Family("bsd-3", "bsd", (r"(?:bsd 3 clause|3 clause bsd|three clause bsd|(?:new|modified|revised) bsd)(?: licen[cs]e)?",), (r"bsd 3 clause",)),
    Family("bsd-2", "bsd", (r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?",), (r"bsd 2 clause",)),
    Family("bsd-0", "bsd", (r"(?:0bsd|zero clause bsd)(?: licen[cs]e)?",), (r"0bsd",)),
    Family("bsd", "bsd", (r"bsd(?: style)? licen[cs]e",)),
    Family("isc", "isc", (r"isc licen[cs]e",), (r"isc",)),
    Family("mpl-2", "mozilla", (r"mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?",)),
    Family("mpl-1", "mozilla", (r"mozilla public licen[cs]e(?: version| v)? ?1(?: [01])?",)),
    Family("mpl", "mozilla", (r"mozilla public licen[cs]e",)),
    Family("mpl-2", "mpl", (r"mpl(?: v)? ?2(?: 0)?",), (r"mpl 2 0",)),
    Family("epl-2", "eclipse|epl", (r"eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?",), (r"epl 2 0",)),
    Family("epl-1", "eclipse|epl", (r"eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?",), (r"epl 1 0",)),
    Family("epl", "eclipse", (r"eclipse public licen[cs]e",)),
    Family("eupl", "european union|eupl", (r"european union public licen[cs]e(?: version| v)?(?: ?1(?: [012])?)?",), (r"eupl 1 [012]",)),
    Family("cddl", "common development|cddl", (r"common development and distribution licen[cs]e(?: version)?(?: 1(?: [01])?)?",), (r"cddl 1 [01]",)),
    Family("artistic", "artistic", (r"artistic licen[cs]e(?: version)?(?: [12](?: 0)?)?",), (r"artistic [12] 0",)),
    Family("boost", "boost|bsl", (r"boost software licen[cs]e(?: version)?(?: 1(?: 0)?)?",), (r"bsl 1 0",)),
    Family("zlib", "zlib", (r"zlib(?: libpng)? licen[cs]e",), (r"zlib",)),
    Family("wtfpl", "wtfpl", (r"wtfpl(?: licen[cs]e)?",), (r"wtfpl",)),
    Family("unlicense", "unlicense", (r"(?:the )?unlicense",), (r"unlicense",)),
    Family("python", "python|psf", (r"python software foundation licen[cs]e", r"psf licen[cs]e"), (r"psf 2 0",)),
    Family("ofl", "open font|ofl", (r"(?:sil )?open font licen[cs]e(?: version)?(?: 1(?: [01])?)?",), (r"ofl 1 [01]",)),
    Family("odbl", "open database|odbl", (r"open (?:data commons )?open database licen[cs]e(?: odbl)?", r"open database licen[cs]e"), (r"odbl 1 0",)),
    Family("openrail", "rail", (r"(?:creativeml |bigscience )?open ?rail(?: [ms]{1,2})?(?: licen[cs]e)?",)),
    Family("llama", "llama", (r"llama(?: [23])?(?: [123])? community licen[cs]e",)),
    Family("cc0", "cc0", (r"cc0(?: 1(?: 0)?)?(?: universal)?",), (r"cc0 1 0",)),
    Family("cc0", "creative commons", (r"creative commons (?:zero|cc0|public domain dedication)(?: licen[cs]e)?",)),
    Family("cc-by-nc-nd", "by nc nd", (r"cc by nc nd(?: [1234] [05])?",), (r"cc by nc nd [1234] [05]",)),
    Family("cc-by-nc-sa", "by nc sa", (r"cc by nc sa(?: [1234] [05])?",), (r"cc by nc sa [1234] [05]",)),
    Family("cc-by-nc", "by nc", (r"cc by nc(?: [1234] [05])?",), (r"cc by nc [1234] [05]",)),
    Family("cc-by-nd", "by nd", (r"cc by nd(?: [1234] [05])?",), (r"cc by nd [1234] [05]",)),
    Family("cc-by-sa", "by sa", (r"cc by sa(?: [1234] [05])?",), (r"cc by sa [1234] [05]",)),
    Family("cc-by", "cc by", (r"cc by(?: [1234] [05])?",), (r"cc by [1234] [05]",)),
    Family("cc-by-nc-nd", "creative commons", (r"creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)?(?: [1234] [05])?",)),
    Family("cc-by-nc-sa", "creative commons", (r"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?",)),
    Family("cc-by-nc", "creative commons", (r"creative commons attribution non ?commercial(?: [1234] [05])?",)),
    Family("cc-by-nd", "creative commons", (r"creative commons attribution no ?deriv(?:s|atives|ative works)?(?: [1234] [05])?",)),
    Family("cc-by-sa", "creative commons", (r"creative commons attribution share ?alike(?: [1234] [05])?",)),
    Family("cc-by", "creative commons", (r"creative commons attribution(?: [1234] [05])?",)),
    Family("cc", "creative commons", (r"creative commons licen[cs]e",)),
    Family("public-domain", "public domain", (r"(?:released|dedicated|placed) (?:in|in ?to|to) the public domain", r"public domain dedication")),
    Family("all-rights-reserved", "all rights reserved", (r"all rights reserved",)),
    Family("proprietary", "proprietary", (r"proprietary and confidential", r"proprietary licen[cs]e")),
    Family("non-commercial", "commercial", (r"for non ?commercial use only", r"commercial use (?:is )?(?:prohibited|not permitted)")),
    # Sentences of the licenses themselves.
    Family(
        "boost",
        "person or organization obtaining a copy",
        texts=(r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",),
    ),
    Family(
        "mit",
        "hereby granted free|permission notice",
        texts=(
            r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files the software)?",
            r"(?:the )?above copyright notice and this permission notice shall be included in all copies(?: or substantial portions of the software)?",
        ),
    ),
    Family(
        "isc",
        "for any purpose with or without fee",
        texts=(r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted",),
    ),
    Family("bsd-4", "advertising materials", texts=(r"all advertising materials mentioning features or use of this software must display",)),
    Family(
        "bsd-3",
        "used to endorse or promote",
        texts=(
            r"neither the names? of the (?:copyright holder|author|organization|company) nor the names of (?:its|the) contributors may be used to endorse or promote products",
            r"may be used to endorse or promote products derived from this software without specific prior written permission",
        ),
    ),
    Family(
        "bsd",
        "redistribution",
        texts=(
            r"redistribution and use in source and binary forms with or without modification are permitted",
            r"redistributions of source code must retain the above copyright notice",
            r"redistributions in binary form must reproduce the above copyright notice",
        ),
    ),
    Family(
        "apache-2",
        "in compliance with the license|agreed to in writing software",
        texts=(
            r"you may not use this file except in compliance with the license",
            r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        ),
    ),
    Family(
        "agpl-3",
        "gnu affero",
        texts=(r"under the terms of the gnu affero general public license as published by the free software foundation(?: either version 3)?",),
    ),
    Family(
        "lgpl",
        "gnu lesser general public license|gnu library general public license",
        texts=(r"under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation",),
    ),
    Family("gpl-3", "either version 3", texts=(r"gnu general public license as published by the free software foundation either version 3",)),
    Family("gpl-2", "either version 2", texts=(r"gnu general public license as published by the free software foundation either version 2",)),
    Family(
        "gpl",
        "gnu general public license",
        texts=(
            r"under the terms of the gnu general public license as published by the free software foundation",
            r"you should have received a copy of the gnu general public license along with this (?:program|library|file)",
        ),
    ),
    Family("mpl-2", "mozilla public license", texts=(r"this source code form is subject to the terms of the mozilla public license(?: v ?2 0)?",)),
    Family(
        "epl",
        "accompanying materials",
        texts=(r"this program and the accompanying materials are made available under the terms of the eclipse public license",),
    ),
    Family("zlib", "authors be held liable", texts=(r"in no event will the authors be held liable for any damages arising from the use of this software",)),
    Family("unlicense", "unencumbered", texts=(r"this is free and unencumbered software released into the public domain",)),
    Family("wtfpl", "do what the", texts=(r"do what the fuck you want to public license",)),
    Family("ofl", "font software", texts=(r"this font software is licensed under the sil open font license",)),
    Family("python", "psf is making", texts=(r"psf is making python available to licensee on an as is basis",)),
    Family("artistic", "package may be copied", texts=(r"the intent of this document is to state the conditions under which a package may be copied",)),
    Family(
        "cc0",
        "associated a work",
        texts=(r"the person who associated a work with this deed has dedicated the work to the public domain",),
    ),
    Family(
        "public-domain",
        "public domain",
        texts=(r"this (?:work|file|text|software) is in the public domain", r"no copyright is claimed and the (?:work|text) is in the public domain"),
    ),
    Family(
        "proprietary",
        "may be reproduced|unauthorized",
        texts=(
            r"no part of this (?:publication|document|work|book|site) may be reproduced",
            r"unauthorized (?:copying|reproduction|distribution|use)(?: of this (?:file|document|software|work))?(?: via any medium)? is strictly prohibited",
        ),
    ),
    Family(
        "non-commercial",
        "commercial purposes|research purposes",
        texts=(
            r"(?:may|must|can) not be used for commercial purposes",
            r"not for commercial purposes",
            r"for (?:academic|non ?commercial) research purposes only",
        ),
    ),
)
#: What stands around a license's name, and how sure it makes the detection.
GRANTS = (
    (r"(?:this )?(?:work|file|software|code|program|document|content|text|data) is (?:licensed|released|distributed|available) (?:under|by) (?:the )?(?:terms of )?(?:the )?{name}", 1.0),
    (r"(?:licensed|released|distributed|published|available|provided|covered|shared) (?:under|by|with) (?:the )?(?:terms of )?(?:the )?{name}", 0.95),
    (r"(?:under|subject to) (?:the )?(?:terms of )?(?:the )?{name}", 0.85),
    (r"licen[cs]e (?:is |type |name )?{name}", 0.8),
    (r"{name}", 0.6),
)
IDENTIFIERS = ((r"spdx licen[cs]e identifier {name}", 0.98), (r"licen[cs]e {name}", 0.75))
TEXT_SURE = 0.9
#: Every signature holds one of these within its words, as every base phrase does.
GATE = (
    "licen", "gpl", "agpl", "affero", "general public", "apache 2", "bsd", "mpl", "cc0", "cc by", "creative commons", "open rail", "openrail", "public domain",
    "all rights reserved", "proprietary and", "commercial use", "commercial purposes", "research purposes", "hereby granted", "permission notice", "advertising materials",
    "endorse or promote", "redistribution", "held liable", "wtfpl", "font software", "psf is making", "package may be copied", "may be reproduced", "is strictly prohibited", "no attribution",
)


def signatures(family: Family) -> list[tuple[str, float]]:
    """A family's signatures in their order, each with how sure it is."""
    either = lambda found: f"(?:{'|'.join(found)})"
    out = [(text, TEXT_SURE) for text in family.texts]
    out += [(t.replace("{name}", either(family.names)), sure) for t, sure in GRANTS if family.names]
    return out + [(t.replace("{name}", either(family.ids)), sure) for t, sure in IDENTIFIERS if family.ids]


def families() -> list[dict]:
    """All families in their order: label, keywords, the one expression of all signatures, and each signature with its confidence and rank."""
    out = []
    for family in FAMILIES:
        held = signatures(family)
        out.append(
            {
                "label": family.label,
                "keywords": family.keyword.split("|"),
                "pattern": f" (?:{'|'.join(p for p, _ in held)})(?= )",
                "rules": [{"whole": f"^ (?:{p})$", "sure": sure, "rank": len(out) * 100 + i} for i, (p, sure) in enumerate(held)],
            }
        )
    return out


_FAMILIES = "array<struct<label: string, pattern: string, rules: array<struct<whole: string, sure: double, rank: int>>>>"


def normal_line(text: Column) -> Column:
    """Words with one space before, between and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _matched(line: Column, known: list[dict]) -> Column:
    """For each family whose keywords and signatures occur: its number and the texts that match, in order."""
    none = F.array().cast("array<string>")
    held = []
    for number, family in enumerate(known):
        keyword = F.contains(line, F.lit(family["keywords"][0]))
        for other in family["keywords"][1:]:
            keyword = keyword | F.contains(line, F.lit(other))
        texts = F.when(keyword, F.regexp_extract_all(line, F.lit(f"({family['pattern']})"), F.lit(1))).otherwise(none)
        held.append(F.struct(F.lit(number).alias("family"), texts.alias("texts")))
    return F.filter(F.array(*held), lambda h: F.size(h["texts"]) > 0)


def _places(hit: Column, line: Column, table: Column) -> Column:
    """The word intervals of a family: spaces before a match count the words before it."""
    family = F.element_at(table, hit["family"] + 1)
    between = F.transform(F.split(line, family["pattern"]), _spaces)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(hit["texts"])), hit["texts"], lambda gap, text: F.struct(gap.alias("gap"), _spaces(text).alias("words"), text.alias("text")))
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<struct<start: int, stop: int, text: string>>").alias("found")),
        lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["words"]).alias("at"),
            F.array_append(a["found"], F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["words"]).alias("stop"), s["text"].alias("text"))).alias("found"),
        ),
        lambda a: a["found"],
    )
    first = lambda p: F.element_at(F.filter(family["rules"], lambda r: F.regexp_like(p["text"], r["whole"])), 1)
    return F.transform(
        walked,
        lambda p: F.struct(
            p["start"].alias("start"), (-p["stop"]).alias("back"), first(p)["rank"].alias("rank"), family["label"].alias("label"), first(p)["sure"].alias("sure")
        ),
    )


def _resolved(found: Column) -> Column:
    """What stays of the sorted intervals: those that reach further than all before them."""
    start = F.struct(F.lit(0).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("sure"))
    return F.aggregate(
        F.array_sort(found),
        start,
        lambda a, d: F.when(
            -d["back"] > a["reach"],
            F.struct((-d["back"]).alias("reach"), F.array_union(a["labels"], F.array(d["label"])).alias("labels"), F.greatest(a["sure"], d["sure"]).alias("sure")),
        ).otherwise(a),
    )


def _base(phrase: str) -> tuple[Column, Column, Column]:
    """Places, first and last start of a phrase in ``line``."""
    line, pattern = F.col("line"), F.lit(f" {phrase}(?= )")
    n = F.regexp_count(line, pattern).cast("long")
    first = _spaces(F.substring(line, F.lit(1), F.regexp_instr(line, pattern) - 1))
    after = _spaces(F.element_at(F.split(line, pattern), -1)) - 1
    last = _spaces(line) - 1 - after - len(phrase.split())
    return n, F.when(n > 0, first).cast("long"), F.when(n > 0, last).cast("long")


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row."""
    line, known = F.col("line"), families()
    rows = docs.select(F.col(key).alias("key"), normal_line(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("line"))
    gate = F.contains(line, F.lit(GATE[0]))
    for word in GATE[1:]:
        gate = gate | F.contains(line, F.lit(word))
    n_words = F.when(F.trim(line) == "", 0).otherwise(_spaces(line) - 1).cast("long")
    rows = rows.select("key", n_words.alias("n_words"), F.when(gate, line).alias("line"))
    base = [_base(phrase) for phrase, _ in BASE]
    n_base = sum((n for n, _, _ in base[1:]), base[0][0])
    held = F.filter(F.array(*(F.when(n > 0, F.lit(label)) for (n, _, _), (_, label) in zip(base, BASE))), lambda x: x.isNotNull())
    some = line.isNotNull()
    rows = rows.select(
        "key",
        "n_words",
        "line",
        F.when(some, F.struct(n_base.alias("n"), F.least(*(f for _, f, _ in base)).alias("first"), F.greatest(*(x for _, _, x in base)).alias("last"), held.alias("labels"))).alias("base"),
        F.when(some, _matched(line, known)).alias("hits"),
    )
    table = F.from_json(F.lit(json.dumps(known)), _FAMILIES)
    found = F.flatten(F.transform("hits", lambda h: _places(h, line, table)))
    rows = rows.select("key", "n_words", "base", F.when(F.size("hits") > 0, _resolved(found)).alias("own"))
    none = F.array().cast("array<string>")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base_labels = F.coalesce("base.labels", none)
    return rows.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("base.n", F.lit(0)).cast("long").alias("n_base"),
        F.col("base.first").alias("first_word"),
        F.col("base.last").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.array_union(base_labels, F.coalesce("own.labels", none))).alias("labels"),
        F.when(F.col("base.n") > 0, F.lit(1.0)).otherwise(F.coalesce("own.sure", F.lit(0.0))).alias("score"),
    )
