"""Finding licences and rights notices by ordered signature rules.

A text is reduced to its words in lower case with one space between them. A rule is a
pattern over words with a label, a priority and a weight, and is tried only where its
keyword occurs. Matches have intervals of words. A match that lies inside another of the
same or a higher priority is dropped: "gnu general public license version 3" says more
than the "general public license" in it. Equal intervals go to the higher priority, then
to the earlier rule. Everything is one projection of built-in functions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.llm.text import set_aside

#: Base phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licences: label, keyword, pattern of its name, identifier in the short notation if this row
#: brings it. Every match of a pattern contains its keyword.
NAMES = [
    ("apache-2.0", "apache", "apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", "apache (?:software )?licen[sc]e (?:version |v )?1 1", "apache 1 1"),
    ("apache", "apache", "apache (?:software )?licen[sc]e", "apache"),
    ("mit", "mit", "mit licen[sc]e", "mit"),
    ("mit", "expat", "expat licen[sc]e", None),
    ("mit", "x11", "x11 licen[sc]e", None),
    ("mit-0", "mit", "mit no attribution licen[sc]e", "mit 0"),
    ("bsd-2", "bsd", "(?:simplified bsd|2 clause bsd|bsd 2 clause|freebsd)(?: licen[sc]e)?", "bsd 2 clause"),
    ("bsd-3", "bsd", "(?:new bsd|modified bsd|3 clause bsd|bsd 3 clause)(?: licen[sc]e)?", "bsd 3 clause"),
    ("bsd-4", "bsd", "(?:original bsd|4 clause bsd|bsd 4 clause)(?: licen[sc]e)?", "bsd 4 clause"),
    ("bsd-0", "bsd", "(?:zero clause bsd|0 clause bsd|bsd zero clause)(?: licen[sc]e)?", "0bsd"),
    ("bsd", "bsd", "bsd (?:style )?licen[sc]e", "bsd"),
    ("gpl-1", "gnu", "gnu general public licen[sc]e (?:version |v )?1(?: 0)?", "gpl 1 0"),
    ("gpl-2", "gnu", "gnu general public licen[sc]e (?:version |v )?2(?: 0)?", "gpl 2 0"),
    ("gpl-3", "gnu", "gnu general public licen[sc]e (?:version |v )?3(?: 0)?", "gpl 3 0"),
    ("gpl-2-short", "gpl", "gpl ?v?2(?: 0)?", "gpl2"),
    ("gpl-3-short", "gpl", "gpl ?v?3(?: 0)?", "gpl3"),
    ("gpl-any", "gpl", "gpl(?: licen[sc]e)?", "gpl"),
    ("lgpl-2.1", "lesser", "gnu lesser general public licen[sc]e (?:version |v )?2 1", "lgpl 2 1"),
    ("lgpl-3", "lesser", "gnu lesser general public licen[sc]e (?:version |v )?3(?: 0)?", "lgpl 3 0"),
    ("lgpl-2", "library", "gnu library general public licen[sc]e", "lgpl 2 0"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[sc]e", "lgpl"),
    ("agpl-3", "affero", "(?:gnu )?affero general public licen[sc]e(?: (?:version |v )?3(?: 0)?)?", "agpl 3 0"),
    ("agpl", "agpl", "agpl(?: ?v?3)?", "agpl"),
    ("gfdl", "documentation", "gnu free documentation licen[sc]e", "gfdl 1 3"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e (?:version |v )?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e (?:version |v )?2 0", "mpl 2 0"),
    ("mpl", "mozilla", "mozilla public licen[sc]e", "mpl"),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e (?:version |v )?1 0", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public licen[sc]e (?:version |v )?2 0", "epl 2 0"),
    ("epl", "eclipse", "eclipse public licen[sc]e", "epl"),
    ("edl", "eclipse", "eclipse distribution licen[sc]e", "edl 1 0"),
    ("cddl", "common development", "common development and distribution licen[sc]e", "cddl 1 0"),
    ("cpl", "common public", "common public licen[sc]e", "cpl 1 0"),
    ("cpal", "common public attribution", "common public attribution licen[sc]e", "cpal 1 0"),
    ("eupl", "european union", "european union public licen[sc]e", "eupl 1 2"),
    ("afl", "academic free", "academic free licen[sc]e", "afl 3 0"),
    ("osl", "open software", "open software licen[sc]e", "osl 3 0"),
    ("artistic-2.0", "artistic", "artistic licen[sc]e (?:version |v )?2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", "(?:perl )?artistic licen[sc]e", "artistic 1 0"),
    ("boost", "boost", "boost software licen[sc]e", "bsl 1 0"),
    ("isc", "isc", "isc licen[sc]e", "isc"),
    ("zlib", "zlib", "(?:zlib|zlib libpng) licen[sc]e", "zlib"),
    ("libpng", "libpng", "libpng licen[sc]e", "libpng 2 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("ofl", "open font", "(?:sil )?open font licen[sc]e", "ofl 1 1"),
    ("lppl", "latex", "latex project public licen[sc]e", "lppl 1 3c"),
    ("psf", "python", "python software foundation licen[sc]e", "psf 2 0"),
    ("python", "python", "python licen[sc]e", "python 2 0"),
    ("php", "php", "php licen[sc]e", "php 3 01"),
    ("ruby", "ruby", "ruby licen[sc]e", "ruby"),
    ("zope", "zope", "zope public licen[sc]e", "zpl 2 1"),
    ("w3c", "w3c", "w3c (?:software )?(?:notice and )?licen[sc]e", "w3c"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e", "ncsa"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl"),
    ("ijg", "jpeg", "independent jpeg group licen[sc]e", "ijg"),
    ("icu", "icu", "icu licen[sc]e", "icu"),
    ("unicode", "unicode", "unicode licen[sc]e(?: agreement)?", "unicode 3 0"),
    ("curl", "curl", "curl licen[sc]e", "curl"),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", "ms rl"),
    ("apsl", "apple", "apple public source licen[sc]e", "apsl 2 0"),
    ("ibm-pl", "ibm", "ibm public licen[sc]e", "ipl 1 0"),
    ("intel", "intel", "intel open source licen[sc]e", "intel"),
    ("nokia", "nokia", "nokia open source licen[sc]e", "nokia"),
    ("qpl", "q public", "q public licen[sc]e", "qpl 1 0"),
    ("sleepycat", "sleepycat", "sleepycat licen[sc]e", "sleepycat"),
    ("sspl", "server side", "server side public licen[sc]e", "sspl 1 0"),
    ("busl", "business source", "business source licen[sc]e", "busl 1 1"),
    ("elastic", "elastic", "elastic licen[sc]e", "elastic 2 0"),
    ("odbl", "open database", "open (?:data commons open )?database licen[sc]e", "odbl 1 0"),
    ("odc-by", "open data commons", "open data commons attribution licen[sc]e", "odc by 1 0"),
    ("pddl", "public domain dedication", "public domain dedication and licen[sc]e", "pddl 1 0"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1-4] [05])?", "cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4] [05])?", "cc by sa 4 0"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4] [05])?", "cc by nd 4 0"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4] [05])?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4] [05])?", "cc by nc nd 4 0"),
    ("cc-by-plain", "cc by", "cc by(?: [1-4] [05])?", "cc by 4 0"),
    ("cc-attribution", "creative commons", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?", "cc by 3 0"),
    ("cc-share-alike", "share", "creative commons attribution share ?alike(?: [1-4] [05])?", "cc by sa 3 0"),
    ("cc-non-commercial", "commercial", "creative commons attribution non ?commercial(?: [1-4] [05])?", "cc by nc 3 0"),
    ("cc-no-derivatives", "deriv", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?", "cc by nd 3 0"),
    ("cc-any", "creative commons", "creative commons(?: licen[sc]e)?", "cc"),
]

#: What may stand around a name: kind, before, after, priority, weight.
AROUND = [
    ("grant", "(?:licensed|released|distributed|published|available|provided|offered|covered|shared|dual licensed) "
     "(?:to you )?(?:under|by|with|in accordance with) (?:the )?(?:terms (?:and conditions )?of )?(?:either )?(?:the |a |an )?", "", 3, 1.0),
    ("terms", "(?:under|subject to|governed by|according to|in compliance with|comply with|accept) (?:the )?"
     "(?:terms (?:and conditions )?of )?(?:the |a |an )?", "", 2, 0.9),
    ("copy", "(?:copy of|see|read|text of|version of|copies of) (?:the |a |an )?", "", 2, 0.8),
    ("name", "", "", 1, 0.6),
]

#: Sentences of licences and notices: label, keyword (in every match), pattern, priority, weight.
SENTENCES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 3, 1.0),
    ("mit", "above copyright notice", "the above copyright notice and this permission notice shall be included in all copies", 3, 1.0),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?", 3, 1.0),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 3, 1.0),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 3, 1.0),
    ("bsd-3", "endorse", "(?:may|must) not be used to endorse or promote products derived from", 3, 1.0),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software", 3, 1.0),
    ("apache-2.0", "applicable law", "unless required by applicable law or agreed to in writing", 3, 1.0),
    ("apache-2.0", "limitations", "see the license for the specific language governing permissions and limitations", 3, 1.0),
    ("apache-2.0", "apache org", "www apache org licenses license 2 0", 3, 1.0),
    ("gpl-any", "free software", "this program is free software you can redistribute it and or modify it", 3, 1.0),
    ("gpl-any", "free software foundation", "(?:as )?published by the free software foundation", 2, 0.9),
    ("gpl-any", "without even", "without even the implied warranty of merchantability or fitness", 3, 1.0),
    ("gpl-any", "should have received", "you should have received a copy of the gnu general public licen[sc]e", 3, 1.0),
    ("lgpl", "this library is free", "this library is free software you can redistribute it", 3, 1.0),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public licen[sc]e", 3, 1.0),
    ("cc-attribution", "licensed under a creative", "this work is licensed under a creative commons attribution", 3, 1.0),
    ("cc-any", "creativecommons", "creativecommons org licenses", 3, 1.0),
    ("isc", "permission to use", "permission to use copy modify and (?:or )?distribute this software for any purpose", 3, 1.0),
    ("zlib", "express or implied", "this software is provided as is without any express or implied warranty", 3, 1.0),
    ("boost", "permission is hereby", "permission is hereby granted free of charge to any person or organization", 3, 1.0),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 3, 1.0),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 3, 0.9),
    ("public-domain", "public domain", "in the public domain", 1, 0.4),
    ("wtfpl", "do what", "do what the fuck you want to public licen[sc]e", 3, 1.0),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 2, 0.7),
    ("copyright", "copyright", "copyright holders?", 1, 0.4),
    ("copyright", "copyright", "copyright notice", 1, 0.4),
    ("rights", "reserved", "(?:all|some|no) rights reserved", 2, 0.7),
    ("rights", "reproduced", "no part of this (?:publication|book|work|document) may be reproduced", 3, 0.9),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)", 3, 0.9),
    ("proprietary", "unauthori", "unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:of this \\S+ )?(?:is )?(?:strictly )?prohibited", 3, 0.9),
    ("proprietary", "non disclosure", "non disclosure agreement", 2, 0.6),
    ("trademark", "trademark", "(?:is a|are|registered) (?:registered )?trademarks?", 1, 0.3),
    ("warranty", "warrant", "(?:without|no) (?:any )?warrant(?:y|ies)", 1, 0.4),
    ("warranty", "as is", "(?:provided|licensed|distributed) (?:on an )?as is(?: basis)?", 2, 0.5),
    ("liability", "in no event", "in no event shall (?:the )?(?:authors?|copyright holders?|contributors?)", 2, 0.7),
    ("terms-of-use", "terms of", "terms of (?:use|service)", 1, 0.3),
    ("eula", "end user", "end user licen[sc]e agreement", 2, 0.8),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


def rules() -> list[Rule]:
    """All rules in order: names with what may stand around them, short notations, sentences."""
    out = []
    for label, keyword, name, short in NAMES:
        for _, before, after, priority, weight in AROUND:
            out.append(Rule(label, keyword, before + name + after, priority, weight))
        if short is not None:
            out.append(Rule(label, "spdx license identifier", "spdx license identifier " + short, 3, 1.0))
    out += [Rule(*s) for s in SENTENCES]
    return out


#: Without any of these words no rule and no base phrase can match.
ROOTS = (
    "licen", "copyright", "reserved", "reproduced", "gpl", "cc by", "cc0", "creative", "public domain", "warrant",
    "as is", "permission", "redistribution", "trademark", "wtf", "spdx", "apache org", "mit ", "bsd", "terms of",
    "proprietary", "prohibited", "disclosure", "liab", "in no event", "applicable law", "free software", "endorse",
    "advertising", "do what", "unencumbered", "without any", "in accordance",
)


def normal(text: str | Column) -> Column:
    """Words with one space before, between and after them."""
    words = F.regexp_replace(F.lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(words: Column, pattern: Column) -> Column:
    """Intervals of words, as (start, stop), of the matches of a pattern, which stands between
    spaces: the spaces before a match number its first word."""
    whole = F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )"))
    between = F.transform(F.split(words, whole), spaces)
    within = F.transform(F.regexp_extract_all(words, whole, F.lit(0)), spaces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))
    both = F.arrays_zip(between.alias("a"), within.alias("b"))
    return F.aggregate(
        F.filter(both, lambda x: x["b"].isNotNull()), start,
        lambda s, x: F.struct(
            (s["at"] + x["a"] + x["b"]).alias("at"),
            F.concat(s["found"], F.array(F.struct((s["at"] + x["a"]).alias("start"), (s["at"] + x["a"] + x["b"]).alias("stop")))).alias("found"),
        ),
        lambda s: s["found"],
    )


def labelled(found: Column, label: str) -> Column:
    return F.transform(found, lambda p: F.struct(p["start"].alias("start"), F.lit(label).alias("label")))


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    ``matches`` are the kept matches of rules: label, start, stop (words from 0), priority, weight.
    n_base counts the places of base phrases, first_word and last_word are the smallest and
    largest of them (else null). Labels are distinct, sorted, comma-joined; base labels stay
    whatever the rules say. ``score`` is the largest weight of a kept match, at least 0.5 with a
    base label, 0 without either. A null or empty text has no words. Repeated rows give repeated
    results; columns of the result's names are replaced, others stay. No shuffle.
    """
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
    df, (text,), restore = set_aside(df, text)
    others = [c for c in df.columns if c.lower() not in added]
    table = json.dumps([r.__dict__ | {"number": i} for i, r in enumerate(rules())])
    every = F.from_json(F.lit(table), "array<struct<label:string,keyword:string,pattern:string,priority:int,weight:double,number:int>>")
    w = F.col("_w")
    rooted = F.lit(False)
    for root in ROOTS:
        rooted = rooted | F.contains(w, F.lit(root))
    with_words = df.select(*others, normal(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    with_words = with_words.withColumn("_n", F.when(F.trim(w) == "", 0).otherwise(spaces(w) - 1).cast("long"))
    with_words = with_words.withColumn("_rooted", rooted)

    tried = F.filter(every, lambda r: F.contains(w, r["keyword"]))
    matches = F.flatten(F.transform(tried, lambda r: F.transform(
        places(w, r["pattern"]),
        lambda p: F.struct(p["start"].alias("start"), (-p["stop"]).alias("last"), (-r["priority"]).alias("rank"),
                           r["number"].alias("number"), r["label"].alias("label"), r["weight"].alias("weight")),
    )))
    # In order of start, longest first, a match lies inside an earlier one if that ends no sooner.
    kind = "array<struct<label:string,start:int,stop:int,priority:int,weight:double>>"
    none = F.struct(*[F.lit(-1).alias(f"m{p}") for p in (1, 2, 3)], F.array().cast(kind).alias("kept"))

    def step(s: Column, m: Column) -> Column:
        stop, priority = -m["last"], -m["rank"]
        reach = F.when(priority == 1, s["m1"]).when(priority == 2, s["m2"]).otherwise(s["m3"])
        one = F.struct(m["label"].alias("label"), m["start"].alias("start"), stop.alias("stop"),
                       priority.alias("priority"), m["weight"].alias("weight"))
        tops = [F.when(priority >= p, F.greatest(s[f"m{p}"], stop)).otherwise(s[f"m{p}"]).alias(f"m{p}") for p in (1, 2, 3)]
        return F.struct(*tops, F.when(reach >= stop, s["kept"]).otherwise(F.concat(s["kept"], F.array(one))).alias("kept"))

    kept = F.aggregate(F.array_sort(matches), none, step, lambda s: s["kept"])
    base = F.flatten(F.array(*[
        F.when(F.contains(w, F.lit(f" {phrase} ")), labelled(places(w, F.lit(phrase)), label)).otherwise(
            F.array().cast("array<struct<start:int,label:string>>")
        )
        for phrase, label in BASE.items()
    ]))
    # Without a root nothing below is computed.
    found = with_words.select(
        *others, F.col("_n"),
        F.when(F.col("_rooted"), base).otherwise(F.array().cast("array<struct<start:int,label:string>>")).alias("_base"),
        F.when(F.col("_rooted"), kept).otherwise(F.array().cast(kind)).alias("matches"),
    )
    starts = F.col("_base.start").cast("array<long>")
    base_labels = F.array_sort(F.array_distinct(F.col("_base.label")))
    labels = F.array_sort(F.array_union(base_labels, F.col("matches.label")))
    best = F.coalesce(F.array_max("matches.weight"), F.lit(0.0))
    return restore(found.select(
        *others, F.col("_n").alias("n_words"), F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("_base") > 0, F.greatest(best, F.lit(0.5))).otherwise(best).alias("score"), "matches",
    ))
