"""Operator 10, license scans: ordered signature rules, gated by keywords, overlaps resolved by priority and containment.

A text is brought to its words (runs of digits, letters of either case and bytes above 127), one space between them. A
rule is a regex over those words. One of the rule's keywords must be in the text, as whole words, before the regex is tried. Of the places that
rules find, one inside a place of a better rule is dropped. Phrases of the base list count wherever they stand.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, texts_of

#: Base phrases: their words must stand one after another.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Everything but digits, letters and bytes above 127 separates words; A-Z count as a-z.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

#: label, keyword, regex of the license's name, regex of its identifier (or none).
NAMES = (
    ("0bsd", "0bsd|zero clause", r"(?:0bsd|zero clause bsd|bsd zero clause)", r"0bsd"),
    ("afl-3", "academic|afl", r"academic free license(?: version| v)? 3(?: 0)?", r"afl 3 0"),
    ("agpl-3", "affero|agpl|agpl3|agplv3|agpllicence|agpllicence3|agpllicencev|agpllicencev3|agpllicense|agpllicense3|agpllicensev|agpllicensev3|agplv", r"(?:gnu )?(?:affero general public|agpl) ?(?:licen[cs]e)?(?: version| ?v)? ?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl", "affero|agpl|agpl3|agplv3|agpllicence|agpllicence3|agpllicencev|agpllicencev3|agpllicense|agpllicense3|agpllicensev|agpllicensev3|agplv", r"(?:gnu affero general public licen[cs]e|gnu agpl|agplv?)", r"agpl 1 0(?: only| or later)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e(?: version| v)? ?1 1", r"apache 1 1"),
    ("apache-2", "apache", r"apache (?:software )?(?:licen[cs]e )?(?:version |v)?2(?: 0)?", r"apache 2 0"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", None),
    ("artistic-2", "artistic", r"(?:perl )?artistic licen[cs]e(?: version| v)? ?2(?: 0)?", r"artistic 2 0"),
    ("artistic-1", "artistic", r"(?:perl )?artistic licen[cs]e", r"artistic 1 0(?: perl| cl8)?"),
    ("beerware", "beer|beerware", r"beer ?ware licen[cs]e", r"beerware"),
    ("blueoak-1", "blue oak", r"blue oak model licen[cs]e", r"blueoak 1 0 0"),
    ("bsd-2-clause", "bsd|freebsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd licen[cs]e)", r"bsd 2 clause(?: patent| views)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd)", r"bsd 3 clause(?: clear| lbnl| attribution)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)", r"bsd 4 clause(?: uc)?"),
    ("bsd", "bsd|berkeley software", r"(?:bsd style|bsd type|berkeley software distribution|bsd)", None),
    ("bsl-1", "boost|bsl", r"boost software licen[cs]e", r"bsl 1 0"),
    ("busl-1.1", "business source|busl", r"business source licen[cs]e", r"busl 1 1"),
    ("cc-by-nc-nd", "cc by|creative commons", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative|s|atives)(?: works)?)", r"cc by nc nd [1-4] [05](?: igo)?"),
    ("cc-by-nc-sa", "cc by|creative commons", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", r"cc by nc sa [1-4] [05](?: igo)?"),
    ("cc-by-nc", "cc by|creative commons", r"(?:cc by nc|creative commons attribution non ?commercial)", r"cc by nc [1-4] [05]"),
    ("cc-by-nd", "cc by|creative commons", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative|s|atives)(?: works)?)", r"cc by nd [1-4] [05]"),
    ("cc-by-sa", "cc by|creative commons", r"(?:cc by sa|creative commons attribution share ?alike)", r"cc by sa [1-4] [05](?: igo)?"),
    ("cc-by", "cc by|creative commons", r"(?:cc by|creative commons attribution)", r"cc by [1-4] [05](?: igo)?"),
    ("cc0-1", "cc0|creative commons", r"(?:cc0|creative commons zero|creative commons public domain dedication)", r"cc0 1 0"),
    ("cddl-1", "cddl|common development", r"(?:cddl|common development and distribution licen[cs]e)", r"cddl 1 [01]"),
    ("cecill-2.1", "cecill", r"cecill(?: [abc])?(?: free software)?(?: licen[cs]e)?(?: agreement)?", r"cecill (?:[bc]|1 [01]|2 [01])"),
    ("cpl-1", "cpl|common public", r"common public licen[cs]e", r"cpl 1 0"),
    ("ecl-2", "educational community|ecl", r"educational community licen[cs]e", r"ecl [12] 0"),
    ("epl-2", "eclipse|epl|epl2|eplv|eplv2", r"(?:eclipse public licen[cs]e|epl)(?: version| ?v)? ?2(?: 0)?", r"epl 2 0"),
    ("epl-1", "eclipse|epl|epl2|eplv|eplv2", r"(?:eclipse public licen[cs]e)", r"epl 1 0"),
    ("eupl-1.2", "european union|eupl", r"(?:european union public licen[cs]e|eupl)", r"eupl 1 [012]"),
    ("gfdl-1.3", "free documentation|gfdl", r"(?:gnu free documentation licen[cs]e|gfdl)", r"gfdl 1 [123](?: only| or later)?"),
    ("gpl-3", "general public|gpl|gpl2|gpl3|gplv2|gplv3|gplversion", r"(?:gnu (?:general public licen[cs]e|gpl)|gpl|general public licen[cs]e)(?: \w+){0,3}? ?(?:version |v)?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl-2", "general public|gpl|gpl2|gpl3|gplv2|gplv3|gplversion", r"(?:gnu (?:general public licen[cs]e|gpl)|gpl|general public licen[cs]e)(?: \w+){0,3}? ?(?:version |v)?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl", "general public|gpl|gpl2|gpl3|gplv2|gplv3|gplversion", r"(?:gnu general public licen[cs]e|gnu gpl|gpl)", r"gpl 1 0(?: only| or later)?"),
    ("isc", "isc|internet systems", r"(?:isc licen[cs]e|internet systems consortium licen[cs]e)", r"isc"),
    ("lgpl-3", "lesser|library|lgpl|lgpl2|lgpl3|lgplv2|lgplv3|lgplv", r"(?:gnu (?:lesser general public licen[cs]e|lgpl)|lgpl)(?: version| ?v)? ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser|library|lgpl|lgpl2|lgpl3|lgplv2|lgplv3|lgplv", r"(?:gnu (?:lesser general public licen[cs]e|lgpl)|lgpl)(?: version| ?v)? ?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-2", "lesser|library|lgpl|lgpl2|lgpl3|lgplv2|lgplv3|lgplv", r"(?:gnu (?:library general public licen[cs]e|lgpl)|lgpl)(?: version| ?v)? ?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl", "lesser|library|lgpl|lgpl2|lgpl3|lgplv2|lgplv3|lgplv", r"(?:gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl)", None),
    ("libpng", "libpng|png reference", r"(?:libpng licen[cs]e|png reference library licen[cs]e)", r"libpng(?: 2 0)?"),
    ("lppl-1.3c", "lppl|latex project", r"(?:latex project public licen[cs]e|lppl)", r"lppl 1 (?:0|1|2|3a|3c)"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", r"mit 0"),
    ("mit", "mit|expat", r"(?:the )?(?:mit|expat) licen[cs]e", r"mit"),
    ("mpl-1.1", "mozilla|mpl|mpl1|mpl2|mplv|mplv1|mplv2", r"(?:mozilla public licen[cs]e|mpl)(?: version| ?v)? ?1 [01]", r"mpl 1 [01]"),
    ("mpl-2", "mozilla|mpl|mpl1|mpl2|mplv|mplv1|mplv2", r"(?:mozilla public licen[cs]e|mpl)(?: version| ?v)? ?2(?: 0)?", r"mpl 2 0(?: no copyleft exception)?"),
    ("mpl", "mozilla|mpl|mpl1|mpl2|mplv|mplv1|mplv2", r"mozilla public licen[cs]e", None),
    ("ms-pl", "microsoft|ms pl", r"(?:microsoft public licen[cs]e)", r"ms pl"),
    ("ms-rl", "microsoft|ms rl", r"(?:microsoft reciprocal licen[cs]e)", r"ms rl"),
    ("mulanpsl-2", "mulan|mulanpsl", r"mulan (?:permissive software licen[cs]e|psl)", r"mulanpsl [12] 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", r"ncsa"),
    ("odbl-1", "odbl|open database", r"(?:open database licen[cs]e|odbl)", r"odbl 1 0"),
    ("odc-by-1", "odc by|open data commons", r"(?:odc by|open data commons attribution licen[cs]e)", r"odc by 1 0"),
    ("ofl-1.1", "ofl|open font", r"(?:sil )?open font licen[cs]e", r"ofl 1 [01]"),
    ("osl-3", "osl|open software", r"open software licen[cs]e", r"osl (?:1|2|3) [01]"),
    ("pddl-1", "pddl|open data commons", r"(?:pddl|open data commons public domain dedication(?: and licen[cs]e)?)", r"pddl 1 0"),
    ("php-3", "php", r"php licen[cs]e", r"php 3 0[01]?"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("psf-2", "python|psf", r"(?:python software foundation licen[cs]e|psf licen[cs]e|python licen[cs]e)", r"(?:psf|python) 2 0"),
    ("ql-1", "q public|qpl", r"q public licen[cs]e", r"qpl 1 0"),
    ("rail", "openrail|open rail|openrail m|responsible ai", r"(?:open ?rail(?: m)?|responsible ai licen[cs]e)", None),
    ("sspl-1", "sspl|server side", r"(?:server side public licen[cs]e|sspl)", r"sspl 1 0"),
    ("unlicense", "unlicense|unlicence", r"the unlicen[cs]e", r"unlicense"),
    ("upl-1", "universal permissive|upl", r"universal permissive licen[cs]e", r"upl 1 0"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e", r"w3c(?: 19980720)?"),
    ("wtfpl", "wtfpl|do what the", r"(?:wtfpl|do what the fuck you want to public licen[cs]e)", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    ("zpl-2.1", "zope|zpl", r"zope public licen[cs]e", r"zpl (?:1 1|2 [01])"),
)

#: Wording around a name ({0}), with the confidence of what it finds; better ones come first.
WORDINGS = (
    (0.95, r"(?:(?:is|are|be|been) )?(?:licen[cs]ed|released|distributed|published|available|provided|covered|redistributed)(?: \w+){{0,3}}? (?:under|by)(?: the)?(?: terms of)?(?: the)? {0}"),
    (0.9, r"(?:under|subject to|governed by|according to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {0}"),
    (0.85, r"(?:licen[cs]e|copying|licen[cs]e type|terms) {0}"),
)

#: Passages of license texts themselves: label, keyword, regex.
PASSAGES = (
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-3-clause", "neither the name", r"neither the name of (?:\w+ ){1,12}?nor the names of its contributors may be used to endorse"),
    ("bsd-2-clause", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-4-clause", "all advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "you may not use this file", r"you may not use this file except in compliance with the license"),
    ("gpl", "free software you can", r"free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software you can", r"free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "free software you can", r"free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-1", "accompanying program", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("bsl-1", "permission is hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("wtfpl", "do what the", r"you just do what the fuck you want to"),
    ("cc0-1", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "may not be", r"may not be (?:copied|reproduced|redistributed|distributed)(?: \w+){0,8}? without (?:the )?(?:prior |express |written )+(?:permission|consent)"),
    ("non-commercial", "for non|for noncommercial", r"for non ?commercial (?:use|purposes) only"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    confidence: float
    regex: re.Pattern[bytes]


@cache
def rules() -> tuple[tuple[tuple[tuple[bytes, bytes], ...], tuple[tuple[int, Rule], ...]], ...]:
    """Rules by keywords, each with its priority (smaller is better): identifiers, passages, worded names, bare names.

    Within a kind the order of the tables holds. A rule matches whole words only.
    """
    found: list[tuple[str, Rule]] = []

    def add(label: str, keyword: str, confidence: float, regex: str) -> None:
        found.append((keyword, Rule(label, confidence, re.compile(rf"(?<= )(?:{regex})(?= )".encode()))))

    for label, _, _, tag in NAMES:
        if tag:
            add(label, "spdx", 1.0, rf"spdx license identifier {tag}")
    for label, keyword, regex in PASSAGES:
        add(label, keyword, 0.95 if label not in ("all-rights-reserved", "public-domain") else 0.6, regex)
    for confidence, wording in WORDINGS:
        for label, keyword, name, _ in NAMES:
            add(label, keyword, confidence, wording.format(name))
    for label, keyword, name, _ in NAMES:
        if " " in name or "licen" in name:
            add(label, keyword, 0.7, name if "licen" in name else rf"{name}(?: licen[cs]e)")
    by: dict[str, list[tuple[int, Rule]]] = {}
    for priority, (keyword, rule) in enumerate(found):
        by.setdefault(keyword, []).append((priority, rule))
    return tuple((tuple((k.split()[0].encode(), f" {k} ".encode()) for k in words.split("|")), tuple(some)) for words, some in by.items())


@cache
def first_words() -> frozenset[bytes]:
    """The first words of all keywords."""
    return frozenset(f for keys, _ in rules() for f, _ in keys)


def normal(text: bytes) -> tuple[bytes, list[bytes]]:
    """The words with one space around each, and their list."""
    words = text.translate(TO_WORDS).split()
    return (b" " + b" ".join(words) + b" " if words else b" "), words


def places(words: bytes, phrase: str) -> Iterator[int]:
    """Word positions at which the phrase stands, ascending; places may share words."""
    needle, at, done, count = f" {phrase} ".encode(), 0, 0, 0
    while (at := words.find(needle, at)) >= 0:
        count += words.count(b" ", done, at)
        done = at
        yield count
        at += 1


def detections(words: bytes, distinct: set[bytes]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) in bytes of the normal text, best rule first; none lies inside another that is kept."""
    if distinct.isdisjoint(first_words()):
        return []
    hits = [(p, m.start(), m.end(), r) for keys, some in rules() if any(f in distinct and k in words for f, k in keys) for p, r in some for m in r.regex.finditer(words)]
    kept: list[tuple[int, int, Rule]] = []
    # a longer place of an equal rule goes first, so that it is not split
    hits.sort(key=lambda h: (h[0], h[1] - h[2], h[1]))
    taken: list[tuple[int, int]] = []
    longest = 0
    for _, a, b, rule in hits:
        at = bisect_right(taken, (a, len(words)))
        while at and taken[at - 1][0] >= a - longest and taken[at - 1][1] < b:
            at -= 1
        if at and taken[at - 1][0] >= a - longest:
            continue
        kept.append((a, b, rule))
        insort(taken, (a, b))
        longest = max(longest, b - a)
    return kept


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words, parts = normal(text)
    distinct = set(parts)
    base = {label: list(places(words, phrase)) if distinct.issuperset(phrase.encode().split()) else [] for phrase, label in BASE}
    at = [k for some in base.values() for k in some]
    own = detections(words, distinct)
    base_labels = sorted(label for label, some in base.items() if some)
    labels = sorted({*base_labels, *(r.label for _, _, r in own)})
    score = max([0.9 if at else 0.0, *(r.confidence for _, _, r in own)])
    return len(parts), len(at), min(at, default=None), max(at, default=None), ",".join(base_labels), ",".join(labels), score


_RESULT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [scan(t) for t in texts_of(b.column("text"))]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RESULT.types, strict=True)] if rows else [pa.array([], t) for t in _RESULT.types]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *_RESULT.names])


def licenses(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; a row for each row.

    Null and empty texts have no words, no labels (empty strings) and score 0. Other columns are ignored; null and
    repeated ids are kept as they are. Empty input: empty result. Whole texts are scanned, one at a time.
    """
    prepare(docs.sparkSession)
    few = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(_scans, f"doc_id {few.dtypes[0][1]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license scan of every document."""
    return licenses(table(spark, sf_dir, "documents"))
