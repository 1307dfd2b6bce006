"""License scan by ordered signature rules.

A text is read as lower-case words with single spaces. Each rule is a regex over that form with a
label, a priority, a weight, and keywords that must all occur in the text before the regex is
tried; most texts have no keyword and meet no regex. Overlapping detections are settled by priority: a detection goes if
its interval lies within that of another of the same or a higher priority (of equals, the earlier rule stays).
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from loometric.llm.common import id_and_text

# Base phrases and their labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# (label, name, identifier) of the licenses the rules know; names and identifiers are regexes over words.
LICENSES = (
    ("mit", "mit", "mit(?: 0)?"),
    ("apache", "apache(?: software)?", "apache 2 0"),
    ("gpl", "(?:gnu )?general public|(?:gnu )?gpl(?: ?v?[123])?", "gpl [123] 0(?: only| or later)?"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public|(?:gnu )?lgpl(?: ?v?[23])?", "lgpl [23] [01](?: only| or later)?"),
    ("agpl", "(?:gnu )?affero general public|(?:gnu )?agpl(?: ?v?3)?", "agpl 3 0(?: only| or later)?"),
    ("bsd", "(?:(?:new|modified|simplified|revised|original|[234]|two|three|four)(?: clause)? )?bsd", "bsd [0234] clause(?: patent| clear)?"),
    ("mpl", "mozilla public|mpl", "mpl [12] [01]"),
    ("epl", "eclipse public|epl", "epl [12] 0"),
    ("edl", "eclipse distribution", "edl 1 0"),
    ("cddl", "common development and distribution|cddl", "cddl 1 [01]"),
    ("cpl", "common public", "cpl 1 0"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("boost", "boost(?: software)?", "bsl 1 0"),
    ("artistic", "(?:perl )?artistic", "artistic [12] 0"),
    ("unlicense", "unlicense|the unlicense", "unlicense"),
    ("wtfpl", "wtfpl|do what the fuck you want to public", "wtfpl"),
    ("eupl", "european union public|eupl", "eupl 1 [012]"),
    ("osl", "open software", "osl [123] [01]"),
    ("afl", "academic free", "afl [123] [01]"),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("psf", "python software foundation|psf", "psf 2 0"),
    ("php", "php", "php 3 01?"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql"),
    ("x11", "x11", "x11"),
    ("w3c", "w3c(?: software)?(?: notice)?", "w3c"),
    ("ofl", "(?:sil )?open font", "ofl 1 [01]"),
    ("ms-pl", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "ms rl"),
    ("cecill", "cecill(?: [abc])?", "cecill [12] [01]"),
    ("odbl", "open database|odbl", "odbl 1 0"),
    ("odc-by", "open data commons attribution", "odc by 1 0"),
    ("pddl", "public domain dedication and", "pddl 1 0"),
    ("cc0", "cc0|creative commons (?:zero|cc0)", "cc0 1 0"),
    ("cc-by", "creative commons attribution|cc by", "cc by [1234] [05]"),
    ("cc-by-sa", "creative commons attribution share ?alike|cc by sa", "cc by sa [1234] [05]"),
    ("cc-by-nc", "creative commons attribution non ?commercial|cc by nc", "cc by nc [1234] [05]"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s|cc by nd", "cc by nd [1234] [05]"),
    ("gfdl", "(?:gnu )?free documentation|gfdl", "gfdl 1 [123]"),
    ("bsl", "business source", "busl 1 1"),
    ("sspl", "server side public|sspl", "sspl 1 0"),
    ("elastic", "elastic", "elastic 2 0"),
    ("mulan", "mulan permissive(?: software)?", "mulanpsl [12] 0"),
    ("bouncy-castle", "bouncy castle", "bouncy castle"),
)

# Forms in which a license is named: (regex with {name} or {id}, keywords, priority, weight).
FORMS = (
    (r"\bspdx license identifier {id}\b", ("spdx",), 60, 1.0),
    (r"\blicen[cs]e(?:d)?(?: is)? under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]e)?(?: version)?(?: v?\d+)*", ("licen", "under"), 50, 0.95),
    (r"\b(?:released|published|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]e)(?: version)?(?: v?\d+)*",
     ("licen", "under"), 50, 0.95),
    (r"\bsubject to the (?:terms of the )?(?:{name}) licen[cs]e(?: version)?(?: v?\d+)*", ("licen", "subject"), 40, 0.9),
    (r"\b(?:{name}) licen[cs]e(?:s|d)?(?: version)?(?: v?\d+)*", ("licen",), 30, 0.8),
    (r"\blicen[cs]e {id}\b", ("licen",), 20, 0.7),
)

# Signatures of license bodies and notices, written out: (label, regex, keywords, priority, weight).
TEXTS = (
    ("mit", r"\bpermission is hereby granted free of charge to any person obtaining a copy of this software\b", ("permission",), 70, 1.0),
    ("mit", r"\bthe above copyright notice and this permission notice shall be included in all copies\b", ("notice",), 65, 0.9),
    ("isc", r"\bpermission to use copy modify and or distribute this software for any purpose with or without fee\b", ("permission",), 70, 1.0),
    ("bsd", r"\bredistribution and use in source and binary forms with or without modification are permitted\b", ("redistribution",), 70, 1.0),
    ("bsd", r"\bneither the name of .{1,120}? nor the names of its contributors may be used to endorse\b", ("endorse",), 65, 0.9),
    ("apache", r"\byou may not use this file except in compliance with the license\b", ("compliance",), 70, 0.95),
    ("apache", r"\bwww apache org licenses license 2 0\b", ("apache",), 70, 1.0),
    ("gpl", r"\bis free software you can redistribute it and or modify it under the terms of the gnu general public license\b", ("redistribute",), 70, 1.0),
    ("lgpl", r"\bis free software you can redistribute it and or modify it under the terms of the gnu lesser general public license\b",
     ("redistribute",), 71, 1.0),
    ("agpl", r"\bis free software you can redistribute it and or modify it under the terms of the gnu affero general public license\b",
     ("redistribute",), 71, 1.0),
    ("mpl", r"\bthis source code form is subject to the terms of the mozilla public license\b", ("mozilla",), 70, 1.0),
    ("unlicense", r"\bthis is free and unencumbered software released into the public domain\b", ("unencumbered",), 70, 1.0),
    ("public-domain", r"\b(?:released|dedicated|placed|placed this work|in) (?:in |in to |into |to )?the public domain\b", ("public domain",), 40, 0.7),
    ("boost", r"\bpermission is hereby granted free of charge to any person or organization obtaining a copy of the software\b", ("permission",), 70, 1.0),
    ("zlib", r"\bthe origin of this software must not be misrepresented\b", ("misrepresented",), 70, 0.95),
    ("cc", r"\bcreative ?commons org licenses [a-z ]{2,20}\d \d\b", ("creative",), 60, 0.9),
    ("proprietary", r"\bproprietary and confidential\b", ("proprietary",), 30, 0.6),
    ("all-rights-reserved", r"\ball rights reserved\b", ("rights reserved",), 10, 0.4),
)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    weight: float


def rules() -> list[Rule]:
    """All signature rules, first the ones that are tried first."""
    found = [Rule(label, pattern, keywords, priority, weight) for label, pattern, keywords, priority, weight in TEXTS]
    for label, name, identifier in LICENSES:
        # the longest plain run of letters in every variant of the name must occur as well
        own = _common_keyword(name)
        for form, keywords, priority, weight in FORMS:
            words = keywords if "{id}" in form or own is None else (*keywords, own)
            found.append(Rule(label, form.format(name=name, id=identifier), words, priority, weight))
    return sorted(found, key=lambda r: -r.priority)


def _common_keyword(name: str) -> str | None:
    """A plain word that all variants of a name hold, where there is one."""
    variants = [set(re.findall(r"[a-z]{3,}", re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", " ", part))) for part in re.split(r"\|(?![^(]*\))", name)]
    common = set.intersection(*variants)
    return max(common, key=lambda w: (len(w), w)) if common else None


# Bytes that words are made of stay, A-Z is lower-cased, all others part words (fixed rule).
_PLAIN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def plain_words(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


class Scanner:
    """All rules, compiled."""

    def __init__(self, chosen: list[Rule]):
        self.rules = [(rule, re.compile(rule.pattern)) for rule in chosen]
        self.keywords = sorted({w for rule in chosen for w in rule.keywords})
        # no rule can hold without its first keyword, and these are few; base phrases hold one as well
        self.leads = sorted({rule.keywords[0].encode() for rule in chosen} | {b"licen"})

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) in the plain text, after suppression, by start."""
        present = {w for w in self.keywords if w in text}
        found = []
        for order, (rule, pattern) in enumerate(self.rules):
            if present.issuperset(rule.keywords):
                found += [(m.start(), m.end(), order, rule) for m in pattern.finditer(text)]
        # widest first among starts: a detection can only lie within one that stands before it here
        found.sort(key=lambda d: (d[0], -d[1], d[2]))
        kept: list[tuple[int, int, int, Rule]] = []
        open_ones: list[tuple[int, int, int, Rule]] = []
        for start, end, order, rule in found:
            open_ones = [d for d in open_ones if d[1] > start]
            inside = any(d[1] >= end and d[3].priority >= rule.priority for d in open_ones)
            if not inside:
                # the same interval with a lower priority goes as well
                for d in [d for d in open_ones if d[:2] == (start, end) and d[3].priority < rule.priority]:
                    kept.remove(d)
                    open_ones.remove(d)
                kept.append((start, end, order, rule))
                open_ones.append(kept[-1])
        return [(start, end, rule) for start, end, _, rule in kept]


DETECTIONS = "array<struct<label:string,first_word:int,end_word:int,priority:int,weight:double>>"
SCAN = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        f"detections {DETECTIONS}")


def scan_text(scanner: Scanner, text: str) -> tuple:
    """A row of SCAN."""
    words = plain_words(text)
    body = b" ".join(words)
    if not any(w in body for w in scanner.leads):
        return len(words), 0, None, None, "", "", 0.0, []
    plain = body.decode()
    spaces = [m.start() for m in re.finditer(" ", plain)]

    def word_at(place: int) -> int:
        return bisect.bisect_left(spaces, place)

    starts, base_labels = [], set()
    padded = f" {plain} "
    for phrase, label in BASE:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            starts.append(word_at(at))
            base_labels.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    found = scanner.detections(plain)
    labels = base_labels | {rule.label for _, _, rule in found}
    score = max([rule.weight for _, _, rule in found] + [0.8] * bool(starts), default=0.0)
    shown = [{"label": rule.label, "first_word": word_at(a), "end_word": word_at(b) + 1, "priority": rule.priority,
              "weight": rule.weight} for a, b, rule in found]
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
            ",".join(sorted(labels)), score, shown)


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chosen: list[Rule] | None = None) -> DataFrame:
    """One row for each row of ``docs``: words, base places, labels, score and the detections.

    ``detections`` has word numbers, from 0, the end exclusive. ``score`` is the weight of the surest
    detection, 0 without any. Null and empty texts have no words and no labels. Repeated rows are
    scanned each; an empty table gives an empty result.
    """
    rows = id_and_text(docs, id_column, text_column)
    picked = rules() if chosen is None else chosen
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
             pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("priority", pa.int32()),
                                 ("weight", pa.float64())])))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(picked)
        for batch in batches:
            if batch.num_rows:
                found = list(zip(*[scan_text(scanner, t.as_py()) for t in batch.column("text")]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(found, kinds)]], names=["id", *names])

    schema = f"id {docs.schema[id_column].dataType.simpleString()}, {SCAN}"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
