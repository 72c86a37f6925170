"""Signature rules for licences: families of hand-written patterns and the rules made of them.

Patterns run over normalised text: words of [0-9a-z] and non-ASCII letters, one space
between, so "GPL-2.0" reads "gpl 2 0".  Each family gives a rule for its bare name, one per
version and form of writing it, and one per identifier tag.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

NAME, VERSIONED, LATER, TAGGED, NOTICE = 1, 2, 3, 4, 5
STRENGTH = {NAME: 0.5, VERSIONED: 0.7, LATER: 0.8, TAGGED: 0.95, NOTICE: 0.9}


@dataclass(frozen=True)
class Rule:
    """priority: of overlapping detections the higher one stays; gates: words of which the text must have one."""

    name: str
    label: str
    gates: frozenset[str]
    pattern: re.Pattern
    priority: int


# label: (words preferred as gates, full names, identifiers, versions, whether "or later" is said of it)
FAMILIES: dict[str, tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...], bool]] = {
    "gpl": ("gnu", (r"gnu (?:general public|gpl) licen[cs]e", r"gnu gpl"), ("gpl",), ("1", "2", "3"), True),
    "lgpl": ("gnu", (r"gnu (?:lesser|library) general public licen[cs]e", r"gnu lgpl"), ("lgpl",), ("2", "2.1", "3"), True),
    "agpl": ("gnu", (r"gnu affero general public licen[cs]e", r"gnu agpl"), ("agpl",), ("1", "3"), True),
    "gfdl": ("gnu", (r"gnu free documentation licen[cs]e", r"gnu fdl"), ("gfdl",), ("1.1", "1.2", "1.3"), True),
    "apache": ("apache", (r"apache (?:software )?licen[cs]e",), ("apache", "asl"), ("1.0", "1.1", "2.0"), False),
    "mit": ("mit", (r"(?:the )?mit licen[cs]e", r"mit style licen[cs]e"), ("mit",), (), False),
    "mit-0": ("mit", (r"mit no attribution licen[cs]e", r"mit 0 licen[cs]e"), ("mit 0",), (), False),
    "bsd": ("bsd berkeley", (r"bsd licen[cs]e", r"berkeley software distribution licen[cs]e"), ("bsd",), (), False),
    "bsd-0": ("bsd", (r"(?:zero|0) clause bsd(?: licen[cs]e)?",), ("0bsd",), (), False),
    "bsd-1": ("bsd", (r"(?:one|1) clause bsd(?: licen[cs]e)?",), ("bsd 1 clause",), (), False),
    "bsd-2": ("bsd", (r"(?:two|2) clause bsd(?: licen[cs]e)?", r"(?:simplified|freebsd) bsd licen[cs]e"), ("bsd 2 clause",), (), False),
    "bsd-3": ("bsd", (r"(?:three|3) clause bsd(?: licen[cs]e)?", r"(?:new|revised|modified) bsd licen[cs]e"), ("bsd 3 clause",), (), False),
    "bsd-4": ("bsd", (r"(?:four|4) clause bsd(?: licen[cs]e)?", r"original bsd licen[cs]e"), ("bsd 4 clause",), (), False),
    "mpl": ("mozilla", (r"mozilla public licen[cs]e",), ("mpl",), ("1.0", "1.1", "2.0"), False),
    "epl": ("eclipse", (r"eclipse public licen[cs]e",), ("epl",), ("1.0", "2.0"), False),
    "edl": ("eclipse", (r"eclipse distribution licen[cs]e",), ("edl",), ("1.0",), False),
    "cddl": ("common", (r"common development and distribution licen[cs]e",), ("cddl",), ("1.0", "1.1"), False),
    "cpl": ("common", (r"common public licen[cs]e",), ("cpl",), ("1.0",), False),
    "cpal": ("common", (r"common public attribution licen[cs]e",), ("cpal",), ("1.0",), False),
    "artistic": ("artistic", (r"(?:perl )?artistic licen[cs]e",), ("artistic",), ("1.0", "2.0"), False),
    "osl": ("open", (r"open software licen[cs]e",), ("osl",), ("1.0", "1.1", "2.0", "2.1", "3.0"), False),
    "afl": ("academic", (r"academic free licen[cs]e",), ("afl",), ("1.1", "1.2", "2.0", "2.1", "3.0"), False),
    "ecl": ("educational", (r"educational community licen[cs]e",), ("ecl",), ("1.0", "2.0"), False),
    "eupl": ("european", (r"european union public licen[cs]e",), ("eupl",), ("1.0", "1.1", "1.2"), False),
    "cecill": ("cecill", (r"cecill(?: free software)? licen[cs]e", r"licence cecill"), ("cecill",), ("1.0", "1.1", "2.0", "2.1"), False),
    "cecill-b": ("cecill", (r"cecill b licen[cs]e",), ("cecill b",), (), False),
    "cecill-c": ("cecill", (r"cecill c licen[cs]e",), ("cecill c",), (), False),
    "boost": ("boost", (r"boost software licen[cs]e",), ("bsl",), ("1.0",), False),
    "zlib": ("zlib", (r"zlib(?: libpng)? licen[cs]e",), ("zlib",), (), False),
    "libpng": ("libpng", (r"libpng licen[cs]e",), ("libpng",), ("2.0",), False),
    "isc": ("isc", (r"isc licen[cs]e",), ("isc",), (), False),
    "unlicense": ("unlicense", (r"the unlicense", r"unlicense"), ("unlicense",), (), False),
    "wtfpl": ("wtfpl", (r"wtfpl",), ("wtfpl",), ("1", "2"), False),
    "python": ("python psf", (r"python (?:software foundation )?licen[cs]e", r"psf licen[cs]e agreement"), ("python", "psf"), ("2", "2.0", "3.0"), False),
    "php": ("php", (r"php licen[cs]e",), ("php",), ("3.0", "3.01"), False),
    "ruby": ("ruby", (r"ruby licen[cs]e", r"licensed under the same terms as ruby"), ("ruby",), (), False),
    "perl": ("perl", (r"same terms as perl(?: itself)?",), ("perl",), ("5",), False),
    "openssl": ("openssl ssleay", (r"openssl licen[cs]e", r"ssleay licen[cs]e"), ("openssl",), (), False),
    "postgresql": ("postgresql", (r"postgresql licen[cs]e",), ("postgresql",), (), False),
    "ms-pl": ("microsoft", (r"microsoft public licen[cs]e",), ("ms pl",), (), False),
    "ms-rl": ("microsoft", (r"microsoft reciprocal licen[cs]e",), ("ms rl",), (), False),
    "ofl": ("font", (r"(?:sil )?open font licen[cs]e",), ("ofl",), ("1.0", "1.1"), False),
    "beerware": ("beer beerware", (r"beer ?ware licen[cs]e",), ("beerware",), (), False),
    "x11": ("x11 consortium", (r"x11 licen[cs]e", r"x consortium licen[cs]e"), ("x11",), (), False),
    "ncsa": ("ncsa", (r"(?:university of illinois )?ncsa open source licen[cs]e",), ("ncsa",), (), False),
    "w3c": ("w3c", (r"w3c software (?:notice and )?licen[cs]e",), ("w3c",), ("20150513", "19980720"), False),
    "zpl": ("zope", (r"zope public licen[cs]e",), ("zpl",), ("1.1", "2.0", "2.1"), False),
    "qpl": ("public", (r"q public licen[cs]e",), ("qpl",), ("1.0",), False),
    "sleepycat": ("sleepycat", (r"sleepycat licen[cs]e",), ("sleepycat",), (), False),
    "ipl": ("ibm", (r"ibm public licen[cs]e",), ("ipl",), ("1.0",), False),
    "apsl": ("apple", (r"apple public source licen[cs]e",), ("apsl",), ("1.0", "1.1", "1.2", "2.0"), False),
    "npl": ("netscape", (r"netscape public licen[cs]e",), ("npl",), ("1.0", "1.1"), False),
    "lppl": ("latex", (r"latex project public licen[cs]e",), ("lppl",), ("1.0", "1.1", "1.2", "1.3"), False),
    "odbl": ("database", (r"open database licen[cs]e",), ("odbl",), ("1.0",), False),
    "odc-by": ("commons", (r"open data commons attribution licen[cs]e",), ("odc by",), ("1.0",), False),
    "pddl": ("domain", (r"public domain dedication and licen[cs]e",), ("pddl",), ("1.0",), False),
    "cc0": ("cc0 creative", (r"cc0(?: public domain dedication)?", r"creative commons zero"), ("cc0",), ("1.0",), False),
    "elastic": ("elastic", (r"elastic licen[cs]e",), ("elastic",), ("1.0", "2.0"), False),
    "sspl": ("server", (r"server side public licen[cs]e",), ("sspl",), ("1.0",), False),
    "busl": ("business", (r"business source licen[cs]e",), ("busl",), ("1.0", "1.1"), False),
    "upl": ("universal", (r"universal permissive licen[cs]e",), ("upl",), ("1.0",), False),
    "bluoak": ("oak", (r"blue oak model licen[cs]e",), ("blueoak",), ("1.0.0",), False),
    "mulan": ("mulan", (r"mulan (?:permissive software|psl) licen[cs]e",), ("mulanpsl",), ("1.0", "2.0"), False),
    "vim": ("vim", (r"vim licen[cs]e",), ("vim",), (), False),
    "json": ("json", (r"json licen[cs]e",), ("json",), (), False),
    "icu": ("icu", (r"icu licen[cs]e",), ("icu",), (), False),
    "unicode": ("unicode", (r"unicode (?:data files and software )?licen[cs]e",), ("unicode",), ("3.0",), False),
    "ftl": ("freetype", (r"freetype (?:project )?licen[cs]e",), ("ftl",), (), False),
    "proprietary": ("rights", (r"all rights reserved",), (), (), False),
}

# Identifiers that are also names of programs and the like: glued versions ("python3") count in a licence context only.
PLAIN = {"python", "perl", "php", "ruby", "elastic", "unicode", "w3c", "libpng", "zlib", "vim", "json", "icu", "openssl", "postgresql", "x11", "artistic"}
UNDER = r"(?:licen[cs]ed|released|distributed|available|published|provided|covered) (?:under|by|with)(?: the)?(?: terms of(?: the)?)?"
FIELD = r"licen[cs]e(?: is| type)?"

CC_PARTS = {"by": r"by", "by-sa": r"by sa", "by-nd": r"by nd", "by-nc": r"by nc", "by-nc-sa": r"by nc sa", "by-nc-nd": r"by nc nd"}
CC_NAMES = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s",
    "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# (label, word preferred as gate, phrase of the licence's own text)
NOTICES: tuple[tuple[str, str, str], ...] = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "endorse", r"neither the name of .{1,120}? may be used to endorse or promote products"),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software"),
    ("apache", "apache", r"licensed under the apache licen[cs]e(?: version \d(?: \d)?)?"),
    ("apache", "apache", r"www apache org licenses licen[cs]e \d \d"),
    ("gpl", "gnu", r"under the terms of the gnu general public licen[cs]e"),
    ("gpl", "gnu", r"www gnu org licenses(?: gpl)?"),
    ("lgpl", "gnu", r"under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "gnu", r"under the terms of the gnu affero general public licen[cs]e"),
    ("gfdl", "gnu", r"under the terms of the gnu free documentation licen[cs]e"),
    ("mpl", "mozilla", r"subject to the terms of the mozilla public licen[cs]e"),
    ("mit", "mit", r"(?:released|licensed|distributed|available) under the (?:terms of the )?mit licen[cs]e"),
    ("boost", "boost", r"distributed under the boost software licen[cs]e"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("wtfpl", "want", r"do what the f\w+ you want to public licen[cs]e"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("cc-by", "creative", r"creative commons attribution(?: \d \d)?(?: international)? licen[cs]e"),
    ("cc-by", "cc", r"licensed under cc by"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthori[sz]ed (?:copying|use|distribution|reproduction) of this"),
    ("commons-clause", "clause", r"commons clause licen[cs]e condition"),
)


def _spoken(version: str) -> str:
    """"2.0" as normalised text has it; a trailing zero may be left out."""
    parts = version.split(".")
    if len(parts) == 1:
        return rf"{parts[0]}(?: 0)?"
    return " ".join(parts[:-1]) + (rf"(?: {parts[-1]})?" if parts[-1] == "0" else rf" {parts[-1]}")


def _parts(pattern: str, at: int = 0) -> tuple[list[str], int]:
    """All texts that the alternatives from `at` on match, up to their closing bracket; "\0" is any run of characters."""
    done: list[str] = []
    texts = [""]
    while at < len(pattern) and pattern[at] != ")":
        if pattern[at] == "|":
            done, texts, at = done + texts, [""], at + 1
            continue
        if pattern.startswith("(?:", at):
            atom, at = _parts(pattern, at + 3)
            at += 1
        elif pattern[at] == "[":
            end = pattern.index("]", at)
            atom, at = list(pattern[at + 1 : end]), end + 1
        elif pattern[at] in "\\.":
            atom, at = ["\0"], at + (1 if pattern[at] == "." else 2)
        elif pattern[at].isalnum() or pattern[at] == " ":
            atom, at = [pattern[at]], at + 1
        else:
            raise ValueError(f"{pattern[at:]!r} is not understood")
        if many := re.match(r"\+|\{[1-9]\d*,\d+\}\??", pattern[at:]):
            atom, at = ["\0"], at + many.end()
        elif pattern[at : at + 1] == "?":
            atom, at = [*atom, ""], at + 1
        texts = [x + y for x in texts for y in atom]
    return done + texts, at


def written(pattern: str) -> list[str]:
    """All texts that a pattern matches."""
    return _parts(pattern)[0]


def _gates(pattern: str, preferred: str) -> frozenset[str]:
    """One word of every text that the pattern matches: a preferred one, one that begins so ("gplv2"), or the longest."""
    first, found = preferred.split(), set()
    for text in written(pattern):
        words = [w for w in text.split() if "\0" not in w]
        found.add(next((x for x in first if x in words), None) or max(words, key=lambda w: (any(w.startswith(x) for x in first), len(w), w)))
    return frozenset(found)


def _rule(name: str, label: str, preferred: str, pattern: str, priority: int) -> Rule:
    return Rule(name, label, _gates(pattern, preferred), re.compile(rf"(?<= )(?:{pattern})(?= )".encode()), priority)


def _in_context(i: str, said: str) -> str:
    """An identifier where a licence is spoken of; one that is also a plain name needs a verb."""
    before = UNDER if i in PLAIN else rf"(?:{UNDER}|{FIELD})"
    return rf"{before} {i}{said}(?: licen[cs]e)?|{i}{said} licen[cs]ed?"


def build_rules() -> list[Rule]:
    rules = []
    for label, (gate, names, ids, versions, later) in FAMILIES.items():
        name = "|".join(names)
        rules.append(_rule(f"{label}:name", label, gate, name, NAME))
        for v in versions:
            said = _spoken(v)
            rules.append(_rule(f"{label}-{v}:name", f"{label}-{v}", gate, rf"(?:{name})(?: version)?(?: v)? ?v?{said}", VERSIONED))
            if later:
                rules.append(_rule(f"{label}-{v}:later", f"{label}-{v}-or-later", gate, rf"(?:{name})(?: as published by the free software foundation)?(?: either)?(?: version)? ?v?{said}(?: of the licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?", LATER))
        for i in ids:
            rules.append(_rule(f"{label}:tag {i}", label, "spdx", rf"spdx licen[cs]e identifier {i}", TAGGED))
            for v in versions:
                rules.append(_rule(f"{label}-{v}:tag {i}", f"{label}-{v}", "spdx", rf"spdx licen[cs]e identifier {i} {_spoken(v)}(?: (?:only|or later))?", TAGGED))
                between = " " if i in PLAIN else "(?: version)? ?"
                rules.append(_rule(f"{label}-{v}:id {i}", f"{label}-{v}", i.split()[0], rf"{i}{between}v?{_spoken(v)}(?: (?:only|or later))?", VERSIONED))
                if i in PLAIN:
                    rules.append(_rule(f"{label}-{v}:context {i}", f"{label}-{v}", i, _in_context(i, rf"(?: version)? ?v?{_spoken(v)}"), VERSIONED))
            rules.append(_rule(f"{label}:context {i}", label, i.split()[0], _in_context(i, ""), NAME))
    for part, written in CC_PARTS.items():
        label = f"cc-{part}"
        rules.append(_rule(f"{label}:id", label, "cc", rf"cc {written}", NAME))
        rules.append(_rule(f"{label}:name", label, "commons", rf"creative commons {CC_NAMES[part]}", NAME))
        for v in CC_VERSIONS:
            rules.append(_rule(f"{label}-{v}:id", f"{label}-{v}", "cc", rf"cc {written} {_spoken(v)}", VERSIONED))
            rules.append(_rule(f"{label}-{v}:name", f"{label}-{v}", "commons", rf"creative commons {CC_NAMES[part]} {_spoken(v)}(?: international| unported)?", VERSIONED))
            rules.append(_rule(f"{label}-{v}:url", f"{label}-{v}", "creativecommons", rf"creativecommons org licenses {written} {_spoken(v)}", TAGGED))
    for k, (label, gate, pattern) in enumerate(NOTICES):
        rules.append(_rule(f"{label}:notice{k}", label, gate, pattern, NOTICE))
    return rules
