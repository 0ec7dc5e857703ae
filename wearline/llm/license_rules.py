"""The ordered signature rules of the licence scan.

A rule is (order, label, keyword, regex, weight, priority). Regexes are written over normalised text: lower-case words with one
space before and after each of them, so every regex starts at a space and looks ahead to one. The keyword is a run of whole words every match contains.
Families and sentences below are written by hand; the wording around a family's name comes from the templates.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str
    regex: str
    weight: float
    priority: int


#: The phrases that always count, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, keyword, name as a regex over words, versions as (words, label).
FAMILIES = (
    ("mit", "mit", r"mit(?: x11)?", ()),
    ("apache", "apache", r"apache(?: software)?", (("1 0", "apache-1.0"), ("1 1", "apache-1.1"), ("2 0", "apache-2.0"), ("2", "apache-2.0"))),
    ("gpl", "general public", r"(?:gnu )?general public", (("1", "gpl-1.0"), ("2", "gpl-2.0"), ("2 0", "gpl-2.0"), ("3", "gpl-3.0"), ("3 0", "gpl-3.0"))),
    ("gpl", "gpl", r"(?:gnu )?gpl", (("1", "gpl-1.0"), ("2", "gpl-2.0"), ("2 0", "gpl-2.0"), ("3", "gpl-3.0"), ("3 0", "gpl-3.0"), ("v2", "gpl-2.0"), ("v3", "gpl-3.0"))),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public", (("2 1", "lgpl-2.1"), ("3", "lgpl-3.0"), ("3 0", "lgpl-3.0"))),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", (("2 1", "lgpl-2.1"), ("3", "lgpl-3.0"), ("3 0", "lgpl-3.0"), ("v3", "lgpl-3.0"))),
    ("agpl", "affero", r"(?:gnu )?affero general public", (("3", "agpl-3.0"), ("3 0", "agpl-3.0"))),
    ("agpl", "agpl", r"(?:gnu )?agpl", (("3", "agpl-3.0"), ("3 0", "agpl-3.0"), ("v3", "agpl-3.0"))),
    ("bsd", "bsd", r"(?:(?:new|modified|simplified|original) )?bsd", (("2 clause", "bsd-2-clause"), ("3 clause", "bsd-3-clause"), ("4 clause", "bsd-4-clause"))),
    ("mpl", "mozilla", r"mozilla public", (("1 0", "mpl-1.0"), ("1 1", "mpl-1.1"), ("2 0", "mpl-2.0"))),
    ("mpl", "mpl", r"mpl", (("1 1", "mpl-1.1"), ("2 0", "mpl-2.0"))),
    ("epl", "eclipse", r"eclipse public", (("1 0", "epl-1.0"), ("2 0", "epl-2.0"))),
    ("cddl", "common development", r"common development and distribution", (("1 0", "cddl-1.0"), ("1 1", "cddl-1.1"))),
    ("cpl", "common public", r"common public", (("1 0", "cpl-1.0"),)),
    *(
        (label, keyword, name, tuple((f"{v}(?: (?:international|unported|generic))?", f"{label}-{v.replace(' ', '.')}") for v in ("1 0", "2 0", "2 5", "3 0", "4 0")))
        for label, long, short in (
            ("cc-by", r"", r""),
            ("cc-by-sa", r" (?:share ?alike|sa)", r" sa"),
            ("cc-by-nc", r" (?:non ?commercial|nc)", r" nc"),
            ("cc-by-nd", r" (?:no ?deriv(?:ative)?s|nd)", r" nd"),
            ("cc-by-nc-sa", r" (?:non ?commercial|nc) (?:share ?alike|sa)", r" nc sa"),
            ("cc-by-nc-nd", r" (?:(?:non ?commercial|nc) (?:no ?deriv(?:ative)?s|nd)|(?:no ?deriv(?:ative)?s|nd) (?:non ?commercial|nc))", r" (?:nc nd|nd nc)"),
        )
        for keyword, name in (("creative commons", f"creative commons (?:attribution|by){long}"), ("cc by", f"cc by{short}"))
    ),
    ("cc0", "cc0", r"cc0", (("1 0", "cc0-1.0"),)),
    ("isc", "isc", r"isc", ()),
    ("zlib", "zlib", r"zlib(?: libpng)?", ()),
    ("boost", "boost", r"boost software", (("1 0", "bsl-1.0"),)),
    ("artistic", "artistic", r"artistic", (("1 0", "artistic-1.0"), ("2 0", "artistic-2.0"))),
    ("unlicense", "unlicense", r"unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", (("2", "wtfpl-2"),)),
    ("psf", "python software", r"python software foundation", (("2", "psf-2.0"),)),
    ("ofl", "open font", r"(?:sil )?open font", (("1 0", "ofl-1.0"), ("1 1", "ofl-1.1"))),
    ("eupl", "european union public", r"european union public", (("1 1", "eupl-1.1"), ("1 2", "eupl-1.2"))),
    ("ms-pl", "microsoft public", r"microsoft public", ()),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", ()),
    ("upl", "universal permissive", r"universal permissive", (("1 0", "upl-1.0"),)),
    ("osl", "open software", r"open software", (("3 0", "osl-3.0"),)),
    ("afl", "academic free", r"academic free", (("2 1", "afl-2.1"), ("3 0", "afl-3.0"))),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", (("1 2", "gfdl-1.2"), ("1 3", "gfdl-1.3"))),
    ("odbl", "open database", r"open database", (("1 0", "odbl-1.0"),)),
    ("ncsa", "ncsa", r"ncsa(?: open source)?", ()),
    ("php", "php", r"php", (("3 0", "php-3.0"), ("3 01", "php-3.01"))),
    ("sleepycat", "sleepycat", r"sleepycat", ()),
    ("postgresql", "postgresql", r"postgresql", ()),
    ("openssl", "openssl", r"openssl", ()),
    ("vim", "vim", r"vim", ()),
    ("ruby", "ruby", r"ruby", ()),
    ("curl", "curl", r"curl", ()),
)

#: Sentences of licence texts.
SENTENCES = (
    ("mit", "permission is hereby granted", r" permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", r" permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", r" redistribution and use in source and binary forms"),
    ("apache", "as is basis", r" distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "free software", r" this program is free software you can redistribute it and or modify it"),
    ("lgpl", "free software", r" this library is free software you can redistribute it and or modify it"),
    ("gpl", "later version", r" either version \d(?: \d)? of the license or at your option any later version"),
    ("public-domain", "public domain", r" (?:released|dedicated|placed) (?:in)?to the public domain"),
    ("unlicense", "unencumbered", r" free and unencumbered software released into the public domain"),
    ("zlib", "altered source", r" altered source versions must be plainly marked as such"),
    ("boost", "derivative works", r" all derivative works of the software unless such copies"),
    ("proprietary", "all rights reserved", r" all rights reserved"),
)

#: What stands around a family's name, the weight of a match and its priority (0 goes first).
TEMPLATES = (
    (r" spdx license identifier {name}{version}", 1.0, 0),
    (r" (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?(?: version)?{version}", 0.95, 1),
    (r" (?:the )?{name} licen[sc]e(?: version)?{version}", 0.8, 2),
)
#: A bare name counts with a version only.
BARE = (r" {name}{version}", 0.5, 3)
LEVELS = 4


def rules() -> list[Rule]:
    """All rules in their order."""
    found = [Rule(label, keyword, f"{regex}(?= )", 0.9, 1) for label, keyword, regex in SENTENCES]
    for label, keyword, name, versions in FAMILIES:
        for words, own in (*versions, ("", label)):
            for template, weight, priority in (*TEMPLATES, *([BARE] if words else [])):
                found.append(Rule(own, keyword, template.format(name=name, version=f" {words}" if words else "") + "(?= )", weight, priority))
    return found


def triggers(table: list[Rule]) -> tuple[str, ...]:
    """Words one of which stands in every text that holds a base phrase or a rule's keyword: the longest word of each."""
    words = {max(phrase.split(), key=len) for phrase in (*[p for p, _ in BASE], *[r.keyword for r in table])}
    return tuple(sorted(w for w in words if not any(o != w and o in w for o in words)))


TRIGGERS = triggers(rules())
