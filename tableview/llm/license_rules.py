"""The ordered rules of the licence scan.

Patterns are written for normalised text: lower-case words of letters and digits with one blank
between them, so `Apache-2.0` is `apache 2 0` and `opensource.org/licenses/MIT` is
`opensource org licenses mit`. Names, sentences and addresses are written by hand; the forms in
which a name is used turn them into rules. A rule counts only where all its `needs` stand.
"""

from __future__ import annotations

from dataclasses import dataclass

#: No rule matches more words than this.
SPAN = 40

# Priorities: a detection inside one of better (smaller) or equal priority is suppressed.
TAG, TEXT, GRANT, VERSIONED, ADDRESS, NAMED, BARE = range(7)

#: How sure a detection of each priority is.
CONFIDENCE = {
    TAG: 1.0, TEXT: 1.0, GRANT: 0.95, VERSIONED: 0.9, ADDRESS: 0.85, NAMED: 0.7, BARE: 0.5,
}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    #: Words that must stand near; the first one is where the search begins.
    needs: tuple[str, ...]
    priority: int
    base: bool = False


# The phrases and labels that are found wherever their words stand.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

LICENSE = "licen[cs]e"
V = "(?:version |v |ver )?"

# Fixed values: (label, name pattern, word to search for, versions). In a versioned name `#`
# stands for the version.
VERSIONED_NAMES = [
    ("gpl", f"(?:gnu )?general public {LICENSE} {V}#", "general", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("gpl", "gnu gpl #", "gpl", ("2 0", "3 0", "2", "3")),
    ("gpl", "gpl #", "gpl", ("2 0", "3 0", "2", "3", "v2", "v3")),
    ("lgpl", f"(?:gnu )?(?:lesser|library) general public {LICENSE} {V}#", "general",
     ("2 1", "2 0", "3 0", "2", "3")),
    ("lgpl", "lgpl #", "lgpl", ("2 1", "2 0", "3 0", "2", "3", "v2 1", "v3")),
    ("agpl", f"(?:gnu )?affero general public {LICENSE} {V}#", "affero", ("1 0", "3 0", "1", "3")),
    ("agpl", "agpl #", "agpl", ("1 0", "3 0", "3", "v3")),
    ("gfdl", f"(?:gnu )?free documentation {LICENSE} {V}#", "documentation", ("1 1", "1 2", "1 3")),
    ("gfdl", "gfdl #", "gfdl", ("1 1", "1 2", "1 3")),
    ("apache", f"apache (?:software )?(?:{LICENSE} )?{V}#", "apache", ("1 0", "1 1", "2 0", "2")),
    ("apache", f"asl {V}#", "asl", ("1 1", "2 0", "2")),
    ("mpl", f"mozilla public {LICENSE} {V}#", "mozilla", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl #", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", f"eclipse public {LICENSE} {V}#", "eclipse", ("1 0", "2 0")),
    ("epl", "epl #", "epl", ("1 0", "2 0")),
    ("edl", f"eclipse distribution {LICENSE} {V}#", "eclipse", ("1 0",)),
    ("cddl", f"common development and distribution {LICENSE} {V}#", "development", ("1 0", "1 1")),
    ("cddl", "cddl #", "cddl", ("1 0", "1 1")),
    ("cpl", f"common public {LICENSE} {V}#", "common", ("0 5", "1 0")),
    ("afl", f"academic free {LICENSE} {V}#", "academic", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", f"open software {LICENSE} {V}#", "software", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("artistic", f"artistic {LICENSE} {V}#", "artistic", ("1 0", "2 0")),
    ("eupl", f"european union public li[cs]en[cs]e {V}#", "european", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl #", "eupl", ("1 0", "1 1", "1 2")),
    ("bsl", f"boost software {LICENSE} {V}#", "boost", ("1 0",)),
    ("busl", f"business source {LICENSE} {V}#", "business", ("1 0", "1 1")),
    ("sspl", f"server side public {LICENSE} {V}#", "server", ("1",)),
    ("elastic", f"elastic {LICENSE} {V}#", "elastic", ("1 0", "2 0", "2")),
    ("zpl", f"zope public {LICENSE} {V}#", "zope", ("1 1", "2 0", "2 1")),
    ("ofl", f"(?:sil )?open font {LICENSE} {V}#", "font", ("1 0", "1 1")),
    ("lppl", f"latex project public {LICENSE} {V}#", "latex", ("1 0", "1 1", "1 2", "1 3", "1 3c")),
    ("ms-pl", f"microsoft public {LICENSE} {V}#", "microsoft", ("1 0",)),
    ("qpl", f"q public {LICENSE} {V}#", "q", ("1 0",)),
    ("w3c", f"w3c software (?:notice and )?{LICENSE} {V}#", "w3c", ("1998", "2015")),
    ("php", f"php {LICENSE} {V}#", "php", ("3 0", "3 01")),
    ("psf", f"python software foundation {LICENSE} {V}#", "python", ("2", "2 0")),
    ("cecill", "cecill #", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("odc-by", f"open data commons attribution {LICENSE} {V}#", "commons", ("1 0",)),
    ("odbl", f"open (?:data commons open )?database {LICENSE} {V}#", "database", ("1 0",)),
    ("odbl", "odbl #", "odbl", ("1 0",)),
    ("cdla-permissive", "cdla permissive #", "cdla", ("1 0", "2 0")),
    ("cc0", "cc0 #", "cc0", ("1 0",)),
    ("openrail", f"(?:creativeml )?open rail m {LICENSE} {V}#", "rail", ("1 0",)),
    ("llama", f"llama (?:2|3) community {LICENSE} {V}#", "llama", ("2", "3")),
]

# Fixed values: (label, name pattern, words it needs), without a version.
PLAIN_NAMES = [
    ("gpl", "gnu gpl", ("gpl",)),
    ("lgpl", f"gnu (?:lesser|library) general public {LICENSE}", ("general", "gnu")),
    ("lgpl", "gnu lgpl", ("lgpl",)),
    ("agpl", f"gnu affero general public {LICENSE}", ("affero",)),
    ("agpl", "gnu agpl", ("agpl",)),
    ("gfdl", f"gnu free documentation {LICENSE}", ("documentation", "gnu")),
    ("apache", f"apache software {LICENSE}", ("apache", "software")),
    ("mit", "mit style licen[cs]ed?", ("style", "mit")),
    ("mit", f"mit x11 {LICENSE}", ("x11",)),
    ("mit", f"expat {LICENSE}", ("expat",)),
    ("x11", f"x11 {LICENSE}", ("x11",)),
    ("bsd", f"bsd {LICENSE}", ("bsd",)),
    ("bsd", "bsd style licen[cs]ed?", ("bsd", "style")),
    ("bsd-2-clause", f"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: {LICENSE})?", ("bsd",)),
    ("bsd-2-clause", f"freebsd {LICENSE}", ("freebsd",)),
    ("bsd-3-clause", f"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd)(?: {LICENSE})?", ("bsd",)),
    ("bsd-4-clause", f"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: {LICENSE})?", ("bsd",)),
    ("0bsd", f"0bsd(?: {LICENSE})?", ("0bsd",)),
    ("0bsd", f"zero clause bsd(?: {LICENSE})?", ("zero", "bsd")),
    ("isc", f"isc {LICENSE}", ("isc",)),
    ("zlib", f"zlib(?: libpng)? {LICENSE}", ("zlib",)),
    ("libpng", f"libpng {LICENSE}", ("libpng",)),
    ("unlicense", "the unlicense", ("unlicense",)),
    ("wtfpl", "wtfpl", ("wtfpl",)),
    ("wtfpl", f"do what the fuck you want to public {LICENSE}", ("fuck",)),
    ("beerware", f"beerware {LICENSE}", ("beerware",)),
    ("mpl", f"mozilla public {LICENSE}", ("mozilla",)),
    ("epl", f"eclipse public {LICENSE}", ("eclipse",)),
    ("cddl", f"common development and distribution {LICENSE}", ("development", "distribution")),
    ("cpl", f"common public {LICENSE}", ("common", "public")),
    ("ipl", f"ibm public {LICENSE}", ("ibm",)),
    ("afl", f"academic free {LICENSE}", ("academic",)),
    ("osl", f"open software {LICENSE}", ("software", "open")),
    ("artistic", f"artistic {LICENSE}", ("artistic",)),
    ("perl", "same terms as perl itself", ("perl",)),
    ("eupl", f"european union public li[cs]en[cs]e", ("european",)),
    ("bsl", f"boost software {LICENSE}", ("boost",)),
    ("busl", f"business source {LICENSE}", ("business",)),
    ("sspl", f"server side public {LICENSE}", ("server",)),
    ("elastic", f"elastic {LICENSE}", ("elastic",)),
    ("zpl", f"zope public {LICENSE}", ("zope",)),
    ("ofl", f"(?:sil )?open font {LICENSE}", ("font", "open")),
    ("lppl", f"latex project public {LICENSE}", ("latex",)),
    ("ms-pl", f"microsoft public {LICENSE}", ("microsoft", "public")),
    ("ms-rl", f"microsoft reciprocal {LICENSE}", ("reciprocal",)),
    ("ncsa", f"(?:university of illinois )?ncsa (?:open source )?{LICENSE}", ("ncsa",)),
    ("postgresql", f"postgresql {LICENSE}", ("postgresql",)),
    ("python", f"python {LICENSE}", ("python",)),
    ("psf", f"python software foundation {LICENSE}", ("python", "foundation")),
    ("php", f"php {LICENSE}", ("php",)),
    ("ruby", f"ruby {LICENSE}", ("ruby",)),
    ("openssl", f"openssl {LICENSE}", ("openssl",)),
    ("curl", f"curl {LICENSE}", ("curl",)),
    ("vim", f"vim {LICENSE}", ("vim",)),
    ("unicode", f"unicode {LICENSE}(?: agreement)?", ("unicode",)),
    ("w3c", f"w3c software (?:notice and )?{LICENSE}", ("w3c",)),
    ("cecill", f"cecill(?: [abc])? {LICENSE}", ("cecill",)),
    ("odbl", f"open database {LICENSE}", ("database", "open")),
    ("odc-by", f"open data commons attribution {LICENSE}", ("commons", "attribution")),
    ("pddl", f"public domain dedication and {LICENSE}", ("dedication",)),
    ("cdla-permissive", "community data license agreement permissive", ("community", "permissive")),
    ("cdla-sharing", "community data license agreement sharing", ("community", "sharing")),
    ("cc0", "cc0", ("cc0",)),
    ("cc0", "creative commons zero", ("commons", "zero")),
    ("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", ("domain", "public")),
    ("openrail", f"openrail(?: m)? {LICENSE}", ("openrail",)),
    ("openrail", f"(?:bigscience|creativeml open) rail(?: m)? {LICENSE}", ("rail",)),
    ("llama", f"llama (?:[234] )?community {LICENSE}", ("llama",)),
    ("cc", f"creative commons {LICENSE}", ("commons", "creative")),
    ("json", f"json {LICENSE}", ("json",)),
    ("upl", f"universal permissive {LICENSE}", ("universal",)),
    ("mulan", f"mulan (?:permissive software|psl|public) {LICENSE}", ("mulan",)),
    ("proprietary", "all rights reserved", ("reserved", "rights")),
    ("proprietary", "proprietary and confidential", ("proprietary",)),
    ("commercial", f"commercial {LICENSE} agreement", ("commercial", "agreement")),
]

# Fixed values: (kind of licence, its words) and versions of the Creative Commons family.
CC_KINDS = [
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:s|ative|atives)(?: works)?"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:s|ative|atives)(?: works)?"),
]
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Fixed values: (label, identifier in words) as used after an SPDX tag.
TAGS = [
    ("gpl-1.0", "gpl 1 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"),
    ("lgpl-2.0", "lgpl 2 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3.0", "lgpl 3 0"),
    ("agpl-3.0", "agpl 3 0"), ("gfdl-1.3", "gfdl 1 3"),
    ("apache-1.1", "apache 1 1"), ("apache-2.0", "apache 2 0"), ("mit", "mit"), ("mit-0", "mit 0"),
    ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause"), ("0bsd", "0bsd"), ("isc", "isc"), ("zlib", "zlib"),
    ("mpl-1.1", "mpl 1 1"), ("mpl-2.0", "mpl 2 0"), ("epl-1.0", "epl 1 0"), ("epl-2.0", "epl 2 0"),
    ("cddl-1.0", "cddl 1 0"), ("cddl-1.1", "cddl 1 1"), ("bsl-1.0", "bsl 1 0"),
    ("busl-1.1", "busl 1 1"), ("sspl-1.0", "sspl 1 0"), ("elastic-2.0", "elastic 2 0"),
    ("afl-3.0", "afl 3 0"), ("osl-3.0", "osl 3 0"), ("artistic-2.0", "artistic 2 0"),
    ("eupl-1.2", "eupl 1 2"), ("ofl-1.1", "ofl 1 1"), ("unlicense", "unlicense"),
    ("wtfpl", "wtfpl"), ("postgresql", "postgresql"), ("ncsa", "ncsa"), ("cc0-1.0", "cc0 1 0"),
    ("odbl-1.0", "odbl 1 0"), ("ms-pl", "ms pl"), ("upl-1.0", "upl 1 0"),
]

# Sentences that stand in the text of a licence alone, and words they need.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("hereby", "charge")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", ("notice", "permission", "copies")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("hereby", "fee")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution", "binary")),
    ("bsd", "redistributions of source code must retain the above copyright notice", ("redistributions", "retain")),
    ("bsd-3-clause", "neither the name of (?:the )?\\S+(?: \\S+){0,8} nor the names of its contributors", ("neither", "contributors")),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", ("advertising",)),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license", ("unless", "writing")),
    ("apache-2.0", "you may not use this file except in compliance with the license", ("compliance", "except")),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", ("redistribute", "gnu")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("redistribute", "lesser")),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", ("redistribute", "affero")),
    ("gpl", "you should have received a copy of the gnu general public license", ("received", "gnu")),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document", ("verbatim",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ("mozilla", "subject")),
    ("zlib", "altered source versions must be plainly marked as such", ("altered", "plainly")),
    ("zlib", "the origin of this software must not be misrepresented", ("misrepresented",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",)),
    ("bsl-1.0", "obtaining a copy of the software and accompanying documentation covered by this license", ("accompanying", "covered")),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license", ("eclipse", "accompanying")),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", ("intent", "package")),
    ("ofl", "the goals of the open font license ofl are to stimulate worldwide development", ("ofl", "worldwide")),
    ("cc", "this work is licensed under a creative commons", ("commons", "work")),
    ("cc0", "to the extent possible under law", ("extent", "law")),
    ("openssl", "this product includes software developed by the openssl project", ("openssl", "product")),
    ("w3c", "this work is being provided by the copyright holders under the following license", ("holders", "provided")),
    ("python", "psf is making python available to licensee on an as is basis", ("psf", "licensee")),
    ("json", "the software shall be used for good not evil", ("evil",)),
    ("beerware", "you can buy me a beer in return", ("beer",)),
    ("proprietary", "no part of this (?:publication|document|book) may be reproduced", ("reproduced",)),
]

# Addresses, in words, and a word they need.
ADDRESSES = [
    ("gpl-2.0", "(?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?gpl 2 0", "gnu"),
    ("gpl-3.0", "(?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?gpl 3 0", "gnu"),
    ("gpl", "(?:www )?gnu org (?:licenses|copyleft) gpl", "gnu"),
    ("lgpl", "(?:www )?gnu org (?:licenses|copyleft) lgpl", "gnu"),
    ("agpl", "(?:www )?gnu org licenses agpl", "gnu"),
    ("gfdl", "(?:www )?gnu org (?:licenses|copyleft) fdl", "gnu"),
    ("apache-2.0", "(?:www )?apache org licenses license 2 0", "apache"),
    ("apache", "(?:www )?apache org licenses", "apache"),
    ("mit", "opensource org licenses? mit(?: license)?", "opensource"),
    ("bsd-2-clause", "opensource org licenses? bsd 2 clause", "opensource"),
    ("bsd-3-clause", "opensource org licenses? bsd 3 clause", "opensource"),
    ("isc", "opensource org licenses? isc", "opensource"),
    ("artistic-2.0", "opensource org licenses? artistic (?:license )?2 0", "opensource"),
    ("afl-3.0", "opensource org licenses? afl 3 0", "opensource"),
    ("osl-3.0", "opensource org licenses? osl 3 0", "opensource"),
    ("mpl-2.0", "(?:www )?mozilla org (?:en us )?mpl 2 0", "mozilla"),
    ("mpl", "(?:www )?mozilla org (?:en us )?mpl", "mozilla"),
    ("epl-2.0", "(?:www )?eclipse org (?:legal epl 2 0|org documents epl 2 0)", "eclipse"),
    ("epl-1.0", "(?:www )?eclipse org legal epl v10", "eclipse"),
    ("bsl-1.0", "(?:www )?boost org license 1 0", "boost"),
    ("unlicense", "(?:www )?unlicense org", "unlicense"),
    ("ofl", "scripts sil org ofl", "sil"),
    ("wtfpl", "(?:www )?wtfpl net", "wtfpl"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", "creativecommons"),
    ("public-domain", "creativecommons org publicdomain mark 1 0", "creativecommons"),
    ("odbl-1.0", "opendatacommons org licenses odbl 1 0", "opendatacommons"),
    ("odbl", "opendatacommons org licenses odbl", "opendatacommons"),
    ("odc-by", "opendatacommons org licenses by", "opendatacommons"),
    ("eupl", "joinup ec europa eu (?:\\S+ ){0,6}eupl", "joinup"),
]

#: What a document says it is given under.
GRANTED = (
    "(?:licen[cs]ed|released|distributed|available|provided|published|covered|governed|shared|"
    "redistributed|offered) (?:under|by) (?:the terms of )?(?:the |a |an )?(?:terms of the )?"
)


def _version(words: str) -> str:
    found = words.removeprefix("v").replace(" ", ".")
    return found if "." in found or len(found) > 1 else found + ".0"


def _uses(label: str, name: str, needs: tuple[str, ...], priority: int) -> list[Rule]:
    """A name by itself and as what something is licensed under."""
    later = "(?: or (?:any later version|later)| only)?"
    return [
        Rule(label, GRANTED + name + later, needs, GRANT),
        Rule(label, name + later, needs, priority),
    ]


def _all() -> list[Rule]:
    # Searches for a phrase begin at its least usual word; in German `mit` is a most usual one.
    first = {"gpl": "gnu", "apache": "apache", "cc-by": "cc", "mit": "license"}
    rules = [Rule(label, phrase, (first[label],), NAMED, True) for phrase, label in BASE.items()]
    for phrase, label in BASE.items():
        rules.append(Rule(label, GRANTED + phrase, (first[label],), GRANT))
    for label, words in TAGS:
        rules.append(Rule(label, f"spdx license identifier {words}(?: only| or later)?", ("spdx",), TAG))
    for label, sentence, needs in SENTENCES:
        rules.append(Rule(label, sentence, needs, TEXT))
    for label, name, word, versions in VERSIONED_NAMES:
        for version in versions:
            found = name.replace("#", version)
            rules += _uses(f"{label}-{_version(version)}", found, (word,), VERSIONED)
    for label, short, long in CC_KINDS:
        code = "" if label == "cc-by" else label.removeprefix("cc-by").replace("-", " ")
        for version in CC_VERSIONS:
            dotted = version.replace(" ", ".")
            rules += _uses(f"{label}-{dotted}", f"cc {short} {version}", ("cc",), VERSIONED)
            rules += _uses(
                f"{label}-{dotted}",
                f"creative commons {long} {version}(?: international| unported| generic)?",
                ("commons",),
                VERSIONED,
            )
            address = f"creativecommons org licenses by{code} {version}"
            rules.append(Rule(f"{label}-{dotted}", address, ("creativecommons",), ADDRESS))
        if code:
            rules += _uses(label, f"cc {short}", ("cc",), NAMED)
        rules += _uses(label, f"creative commons {long}(?: {LICENSE})?", ("commons",), NAMED)
    for label, address, word in ADDRESSES:
        rules.append(Rule(label, address, (word,), ADDRESS))
    for label, name, needs in PLAIN_NAMES:
        rules += _uses(label, name, needs, BARE if label in ("proprietary", "commercial") else NAMED)
    return rules


RULES = _all()
