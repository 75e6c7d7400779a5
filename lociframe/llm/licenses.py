"""License scans by ordered signature rules.

A text is reduced to its words (A-Z lower-cased, cut at ASCII characters that are neither letters nor digits). Each
rule is a regular expression over the words, written out for a licence, notice or tag, with a keyword that must occur
in the text before the expression is tried, a label, a priority and a weight. Detections are word intervals; they are
taken by priority, then by length, then by place, and one that lies inside an interval already taken is suppressed, so
that "gnu lesser general public license" is not also reported as the general one. The places of the three base phrases
are always kept and counted.

Nulls: a null text has no words. Texts without words have no detections. Rules are linear in the text (no nested
repeats), and texts are never cut. Repeated rows give equal rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte table of UTF-8: word bytes (0-9, a-z, all beyond ASCII) stay, A-Z become lower-case, the rest spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


# Families: label, keyword, name pattern. `V` stands for an optional version, "v2", "version 2 0", "2 1".
_V = r"(?: (?:v|version )?v?\d+(?: \d+)*)?"
_FAMILIES = [
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]eV"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]eV"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[sc]eV"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]eV"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]eV"),
    ("apache", "apache", r"apache (?:software )?licen[sc]eV"),
    ("mit", "mit", r"(?:the )?mit licen[sc]e"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("bsd", "bsd", r"(?:new |modified |revised |simplified |original )?bsd(?: [0234]| two| three| four)?(?: clause)? licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("mpl", "mozilla", r"mozilla public licen[sc]eV"),
    ("epl", "eclipse", r"eclipse public licen[sc]eV"),
    ("edl", "eclipse", r"eclipse distribution licen[sc]eV"),
    ("cddl", "common development", r"common development and distribution licen[sc]eV"),
    ("cpl", "common public", r"common public licen[sc]eV"),
    ("ipl", "ibm", r"ibm public licen[sc]eV"),
    ("eupl", "european union", r"european union public licen[sc]eV"),
    ("artistic", "artistic", r"(?:the )?artistic licen[sc]eV"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]eV"),
    ("boost", "boost", r"boost software licen[sc]eV"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[sc]eV"),
    ("psf", "python software", r"python software foundation licen[sc]eV"),
    ("php", "php", r"php licen[sc]eV"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("osl", "open software", r"open software licen[sc]eV"),
    ("afl", "academic free", r"academic free licen[sc]eV"),
    ("qpl", "q public", r"q public licen[sc]eV"),
    ("sissl", "sun industry", r"sun industry standards source licen[sc]eV"),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?(?:document )?licen[sc]e"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]eV"),
    ("odbl", "open database", r"open (?:data commons open )?database licen[sc]eV"),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]eV"),
    ("pddl", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[sc]eV"),
    ("cc0", "cc0", r"cc0V"),
    ("cc0", "zero", r"creative commons (?:cc )?zeroV"),
    ("cc-by-nc-nd", "noncommercial", r"(?:creative commons )?attribution noncommercial no ?deriv(?:ative)?s?V"),
    ("cc-by-nc-sa", "noncommercial", r"(?:creative commons )?attribution noncommercial share ?alikeV"),
    ("cc-by-nc", "noncommercial", r"(?:creative commons )?attribution noncommercialV"),
    ("cc-by-sa", "share", r"(?:creative commons )?attribution share ?alikeV"),
    ("cc-by-nd", "deriv", r"(?:creative commons )?attribution no ?deriv(?:ative)?s?V"),
    ("cc-by", "creative commons", r"creative commons attributionV"),
    ("cc-by-nc-nd", "cc by nc", r"cc by nc ndV"),
    ("cc-by-nc-sa", "cc by nc", r"cc by nc saV"),
    ("cc-by-nc", "cc by nc", r"cc by ncV"),
    ("cc-by-sa", "cc by sa", r"cc by saV"),
    ("cc-by-nd", "cc by nd", r"cc by ndV"),
    ("cc-by", "cc by", r"cc byV"),
    ("creative-commons", "creative commons", r"creative commons(?: public)? licen[sc]eV"),
    ("sspl", "server side", r"server side public licen[sc]eV"),
    ("busl", "business source", r"business source licen[sc]eV"),
    ("elastic", "elastic", r"elastic licen[sc]eV"),
    ("commons-clause", "commons clause", r"commons clause"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[sc]e)V"),
    ("cecill", "cecill", r"cecill(?: [abc])?V"),
    ("upl", "universal permissive", r"universal permissive licen[sc]eV"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("json", "json", r"json licen[sc]e"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("icu", "icu", r"icu licen[sc]e"),
    ("unicode", "unicode", r"unicode licen[sc]e(?: agreement)?"),
    ("bsl", "bsl", r"bsl 1 0"),
    ("beerware", "beer", r"beer ?ware licen[sc]e"),
    ("openrail", "rail", r"(?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[sc]e)?V"),
    ("ogl", "open government", r"open government licen[sc]eV"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|licen[sc]e|software licen[sc]e)"),
]
#: How a family's name is used; {0} is the name. The weight says how sure the wording is.
_FORMS = [
    (r"licen[sc]ed under (?:the )?(?:terms of )?(?:the )?{0}", 60, 0.95),
    (r"(?:released|distributed|available|published|provided|covered|shared) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{0}", 55, 0.9),
    (r"(?:under|subject to) (?:the )?terms (?:and conditions )?of (?:the )?{0}", 50, 0.85),
    (r"{0}", 30, 0.6),
]
# Tags: identifier as words, label.
_TAGS = {
    "mit": "mit", "apache 2 0": "apache", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "bsd 4 clause": "bsd", "0bsd": "bsd", "isc": "isc", "gpl 2 0": "gpl",
    "gpl 3 0": "gpl", "lgpl 2 0": "lgpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "mpl 1 1": "mpl", "mpl 2 0": "mpl", "epl 1 0": "epl",
    "epl 2 0": "epl", "cddl 1 0": "cddl", "eupl 1 2": "eupl", "artistic 2 0": "artistic", "zlib": "zlib", "bsl 1 0": "boost", "unlicense": "unlicense",
    "wtfpl": "wtfpl", "psf 2 0": "psf", "python 2 0": "psf", "php 3 01": "php", "ms pl": "ms-pl", "ms rl": "ms-rl", "openssl": "openssl", "osl 3 0": "osl",
    "afl 3 0": "afl", "ofl 1 1": "ofl", "odbl 1 0": "odbl", "odc by 1 0": "odc-by", "pddl 1 0": "pddl", "cc0 1 0": "cc0", "cc by 3 0": "cc-by", "cc by 4 0": "cc-by",
    "cc by sa 3 0": "cc-by-sa", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "cc by nd 4 0": "cc-by-nd", "cc by nc sa 4 0": "cc-by-nc-sa",
    "cc by nc nd 4 0": "cc-by-nc-nd", "sspl 1 0": "sspl", "busl 1 1": "busl", "elastic 2 0": "elastic", "mulanpsl 2 0": "mulan", "upl 1 0": "upl",
    "ncsa": "ncsa", "json": "json", "vim": "vim", "postgresql": "postgresql", "unicode dfs 2016": "unicode", "gfdl 1 3": "gfdl",
}
# Short names as people write them: label, keyword, pattern, priority, weight.
_NUMBER = r"(?:v?\d+|(?: (?:version |v )?v?\d+(?: \d+)?))?"
_SHORT = [
    ("agpl", "agpl", r"(?:gnu )?agplN(?: only| or later| or any later version)?", 45, 0.8),
    ("lgpl", "lgpl", r"(?:gnu )?lgplN(?: only| or later| or any later version)?", 45, 0.8),
    ("gpl", "gpl", r"(?:gnu )?gplN(?: only| or later| or any later version)?", 44, 0.75),
    ("gpl", "gpl compatible", r"gpl compatible", 46, 0.4),
    ("gpl", "copyleft", r"copyleft(?: licen[sc]e)?", 20, 0.4),
    ("gfdl", "gfdl", r"(?:gnu )?gfdlN", 45, 0.8),
    ("gfdl", "gnu fdl", r"gnu fdlN", 45, 0.8),
    ("apache", "apache 2", r"apache 2(?: 0)?(?: licen[sc]ed?)?", 45, 0.85),
    ("apache", "apache v2", r"apache v2(?: 0)?(?: licen[sc]ed?)?", 45, 0.85),
    ("apache", "apache2", r"apache2(?: 0)?(?: licen[sc]ed?)?", 45, 0.85),
    ("apache", "asl 2", r"asl 2 0", 40, 0.6),
    ("apache", "al2", r"al2 0", 35, 0.5),
    ("bsd", "clause", r"bsd (?:[0234]|two|three|four) clause(?: licen[sc]ed?)?", 46, 0.9),
    ("bsd", "clause bsd", r"(?:[0234]|two|three|four) clause bsd(?: licen[sc]ed?)?", 46, 0.9),
    ("bsd", "0bsd", r"0bsd", 45, 0.8),
    ("bsd", "bsd style", r"bsd style(?: licen[sc]ed?)?", 45, 0.7),
    ("bsd", "bsd licensed", r"bsd licen[sc]ed", 45, 0.8),
    ("mit", "mit licensed", r"mit licen[sc]ed", 45, 0.85),
    ("mit", "mit style", r"mit style(?: licen[sc]ed?)?", 45, 0.7),
    ("mit", "mit x11", r"mit x11(?: licen[sc]e)?", 46, 0.85),
    ("mit", "x11 licen", r"x11 licen[sc]e", 45, 0.75),
    ("mit", "mit or apache", r"mit or apache(?: 2 0)?", 47, 0.9),
    ("mpl", "mpl", r"mpl(?: ?v?[12])(?: \d)?", 45, 0.8),
    ("mpl", "mpl2", r"mpl2", 45, 0.8),
    ("epl", "epl", r"epl ?v?[12](?: 0)?", 45, 0.8),
    ("cddl", "cddl", r"cddl(?: ?v?1)?(?: [01])?", 45, 0.8),
    ("eupl", "eupl", r"eupl(?: ?v?1)?(?: [0-2])?", 45, 0.85),
    ("osl", "osl", r"osl ?v?[1-3](?: \d)?", 45, 0.75),
    ("afl", "afl", r"afl ?v?[1-3](?: \d)?", 45, 0.7),
    ("isc", "isc licensed", r"isc licen[sc]ed", 45, 0.8),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]ed?", 45, 0.85),
    ("boost", "bsl 1", r"bsl 1 0", 46, 0.7),
    ("boost", "boost", r"boost software licen[sc]ed?(?: (?:version |v )?1 0)?", 46, 0.9),
    ("unlicense", "unlicense", r"(?:the )?unlicense", 45, 0.8),
    ("wtfpl", "wtfpl", r"wtfpl(?: ?v?[12])?", 45, 0.85),
    ("sspl", "sspl", r"sspl(?: ?v?1)?", 45, 0.85),
    ("busl", "busl", r"busl(?: 1 1)?", 45, 0.8),
    ("ofl", "ofl", r"(?:sil )?ofl(?: ?v?1)?(?: 1)?", 45, 0.75),
    ("odbl", "odbl", r"odbl(?: ?v?1)?(?: 0)?", 45, 0.85),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 45, 0.9),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: \d(?: \d)?)?", 50, 0.95),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: \d(?: \d)?)?", 50, 0.95),
    ("cc-by-nc", "cc by", r"cc by nc(?: \d(?: \d)?)?", 48, 0.95),
    ("cc-by-sa", "cc by", r"cc by sa(?: \d(?: \d)?)?", 48, 0.95),
    ("cc-by-nd", "cc by", r"cc by nd(?: \d(?: \d)?)?", 48, 0.95),
    ("cc-by", "cc by", r"cc by(?: \d(?: \d)?)?", 46, 0.9),
    ("warranty", "as is", r"(?:is |are )?(?:provided|distributed|offered|supplied) (?:on an )?as is(?: basis)?(?: and)?(?: without (?:any )?warrant(?:y|ies) of any kind)?", 30, 0.5),
    ("warranty", "without any warranty", r"without any warranty(?: without even the implied warranty of merchantability or fitness for a particular purpose)?", 30, 0.5),
    ("warranty", "warranties or conditions", r"without warranties or conditions of any kind(?: either express or implied)?", 30, 0.5),
    ("warranty", "merchantability", r"(?:the )?(?:implied )?warranties of merchantability(?: and)? fitness for a particular purpose(?: and non ?infringement)?", 30, 0.5),
    ("liability", "in no event", r"in no event (?:shall|will) (?:the )?(?:\S+ ){1,8}?be liable(?: for any)?", 30, 0.5),
    ("liability", "consequential damages", r"(?:direct indirect )?incidental special exemplary or consequential damages", 30, 0.5),
    ("patent", "patent license", r"(?:a )?(?:perpetual )?worldwide non ?exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent licen[sc]e", 30, 0.6),
    ("patent", "patent claims", r"patent claims (?:licensable|necessarily infringed)", 30, 0.5),
    ("redistribution", "redistribution and use", r"redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?", 60, 0.85),
    ("redistribution", "redistribute", r"(?:you (?:can|may) )?redistribute it and or modify it under the terms", 40, 0.6),
    ("redistribution", "derivative works", r"(?:prepare|create|make|distribute) derivative works(?: of| based (?:up)?on)", 30, 0.5),
    ("trademark", "trade names", r"does not grant permission to use the trade names", 30, 0.5),
    ("attribution", "appropriate credit", r"(?:you )?must give appropriate credit", 30, 0.6),
    ("attribution", "copyright notice", r"(?:retain|reproduce|include) (?:the above|all|this) copyright notices?", 30, 0.5),
    ("non-commercial", "commercial", r"(?:for )?non ?commercial (?:use|purposes)(?: only)?", 25, 0.4),
    ("non-commercial", "commercial", r"(?:may|must) not be used for commercial purposes", 30, 0.5),
]
# Sentences and addresses of their own: label, keyword, pattern, priority, weight.
_TEXTS = [
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 80, 0.97),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 80, 0.95),
    ("isc", "permission to use", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee", 80, 0.95),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice", 80, 0.95),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice", 80, 0.95),
    ("bsd", "neither the name", r"neither the name of (?:\S+ ){1,12}?nor the names of its contributors", 80, 0.95),
    ("apache", "apache", r"you may not use this file except in compliance with the license", 80, 0.9),
    ("apache", "www apache org", r"www apache org licenses license 2 0", 85, 0.97),
    ("gpl", "free software foundation", r"as published by the free software foundation", 70, 0.7),
    ("gpl", "www gnu org", r"www gnu org (?:licenses gpl|copyleft gpl)(?: \d+(?: \d+)*)?", 85, 0.95),
    ("lgpl", "www gnu org", r"www gnu org (?:licenses lgpl|copyleft lesser)(?: \d+(?: \d+)*)?", 86, 0.95),
    ("agpl", "www gnu org", r"www gnu org licenses agpl(?: \d+(?: \d+)*)?", 86, 0.95),
    ("gfdl", "www gnu org", r"www gnu org licenses fdl(?: \d+(?: \d+)*)?", 86, 0.95),
    ("mpl", "mozilla org", r"(?:www )?mozilla org mpl(?: \d+(?: \d+)*)?", 85, 0.95),
    ("epl", "eclipse org", r"(?:www )?eclipse org legal epl(?: v?\d+)*", 85, 0.95),
    ("boost", "boost org", r"(?:www )?boost org license 1 0", 85, 0.95),
    ("ofl", "scripts sil org", r"scripts sil org ofl", 85, 0.95),
    ("unlicense", "unlicense org", r"(?:www )?unlicense org", 85, 0.95),
    ("wtfpl", "wtfpl net", r"(?:www )?wtfpl net", 85, 0.95),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd(?: \d+)*", 90, 0.98),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: \d+)*", 90, 0.98),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: \d+)*", 88, 0.98),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: \d+)*", 88, 0.98),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: \d+)*", 88, 0.98),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?: \d+)*", 86, 0.98),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero(?: \d+)*", 88, 0.98),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark(?: \d+)*", 88, 0.9),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 60, 0.85),
    ("public-domain", "public domain", r"this is free and unencumbered software released into the public domain", 90, 0.95),
    ("public-domain", "public domain", r"(?:is|are) in the public domain", 40, 0.7),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 80, 0.95),
    ("artistic", "perl itself", r"(?:under the )?same terms as perl itself", 60, 0.85),
    ("proprietary", "unauthorized", r"unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: or distribution)?(?: of this \S+)?(?: is)?(?: strictly)? prohibited", 60, 0.8),
    ("proprietary", "without permission", r"(?:may|must|can) not be (?:reproduced|copied|distributed|republished)(?: \S+){0,8}? without (?:prior |written |express |the )*permission", 60, 0.8),
    ("proprietary", "written consent", r"without (?:the )?(?:prior )?(?:express )?written consent", 40, 0.5),
    ("reserved", "rights reserved", r"(?:some|no) rights reserved", 35, 0.5),
    ("reserved", "rights reserved", r"all rights reserved", 35, 0.6),
    ("reserved", "alle rechte", r"alle rechte vorbehalten", 35, 0.6),
    ("reserved", "tous droits", r"tous droits (?:r\S*serv\S*s)", 35, 0.6),
    ("reserved", "todos los derechos", r"todos los derechos reservados", 35, 0.6),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?(?: by)?", 20, 0.3),
    ("copyright", "©", r"© (?:19|20)\d\d", 20, 0.3),
]


def build_rules() -> list[Rule]:
    """All rules in order: by priority, then as written."""
    rules = [Rule(*x) for x in _TEXTS]
    rules += [Rule(label, keyword, pattern.replace("N", _NUMBER), priority, weight) for label, keyword, pattern, priority, weight in _SHORT]
    for tag, label in _TAGS.items():
        rules.append(Rule(label, "spdx", rf"spdx (?:license )?(?:identifier )?{tag}(?: only| or later)?", 95, 0.99))
    for label, keyword, name in _FAMILIES:
        name = name.replace("V", _V)
        for form, priority, weight in _FORMS:
            # names of more than one kind are told apart by length: a longer keyword is the narrower name
            rules.append(Rule(label, keyword, form.format(name), priority, weight))
    return sorted(rules, key=lambda r: -r.priority)


class Scanner:
    """Works on UTF-8 bytes; places are numbers of words, so that bytes and code points don't matter."""

    def __init__(self):
        whole = lambda pattern: re.compile(rb"(?<![^ ])" + pattern.encode() + rb"(?![^ ])")
        self.rules = [(r, whole(r.pattern)) for r in build_rules()]
        self.keywords: dict[bytes, list[int]] = {}
        for i, (rule, _) in enumerate(self.rules):
            self.keywords.setdefault(rule.keyword.encode(), []).append(i)
        self.base = [(phrase.encode(), label, whole(phrase)) for phrase, label in BASE.items()]

    def detections(self, line: bytes, start_of: list[int]) -> list[tuple[int, int, Rule]]:
        """Surviving detections as (first word, end word, rule), in word order. line: the words joined by spaces."""
        found = []
        for keyword, rules in self.keywords.items():
            if keyword not in line:
                continue
            for i in rules:
                rule, pattern = self.rules[i]
                for m in pattern.finditer(line):
                    if m.end() > m.start():
                        found.append((bisect_right(start_of, m.start()) - 1, bisect_right(start_of, m.end() - 1), i))
        found.sort(key=lambda d: (-self.rules[d[2]][0].priority, d[0] - d[1], d[0], d[2]))
        taken: list[tuple[int, int, int]] = []
        firsts: list[int] = []  # of taken, sorted, with the furthest end up to each
        ends: list[int] = []
        for lo, hi, i in found:
            k = bisect_right(firsts, lo)
            if k and ends[k - 1] >= hi:
                continue
            taken.append((lo, hi, i))
            firsts.insert(k, lo)
            ends.insert(k, max(hi, ends[k - 1] if k else 0))
            j = k + 1
            while j < len(ends) and ends[j] < hi:
                ends[j] = hi
                j += 1
        return [(lo, hi, self.rules[i][0]) for lo, hi, i in sorted(taken)]

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, detections as (label, first, end)."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split(b" ")
        words = [w for w in words if w]
        line = b" ".join(words)
        places: list[tuple[int, str]] = []
        hits: list[tuple[int, int, Rule]] = []
        if any(k in line for k in self.keywords):
            start_of = [0, *(np.cumsum([len(w) + 1 for w in words])[:-1].tolist())] if words else []
            for phrase, label, pattern in self.base:
                if phrase in line:
                    places += [(bisect_right(start_of, m.start()) - 1, label) for m in pattern.finditer(line)]
            hits = self.detections(line, start_of)
        base = {label for _, label in places}
        labels = base | {r.label for _, _, r in hits}
        miss = 1.0
        for _, _, rule in hits:
            miss *= 1.0 - rule.weight
        if base and not hits:
            miss = 0.5
        at = [p for p, _ in places]
        return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - miss,
                [(r.label, lo, hi) for lo, hi, r in hits])


RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "detections array<struct<label:string,first:long,end:long>>")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each document, as RESULT says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t if isinstance(t, str) else None) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
            out["detections"] = [[{"label": a, "first": lo, "end": hi} for a, lo, hi in d] for d in out["detections"]]
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, RESULT)
