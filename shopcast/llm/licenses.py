"""License scan with column expressions only: ordered signature rules.

A rule is a regular expression with a keyword that any text it matches holds,
a label and a priority.  Keywords are looked up first; only then is a rule's
expression run.  Of detections, one that lies inside another of higher
priority, or of the same priority and at least its length, is suppressed.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import fresh
from shopcast.llm.spans import let, match_spans, running

#: A character that is no part of a word, and a word.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Base phrases, as one expression: no two can overlap, since none ends with the first word of one.
PHRASES = (
    rf"(?i)(?<={_GAP}|^)(?:(?:mit|apache){_GAP}+license|general{_GAP}+public{_GAP}+license)(?={_GAP}|\z)"
)
#: Label of a base phrase by its first letter.
_BASE_LABELS = {"m": "mit", "a": "apache", "g": "gpl"}

#: (label, SPDX name, keyword, name as an expression, page as an expression).  Blanks in
#: expressions stand for any white space or comment signs.
FAMILIES = (
    ("mit", "MIT", "mit", r"(?:the )?mit(?: \(?expat\)?)?", r"opensource\.org/licenses?/mit"),
    ("mit-0", "MIT-0", "mit", r"mit(?: no attribution|-0)", r"opensource\.org/licenses?/mit-0"),
    ("apache-2.0", "Apache-2.0", "apache", r"apache(?: software)?(?:(?:,? |-)v?2(?:\.0)?)?", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "Apache-1.1", "apache", r"apache(?: software)?,? (?:v|version )?1\.1", r"apache\.org/licenses/license-1\.1"),
    ("gpl-3.0", "GPL-3.0(?:-only|-or-later)?", "gnu", r"gnu (?:general public|gpl)(?: v3| 3(?:\.0)?)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-2.0", "GPL-2.0(?:-only|-or-later)?", "gnu", r"gnu (?:general public|gpl) (?:v|version )?2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("lgpl-3.0", "LGPL-3.0(?:-only|-or-later)?", "lesser", r"(?:gnu )?lesser general public", r"gnu\.org/licenses/lgpl(?:-3\.0)?"),
    ("lgpl-2.1", "LGPL-2.1(?:-only|-or-later)?", "lesser", r"(?:gnu )?lesser general public v?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-2.0", "LGPL-2.0(?:-only|-or-later)?", "library", r"(?:gnu )?library general public", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("agpl-3.0", "AGPL-3.0(?:-only|-or-later)?", "affero", r"(?:gnu )?affero general public", r"gnu\.org/licenses/agpl(?:-3\.0)?"),
    ("gfdl-1.3", "GFDL-1.3(?:-only|-or-later)?", "documentation", r"(?:gnu )?free documentation", r"gnu\.org/licenses/fdl(?:-1\.3)?"),
    ("bsd-3-clause", "BSD-3-Clause", "bsd", r"(?:(?:new|modified|revised|3-clause|three-clause) bsd|bsd(?:-| )(?:3|three)(?:-| )clause(?: ['\"]?new['\"]? or ['\"]?revised['\"]?)?)", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-2-clause", "BSD-2-Clause", "bsd", r"(?:(?:simplified|freebsd|2-clause|two-clause) bsd|bsd(?:-| )(?:2|two)(?:-| )clause(?: ['\"]?simplified['\"]?)?)", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd", "0BSD", "bsd", r"(?:the )?(?:bsd(?:-style)?|bsd(?:-| )(?:0|zero)(?:-| )clause|(?:zero(?:-| )clause |0)bsd)", r"opensource\.org/licenses?/0bsd"),
    ("mpl-2.0", "MPL-2.0", "mozilla", r"mozilla public", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-1.1", "MPL-1.1", "mozilla", r"mozilla public v?1\.1", r"mozilla\.org/(?:en-us/)?mpl/1\.1"),
    ("epl-2.0", "EPL-2.0", "eclipse", r"eclipse public", r"eclipse\.org/legal/epl-2\.0"),
    ("epl-1.0", "EPL-1.0", "eclipse", r"eclipse public v?1\.0", r"eclipse\.org/legal/epl-v10"),
    ("edl-1.0", "EDL-1.0", "eclipse", r"eclipse distribution", r"eclipse\.org/org/documents/edl-v10"),
    ("cddl-1.0", "CDDL-1.[01]", "distribution", r"common development and distribution", r"opensource\.org/licenses?/cddl-1\.0"),
    ("cpl-1.0", "CPL-1.0", "common", r"common public", r"opensource\.org/licenses?/cpl1\.0"),
    ("isc", "ISC", "isc", r"(?:the )?isc", r"opensource\.org/licenses?/isc"),
    ("zlib", "Zlib", "zlib", r"(?:the )?zlib(?:/libpng)?", r"opensource\.org/licenses?/zlib"),
    ("libpng", "Libpng", "libpng", r"(?:the )?libpng", r"libpng\.org/pub/png/src/libpng-license"),
    ("bsl-1.0", "BSL-1.0", "boost", r"boost software", r"boost\.org/license_1_0"),
    ("unlicense", "Unlicense", "unlicense", r"the un", r"unlicense\.org"),
    ("wtfpl", "WTFPL", "public", r"do what the f\S+ you want to public", r"wtfpl\.net"),
    ("artistic-2.0", "Artistic-2.0", "artistic", r"(?:the )?artistic(?: 2\.0)?", r"opensource\.org/licenses?/artistic-2\.0"),
    ("artistic-1.0", "Artistic-1.0", "artistic", r"artistic 1\.0", r"opensource\.org/licenses?/artistic-1\.0"),
    ("psf-2.0", "PSF-2.0|Python-2.0", "python", r"python(?: software foundation)?", r"python\.org/(?:psf/|download/releases/[0-9.]+/)license"),
    ("php-3.01", "PHP-3.01", "php", r"(?:the )?php", r"php\.net/license"),
    ("ruby", "Ruby", "ruby", r"(?:the )?ruby", r"ruby-lang\.org/en/about/license"),
    ("openssl", "OpenSSL", "openssl", r"(?:the )?openssl", r"openssl\.org/source/license"),
    ("postgresql", "PostgreSQL", "postgresql", r"(?:the )?postgresql", r"postgresql\.org/about/licen[cs]e"),
    ("ofl-1.1", "OFL-1.1", "font", r"(?:sil )?open font", r"scripts\.sil\.org/ofl"),
    ("ncsa", "NCSA", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)?", r"opensource\.org/licenses?/ncsa"),
    ("ms-pl", "MS-PL", "microsoft", r"microsoft public", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "MS-RL", "microsoft", r"microsoft reciprocal", r"opensource\.org/licenses?/ms-rl"),
    ("eupl-1.2", "EUPL-1.2", "european", r"european union public", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("cecill-2.1", "CECILL-2.1", "cecill", r"cecill(?:-[bc])?(?: free software)?", r"cecill\.info/licences"),
    ("upl-1.0", "UPL-1.0", "universal", r"universal permissive", r"oss\.oracle\.com/licenses/upl"),
    ("afl-3.0", "AFL-3.0", "academic", r"academic free", r"opensource\.org/licenses?/afl-3\.0"),
    ("osl-3.0", "OSL-3.0", "open", r"open software", r"opensource\.org/licenses?/osl-3\.0"),
    ("ecl-2.0", "ECL-2.0", "educational", r"educational community", r"opensource\.org/licenses?/ecl-2\.0"),
    ("odbl-1.0", "ODbL-1.0", "database", r"open (?:data commons open )?database", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "ODC-By-1.0", "commons", r"open data commons attribution", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "PDDL-1.0", "dedication", r"public domain dedication (?:and|&)", r"opendatacommons\.org/licenses/pddl"),
    ("ogl-uk-3.0", "OGL-UK-3.0", "government", r"open government", r"nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("busl-1.1", "BUSL-1.1", "business", r"business source", r"mariadb\.com/bsl11"),
    ("sspl-1.0", "SSPL-1.0", "server", r"server side public", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", "Elastic-2.0", "elastic", r"elastic", r"elastic\.co/licensing/elastic-license"),
    ("openrail", "OpenRAIL", "rail", r"(?:creativeml )?open(?: )?rail(?:\+\+)?(?:-m)?", r"huggingface\.co/spaces/\S*openrail"),
)
#: (label, keyword, name as an expression): names of a family that lack its keyword.
OTHER_NAMES = (
    ("mit", "expat", r"(?:the )?expat(?: \(?expat\)?)?"),
    ("mit", "x11", r"(?:the )?x11(?: \(?expat\)?)?"),
    ("psf-2.0", "psf", r"(?:the )?psf"),
)
#: (label, SPDX name, clause as an expression, path): the licenses that share a name and differ in clauses.
COMMONS = (
    ("cc-by", r"CC-BY-\d\.\d", r"by", "by"),
    ("cc-by-sa", r"CC-BY-SA-\d\.\d", r"by(?:-| )sa", "by-sa"),
    ("cc-by-nc", r"CC-BY-NC-\d\.\d", r"by(?:-| )nc", "by-nc"),
    ("cc-by-nd", r"CC-BY-ND-\d\.\d", r"by(?:-| )nd", "by-nd"),
    ("cc-by-nc-sa", r"CC-BY-NC-SA-\d\.\d", r"by(?:-| )nc(?:-| )sa", "by-nc-sa"),
    ("cc-by-nc-nd", r"CC-BY-NC-ND-\d\.\d", r"by(?:-| )nc(?:-| )nd", "by-nc-nd"),
)
#: Rules of one form: (label, keyword, priority, score, expression).
PLAIN = (
    ("gpl-3.0", "gpl", 2, 0.8, r"\b(?:gnu )?gpl(?:-| )?(?:v|version )?3(?:\.0)?\b"),
    ("gpl-2.0", "gpl", 2, 0.8, r"\b(?:gnu )?gpl(?:-| )?(?:v|version )?2(?:\.0)?\b"),
    ("lgpl-3.0", "lgpl", 2, 0.8, r"\blgpl(?:-| )?(?:v|version )?3(?:\.0)?\b"),
    ("lgpl-2.1", "lgpl", 2, 0.8, r"\blgpl(?:-| )?(?:v|version )?2\.1\b"),
    ("agpl-3.0", "agpl", 2, 0.8, r"\bagpl(?:-| )?(?:v|version )?3(?:\.0)?\b"),
    ("gpl-3.0", "general", 5, 0.95, r"gnu general public licen[cs]e,? (?:v|version )3"),
    ("gpl-2.0", "general", 5, 0.95, r"gnu general public licen[cs]e,? (?:v|version )2"),
    ("gpl", "general", 1, 0.7, r"\bgeneral public licen[cs]e\b"),
    ("lgpl-2.1", "lesser", 5, 0.95, r"lesser general public licen[cs]e,? (?:v|version )2\.1"),
    ("lgpl-3.0", "lesser", 5, 0.95, r"lesser general public licen[cs]e,? (?:v|version )3"),
    ("mpl-1.1", "mozilla", 5, 0.95, r"mozilla public licen[cs]e,? (?:v|version )?1\.1"),
    ("epl-1.0", "eclipse", 5, 0.95, r"eclipse public licen[cs]e,?(?: -)? (?:v|version )?1\.0"),
    ("apache-1.1", "apache", 5, 0.95, r"apache(?: software)? licen[cs]e,? (?:v|version )?1\.1"),
    ("artistic-1.0", "artistic", 5, 0.95, r"artistic licen[cs]e,? (?:v|version )?1\.0"),
    ("cc0-1.0", "cc0", 2, 0.8, r"\bcc0(?:(?:-| )1\.0)?\b"),
    ("cc0-1.0", "creativecommons", 4, 0.9, r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain", "domain", 1, 0.6, r"(?:dedicated to|released into|placed in) the public domain"),
    ("all-rights-reserved", "reserved", 1, 0.6, r"\ball rights reserved\b"),
    ("proprietary", "proprietary", 1, 0.6, r"\bproprietary and confidential\b"),
    ("mit", "granted", 3, 0.95, r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("isc", "permission", 3, 0.9, r"permission to use,? copy,? modify,? and/or distribute this software for any purpose"),
    ("bsd", "redistribution", 3, 0.9, r"redistribution and use in source and binary forms,? with or without modification"),
    ("unlicense", "unencumbered", 3, 0.95, r"free and unencumbered software released into the public domain"),
    ("zlib", "warranty", 3, 0.9, r"this software is provided ['`\"]+as-is['`\"]+,? without any express or implied warranty"),
)
#: Sentences of notices and license texts: (label, keyword, priority, score, expression).
NOTICES = (
    ("apache-2.0", "compliance", 3, 0.95, r"you may not use this (?:file|software|work) except in compliance with the license"),
    ("apache-2.0", "contributor", 3, 0.95, r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-2.0", "applicable", 3, 0.9, r"unless required by applicable law or agreed to in writing,? (?:software|any software|licensor)"),
    ("apache-2.0", "governing", 3, 0.9, r"see the license for the specific language governing permissions and limitations"),
    ("apache-2.0", "perpetual", 3, 0.9, r"a perpetual,? worldwide,? non-exclusive,? no-charge,? royalty-free,? irrevocable copyright license"),
    ("gpl", "redistribute", 3, 0.9, r"this (?:program|file|software|package) is free software[:;,]? you can redistribute it and/or modify"),
    ("gpl-3.0", "option", 3, 0.9, r"either version 3 of the license,? or,? \(at your option\)"),
    ("gpl-2.0", "option", 3, 0.9, r"either version 2 of the license,? or,? \(at your option\)"),
    ("gpl-2.0", "published", 3, 0.9, r"gnu general public license version 2(?: only)?,? as published by the free software foundation"),
    ("gpl", "received", 3, 0.9, r"you should have received a copy of the gnu general public license"),
    ("gpl", "merchantability", 1, 0.7, r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "copyleft", 3, 0.9, r"the gnu general public license is a free,? copyleft license"),
    ("gpl", "verbatim", 3, 0.8, r"verbatim copies of this license document,? but changing it is not allowed"),
    ("lgpl", "library", 3, 0.9, r"this library is free software[:;,]? you can redistribute it and/or modify"),
    ("lgpl-2.1", "option", 3, 0.9, r"either version 2\.1 of the license,? or,? \(at your option\)"),
    ("lgpl", "lesser", 3, 0.9, r"you should have received a copy of the gnu lesser general public license"),
    ("agpl-3.0", "affero", 3, 0.95, r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", "remotely", 3, 0.9, r"all users interacting with it remotely through a computer network"),
    ("gfdl-1.3", "document", 3, 0.95, r"permission is granted to copy,? distribute and/or modify this document under the terms of the gnu free documentation"),
    ("mpl-2.0", "subject", 3, 0.95, r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "mpl", 3, 0.95, r"if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", "contents", 3, 0.95, r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("cddl-1.0", "development", 3, 0.95, r"(?:contents of this file|this file) (?:are|is) subject to the terms of the common development and distribution license"),
    ("cddl-1.0", "cddl", 3, 0.95, r"when distributing covered code,? include this cddl header in each file"),
    ("cddl-1.0", "opensolaris", 3, 0.9, r"usr/src/opensolaris\.license"),
    ("epl-2.0", "accompanying", 3, 0.95, r"the accompanying materials are made available under the terms of the eclipse public license"),
    ("bsd", "retain", 3, 0.9, r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "reproduce", 3, 0.9, r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd-3-clause", "endorse", 3, 0.9, r"neither the names? of [^.]{1,120} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", 3, 0.95, r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "holders", 3, 0.9, r"this software is provided by the copyright holders (?:and contributors )?['`\"]*as is"),
    ("sleepycat", "accompanied", 3, 0.95, r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("mit", "substantial", 3, 0.95, r"this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions"),
    ("mit", "noninfringement", 3, 0.9, r"including but not limited to the warranties of merchantability,? fitness for a particular purpose and noninfringement"),
    ("mit", "contained", 3, 0.8, r"except as contained in this notice,? the names? of"),
    ("json", "evil", 4, 0.95, r"the software shall be used for good,? not evil"),
    ("bsl-1.0", "organization", 3, 0.95, r"permission is hereby granted,? free of charge,? to any person or organization obtaining a copy"),
    ("ncsa", "deal", 3, 0.9, r"to deal with the software without restriction"),
    ("isc", "disclaims", 3, 0.9, r"the software is provided ['`\"]*as is['`\"]* and the author disclaims all warranties"),
    ("hpnd", "documentation", 3, 0.9, r"permission to use,? copy,? modify,? (?:and )?distribute(?:,? and sell)? this software and its documentation for any purpose"),
    ("curl", "fee", 3, 0.9, r"permission to use,? copy,? modify,? and distribute this software for any purpose with or without fee"),
    ("zlib", "misrepresented", 3, 0.95, r"the origin of this software must not be misrepresented"),
    ("zlib", "plainly", 3, 0.95, r"altered source versions must be plainly marked as such"),
    ("zlib", "removed", 3, 0.9, r"this notice may not be removed or altered from any source distribution"),
    ("unlicense", "anyone", 3, 0.95, r"anyone is free to copy,? modify,? publish,? use,? compile,? sell,? or distribute this software"),
    ("unlicense", "dedicate", 3, 0.9, r"dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "permitted", 3, 0.9, r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("cc0-1.0", "waived", 3, 0.95, r"to the extent possible under law,? [^.]{1,120} waived all copyright"),
    ("cc-by", "commons", 3, 0.9, r"creative commons attribution (?:\d\.\d|international|generic|unported|licen[cs]e)"),
    ("cc-by-sa", "commons", 3, 0.9, r"creative commons attribution(?:-| )share ?alike"),
    ("cc-by-nd", "commons", 3, 0.9, r"creative commons attribution(?:-| )no ?deriv(?:atives|s)"),
    ("cc-by-nc", "commons", 3, 0.9, r"creative commons attribution(?:-| )non-?commercial (?:\d\.\d|international|generic|unported|licen[cs]e)"),
    ("cc-by-nc-sa", "commons", 3, 0.9, r"creative commons attribution(?:-| )non-?commercial(?:-| )share ?alike"),
    ("cc-by-nc-nd", "commons", 3, 0.9, r"creative commons attribution(?:-| )non-?commercial(?:-| )no ?deriv(?:atives|s)"),
    ("psf-2.0", "psf", 3, 0.95, r"psf is making python available to licensee"),
    ("openssl", "openssl", 3, 0.95, r"this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", 3, 0.95, r"this product includes cryptographic software written by eric young"),
    ("php-3.01", "php", 3, 0.9, r"this source file is subject to version 3\.01 of the php license"),
    ("ofl-1.1", "font", 3, 0.95, r"this font software is licensed under the sil open font license"),
    ("ms-pl", "governs", 3, 0.9, r"this license governs use of the accompanying software"),
    ("eupl-1.2", "eupl", 3, 0.9, r"licensed under the eupl"),
    ("bitstream-vera", "bitstream", 3, 0.9, r"bitstream vera is a trademark of bitstream"),
    ("ftl", "freetype", 3, 0.9, r"portions of this software are copyright [^.]{1,60} the freetype project"),
    ("ijg", "jpeg", 3, 0.9, r"based in part on the work of the independent jpeg group"),
    ("beerware", "stuff", 3, 0.9, r"if we meet some day,? and you think this stuff is worth it"),
    ("llama", "llama", 3, 0.9, r"llama (?:\d(?:\.\d)? )?community license"),
    ("gemma", "gemma", 3, 0.9, r"gemma terms of use"),
    ("public-domain", "disclaim", 2, 0.8, r"authors? (?:hereby )?disclaims? copyright to this source code"),
    ("proprietary", "reproduced", 2, 0.7, r"no part of this (?:publication|software|document|work) may be reproduced"),
    ("proprietary", "confidential", 2, 0.7, r"confidential and proprietary"),
    ("proprietary", "unauthorized", 2, 0.8, r"unauthorized copying of this (?:file|software)"),
)
#: Texts that no rule but those of ``SPLIT_STEM`` matches without: the first look at a text.
STEMS = (
    "licen", "spdx", "gpl", "cc0", "cc-by", "creative", "domain", "reserved",
    "proprietary", "granted", "permission", "redistribution", "unencumbered", "as-is", "unlicense", ".org/",
    ".net/", ".com/", ".co/", ".uk/", ".eu/", ".info/", "wtfpl.net",
    "software", "copyright", "warrant", "applicable", "remotely", "cddl", "distributed", "endorse", "contained",
    "altered", "trademark", "jpeg", "stuff", "gemma", "reproduced", "unauthorized",
)
_BLANKS = r"[\s*#/]+"
#: The same for names with a blank in their stem, over line breaks and comment signs too.
SPLIT_STEM = rf"cc{_BLANKS}by"


@dataclass(frozen=True)
class Rule:
    """``keyword`` is in lower case and in the lower-case form of every match."""

    name: str
    label: str
    keyword: str
    priority: int
    score: float
    pattern: str


def _rule(name: str, label: str, keyword: str, priority: int, score: float, text: str) -> Rule:
    return Rule(name, label, keyword, priority, score, "(?i)" + text.replace(" ", _BLANKS))


def signature_rules() -> list[Rule]:
    """All rules: five forms of each family, three of its other names, four of each commons license, the
    plain ones and the sentences of notices."""
    rules = []
    under = r"(?:the )?(?:terms of )?(?:the )?"

    def named(name: str, label: str, keyword: str, word: str) -> list[Rule]:
        return [
            _rule(f"{name}:licensed", label, keyword, 4, 0.95, rf"licen[cs]ed under {under}{word[2:]}"),
            _rule(f"{name}:released", label, keyword, 4, 0.95,
                  rf"(?:released|distributed|available|published|provided) under {under}{word[2:]}"),
            _rule(f"{name}:name", label, keyword, 2, 0.8, word),
        ]

    for label, spdx, keyword, name, page in FAMILIES:
        word = rf"\b{name}(?:-| )?licen[cs]e\b"
        if label == "unlicense":
            word = r"\bthe unlicense\b"
        rules += [
            _rule(f"{label}:spdx", label, "spdx", 6, 1.0, rf"spdx-license-identifier:\s*(?:{spdx})(?![\w.-]*\w)"),
            _rule(f"{label}:page", label, page.split("\\")[0].split("/")[0].strip(), 4, 0.9, rf"https?://(?:www\.)?{page}"),
            *named(label, label, keyword, word),
        ]
    for label, keyword, name in OTHER_NAMES:
        rules += named(keyword, label, keyword, rf"\b{name}(?:-| )?licen[cs]e\b")
    for label, spdx, clause, path in COMMONS:
        end = r"(?!(?:-| )?(?:sa|nc|nd)\b)"
        rules += [
            _rule(f"{label}:spdx", label, "spdx", 6, 1.0, rf"spdx-license-identifier:\s*{spdx}"),
            _rule(f"{label}:page", label, "creativecommons", 4, 0.9,
                  rf"https?://(?:www\.)?creativecommons\.org/licenses/{path}/\d"),
            _rule(f"{label}:licensed", label, "cc", 4, 0.95,
                  rf"licen[cs]ed under (?:a |the )?\bcc(?:-| ){clause}{end}(?:(?:-| )\d\.\d)?"),
            _rule(f"{label}:name", label, "cc", 2, 0.8, rf"\bcc(?:-| ){clause}{end}(?:(?:-| )\d\.\d)?\b"),
        ]
    for form, listed in (("plain", PLAIN), ("notice", NOTICES)):
        for i, (label, keyword, priority, score, text) in enumerate(listed):
            rules.append(_rule(f"{label}:{form}{i}", label, keyword, priority, score, text))
    return rules


def _rule_array(rules: list[Rule]) -> Column:
    """The rules as one constant."""
    return F.from_json(
        F.lit(json.dumps([asdict(r) for r in rules])),
        "array<struct<name:string,label:string,keyword:string,priority:int,score:double,pattern:string>>",
    )


_DETECTION = "struct<start:int,back:int,rank:int,end:int,label:string,score:double,rule:string>"


def unsuppressed(detections: Column) -> Column:
    """Detections without those inside another that outranks them.

    In order of start, the longer and then the higher priority first, whatever
    contains a detection comes before it.  It is dropped if one so far, of at
    least its priority, ends no earlier.  Of each priority the furthest end is
    held, unless a higher one reaches as far.
    """
    def step(ends: Column, x: Column) -> tuple[Column, Column, Column]:
        inside = F.exists(ends, lambda e: (e["rank"] <= x["rank"]) & (e["end"] >= x["end"]))
        others = F.filter(ends, lambda e: (e["rank"] < x["rank"]) | (e["end"] > x["end"]))
        reach = F.struct(x["rank"].alias("rank"), x["end"].alias("end"))
        return F.when(inside, ends).otherwise(F.concat(others, F.array(reach))), ~inside, x

    start = F.array().cast("array<struct<rank:int,end:int>>")
    return running(F.array_sort(detections), start, _DETECTION, step)


def scan_licenses(
    docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text",
    names: tuple[str, str, str] = ("n_words", "places", "detections"),
) -> DataFrame:
    """Rows of ``docs`` with the word count, places of base phrases, and detections.

    ``places`` is an array of (word, label), the number of the word where a
    phrase starts, from 0.  ``detections`` is an array of (start, end, label,
    score, rule) in code points, without suppressed ones.  Null and empty texts
    have no words, places or detections.  A column of ``docs`` with the name of
    an output stays; the output gets an underscore.

    A rule is run only where its keyword occurs.  The library's own rules are
    looked at only in texts with one of ``STEMS`` or ``SPLIT_STEM``, which all
    their matches hold; rules that are given, in any text with a keyword.
    """
    stems, split_stem = ([r.keyword for r in rules], None) if rules is not None else (STEMS, SPLIT_STEM)
    rules = signature_rules() if rules is None else rules
    text, low = fresh(docs, "_scan_text", "_scan_low")
    names = fresh(docs, *names)
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(low, F.lower(text))
    phrase_word = F.contains(low, F.lit("license"))
    counted = let(
        F.split(F.col(text), PHRASES, -1),
        lambda parts: let(
            F.regexp_extract_all(F.col(text), F.lit(PHRASES), F.lit(0)),
            lambda hits: running(
                F.zip_with(
                    parts,
                    hits,
                    lambda p, h: F.struct(
                        F.regexp_count(p, F.lit(WORD)).alias("gap"), F.lower(F.substring(h, 1, 1)).alias("kind")
                    ),
                ),
                F.lit(0),
                "struct<word:int,label:string>",
                lambda at, x: (
                    at + x["gap"] + F.when(x["kind"] == "g", 3).when(x["kind"].isNull(), 0).otherwise(2),
                    x["kind"].isNotNull(),
                    F.struct(
                        (at + x["gap"]).alias("word"),
                        F.element_at(F.create_map(*(F.lit(v) for kv in _BASE_LABELS.items() for v in kv)), x["kind"]).alias("label"),
                    ),
                ),
            ),
        ),
    )
    places = F.when(phrase_word, counted).otherwise(F.array().cast("array<struct<word:int,label:string>>"))
    hinted = F.lit(False)
    for stem in dict.fromkeys(stems):
        hinted = hinted | F.contains(low, F.lit(stem))
    if split_stem:
        hinted = hinted | (F.contains(low, F.lit("cc")) & F.col(low).rlike(split_stem))
    found = F.flatten(
        F.transform(
            F.filter(_rule_array(rules), lambda r: F.contains(F.col(low), r["keyword"])),
            lambda r: F.transform(
                match_spans(F.col(text), r["pattern"]),
                lambda s: F.struct(
                    s["start"].alias("start"),
                    (-s["end"]).alias("back"),
                    (-r["priority"]).alias("rank"),
                    s["end"].alias("end"),
                    r["label"].alias("label"),
                    r["score"].alias("score"),
                    r["name"].alias("rule"),
                ),
            ),
        )
    )
    kept = F.transform(
        unsuppressed(found),
        lambda d: F.struct(
            d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label"),
            d["score"].alias("score"), d["rule"].alias("rule"),
        ),
    )
    nothing = F.array().cast("array<struct<start:int,end:int,label:string,score:double,rule:string>>")
    return (
        rows.withColumn(names[0], F.regexp_count(text, F.lit(WORD)).cast("long"))
        .withColumn(names[1], places)
        .withColumn(names[2], F.when(hinted, kept).otherwise(nothing))
        .drop(text, low)
    )
