"""License scans by ordered signature rules.

A rule is a regex over the words of a text (lower case, one space between), a keyword without which it cannot
match, a label, a priority and a score.  Rules are sentences of licenses, their titles and addresses and other notices,
each written out, and names of licenses in the phrases by which texts grant or mention a license.  A text is first
searched for stems of which every match has one; only where one stands, its words are taken apart, and only rules whose
keyword is among the words are tried.

Overlapping detections: one inside another is suppressed unless its priority is higher; of two at the same words the
one with the higher priority stays, then the earlier rule.  Base phrases (``BASE``) are counted before and apart, so
suppression never takes one away.

Everything is built-in functions, and each row is worked on by itself; nothing is shuffled.

Defined results: a null or empty text has no words and no labels, score 0; rows map one to one; other columns are
ignored; positions are numbers of words, from 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let, walk

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_SCORE = 0.5

#: Label, keyword, and the license's name in words.
NAMES = [
    ("mit", "mit", r"mit(?: expat)?"),
    ("mit-0", "attribution", r"mit no attribution"),
    ("x11", "x11", r"x11(?: mit)?"),
    ("isc", "isc", r"isc"),
    ("bsd-2-clause", "bsd", r"(?:simplified |freebsd |2 clause )bsd|bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new |modified |revised |3 clause )bsd|bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original |4 clause )bsd|bsd 4 clause"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("0bsd", "0bsd", r"0bsd"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)? (?:version |v )?1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)? (?:version |v )?(?:2 0|2|v2)"),
    ("apache", "apache", r"apache(?: software)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public(?: license)?(?: version| v)? (?:3|v3)(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public(?: license)?(?: version| v)? 2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public(?: license)?(?: version| v)? (?:3|v3)(?: 0)?"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public"),
    ("gpl-1.0", "gnu", r"gnu (?:general public|gpl)(?: license)?(?: version| v)? 1(?: 0)?"),
    ("gpl-2.0", "gnu", r"gnu (?:general public|gpl)(?: license)?(?: version| v)? (?:2|v2)(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu (?:general public|gpl)(?: license)?(?: version| v)? (?:3|v3)(?: 0)?"),
    ("gpl", "gnu", r"gnu (?:general public|gpl)"),
    ("gfdl", "gnu", r"gnu free documentation"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)?(?: version| v)? 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public"),
    ("epl-1.0", "eclipse", r"eclipse public(?: license)?(?: version| v)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public"),
    ("eupl", "european", r"european union public"),
    ("cddl", "development", r"common development and distribution"),
    ("cpl", "common", r"common public"),
    ("artistic-2.0", "artistic", r"artistic(?: license)? 2(?: 0)?"),
    ("artistic", "artistic", r"artistic"),
    ("bsl-1.0", "boost", r"boost software"),
    ("busl", "business", r"business source"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python", "python", r"python(?: software foundation)?"),
    ("php", "php", r"php"),
    ("ruby", "ruby", r"ruby"),
    ("openssl", "openssl", r"openssl"),
    ("ofl", "font", r"(?:sil )?open font"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("unlicense", "unlicense", r"unlicense"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database"),
    ("odc-by", "commons", r"open data commons attribution"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv[a-z]*"),
    ("cc-by", "creative", r"creative commons attribution"),
    ("mit-0", "mit", r"mit 0"),
    ("agpl-1.0", "agpl", r"agpl(?: version| v)? ?(?:1|v1)(?: 0)?(?: only| or later)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: version| v)? ?(?:3|v3)(?: 0)?(?: only| or later)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl(?: version| v)? ?(?:2|v2)(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version| v)? ?(?:2|v2) 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?: version| v)? ?(?:3|v3)(?: 0)?(?: only| or later)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl(?: version| v)? ?(?:1|v1)(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: version| v)? ?(?:2|v2)(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: version| v)? ?(?:3|v3)(?: 0)?(?: only| or later)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl(?: version| v)?(?: ?v?1 [1-3])?(?: only| or later)?"),
    ("mpl-1.0", "mpl", r"mpl(?: version| v)? ?(?:1|v1)(?: 0)?"),
    ("mpl-1.1", "mpl", r"mpl(?: version| v)? ?(?:1|v1) 1"),
    ("mpl-2.0", "mpl", r"mpl(?: version| v)? ?(?:2|v2)(?: 0)?"),
    ("mpl", "mpl", r"mpl"),
    ("epl-1.0", "epl", r"epl(?: version| v)? ?(?:1|v1)(?: 0)?"),
    ("epl-2.0", "epl", r"epl(?: version| v)? ?(?:2|v2)(?: 0)?"),
    ("epl", "epl", r"epl"),
    ("eupl", "eupl", r"eupl(?: version| v)?(?: ?v?1 [0-2])?"),
    ("cddl", "cddl", r"cddl(?: version| v)?(?: ?v?1 [01])?"),
    ("cpl", "cpl", r"cpl(?: 1 0)?"),
    ("bsl-1.0", "bsl", r"bsl(?: 1 0)?"),
    ("busl", "busl", r"busl(?: 1 1)?"),
    ("python", "psf", r"psf(?: 2 0)?"),
    ("ofl", "ofl", r"(?:sil )?ofl(?: 1 [01])?"),
    ("odbl", "odbl", r"odbl(?: 1 0)?"),
    ("odc-by", "odc", r"odc by(?: 1 0)?"),
    ("ms-pl", "ms", r"ms pl"),
    ("ms-rl", "ms", r"ms rl"),
]
#: The phrases around a name, with priority and score; the most telling first.
PHRASES = [
    (r"spdx license identifier (?:{})", 60, 1.0),
    (r"(?:licensed|released|distributed|published|available|provided) (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:{})(?: (?:public )?license)?", 50, 0.95),
    (r"(?:dual |multi )?licensed (?:as|with|by) (?:the )?(?:{})(?: license)?", 45, 0.9),
    (r"(?:under|subject to) the (?:terms|conditions)(?: and conditions)? of (?:the )?(?:{})(?: license)?", 45, 0.9),
    (r"licen[cs]e (?:is )?(?:the )?(?:{})(?: license)?", 40, 0.8),
    (r"(?:{}) licen[cs]ed?", 30, 0.8),
]
#: Sentences of licenses, notices and addresses.  Label, keyword, regex; priority and score by group.
GRANTS = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("x11", "advertising", r"except as contained in this notice the names? of (?:[^ ]+ ){1,8}shall not be used in advertising"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "appear", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("hpnd", "documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:[^ ]+ ){1,8}nor the names of (?:its|the|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "provided", r"this software is provided by the (?:copyright holders|regents|authors?)(?: and contributors)? as is"),
    ("apache-2.0", "compliance", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-2.0", "irrevocable", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2.0", "limitations", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license"),
    ("gpl-2.0", "option", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "option", r"either version 3 of the license or at your option any later version"),
    ("gpl", "copyleft", r"the gnu general public license is a free copyleft license"),
    ("gpl", "freedom", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom"),
    ("gpl-3.0", "circumvention", r"protecting users legal rights from anti circumvention law"),
    ("gpl-exception", "exception", r"as a special exception the (?:copyright holders?|authors?) (?:of [^ ]+ )?gives? (?:you )?permission to link"),
    ("gpl-exception", "classpath", r"designates this particular file as subject to the classpath exception"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it"),
    ("lgpl-2.1", "option", r"either version 2 1 of the license or at your option any later version"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", "remotely", r"all users interacting with it remotely through a computer network"),
    ("gfdl", "document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "secondary", r"this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "contents", r"the contents of this file are subject to the terms of (?:either )?(?:the )?common development and distribution license"),
    ("cpl", "recipient", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("artistic", "perl", r"under the same terms as perl itself"),
    ("bsl-1.0", "organization", r"free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("busl", "production", r"the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", r"the origin of this (?:software|source code) must not be misrepresented"),
    ("postgresql", "university", r"in no event shall the university of california be liable to any party"),
    ("python", "psf", r"psf is making python available to licensee on an as is basis"),
    ("php", "php", r"products derived from this software may not be called php"),
    ("ruby", "bsdl", r"redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("ofl", "font", r"this font software is licensed under the sil open font license"),
    ("ofl", "font", r"with reserved font names?"),
    ("wtfpl", "fuck", r"do what the fuck you want to"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("cc0", "neighboring", r"dedicated all copyright and related and neighboring rights"),
    ("beerware", "retain", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sleepycat", "accompanied", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("tcl", "authors", r"the authors hereby grant permission to use copy modify distribute and license this software"),
    ("curl", "fee", r"distribute this software for any purpose with or without fee is hereby granted"),
    ("ncsa", "illinois", r"neither the names of (?:[^ ]+ ){1,8}university of illinois nor the names of"),
    ("llama", "llama", r"llama materials and derivative works"),
]
#: Licenses that go by one usual name or address.
TITLES = [
    ("apache-2.0", "apache", r"apache org licenses license 2 0"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse org (?:legal|org documents) epl v10"),
    ("epl-2.0", "eclipse", r"eclipse org legal epl (?:v20|2 0)"),
    ("cddl", "opensolaris", r"opensolaris org os licensing"),
    ("bsl-1.0", "boost", r"boost org license 1 0 txt"),
    ("mit", "opensource", r"opensource org licenses mit"),
    ("bsd-2-clause", "opensource", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource", r"opensource org licenses bsd 3 clause"),
    ("gpl-2.0", "gnu", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu", r"gnu org licenses gpl 3 0"),
    ("lgpl-2.1", "gnu", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu", r"gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "gnu", r"gnu org licenses agpl 3 0"),
    ("gfdl", "gnu", r"gnu org licenses fdl 1 [1-3]"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by"),
    ("pddl", "opendatacommons", r"opendatacommons org licenses pddl"),
    ("pddl", "dedication", r"public domain dedication and license"),
    ("ncsa", "ncsa", r"ncsa open source license"),
    ("sspl", "server", r"server side public license"),
    ("elastic-2.0", "elastic", r"elastic license 2 0"),
    ("commons-clause", "clause", r"commons clause license condition"),
    ("polyform", "polyform", r"polyform (?:noncommercial|shield|strict|perimeter|internal use|small business|free trial) license"),
    ("fsl", "functional", r"functional source license"),
    ("osl", "open", r"open software license (?:version |v )?[1-3] [01]"),
    ("afl", "academic", r"academic free license"),
    ("upl", "universal", r"universal permissive license"),
    ("ecl", "educational", r"educational community license"),
    ("ogl", "government", r"open government licen[cs]e"),
    ("etalab", "ouverte", r"licence ouverte"),
    ("cecill", "cecill", r"(?:free software license agreement|licence) cecill(?: [bc])?"),
    ("vim", "vim", r"vim license"),
    ("ipl", "ibm", r"ibm public license"),
    ("apsl", "apple", r"apple public source license"),
    ("sgi-b", "sgi", r"sgi free software license b"),
    ("unicode", "unicode", r"unicode (?:inc )?license agreement"),
    ("icu", "icu", r"icu license"),
    ("w3c", "w3c", r"w3c software (?:and )?(?:document )?(?:notice and )?license"),
    ("zpl", "zope", r"zope public license"),
    ("qpl", "q", r"the q public license"),
    ("hippocratic", "hippocratic", r"hippocratic license"),
    ("openrail", "openrail", r"openrail(?: m)? license"),
    ("openrail", "rail", r"rail(?: m)? license"),
    ("llama", "llama", r"llama (?:[234] )?(?:[1-3] )?community license"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("bigscience", "bigscience", r"bigscience (?:open )?rail license"),
]
#: Notices that grant or deny rights without naming a license.
NOTICES = [
    ("public-domain", "public", r"(?:released|dedicated|placed|work is) (?:in(?:to)?|to) the public domain", 40, 0.8),
    ("public-domain", "domain", r"not subject to copyright protection and (?:is|are) in the public domain", 45, 0.9),
    ("public-domain", "claimed", r"no copyright is claimed", 40, 0.8),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 40, 0.8),
    ("proprietary", "secrets", r"(?:contains|constitutes|are) (?:the )?trade secrets of", 40, 0.8),
    ("proprietary", "prohibited", r"unauthorized (?:copying|use|reproduction|distribution|duplication) (?:[^ ]+ ){0,12}?is (?:strictly )?prohibited", 40, 0.8),
    ("proprietary", "reproduced", r"no part of this (?:publication|document|book|work|site|website) may be reproduced", 40, 0.8),
    ("proprietary", "installing", r"by installing (?:or using )?(?:this|the) software you (?:agree|accept)", 40, 0.8),
    ("proprietary", "reverse", r"you (?:may|shall|must) not (?:modify )?(?:decompile |disassemble )?(?:or )?reverse engineer", 40, 0.7),
    ("proprietary", "agreement", r"end user license agreement", 40, 0.8),
    ("proprietary", "agreement", r"subject to (?:a|the) non ?disclosure agreement", 40, 0.8),
    ("proprietary", "permission", r"without (?:the )?(?:prior )?(?:express )?written permission", 20, 0.6),
    ("proprietary", "consent", r"without (?:the )?(?:prior )?(?:express )?written consent of the copyright", 20, 0.6),
    ("proprietary", "rights", r"all rights reserved", 20, 0.6),
    ("non-commercial", "commercial", r"for non commercial (?:use|purposes) only", 40, 0.8),
    ("non-commercial", "noncommercial", r"for noncommercial (?:use|purposes) only", 40, 0.8),
    ("non-commercial", "commercial", r"commercial use (?:is )?(?:strictly )?(?:prohibited|not permitted|forbidden)", 40, 0.8),
    ("non-commercial", "academic", r"licensed for academic (?:and research )?use only", 40, 0.8),
]
#: Keywords that also begin longer words, such as gplv2; all others are whole words.
PREFIXES = {"agpl", "lgpl", "gpl", "gfdl", "mpl", "epl", "eupl", "cddl"}
#: Searched for first, in the text as it stands; every rule's match has one of them.
#: Parts of words, and where those alone are common, what must stand around them.
GATES = {
    "licen": None, "permission": None, "permitted": None, "redistribut": None, "warrant": None, "confidential": None, "copyright": None, "software": None, "source": None, "commons": None, "creativecommons": None,
    "prohibited": None, "reproduc": None, "forbidden": None, "secrets": None, "disclosure": None, "engineer": None, "program": None, "opensource": None, "unlicense": None, "font": None,
    "domain": r"public[\W_]+domain", "rights": r"rights[\W_]+(?:reserved|from)", "terms": r"(?:(?:under|to)[\W_]+the|same)[\W_]+terms|terms[\W_]+of[\W_]+use", "conditions": r"(?:under|to)[\W_]+the[\W_]+conditions",
    "under": r"(?:released|distributed|published|available|provided)[\W_]+(?:to[\W_]+you[\W_]+)?under", "commercial": r"commercial[\W_]+(?:use|purposes)", "org": r"(?:mozilla|eclipse|opensolaris|gnu)[\W_]+org",
    "invariant": r"invariant[\W_]+sections", "network": r"computer[\W_]+network", "university": r"university[\W_]+of[\W_]+(?:california|illinois)", "psf": None, "bsdl": None, "fuck": None, "irrevocable": None, "classpath": None, "stuff": r"this[\W_]+stuff",
    "llama": r"llama[\W_]+materials", "version": r"any[\W_]+later[\W_]+version", "names": r"nor[\W_]+the[\W_]+names", "notice": r"in[\W_]+this[\W_]+notice",
}
GATE = "(?i)" + "|".join(x or stem for stem, x in GATES.items())


def rules() -> list[dict]:
    """All rules in order: names in phrases, then what is written out in full."""
    out = [
        {"label": label, "keyword": keyword, "regex": phrase.format(name), "priority": priority + 2 * any(c.isdigit() for c in label), "score": score}
        for phrase, priority, score in PHRASES
        for label, keyword, name in NAMES
    ]
    written = [(*x, 70, 1.0) for x in GRANTS] + [(*x, 48, 0.9) for x in TITLES] + NOTICES
    out += [dict(zip(("label", "keyword", "regex", "priority", "score"), x, strict=True)) for x in written]
    return [{**r, "no": i, "regex": f"(?<= )(?:{r['regex']})(?= )"} for i, r in enumerate(out)]


def gated(text: Column) -> Column:
    """Whether anything in ``GATES`` stands in a text; most texts are turned away by plain searches for the stems."""
    low = F.lower(text)
    one = lambda stem, around: low.contains(stem) if around is None else low.contains(stem) & low.rlike(around)
    return reduce(Column.__or__, (one(*g) for g in GATES.items()))


def normal(text: Column) -> Column:
    """The words of a text in lower case, with a space before and after each."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" ")))


PLACE = "struct<start:bigint,end:bigint,hit:string>"


def places(norm: Column, regex: Column) -> Column:
    """(first word, word after the last, words) of every match of a regex over ``normal`` text."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + _spaces(x["piece"])
        end = begin + _spaces(x["hit"]) + 1
        return end - 1, F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit"))

    pairs = lambda found: F.arrays_zip(F.slice(F.split(norm, regex, -1), 1, F.size(found)).alias("piece"), found.alias("hit"))
    none = F.expr(f"cast(array() as array<{PLACE}>)")
    return let(F.regexp_extract_all(norm, regex, F.lit(0)), lambda found: F.when(F.size(found) > 0, walk(pairs(found), F.lit(-1), "bigint", PLACE, step)).otherwise(none))


DETECTION = "struct<start:bigint,before:bigint,rank:int,no:int,label:string,score:double>"
FOUND = f"array<{DETECTION}>"


def detections(norm: Column, known: list[dict]) -> Column:
    """Detections of all rules, sorted and without those that others contain (see ``outermost``)."""
    gates = sorted({r["keyword"] for r in known})
    stands = lambda k: norm.contains(F.concat(F.lit(" "), k, F.when(k.isin(sorted(PREFIXES)), F.lit("")).otherwise(F.lit(" "))))
    table = F.array(*(F.struct(*(F.lit(r[k]).alias(k) for k in ("no", "label", "keyword", "regex", "priority", "score"))) for r in known))
    tried = let(F.filter(F.array(*(F.lit(k) for k in gates)), stands), lambda here: F.filter(table, lambda r: F.array_contains(here, r["keyword"])))
    # before and rank are negative, so that longer and more important ones sort first
    one = lambda r: F.transform(places(norm, r["regex"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("before"), (-r["priority"]).alias("rank"), r["no"].alias("no"), r["label"].alias("label"), r["score"].alias("score")))
    return outermost(F.array_sort(F.flatten(F.transform(tried, one))).cast(FOUND))


def outermost(found: Column) -> Column:
    """Sorted detections without those inside another of equal or higher priority; of two alike the earlier stays.

    Those kept so far that still matter are a short list: none of them is inside another of at least its priority, so
    there are no more than priorities.  One that is left out never hides more than the one that hid it.
    """
    front = "array<struct<before:bigint,rank:int>>"

    def step(open_: Column, x: Column) -> tuple[Column, Column]:
        hidden = F.exists(open_, lambda o: (o["before"] <= x["before"]) & (o["rank"] <= x["rank"]))
        left = F.filter(open_, lambda o: (-o["before"] > x["start"]) & ~((x["before"] <= o["before"]) & (x["rank"] <= o["rank"])))
        after = F.when(hidden, open_).otherwise(F.concat(left, F.array(F.struct(x["before"].alias("before"), x["rank"].alias("rank")))))
        return after, F.struct(x.alias("x"), hidden.alias("hidden"))

    marked = walk(found, F.expr(f"cast(array() as {front})"), front, f"struct<x:{DETECTION},hidden:boolean>", step)
    return F.transform(F.filter(marked, lambda m: ~m["hidden"]), lambda m: m["x"])


def scan(docs: DataFrame, known: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, base (places of the base phrases) and found (FOUND) of every row of ``docs`` (doc_id, text)."""
    known = known or rules()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = own.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(gated(F.col("text")), normal(F.col("text"))).alias("norm"))
    phrases = F.lit(f"(?<= )(?:{'|'.join(BASE)})(?= )")
    base = F.when(F.col("norm").rlike(f" (?:{'|'.join(BASE)}) "), places(F.col("norm"), phrases)).otherwise(F.expr(f"cast(array() as array<{PLACE}>)"))
    found = F.when(F.col("norm").isNotNull(), detections(F.col("norm"), known)).otherwise(F.expr(f"cast(array() as {FOUND})"))
    return own.select("doc_id", "n_words", base.alias("base"), found.alias("found"))


def report(scanned: DataFrame) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in BASE.items() for x in pair))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda p: F.element_at(names, p["hit"]))))
    more = F.transform("found", lambda d: d["label"])
    score = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda d: d["score"])), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["start"])).alias("first_word"), F.array_max(F.transform("base", lambda p: p["start"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"), score.alias("score"),
    )
