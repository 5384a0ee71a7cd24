"""License scan: ordered signature rules behind a keyword prefilter, with priorities and interval containment."""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import bound_batches, table

#: Upper to lower case, and every byte outside of a word (0-9, a-z, 0x80 and above) to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BASE = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: Hand-written families: label, keyword that the text must hold, how the license is called, and its versions.
#: Patterns are matched against folded words joined by single blanks, so "GPL-3.0" reads "gpl 3 0".
FAMILIES = [
    ("mit", "mit", r"(?:mit|expat|x11)", ""),
    ("mit-0", "mit", r"mit (?:no attribution|0)", ""),
    ("apache", "apache", r"(?:apache(?: software)?|asl|al)", "1 0|1 1|2 0"),
    ("gpl", "gpl", r"gpl", "1 0|2 0|3 0"),
    ("gpl", "general public", r"(?:gnu )?general public", "1 0|2 0|3 0"),
    ("lgpl", "lgpl", r"lgpl", "2 0|2 1|3 0"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public", "2 0|2 1|3 0"),
    ("lgpl", "library general", r"(?:gnu )?library general public", "2 0"),
    ("agpl", "agpl", r"agpl", "1 0|3 0"),
    ("agpl", "affero", r"(?:gnu )?affero general public", "1 0|3 0"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", "1 1|1 2|1 3"),
    ("bsd", "bsd", r"(?:bsd|berkeley software distribution)", ""),
    ("bsd-0-clause", "bsd", r"(?:0|zero) clause bsd", ""),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", ""),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", ""),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)", ""),
    ("isc", "isc", r"isc", ""),
    ("mpl", "mpl", r"mpl", "1 0|1 1|2 0"),
    ("mpl", "mozilla", r"mozilla public", "1 0|1 1|2 0"),
    ("epl", "eclipse", r"eclipse public", "1 0|2 0"),
    ("edl", "eclipse", r"eclipse distribution", "1 0"),
    ("cddl", "cddl", r"cddl", "1 0|1 1"),
    ("cddl", "common development", r"common development and distribution", "1 0|1 1"),
    ("cpl", "common public", r"common public", "1 0"),
    ("cpal", "common public attribution", r"common public attribution", "1 0"),
    ("eupl", "european union", r"european union public", "1 0|1 1|1 2"),
    ("eupl", "eupl", r"eupl", "1 0|1 1|1 2"),
    ("artistic", "artistic", r"(?:perl )?artistic", "1 0|2 0"),
    ("zlib", "zlib", r"zlib(?: libpng)?", ""),
    ("libpng", "libpng", r"libpng", "2 0"),
    ("boost", "boost", r"boost software", "1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", r"wtfpl", "1 0|2 0"),
    ("python", "python software", r"python software foundation", "2 0"),
    ("php", "php", r"php", "3 0|3 01"),
    ("openssl", "openssl", r"openssl", ""),
    ("ofl", "open font", r"(?:sil )?open font", "1 0|1 1"),
    ("odbl", "open database", r"open (?:data commons open )?database", "1 0"),
    ("odc-by", "open data commons", r"open data commons attribution", "1 0"),
    ("pddl", "public domain dedication", r"(?:open data commons )?public domain dedication", "1 0"),
    ("bsl", "business source", r"business source", "1 0|1 1"),
    ("sspl", "server side public", r"server side public", "1 0"),
    ("elastic", "elastic", r"elastic", "1 0|2 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", ""),
    ("postgresql", "postgresql", r"postgresql", ""),
    ("ms-pl", "microsoft public", r"microsoft public", ""),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", ""),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?open ?rail(?: m| d)?", ""),
    ("cc0", "cc0", r"cc0", "1 0"),
    ("cc0", "creative commons zero", r"creative commons zero", "1 0"),
    *((f"cc-{short.replace(' ', '-')}", key, call, "1 0|2 0|2 5|3 0|4 0") for short, long in {
        "by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial",
        "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives",
    }.items() for key, call in (("cc by", f"cc {short}"), ("creative commons", f"creative commons {long}"), ("creative commons", f"creative commons {short}"))),
]
#: Forms that a signature takes: name, priority (the lowest wins), confidence, and the pattern around a family's own.
FORMS = [
    ("identifier", 0, 0.95, r"spdx license identifier {call}(?: {version})?(?: only| or later)?"),
    ("grant", 1, 0.9, r"(?:licensed|released|distributed|available|published|provided|covered|governed|dedicated)(?: to you)? (?:under|by|with|in)(?: the)?(?: terms of)?(?: the)? {call}(?: software)?(?: licen[cs]e)?(?: international)?(?: version)?(?: v)?(?: {version})?"),
    ("titled", 2, 0.7, r"{call} (?:international )?licen[cs]e(?: version| v)?(?: {version})?"),
    ("versioned", 3, 0.5, r"{call}(?: licen[cs]e)?(?: version| v)? {version}"),
]
#: Signatures that stand alone, each the words of a notice, grant, condition or disclaimer: name, priority, confidence,
#: label, keyword, pattern. Up to a dozen words may stand where a text names somebody.
SOMEBODY = r"(?:[^ ]+ ){1,12}"
SINGLE = [
    ("mit grant text", 0, 0.95, "mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit grant opening", 1, 0.9, "mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit notice condition", 1, 0.8, "mit", "substantial portions", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit disclaimer", 2, 0.5, "mit", "noninfringement", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit liability", 2, 0.5, "mit", "copyright holders be liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11 names", 1, 0.8, "x11", "contained in this notice", rf"except as contained in this notice the names? of {SOMEBODY}shall not be used in advertising"),
    ("json condition", 0, 0.95, "json", "not evil", r"the software shall be used for good not evil"),
    ("isc grant text", 0, 0.9, "isc", "permission to use", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc grant opening", 2, 0.7, "isc", "permission to use", r"permission to use copy modify and or distribute this software"),
    ("isc disclaimer", 2, 0.6, "isc", "disclaims all warranties", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("hpnd grant", 0, 0.9, "hpnd", "permission to use", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("postgresql grant", 0, 0.9, "postgresql", "without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("tcl grant", 0, 0.9, "tcl", "hereby grant permission", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("ncsa grant", 0, 0.85, "ncsa", "deal with the software", r"to deal with the software without restriction"),
    ("bsd grant text", 0, 0.9, "bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd grant opening", 1, 0.85, "bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd source condition", 1, 0.7, "bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd binary condition", 1, 0.7, "bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd names condition", 0, 0.9, "bsd-3-clause", "endorse or promote", rf"neither the names? of {SOMEBODY}nor the names of (?:its|their) contributors may be used to endorse or promote products"),
    ("bsd advertising condition", 0, 0.9, "bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd disclaimer", 1, 0.7, "bsd", "this software is provided", r"this software is provided by the (?:copyright holders|regents|author)(?: and contributors)? as is"),
    ("bsd clear condition", 0, 0.9, "bsd-3-clause-clear", "express or implied licenses", r"no express or implied licenses to any party s patent rights are granted"),
    ("apache file notice", 0, 0.95, "apache-2.0", "in compliance with the license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache basis", 1, 0.8, "apache-2.0", "required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache contributors", 0, 0.9, "apache-2.0", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache patent grant", 0, 0.9, "apache-2.0", "patent license subject", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache terms heading", 1, 0.7, "apache-2.0", "for use reproduction", r"terms and conditions for use reproduction and distribution"),
    ("apache acknowledgement", 0, 0.8, "apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache link", 1, 0.9, "apache-2.0", "apache org", r"www apache org licenses license 2 0"),
    ("gpl program notice", 0, 0.95, "gpl", "is free software", r"(?:this program|this software|this file|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl 2 or later", 0, 0.9, "gpl-2.0", "any later version", r"either version 2 of the license or at your option any later version"),
    ("gpl 3 or later", 0, 0.9, "gpl-3.0", "any later version", r"either version 3 of the license or at your option any later version"),
    ("gpl hope", 2, 0.6, "gpl", "in the hope that", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl copy", 1, 0.85, "gpl", "should have received", r"you should have received a copy of the gnu general public license along with"),
    ("gpl address", 2, 0.5, "gpl", "free software foundation", r"write to the free software foundation inc"),
    ("gpl verbatim", 2, 0.5, "gpl", "verbatim copies of this license", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl preamble", 0, 0.9, "gpl", "take away your freedom", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom"),
    ("gpl 3 preamble", 0, 0.95, "gpl-3.0", "free copyleft license", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl 2 notices", 0, 0.85, "gpl-2.0", "carry prominent notices", r"you must cause the modified files to carry prominent notices stating that you changed the files"),
    ("gpl 3 circumvention", 0, 0.9, "gpl-3.0", "anti circumvention", r"protecting users legal rights from anti circumvention law"),
    ("gpl interactive notice", 1, 0.7, "gpl", "absolutely no warranty", r"comes with absolutely no warranty"),
    ("gpl classpath exception", 0, 0.9, "gpl-classpath", "combined work", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gnu link", 2, 0.6, "gpl", "gnu org", r"www gnu org licenses(?: gpl \d(?: \d)?)?"),
    ("lgpl library notice", 0, 0.95, "lgpl", "is free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl copy", 1, 0.85, "lgpl", "should have received", r"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl 3 terms", 0, 0.95, "lgpl-3.0", "incorporates the terms", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("lgpl work that uses", 1, 0.7, "lgpl-2.1", "uses the library", r"a work that uses the library"),
    ("agpl network", 0, 0.9, "agpl-3.0", "remote network interaction", r"remote network interaction use with the gnu general public license"),
    ("agpl source offer", 0, 0.85, "agpl-3.0", "interact with users remotely", r"if your software can interact with users remotely through a(?: computer)? network you should also make sure"),
    ("agpl copy", 1, 0.9, "agpl", "should have received", r"you should have received a copy of the gnu affero general public license along with"),
    ("gfdl grant", 0, 0.95, "gfdl", "modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl sections", 1, 0.8, "gfdl", "invariant sections", r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    ("mpl 2 notice", 0, 0.95, "mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl 2 copy", 1, 0.9, "mpl-2.0", "copy of the mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl 1 notice", 0, 0.95, "mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl secondary", 0, 0.85, "mpl-2.0", "secondary licenses", r"incompatible with secondary licenses"),
    ("cddl notice", 0, 0.95, "cddl", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl notice", 0, 0.9, "epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl agreement", 0, 0.95, "epl", "accompanying program", r"the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("cpl agreement", 0, 0.95, "cpl", "accompanying program", r"the accompanying program is provided under the terms of this common public license agreement"),
    ("ibm agreement", 0, 0.95, "ipl", "accompanying program", r"the accompanying program is provided under the terms of this ibm public license agreement"),
    ("eupl notice", 0, 0.9, "eupl", "compliance with the licence", r"you may not use this work except in compliance with the licence"),
    ("cecill notice", 0, 0.9, "cecill", "cecill", r"(?:governed by the|régi par la licence) cecill"),
    ("artistic preamble", 0, 0.9, "artistic", "package may be copied", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("perl terms", 1, 0.85, "perl", "perl", r"(?:under the )?same terms as (?:the )?perl(?: 5)?(?: programming language system)? itself"),
    ("zlib disclaimer", 0, 0.85, "zlib", "held liable", r"provided as is without any express or implied warranty in no event will the authors? be held liable"),
    ("zlib origin", 0, 0.9, "zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib altered", 1, 0.8, "zlib", "plainly marked", r"altered source versions must be plainly marked as such"),
    ("libpng notice", 0, 0.9, "libpng", "png reference library", r"the png reference library is supplied as is"),
    ("ijg notice", 0, 0.9, "ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype notice", 0, 0.9, "ftl", "freetype project", rf"portions of this software are copyright {SOMEBODY}the freetype project"),
    ("boost grant", 0, 0.95, "boost-1.0", "person or organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost file notice", 0, 0.95, "boost-1.0", "boost software", r"distributed under the boost software license version 1 0"),
    ("unlicense opening", 0, 0.95, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense grant", 0, 0.9, "unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl terms", 0, 0.95, "wtfpl", "do what the", r"do what the f[^ ]* you want to"),
    ("beerware terms", 0, 0.9, "beerware", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("cc0 waiver", 0, 0.9, "cc0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("cc0 deed", 0, 0.9, "cc0", "associated a work", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0 universal", 0, 0.95, "cc0-1.0", "cc0", r"cc0 1 0 universal"),
    ("cc deed share", 1, 0.7, "cc", "redistribute the material", r"(?:share )?copy and redistribute the material in any medium or format"),
    ("cc deed noncommercial", 0, 0.85, "cc-by-nc", "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc deed sharealike", 0, 0.85, "cc-by-sa", "same license as the original", r"you must distribute your contributions under the same license as the original"),
    ("cc deed noderivatives", 0, 0.85, "cc-by-nd", "modified material", r"you may not distribute the modified material"),
    ("cc deed attribution", 0, 0.8, "cc-by", "appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc acceptance", 0, 0.85, "cc", "exercising the licensed rights", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms"),
    ("cc site notice", 1, 0.75, "cc", "otherwise noted", r"except where otherwise noted (?:this work|content on this site|content on this page|content on this wiki) is licensed under a creative commons"),
    ("cc link", 1, 0.85, "cc", "creativecommons org", r"creativecommons org (?:licenses|publicdomain) (?:by|zero)(?: nc)?(?: nd| sa)? \d \d"),
    ("python agreement", 0, 0.95, "python", "python software", r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("php acknowledgement", 0, 0.9, "php", "php software", r"this product includes php software freely available from"),
    ("ruby terms", 0, 0.8, "ruby", "2 clause bsdl", r"under either the terms of the 2 clause bsdl"),
    ("openssl acknowledgement", 0, 0.9, "openssl", "openssl project", r"this product includes software developed by the openssl project"),
    ("ssleay acknowledgement", 0, 0.9, "ssleay", "cryptographic software", r"this product includes cryptographic software written by eric young"),
    ("ofl notice", 0, 0.95, "ofl-1.1", "font software", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl derivatives", 0, 0.85, "ofl", "fonts and derivatives", r"the fonts and derivatives however cannot be released under any other type of license"),
    ("odbl notice", 0, 0.9, "odbl", "open database", r"is made available under the open database license"),
    ("odbl contents", 0, 0.9, "odbl", "database contents license", r"any rights in individual contents of the database are licensed under the database contents license"),
    ("bsl grant", 0, 0.95, "bsl-1.1", "non production use", r"create derivative works redistribute and make non production use of the licensed work"),
    ("sspl service", 0, 0.9, "sspl", "as a service", r"make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic limitation", 0, 0.9, "elastic-2.0", "managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons clause", 0, 0.9, "commons-clause", "commons clause", r"commons clause license condition(?: v)? 1 0"),
    ("ms-pl opening", 0, 0.85, "ms-pl", "governs use", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl grants", 0, 0.9, "ms-rl", "reciprocal grants", r"reciprocal grants for any file you distribute that contains code from the software"),
    ("openrail restrictions", 0, 0.85, "openrail", "derivatives of the model", r"you agree not to use the model or derivatives of the model"),
    ("llama agreement", 0, 0.9, "llama", "llama", r"llama (?:\d )?(?:\d )?community license agreement"),
    ("w3c notice", 0, 0.9, "w3c", "w3c software", r"w3c software(?: and document)? notice and license"),
    ("zope license", 0, 0.9, "zpl", "zope public", r"zope public license(?: zpl)? version 2 [01]"),
    ("q public license", 0, 0.9, "qpl", "q public", r"q public license(?: version 1 0)?"),
    ("academic free", 0, 0.9, "afl", "academic free", r"academic free license(?: version)?(?: v)? [123] \d"),
    ("open software license", 0, 0.9, "osl", "open software license", r"open software license(?: version)?(?: v)? [123] \d"),
    ("educational community", 0, 0.9, "ecl", "educational community", r"educational community license version [12] 0"),
    ("unicode agreement", 0, 0.9, "unicode", "unicode license", r"unicode license agreement data files and software"),
    ("mulan license", 0, 0.9, "mulanpsl", "mulan", r"mulan (?:psl|permissive software license)(?: v| version)? ?[12]"),
    ("open government", 0, 0.9, "ogl-uk", "open government", r"licensed under the open government licence(?: v[123])?"),
    ("licence ouverte", 0, 0.85, "etalab", "licence ouverte", r"licence ouverte(?: open licence)?"),
    ("public domain release", 0, 0.85, "public-domain", "release this work", r"the copyright holder of this work(?: hereby)? release this work into the public domain"),
    ("public domain file", 1, 0.8, "public-domain", "public domain", r"this (?:file|code|work|document|software) is in the public domain"),
    ("government work", 0, 0.8, "public-domain", "states government", r"works? of the united states government (?:is|are) not subject to copyright"),
    ("public domain", 4, 0.5, "public-domain", "public domain", r"(?:in|into|to) the public domain"),
    ("gemeinfrei", 4, 0.5, "public-domain", "gemeinfrei", r"gemeinfrei"),
    ("domaine public", 4, 0.5, "public-domain", "domaine public", r"dans le domaine public"),
    ("dominio público", 4, 0.5, "public-domain", "dominio público", r"(?:en el|de) dominio público"),
    ("confidential notice", 3, 0.7, "proprietary", "confidential and proprietary", r"(?:is|are) confidential and proprietary"),
    ("copying prohibited", 3, 0.8, "proprietary", "strictly prohibited", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("no part reproduced", 3, 0.75, "proprietary", "may be reproduced", r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("evaluation only", 3, 0.6, "proprietary", "evaluation purposes", r"for evaluation purposes only"),
    ("end user agreement", 3, 0.6, "proprietary", "end user license", r"end user license agreement"),
    ("all rights reserved", 4, 0.6, "proprietary", "all rights reserved", r"all rights reserved"),
    ("alle rechte vorbehalten", 4, 0.6, "proprietary", "alle rechte", r"alle rechte vorbehalten"),
    ("tous droits réservés", 4, 0.6, "proprietary", "tous droits", r"tous droits réservés"),
    ("todos los derechos reservados", 4, 0.6, "proprietary", "todos los derechos", r"todos los derechos reservados"),
]


class Rule(NamedTuple):
    name: str
    priority: int
    confidence: float
    label: str
    keyword: bytes
    pattern: re.Pattern


@functools.cache
def rules() -> list[Rule]:
    """The ordered rules: signatures that stand alone, and every family by name in every form that it has; some hundreds."""
    made = []
    for label, keyword, call, versions in FAMILIES:
        for form, priority, confidence, around in FORMS:
            for version in versions.split("|") if versions else [""]:
                if form == "versioned" and not version:
                    continue
                short = re.sub(r" 0$", "(?: 0)?", version) or r"\d(?: \d)?"
                body = around.replace("(?: {version})?", f" {short}" if version else "").format(call=call, version=short)
                name = f"{label}-{version.replace(' ', '.')}" if version else label
                made.append(Rule(f"{form} {name}", priority, confidence, name, keyword.encode(), re.compile(rf"(?<= )(?:{body})(?= )".encode())))
            if versions and form in ("grant", "titled", "identifier"):  # without a version
                body = around.replace("(?: {version})?", "").format(call=call, version="")
                made.append(Rule(f"{form} {label}", priority, confidence - 0.1, label, keyword.encode(), re.compile(rf"(?<= )(?:{body})(?= )".encode())))
    made += [Rule(n, p, c, label, k.encode(), re.compile(rf"(?<= )(?:{b})(?= )".encode())) for n, p, c, label, k, b in SINGLE]
    return sorted(made, key=lambda r: r.priority)


@functools.cache
def _by_keyword() -> dict[bytes, list[tuple[bytes, list[Rule]]]]:
    """Keywords and their rules, by the longest word of the keyword."""
    found: dict[bytes, list[Rule]] = {}
    for rule in rules():
        found.setdefault(rule.keyword, []).append(rule)
    out: dict[bytes, list[tuple[bytes, list[Rule]]]] = {}
    for keyword, own in found.items():
        out.setdefault(max(keyword.split(), key=len), []).append((keyword, own))
    return out


@functools.cache
def _gate() -> frozenset[bytes]:
    return frozenset(_by_keyword())


def fold(text: bytes) -> bytes:
    """Folded words joined by single blanks, with a blank at either end."""
    return b" %s " % b" ".join(text.translate(_FOLD).split())


def suppressed(found: list[tuple[int, int]]) -> list[bool]:
    """Of intervals (first, end) in the order in which they are taken, which lie inside one taken before.

    The farthest end of taken intervals is kept by their start, in a tree of prefix maxima.
    """
    place = {a: k + 1 for k, a in enumerate(sorted({a for a, _ in found}))}
    farthest, out = [-1] * (len(place) + 1), []
    for a, b in found:
        k, reach = place[a], -1
        while k and reach < b:
            reach = max(reach, farthest[k])
            k &= k - 1
        out.append(reach >= b)
        if reach < b:
            k = place[a]
            while k < len(farthest):
                farthest[k] = max(farthest[k], b)
                k += k & -k
    return out


def scan(folded: bytes, words: list[bytes] | None = None) -> list[tuple[str, str, int, int, float]]:
    """Detections (rule, label, first byte, end byte, confidence) in a folded text.

    Rules run only where the text holds their keyword. Detections are taken by priority, then length, then place;
    one that lies inside of an interval already taken is suppressed.
    """
    gates = _gate().intersection(folded.split() if words is None else words)
    found = [
        (rule.priority, m.start() - m.end(), m.start(), rule) for gate in gates for keyword, own in _by_keyword()[gate] if keyword in folded for rule in own for m in rule.pattern.finditer(folded)
    ]
    found.sort(key=lambda x: x[:3] + (x[3].name,))
    taken = [(rule.name, rule.label, at, at - minus, rule.confidence) for (_, minus, at, rule), skip in zip(found, suppressed([(at, at - minus) for _, minus, at, _ in found])) if not skip]
    return sorted(taken, key=lambda x: (x[2], x[3], x[0]))


def base_places(folded: bytes) -> list[tuple[int, str]]:
    """Every place of a base phrase: (byte of the blank before it, label)."""
    places = []
    for phrase, label in BASE.items():
        at = folded.find(b" %s " % phrase)
        while at >= 0:
            places.append((at, label))
            at = folded.find(b" %s " % phrase, at + 1)
    return sorted(places)


_SPAN = StructType([StructField("rule", StringType()), StructField("label", StringType()), StructField("first_word", LongType()), StructField("end_word", LongType()), StructField("confidence", DoubleType())])
_SCAN = StructType([
    StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType()),
    StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()), StructField("detections", ArrayType(_SPAN)),
])


def scan_text(text: bytes) -> dict:
    words = text.translate(_FOLD).split()
    folded = b" %s " % b" ".join(words)
    base, found = base_places(folded), scan(folded, words)
    labels = {label for _, label in base}
    doubt = 1.0
    for *_, confidence in found:
        doubt *= 1 - confidence
    if base and not found:
        doubt = 0.4
    if base or found:
        blanks = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)  # the word from 0 that a blank stands before
        base = list(zip(np.searchsorted(blanks, [a for a, _ in base]).tolist(), [n for _, n in base]))
        first, end = (np.searchsorted(blanks, [x[k] for x in found]).tolist() for k in (2, 3))
    else:
        first = end = []
    spans = [{"rule": r, "label": n, "first_word": a - 1, "end_word": b, "confidence": c} for (r, n, _, _, c), a, b in zip(found, first, end)]
    return {
        "n_words": len(words), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {n for _, n, *_ in found})), "score": 1 - doubt, "detections": spans,
    }


@arrow_udf(_SCAN)
def _scan_column(text: pa.Array) -> pa.Array:
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("detections", pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("confidence", pa.float64())]))),
    ])
    return pa.array([scan_text(x or b"") for x in text.cast(pa.binary()).to_pylist()], kind)


def scan_licenses(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """License detections of every whole text, one row for each row of ``docs``, nothing shuffled.

    Returns doc_id and the scan's fields: counts, base labels, all labels, score, and the detections with their words.
    Null texts count as empty; no words give zero counts, null places, empty label lists and score 0; null ids and
    repeated rows are scanned like others; columns other than the two are not read.
    """
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", _scan_column(F.col(text_column).cast("binary")).alias("scan")).select("doc_id", "scan.*")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of every row of ``documents``; see :func:`scan_licenses` for nulls, empties, repeats and empty tables."""
    return scan_licenses(table(spark, sf_dir, "documents"))
