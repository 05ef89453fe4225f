"""License scan by ordered signature rules.

A document becomes its words joined by single spaces. Each rule is a regular expression over that, gated by a
keyword that must occur in the document first. Rules stand in order of priority: full grants before names with
versions, those before bare names, those before short names (which need no word for licence). All matches of all gated rules are found; sorted by priority, then length,
then place, a match is dropped when its interval lies within the interval of a match kept before it.

Base phrases are counted apart from that, at every place, and their labels always stay.

Null and empty texts have no words and no labels. Texts of any length are scanned whole, in time that grows with their
length and not with the square of their matches. Matches with one interval are ties: the one of higher priority stays.
Repeated rows and null ids are ordinary rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinforge.llm.common import column, pieces, words_of

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Families as (label, keyword, pattern of the name, versions). Rules are made from them below.
FAMILIES = (
    ("mit", "mit", r"(?:the )?(?:expat )?mit", ()),
    ("apache", "apache", r"(?:the )?apache(?: software)?", ("1 0", "1 1", "2 0", "2")),
    ("lgpl", "lesser", r"(?:the )?(?:gnu )?lesser general public", ("2 1", "3 0", "3")),
    ("lgpl", "library general", r"(?:the )?(?:gnu )?library general public", ("2 0", "2")),
    ("agpl", "affero", r"(?:the )?(?:gnu )?affero general public", ("1 0", "3 0", "3")),
    ("gpl", "general public", r"(?:the )?(?:gnu )?general public", ("1 0", "1", "2 0", "2", "3 0", "3")),
    ("fdl", "free documentation", r"(?:the )?(?:gnu )?free documentation", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla", r"(?:the )?mozilla public", ("1 0", "1 1", "2 0", "2")),
    ("epl", "eclipse", r"(?:the )?eclipse public", ("1 0", "2 0", "2")),
    ("cddl", "common development", r"(?:the )?common development and distribution", ("1 0", "1 1")),
    ("cpl", "common public", r"(?:the )?common public", ("1 0",)),
    ("eupl", "european union", r"(?:the )?european union public", ("1 0", "1 1", "1 2")),
    ("bsd", "bsd", r"(?:the )?(?:(?:2|3|4|two|three|four) clause |simplified |modified |new |revised )?bsd", ()),
    ("isc", "isc", r"(?:the )?isc", ()),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?", ()),
    ("boost", "boost", r"(?:the )?boost software", ("1 0",)),
    ("artistic", "artistic", r"(?:the )?(?:perl )?artistic", ("1 0", "2 0")),
    ("cc-by-sa", "attribution", r"(?:the )?creative commons attribution share ?alike", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "attribution", r"(?:the )?creative commons attribution non ?commercial", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "attribution", r"(?:the )?creative commons attribution no ?deriv(?:ative)?s?", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "attribution", r"(?:the )?creative commons attribution", ("2 0", "2 5", "3 0", "4 0")),
    ("cc0", "cc0", r"(?:the )?(?:creative commons )?cc0", ("1 0",)),
    ("odbl", "open database", r"(?:the )?open (?:data commons open )?database", ("1 0",)),
    ("psf", "python software", r"(?:the )?python software foundation", ("2",)),
    ("openssl", "openssl", r"(?:the )?openssl", ()),
    ("postgresql", "postgresql", r"(?:the )?postgresql", ()),
    ("ofl", "open font", r"(?:the )?(?:sil )?open font", ("1 0", "1 1")),
    ("wtfpl", "do what the", r"(?:the )?do what the [a-z]+ you want to public", ("2",)),
    ("ms-pl", "microsoft public", r"(?:the )?microsoft public", ()),
    ("ms-rl", "microsoft reciprocal", r"(?:the )?microsoft reciprocal", ()),
    ("upl", "universal permissive", r"(?:the )?universal permissive", ("1 0",)),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
)
# Wording that grants, around a name; weights say how sure a match is.
GRANTS = (
    ("grant", 1.0, r"(?:is |are |be )?(?:re|dual )?(?:licensed|released|distributed|published|available|provided|redistributed|covered|made available) (?:for use )?(?:only )?(?:under|by) (?:the terms (?:and conditions )?of )?{name} licen[sc]e{version}"),
    ("terms", 0.95, r"(?:under|subject to|accept|see|by) (?:the )?(?:terms|conditions|provisions)(?: and conditions)? of {name} licen[sc]e{version}"),
    ("copy", 0.9, r"(?:a )?copy of {name} licen[sc]e{version}"),
    ("modify", 0.95, r"redistribute it and or modify it under the terms of {name} licen[sc]e{version}"),
    ("name", 0.7, r"{name} licen[sc]e{version}"),
)
# Sentences of licences, recognised without a name.
SENTENCES = (
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "without restriction", r"deal in the software without restriction including without limitation the rights", 1.0),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 1.0),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 1.0),
    ("isc", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 1.0),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 1.0),
    ("apache", "apache org", r"(?:www )?apache org licenses license 2 0", 0.95),
    ("gpl", "gnu org", r"(?:www )?gnu org licenses (?:old licenses )?gpl(?: [0-9] [0-9])?", 0.95),
    ("lgpl", "gnu org", r"(?:www )?gnu org licenses (?:old licenses )?lgpl(?: [0-9] [0-9])?", 0.95),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [0-9] [0-9]", 0.95),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [0-9] [0-9]", 0.95),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero [0-9] [0-9]", 0.95),
    ("mit", "included in all copies", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1.0),
    ("mit", "provided as is without", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.8),
    ("mit-0", "without limitation the rights", r"without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 0.9),
    ("bsd", "neither the name", r"neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products", 1.0),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 1.0),
    ("bsd", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment", 1.0),
    ("bsd", "copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is", 0.9),
    ("isc", "disclaims all warranties", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", 0.8),
    ("zlib", "misrepresent", r"the origin of this software must not be misrepresented", 1.0),
    ("zlib", "altered from any source", r"this notice may not be removed or altered from any source distribution", 1.0),
    ("zlib", "express or implied warranty", r"this software is provided as is without any express or implied warranty", 0.8),
    ("apache", "except in compliance", r"you may not use this file except in compliance with the license", 1.0),
    ("apache", "as is basis", r"distributed on an as is basis without warranties or conditions of any kind either express or implied", 0.95),
    ("apache", "apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("apache", "grant of patent", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual", 0.95),
    ("apache", "software developed by the apache", r"this product includes software developed (?:by|at) the apache (?:software foundation|group)", 0.95),
    ("gpl", "free software you can redistribute", r"(?:this (?:program|library|file)|it) is free software you can redistribute it and or modify it under the terms of the gnu general public", 1.0),
    ("gpl", "version 2 of the license", r"either version 2 of the license or at your option any later version", 0.8),
    ("gpl", "version 3 of the license", r"either version 3 of the license or at your option any later version", 0.8),
    ("gpl", "you should have received", r"you should have received a copy of the gnu general public licen[sc]e", 1.0),
    ("gpl", "changing it is not allowed", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.9),
    ("gpl", "freedom to share and change", r"the gnu general public license is intended to guarantee your freedom to share and change", 1.0),
    ("lgpl", "you should have received", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 1.0),
    ("lgpl", "such a work in isolation", r"such a work in isolation is not a derivative work of the library", 0.9),
    ("lgpl", "lesser general public", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", 1.0),
    ("agpl", "you should have received", r"you should have received a copy of the gnu affero general public licen[sc]e", 1.0),
    ("agpl", "remotely through a computer network", r"all users interacting with it remotely through a computer network", 1.0),
    ("fdl", "invariant sections", r"with (?:no|the) invariant sections", 0.95),
    ("fdl", "permission is granted to copy distribute", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation", 1.0),
    ("mpl", "source code form is subject", r"this source code form is subject to the terms of the mozilla public", 1.0),
    ("mpl", "mpl was not distributed", r"if a copy of the mpl was not distributed with this file you can obtain one", 1.0),
    ("mpl", "contents of this file are subject", r"the contents of this file are subject to the mozilla public license", 1.0),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public", 1.0),
    ("epl", "eclipse org", r"(?:www )?eclipse org (?:legal|org documents) epl (?:v10|2 0)", 0.95),
    ("edl", "eclipse org", r"(?:www )?eclipse org org documents edl v10", 0.95),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("cddl", "opensolaris", r"(?:www )?opensolaris org os licensing", 0.9),
    ("cpl", "common public", r"the accompanying program is provided under the terms of this common public license agreement", 1.0),
    ("eupl", "eupl", r"licensed under the eupl (?:version [0-9] [0-9] )?or as soon they will be approved by the european commission", 1.0),
    ("eupl", "joinup", r"joinup ec europa eu (?:collection eupl|software page eupl|community eupl)", 0.95),
    ("cecill", "cecill", r"governed by the cecill(?: [bc])? license under french law", 1.0),
    ("boost", "boost org", r"(?:www )?boost org license 1 0 txt", 0.95),
    ("boost", "machine executable object code", r"unless such copies or derivative works are solely in the form of machine executable object code", 1.0),
    ("boost", "boost software license", r"distributed under the boost software license version 1 0", 1.0),
    ("artistic", "standard version", r"you may (?:make and give away|distribute) verbatim copies of the (?:source form of the )?standard version of this package without restriction", 1.0),
    ("artistic", "same terms as perl", r"(?:this library|this program|it) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl itself", 0.95),
    ("psf", "python software foundation", r"this license agreement is between the python software foundation psf and the individual or organization", 1.0),
    ("php", "this product includes php", r"this product includes php software freely available from", 1.0),
    ("php", "php freely available", r"includes php (?:software )?freely available from http (?:www )?php net", 1.0),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project", 1.0),
    ("openssl", "eric young", r"this product includes cryptographic software written by eric young", 0.95),
    ("postgresql", "any purpose without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", 0.9),
    ("postgresql", "without a written agreement", r"without fee and without a written agreement is hereby granted", 1.0),
    ("ncsa", "deal with the software", r"to deal with the software without restriction including without limitation the rights to use copy modify merge publish", 1.0),
    ("w3c", "by obtaining using", r"by obtaining using and or copying this work you the licensee agree", 0.95),
    ("ofl", "reserved font name", r"with reserved font names?", 0.95),
    ("ofl", "scripts sil org", r"(?:www )?scripts sil org ofl", 0.95),
    ("ofl", "font software", r"this font software is licensed under the sil open font license", 1.0),
    ("wtfpl", "you just do what", r"you just do what the [a-z]+ you want to", 1.0),
    ("beerware", "beer in return", r"(?:you )?can buy me a beer in return", 1.0),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("json", "good not evil", r"the software shall be used for good not evil", 1.0),
    ("ms-pl", "this license governs use", r"this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    ("cc-by", "free to share", r"you are free to share copy and redistribute the material in any medium or format", 0.8),
    ("cc-by", "give appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made", 0.85),
    ("cc-by-sa", "same license as the original", r"you must distribute your contributions under the same license as the original", 0.9),
    ("cc-by-nc", "for commercial purposes", r"you may not use the material for commercial purposes", 0.85),
    ("cc-by-nd", "distribute the modified material", r"you may not distribute the modified material", 0.85),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?: [1-4] [05])? (?:deed|legalcode)", 0.95),
    ("cc0", "waived all copyright", r"waived all copyright and related or neighbou?ring rights", 1.0),
    ("cc0", "to the extent possible under law", r"to the extent possible under law the (?:person|author|authors|copyright holder) who associated cc0", 1.0),
    ("odbl", "any rights in individual contents", r"any rights in individual contents of the database are licensed under", 0.95),
    ("odbl", "opendatacommons", r"(?:www )?opendatacommons org licenses odbl", 0.95),
    ("pddl", "opendatacommons", r"(?:www )?opendatacommons org licenses pddl", 0.95),
    ("odc-by", "opendatacommons", r"(?:www )?opendatacommons org licenses by", 0.95),
    ("ogl", "public sector information", r"contains public sector information licensed under the open government licen[sc]e", 1.0),
    ("busl", "change date", r"on the change date or the fourth anniversary of the first publicly available distribution", 1.0),
    ("sspl", "functionality of the program", r"if you make the functionality of the program or a modified version available to third parties as a service", 1.0),
    ("elastic", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("commons-clause", "right to sell the software", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software", 1.0),
    ("openrail", "use based restrictions", r"(?:use based restrictions as referenced in|subject to the use based restrictions)", 0.95),
    ("llama", "llama", r"llama (?:2|3|3 [123]) community license(?: agreement)?", 1.0),
    ("proprietary", "of this", r"unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:or [a-z]+ )?of this (?:file|software|document|program|material)", 0.9),
    ("proprietary", "trade secret", r"(?:contains|constitutes?) (?:valuable )?trade secrets?", 0.8),
    ("proprietary", "no part of this", r"no part of this (?:publication|book|work|document|site|website) may be reproduced", 0.9),
    ("proprietary", "written", r"without (?:the )?(?:express |prior )*written (?:permission|consent) of", 0.6),
    ("proprietary", "end user license", r"end user license agreement", 0.8),
    ("proprietary", "reverse engineer", r"(?:you )?(?:may|shall|must) not (?:[a-z]+ ){0,6}reverse engineer", 0.8),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|donated) (?:in|to|into) the public domain", 0.9),
    ("public-domain", "unencumbered", r"free and unencumbered software released into the public domain", 1.0),
    ("proprietary", "all rights reserved", r"(?:copyright|c) (?:[0-9]{4} )?(?:[^ ]+ ){0,6}all rights reserved", 0.6),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 0.8),
)

# Short and hyphenated names as their words, with and without version, special ones before general
# ones; the last field says whether the name alone is a licence or only after wording of LEAD.
V1, V2, V3 = r"(?: ?(?:version |ver |v ?)?1(?: [0-3])?)?", r"(?: ?(?:version |ver |v ?)?[12](?: [01])?)?", r"(?: ?(?:version |ver |v ?)?[1-3](?: [01])?)?"
LATER = r"(?: only| plus| or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?)?"
CC = r"(?: ?v?[1-4] [05])?(?: (?:international|unported|generic|intergovernmental|igo|deed|us|uk|de|fr))?(?: public)?(?: licen[sc]e)?"
SHORT = (
    ("gpl-classpath", "classpath", rf"(?:gnu )?gpl{V3}(?: only)? (?:with|w) (?:the )?classpath(?: linking)? exception(?: 2 0)?", True),
    ("gpl-classpath", "classpath", r"gnu classpath (?:linking )?exception", True),
    ("agpl", "agpl", rf"(?:the )?(?:gnu )?agpl{V3}{LATER}", True),
    ("agpl", "affero gpl", rf"(?:the )?(?:gnu )?affero gpl{V3}{LATER}", True),
    ("agpl", "affero general public", rf"(?:the )?(?:gnu )?affero general public licence{V3}{LATER}", True),
    ("lgpl", "lgpl", rf"(?:the )?(?:gnu )?lgpl(?: ?(?:version |ver |v ?)?[23](?: [01])?)?{LATER}", True),
    ("lgpl", "lesser gpl", rf"(?:the )?(?:gnu )?lesser gpl(?: ?(?:version |ver |v ?)?[23](?: [01])?)?{LATER}", True),
    ("lgpl", "library gpl", rf"(?:the )?(?:gnu )?library gpl(?: ?(?:version |ver |v ?)?2(?: 0)?)?{LATER}", True),
    ("fdl", "gfdl", rf"(?:the )?(?:gnu )?gfdl{V1}{LATER}", True),
    ("fdl", "gnu fdl", rf"(?:the )?gnu fdl{V1}{LATER}", True),
    ("gpl", "gpl", rf"(?:the )?(?:gnu )?gpl{V3}{LATER}", True),
    ("gpl", "gnu public licen", rf"(?:the )?gnu public licen[sc]e{V3}{LATER}", True),
    ("apache", "apache 2", r"(?:the )?(?:asf )?apache 2 0(?: licen[sc]ed?)?", True),
    ("apache", "apache 1", r"(?:the )?apache 1 [01](?: licen[sc]ed?)?", True),
    ("apache", "apache 2", r"(?:the )?apache 2 licen[sc]ed?", True),
    ("apache", "apache v", r"(?:the )?apache v ?[12](?: [01])?(?: licen[sc]ed?)?", True),
    ("apache", "apache version", r"(?:the )?apache version [12](?: [01])?", True),
    ("apache", "apache2", r"(?:the )?apache2(?: 0)?(?: licen[sc]ed?)?", False),
    ("apache", "apache licensed", r"apache licensed", True),
    ("apache", "asl 2", r"(?:the )?asl 2 0", True),
    ("apache", "al2", r"al2(?: 0)?", False),
    ("apache", "apache", r"(?:the )?apache(?: 2)?", False),
    ("bsd-0", "0bsd", r"(?:the )?0bsd", True),
    ("bsd-0", "zero clause bsd", r"(?:the )?zero clause bsd", True),
    ("bsd", "clause bsd", r"(?:the )?(?:1|2|3|4|one|two|three|four) clause bsd", True),
    ("bsd", "bsd 4", r"(?:the )?bsd 4 clause(?: uc)?", True),
    ("bsd", "bsd 3", r"(?:the )?bsd 3 clause(?: (?:clear|attribution|lbnl))?", True),
    ("bsd", "bsd 2", r"(?:the )?bsd 2 clause(?: (?:patent|views|freebsd|netbsd))?", True),
    ("bsd", "bsd 1", r"(?:the )?bsd 1 clause", True),
    ("bsd", "bsd three clause", r"(?:the )?bsd three clause", True),
    ("bsd", "bsd two clause", r"(?:the )?bsd two clause", True),
    ("bsd", "bsd3", r"(?:the )?bsd3(?: clause)?", True),
    ("bsd", "bsd2", r"(?:the )?bsd2(?: clause)?", True),
    ("bsd", "new bsd", r"(?:the )?new bsd", False),
    ("bsd", "modified bsd", r"(?:the )?modified bsd", True),
    ("bsd", "simplified bsd", r"(?:the )?simplified bsd", True),
    ("bsd", "revised bsd", r"(?:the )?revised bsd", True),
    ("bsd", "freebsd licen", r"(?:the )?freebsd licen[sc]e", True),
    ("bsd", "bsd style", r"(?:a )?bsd style(?: licen[sc]ed?)?", True),
    ("bsd", "bsd licensed", r"bsd licensed", True),
    ("bsd", "bsd", r"(?:the )?bsd", False),
    ("mit-0", "mit 0", r"(?:the )?mit 0", True),
    ("mit-0", "mit no attribution", r"(?:the )?mit no attribution(?: licen[sc]e)?", True),
    ("mit", "mit licensed", r"mit licensed", True),
    ("mit", "mit style", r"(?:a )?mit style licen[sc]ed?", True),
    ("mit", "mit x11", r"(?:the )?mit x11(?: licen[sc]e)?", True),
    ("mit", "x11 licen", r"(?:the )?x11 licen[sc]e", True),
    ("mit", "mit expat", r"(?:the )?mit expat(?: licen[sc]e)?", True),
    ("mit", "expat licen", r"(?:the )?expat licen[sc]e", True),
    ("mit", "mit or apache", r"mit or apache(?: 2 0)?", True),
    ("mit", "apache 2 0 or mit", r"apache 2 0 or mit", True),
    ("mit", "mit", r"(?:the )?mit", False),
    ("isc", "isc licensed", r"isc licensed", True),
    ("isc", "isc", r"(?:the )?isc", False),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?(?: acknowledgement)?", False),
    ("mpl", "mpl 2", r"(?:the )?mpl 2 0(?: no copyleft exception)?", True),
    ("mpl", "mpl 1", r"(?:the )?mpl 1 [01]", True),
    ("mpl", "mplv", r"(?:the )?mplv[12](?: [01])?", True),
    ("mpl", "mpl", r"(?:the )?mpl ?(?:version |ver |v ?)[12](?: [01])?", True),
    ("mpl", "mpl", r"(?:the )?mpl", False),
    ("epl", "epl 2", r"(?:the )?epl 2 0", True),
    ("epl", "epl 1", r"(?:the )?epl 1 0", True),
    ("epl", "epl", r"(?:the )?epl(?: ?v?[12](?: 0)?)?", False),
    ("edl", "edl 1", r"(?:the )?edl 1 0", True),
    ("edl", "eclipse distribution", r"(?:the )?eclipse distribution licen[sc]e(?: v?1 0)?", True),
    ("cddl", "cddl", rf"(?:the )?cddl{V1}", True),
    ("cpl", "cpl 1", r"(?:the )?cpl 1 0", True),
    ("cpal", "cpal", r"(?:the )?cpal(?: 1 0)?", True),
    ("eupl", "eupl", rf"(?:the )?eupl{V1}", True),
    ("cecill", "cecill", r"(?:the )?cecill(?: [bc])?(?: ?v?[12](?: [01])?)?", True),
    ("osl", "osl 3", r"(?:the )?osl 3 0", True),
    ("osl", "open software licen", r"(?:the )?open software licen[sc]e(?: (?:version |v )?[123] [01])?", True),
    ("afl", "afl 3", r"(?:the )?afl 3 0", True),
    ("afl", "academic free", r"(?:the )?academic free licen[sc]e(?: (?:version |v )?[123] [0-2])?", True),
    ("artistic", "artistic 2", r"(?:the )?(?:perl )?artistic 2 0", True),
    ("artistic", "artistic 1", r"(?:the )?(?:perl )?artistic 1 0(?: (?:perl|cl8))?", True),
    ("boost", "bsl 1 0", r"(?:the )?bsl 1 0", True),
    ("boost", "boost 1 0", r"(?:the )?boost 1 0", True),
    ("boost", "boost licen", r"(?:the )?boost licen[sc]e", True),
    ("busl", "busl", r"(?:the )?busl(?: 1 1)?", True),
    ("busl", "bsl 1 1", r"(?:the )?bsl 1 1", True),
    ("busl", "business source", r"(?:the )?business source licen[sc]e(?: (?:version |v )?1 1)?", True),
    ("sspl", "sspl", r"(?:the )?sspl(?: ?v?1(?: 0)?)?", True),
    ("sspl", "server side public", r"(?:the )?server side public licen[sc]e(?: (?:version |v )?1)?", True),
    ("elastic", "elastic licen", r"(?:the )?elastic licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?", True),
    ("polyform", "polyform", r"(?:the )?polyform (?:noncommercial|small business|shield|perimeter|strict|internal use)(?: licen[sc]e)?(?: 1 0 0)?", True),
    ("commons-clause", "commons clause", r"(?:the )?commons clause", True),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)?(?: licen[sc]e)?", False),
    ("json", "json licen", r"(?:the )?json licen[sc]e", True),
    ("php", "php licen", r"(?:the )?php licen[sc]e(?: (?:version |v )?3 0[01]?)?", True),
    ("ruby", "ruby licen", r"(?:the )?ruby licen[sc]e", True),
    ("vim", "vim licen", r"(?:the )?vim licen[sc]e", True),
    ("w3c", "w3c", r"(?:the )?w3c (?:software(?: notice)?(?: and document)? )?(?:notice and )?licen[sc]e", True),
    ("x-consortium", "x consortium", r"(?:the )?x consortium licen[sc]e", True),
    ("beerware", "beerware", r"(?:the )?beerware(?: licen[sc]e)?", True),
    ("beerware", "beer ware", r"(?:the )?beer ware licen[sc]e", True),
    ("blueoak", "blue oak", r"(?:the )?blue oak model licen[sc]e(?: 1 0 0)?", True),
    ("blueoak", "blueoak", r"blueoak 1 0 0", True),
    ("mulan", "mulan", r"(?:the )?mulan(?: psl| permissive software licen[sc]e)(?: ?v?[12](?: 0)?)?", True),
    ("psf", "psf", r"(?:the )?psf(?: 2 0| licen[sc]e(?: (?:version |v )?2)?)", True),
    ("psf", "python 2 0", r"(?:the )?python 2 0", False),
    ("upl", "upl 1", r"(?:the )?upl 1 0", True),
    ("ofl", "ofl", rf"(?:the )?(?:sil )?ofl{V1}", True),
    ("ofl", "open font", rf"(?:the )?(?:sil )?open font licen[sc]e{V1}", True),
    ("ms-pl", "ms pl", r"(?:the )?ms pl", True),
    ("ms-rl", "ms rl", r"(?:the )?ms rl", True),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl(?: ?(?:version |v ?)?2(?: 0)?)?", True),
    ("unlicense", "unlicense", r"(?:the )?unlicense", True),
    ("unlicense", "unlicence", r"(?:the )?unlicence", True),
    ("unlicense", "unlicense org", r"(?:www )?unlicense org", True),
    ("odbl", "odbl", rf"(?:the )?(?:odc )?odbl{V1}", True),
    ("odc-by", "odc by", rf"(?:the )?odc by{V1}", True),
    ("odc-by", "open data commons attribution", rf"(?:the )?open data commons attribution(?: licen[sc]e)?{V1}", True),
    ("pddl", "pddl", rf"(?:the )?(?:odc )?pddl{V1}", True),
    ("cdla", "cdla", r"(?:the )?cdla (?:permissive|sharing)(?: [12] 0)?", True),
    ("ogl", "open government", r"(?:the )?open government licen[sc]e(?: (?:version |v ?)?[1-3](?: 0)?)?", True),
    ("ogl", "ogl uk", r"ogl uk [1-3] 0", True),
    ("openrail", "openrail", r"(?:the )?(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: ?v?1)?", True),
    ("cc-by-nc-sa", "cc by nc sa", rf"(?:the )?cc by nc sa{CC}", True),
    ("cc-by-nc-nd", "cc by nc nd", rf"(?:the )?cc by nc nd{CC}", True),
    ("cc-by-nc", "cc by nc", rf"(?:the )?cc by nc{CC}", True),
    ("cc-by-sa", "cc by sa", rf"(?:the )?cc by sa{CC}", True),
    ("cc-by-nd", "cc by nd", rf"(?:the )?cc by nd{CC}", True),
    ("cc-by", "cc by", r"(?:the )?cc by ?v?[1-4] [05](?: (?:international|unported|generic|igo))?(?: licen[sc]e)?", True),
    ("cc-by", "cc by", r"(?:the )?cc by licen[sc]e", True),
    ("cc-by", "cc by", r"(?:the )?cc by", False),
    ("cc-by-nc-sa", "by nc sa", rf"(?:the )?(?:creative commons )?by nc sa{CC}", True),
    ("cc-by-nc-nd", "by nc nd", rf"(?:the )?(?:creative commons )?by nc nd{CC}", True),
    ("cc-by-nc", "creative commons by nc", rf"(?:the )?creative commons by nc{CC}", True),
    ("cc-by-sa", "creative commons by sa", rf"(?:the )?creative commons by sa{CC}", True),
    ("cc-by-nd", "creative commons by nd", rf"(?:the )?creative commons by nd{CC}", True),
    ("cc-by", "creative commons by", rf"(?:the )?creative commons by{CC}", True),
    ("cc-by-nc-sa", "attribution non", rf"(?:the |a )?(?:creative commons|cc) attribution non ?commercial share ?alike{CC}", True),
    ("cc-by-nc-nd", "attribution non", rf"(?:the |a )?(?:creative commons|cc) attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?{CC}", True),
    ("cc-by-nc", "attribution non", rf"(?:the |a )?(?:creative commons|cc) attribution non ?commercial{CC}", True),
    ("cc-by-sa", "attribution share", rf"(?:the |a )?(?:creative commons|cc) attribution share ?alike{CC}", True),
    ("cc-by-nd", "attribution no", rf"(?:the |a )?(?:creative commons|cc) attribution no ?deriv(?:ative)?s?(?: works)?{CC}", True),
    ("cc-by", "commons attribution", rf"(?:the |a )?creative commons attribution{CC}", True),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", r"creativecommons org licenses by nc sa(?: [1-4] [05])?", True),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", r"creativecommons org licenses by nc nd(?: [1-4] [05])?", True),
    ("cc-by-nc", "creativecommons org licenses by nc", r"creativecommons org licenses by nc(?: [1-4] [05])?", True),
    ("cc-by-nd", "creativecommons org licenses by nd", r"creativecommons org licenses by nd(?: [1-4] [05])?", True),
    ("cc0", "cc0", rf"(?:the )?(?:creative commons )?cc0{V1}(?: universal)?", True),
    ("cc0", "cc zero", r"(?:the )?(?:creative commons )?cc zero(?: 1 0)?", True),
    ("cc0", "creative commons zero", r"(?:the )?creative commons zero(?: v?1 0)?(?: universal)?", True),
    ("public-domain", "public domain mark", r"(?:the )?public domain mark(?: 1 0)?", True),
    ("public-domain", "in the public domain", r"(?:is|are) in the public domain", True),
    ("proprietary", "unlicensed", r"license unlicensed", True),
)
# Wording before a short name.
LEAD = r"(?:(?:is |are |be |was )?(?:re|dual |multi |sub )?(?:licen[sc]ed|released|distributed|published|available|provided|covered|offered|shared|redistributed)(?: only| also)? (?:under|by) (?:the terms (?:and conditions )?of )?|(?:under|subject to) (?:the terms (?:and conditions )?of )?|spdx license identifier (?:[a-z0-9 ]{0,20} )?|licen[sc]es?(?: (?:is|as|name|type|under))? )"


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: bytes
    pattern: re.Pattern
    weight: float
    priority: int


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """Every family with every wording, with each version and without, then the short names, in order of priority."""
    made = [(f"{label}-text", label, key, pattern, weight) for label, key, pattern, weight in SENTENCES]
    for kind, weight, wording in GRANTS:
        for label, key, name, versions in FAMILIES:
            for v in versions:
                tail = rf"(?: (?:version|v))? {v}(?: or (?:\(?at your option )?(?:any )?later(?: version)?)?"
                made.append((f"{label}-{v.replace(' ', '.')}-{kind}", label, key, wording.format(name=name, version=tail), weight))
            made.append((f"{label}-{kind}", label, key, wording.format(name=name, version=""), weight - 0.05))
    for at, (label, key, pattern, alone) in enumerate(SHORT):
        made.append((f"{label}-short-{at}-grant", label, key, LEAD + pattern, 0.95))
        if alone:
            made.append((f"{label}-short-{at}", label, key, pattern, 0.75))
    for label in dict.fromkeys(f[0] for f in FAMILIES):
        made.append((f"{label}-spdx", label, "spdx license identifier", rf"spdx license identifier (?:[a-z0-9 ]{{0,20}} )?{label.replace('-', ' ')}(?: [0-9]+){{0,2}}", 1.0))
    return tuple(
        Rule(name, label, key.encode(), re.compile(rf"(?<![^ ]){pattern}(?![^ ])".encode()), weight, at)
        for at, (name, label, key, pattern, weight) in enumerate(made)
    )


@lru_cache(maxsize=1)
def by_keyword() -> dict[bytes, list[Rule]]:
    out: dict[bytes, list[Rule]] = {}
    for rule in rules():
        out.setdefault(b" " + rule.keyword, []).append(rule)
    return out


def detections(joined: bytes) -> list[tuple[Rule, int, int]]:
    """Kept matches (rule, begin, end) over the joined words, most important first."""
    padded = b" " + joined
    found = [
        (r, m.start(), m.end())
        for key, gated in by_keyword().items()
        if key in padded
        for r in gated
        for m in r.pattern.finditer(joined)
    ]
    found.sort(key=lambda d: (d[0].priority, d[1] - d[2], d[1]))
    kept: list[tuple[Rule, int, int]] = []
    # kept intervals that no other holds: both ends rise, so the last that begins in time is the one that reaches furthest
    begins: list[int] = []
    ends: list[int] = []
    for d in found:
        at = bisect_right(begins, d[1])
        if at and ends[at - 1] >= d[2]:
            continue
        kept.append(d)
        at = bisect_left(begins, d[1])
        after = bisect_right(ends, d[2], at)
        begins[at:after], ends[at:after] = [d[1]], [d[2]]
    return kept


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase, in order."""
    at = []
    for phrase, label in BASE.items():
        want = phrase.encode().split()
        last, i = len(words) - len(want), -1
        try:
            while (i := words.index(want[0], i + 1)) <= last:
                if words[i : i + len(want)] == want:
                    at.append((i, label))
        except ValueError:
            pass
    return sorted(at)


def word_places(joined: bytes, kept: list[tuple[Rule, int, int]]) -> list[dict]:
    """The matches with their places in words."""
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    first = np.searchsorted(spaces, [b for _, b, _ in kept])
    last = np.searchsorted(spaces, [e for _, _, e in kept])
    return [
        {"rule": r.name, "label": r.label, "first_word": int(a), "n_words": int(z - a) + 1, "weight": r.weight}
        for (r, _, _), a, z in zip(kept, first, last, strict=True)
    ]


def scan_text(text: str | None, details: bool = True) -> dict:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, and with ``details`` the detections."""
    words = words_of(text)
    joined = b" ".join(words)
    places = base_places(words) if b"license" in joined else []
    kept = detections(joined)
    base = {label for _, label in places}
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": places[0][0] if places else None,
        "last_word": places[-1][0] if places else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {r.label for r, _, _ in kept})),
        "score": max([0.65 * bool(base), *(r.weight for r, _, _ in kept)]),
        "detections": word_places(joined, kept) if details and kept else [],
    }


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<rule:string,label:string,first_word:long,n_words:long,weight:double>>"
)


def scan(docs: DataFrame, details: bool = True) -> DataFrame:
    """doc_id with what ``scan_text`` finds in each document's whole text."""
    from pyspark.sql import types as T

    from kinforge.llm.common import arrow_schema

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL(SCHEMA).fields[: None if details else -1]])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = list(arrow_schema(schema))[1:]
        for batch in pieces(batches):
            rows = [scan_text(t, details) for t in column(batch, "text")]
            cols = [pa.array([r[f.name] for r in rows], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", *(f.name for f in fields)])

    return docs.select("doc_id", "text").mapInArrow(find, schema)
