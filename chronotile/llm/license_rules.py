"""Hand-written signature rules of licenses, as data.

Each line is: priority (smaller is stronger), confidence, keyword, pattern. Patterns match lower-case words joined by
single blanks; every match of a pattern holds its keyword. Names in braces stand for the fragments below.
"""

from __future__ import annotations

FRAGMENTS = {
    # how a text says that it stands under something
    "by": "(?:(?:dual |re)?licen[cs]ed|released|distributed|published|available|made available|provided|shared|covered|offered)(?: to you)?(?: freely)? (?:under|as|with|by)(?: (?:an?|the|either the))?(?: (?:terms|conditions|provisions)(?: and conditions)? of)?(?: (?:an?|the))?",
    "under": "under (?:the )?(?:terms|conditions|provisions)(?: and conditions)? of (?:the )?",
    "subject": "subject to (?:the )?(?:(?:terms|conditions)(?: and conditions)? of (?:the )?)?",
    # what may follow a name
    "lic": "(?: licen[cs]e)?",
    "v": "(?:(?: version)? ?v?[0-9]+(?: [0-9]+)*)?(?: only| or later| or any later version| or newer)?",
    "cc": "(?: [1234] [05])?(?: international| unported| generic)?",
}

RULES: dict[str, list[tuple[int, float, str, str]]] = {
    "mit": [
        (0, 1.0, "spdx license identifier", "spdx license identifier mit"),
        (0, 1.0, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?(?: and associated documentation files)?"),
        (0, 1.0, "publish distribute sublicense", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
        (1, 0.95, "this permission notice shall be included", "(?:the above copyright notice and )?this permission notice shall be included in all copies or substantial portions of the software"),
        (1, 0.9, "dealings in the software", "arising from out of or in connection with the software or the use or other dealings in the software"),
        (1, 0.95, "opensource org licenses mit", "opensource org licenses mit(?: license)?"),
        (1, 0.95, " mit", "{by} mit{lic}"),
        (1, 0.95, " mit", "{under}mit{lic}"),
        (2, 0.9, " mit", "{subject}mit{lic}"),
        (2, 0.85, "mit licen", "mit licen[cs]e"),
        (2, 0.85, "mit licensed", "mit licensed"),
        (2, 0.8, " mit", "licen[cs]e (?:is |type |name )?mit"),
        (1, 0.95, "expat", "{by} expat{lic}"),
        (1, 0.95, "expat", "{under}expat{lic}"),
        (2, 0.85, "expat licen", "expat licen[cs]e"),
        (2, 0.8, " mit style", "mit style licen[cs]e"),
        (2, 0.8, " mit x11", "mit x11(?: licen[cs]e)?"),
        (2, 0.85, " mit no attribution", "mit no attribution(?: licen[cs]e)?"),
    ],
    "apache": [
        (0, 1.0, "spdx license identifier", "spdx license identifier apache(?: [12](?: [01])?)?"),
        (0, 1.0, "apache license", "licensed under the apache license version [12](?: [01])? the license you may not use this file except in compliance with the license"),
        (0, 1.0, "apache org licenses", "you may obtain a copy of the license at https? www apache org licenses license [12] [01]"),
        (1, 0.95, "apache org licenses", "apache org licenses(?: license)?(?: [12] [01])?"),
        (1, 0.95, "opensource org licenses apache", "opensource org licenses apache(?: [12] [01])?"),
        (0, 0.95, "apache software foundation", "licensed to the apache software foundation asf under one or more contributor license agreements"),
        (1, 0.9, "express or implied see the license", "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions"),
        (1, 0.95, "grant of patent license", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
        (1, 0.9, "apache license", "how to apply the apache license to your work"),
        (1, 0.95, "apache", "{by} apache(?: software)?{lic}{v}"),
        (1, 0.95, "apache", "{under}apache(?: software)?{lic}{v}"),
        (2, 0.9, "apache", "{subject}apache(?: software)?{lic}{v}"),
        (2, 0.85, "apache", "apache(?: software)? licen[cs]e{v}"),
        (2, 0.8, "apache", "licen[cs]e (?:is |type |name )?apache(?: software licen[cs]e)?{v}"),
        (2, 0.85, "apache", "apache(?: version| v)? ?2 0"),
        (1, 0.9, " asl", "{by} asl{lic}{v}"),
        (1, 0.9, " asl", "{under}asl{lic}{v}"),
        (2, 0.8, "asl 2", "asl 2(?: 0)?"),
        (2, 0.85, "readable copy of the attribution notices", "include a readable copy of the attribution notices contained within such notice(?: text)? file"),
    ],
    "gpl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier gpl(?: [123](?: 0)?)?(?: only| or later)?"),
        (0, 1.0, "free software you can redistribute", "(?:this program|this software|this file|it) is free software you can redistribute it and or modify it under the terms of (?:version [123] of )?the gnu general public license"),
        (1, 0.9, "general public license", "you should have received a copy of the gnu general public license"),
        (1, 0.9, "general public license", "see the gnu general public license for more details"),
        (1, 0.95, "everyone is permitted to copy", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
        (1, 0.95, "general public license", "the gnu general public license is a free copyleft license"),
        (1, 0.9, "general public license", "the gnu general public license is intended to guarantee your freedom"),
        (1, 0.95, "gnu org licenses", "gnu org licenses(?: old licenses)? gpl(?: [123](?: 0)?)?"),
        (1, 0.95, "opensource org licenses gpl", "opensource org licenses gpl(?: licen[cs]e)?(?: [123](?: 0)?)?"),
        (1, 0.95, "general public license", "{by} (?:gnu )?general public license{v}"),
        (1, 0.95, "general public license", "{under}(?:gnu )?general public license{v}"),
        (2, 0.9, "general public license", "{subject}(?:gnu )?general public license{v}"),
        (2, 0.85, "general public license", "(?:gnu )?general public license{v}"),
        (2, 0.85, "general public licence", "(?:gnu )?general public licence{v}"),
        (1, 0.95, "gpl", "{by} (?:gnu )?gpl ?{v}{lic}"),
        (1, 0.95, "gpl", "{under}(?:gnu )?gpl ?{v}{lic}"),
        (2, 0.9, "gpl", "{subject}(?:gnu )?gpl ?{v}{lic}"),
        (2, 0.85, "gnu gpl", "gnu gpl ?{v}"),
        (2, 0.8, "gplv", "gplv[123](?: only| or later)?"),
        (2, 0.8, "gpl", "gpl v?[123](?: 0)?(?: only| or later)?"),
        (2, 0.8, "gpl licen", "gpl licen[cs]ed?"),
        (2, 0.8, "gpl", "licen[cs]e (?:is |type |name )?(?:gnu )?gpl ?{v}"),
        (2, 0.8, "gpl compatible", "gpl compatible(?: licen[cs]e)?"),
        (1, 0.9, "module license", "module license (?:dual mit )?gpl"),
        (1, 0.9, "classpath exception", "(?:gpl )?(?:2 0 )?with(?: the)? classpath exception"),
        (1, 0.9, "classpath exception", "designates this particular file as subject to the classpath exception"),
        (1, 0.9, "gcc runtime library exception", "gcc runtime library exception"),
        (1, 0.9, "font exception", "gpl with(?: the)? font exception"),
        (1, 0.9, "autoconf exception", "(?:gpl )?with(?: the)? autoconf exception"),
        (1, 0.9, "gpl 2 0 with linux syscall", "gpl 2 0 with linux syscall note"),
        (1, 0.9, "free software foundation inc 51 franklin", "free software foundation inc 51 franklin st(?:reet)? fifth floor boston ma"),
        (1, 0.9, "free software foundation inc 59 temple", "free software foundation inc 59 temple place suite 330 boston ma"),
        (1, 0.9, "free software foundation inc 675 mass", "free software foundation inc 675 mass ave cambridge ma"),
    ],
    "lgpl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier lgpl(?: [23](?: [01])?)?(?: only| or later)?"),
        (0, 1.0, "free software you can redistribute", "(?:this library|this software|this program|it) is free software you can redistribute it and or modify it under the terms of (?:version [23](?: [01])? of )?the gnu (?:lesser|library) general public license"),
        (0, 0.95, "lesser general public", "you should have received a copy of the gnu lesser general public license"),
        (0, 0.95, "library general public", "you should have received a copy of the gnu library general public license"),
        (0, 0.9, "lesser general public", "see the gnu lesser general public license for more details"),
        (0, 0.9, "library general public", "see the gnu library general public license for more details"),
        (0, 0.95, "gnu org licenses", "gnu org licenses(?: old licenses)? lgpl(?: [23](?: [01])?)?"),
        (0, 0.95, "lesser general public", "{by} (?:gnu )?lesser general public license{v}"),
        (0, 0.95, "library general public", "{by} (?:gnu )?library general public license{v}"),
        (0, 0.95, "lesser general public", "{under}(?:gnu )?lesser general public license{v}"),
        (0, 0.95, "library general public", "{under}(?:gnu )?library general public license{v}"),
        (1, 0.9, "lesser general public", "(?:gnu )?lesser general public licen[cs]e{v}"),
        (1, 0.9, "library general public", "(?:gnu )?library general public licen[cs]e{v}"),
        (1, 0.95, "lgpl", "{by} (?:gnu )?lgpl ?{v}{lic}"),
        (1, 0.95, "lgpl", "{under}(?:gnu )?lgpl ?{v}{lic}"),
        (2, 0.85, "gnu lgpl", "gnu lgpl ?{v}"),
        (2, 0.8, "lgpl", "lgpl v?[23](?: [01])?(?: only| or later)?"),
        (2, 0.8, "lgplv", "lgplv[23](?: [01])?(?: only| or later)?"),
        (2, 0.8, "lgpl licen", "lgpl licen[cs]ed?"),
        (2, 0.8, "lgpl", "licen[cs]e (?:is |type |name )?(?:gnu )?lgpl ?{v}"),
    ],
    "agpl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier agpl(?: [13] 0)?(?: only| or later)?"),
        (0, 1.0, "free software you can redistribute", "(?:this program|this software|it) is free software you can redistribute it and or modify it under the terms of (?:version 3 of )?the gnu affero general public license"),
        (0, 0.95, "affero general public", "you should have received a copy of the gnu affero general public license"),
        (0, 0.9, "affero general public", "see the gnu affero general public license for more details"),
        (0, 0.95, "gnu org licenses", "gnu org licenses agpl(?: 3 0)?"),
        (0, 0.95, "affero general public", "{by} (?:gnu )?affero general public license{v}"),
        (0, 0.95, "affero general public", "{under}(?:gnu )?affero general public license{v}"),
        (1, 0.9, "affero general public", "(?:gnu )?affero general public licen[cs]e{v}"),
        (1, 0.95, "agpl", "{by} (?:gnu )?agpl ?{v}{lic}"),
        (2, 0.85, "gnu agpl", "gnu agpl ?{v}"),
        (2, 0.8, "agpl", "agpl ?v?3(?: 0)?(?: only| or later)?"),
        (1, 0.9, "remote network interaction use with the gnu general public", "remote network interaction use with the gnu general public license"),
    ],
    "fdl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier gfdl(?: 1 [123])?(?: only| or later)?"),
        (0, 1.0, "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
        (1, 0.95, "free documentation license", "{by} (?:gnu )?free documentation license{v}"),
        (2, 0.85, "free documentation licen", "(?:gnu )?free documentation licen[cs]e{v}"),
        (1, 0.9, "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
        (1, 0.9, "gnu org licenses", "gnu org licenses fdl(?: 1 [123])?"),
    ],
    "bsd": [
        (0, 1.0, "spdx license identifier", "spdx license identifier (?:0bsd|bsd(?: [234] clause)?)"),
        (0, 1.0, "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
        (1, 0.95, "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
        (1, 0.95, "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
        (1, 0.95, "from this software without specific prior", "(?:may|nor the names of its contributors may) be used to endorse or promote products derived from this software without specific prior written permission"),
        (1, 0.9, "features or use of this software", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
        (1, 0.9, "copyright holders and contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
        (1, 0.9, "this software is provided by the regents", "this software is provided by the regents and contributors as is and any express or implied warranties"),
        (1, 0.9, "use of this software even if advised", "arising in any way out of the use of this software even if advised of the possibility of such damage"),
        (1, 0.95, "opensource org licenses bsd", "opensource org licenses bsd(?: licen[cs]e| [23] clause)?"),
        (1, 0.95, "bsd", "{by} (?:(?:2|3|4|two|three|four) clause |new |modified |simplified |original |revised )?bsd(?: [234] clause)?{lic}"),
        (1, 0.95, "bsd", "{under}(?:(?:2|3|4|two|three|four) clause |new |modified |simplified |original |revised )?bsd(?: [234] clause)?{lic}"),
        (2, 0.85, "clause bsd", "(?:2|3|4|two|three|four) clause bsd(?: licen[cs]e)?"),
        (2, 0.85, "bsd", "bsd [234] clause(?: licen[cs]e)?"),
        (2, 0.8, "bsd licen", "(?:new |modified |simplified |original |revised )?bsd licen[cs]ed?"),
        (2, 0.8, "bsd style licen", "bsd style licen[cs]e"),
        (2, 0.8, "bsd", "licen[cs]e (?:is |type |name )?bsd(?: [234] clause)?"),
        (2, 0.85, "berkeley software distribution", "berkeley software distribution(?: licen[cs]e)?"),
        (2, 0.85, "zero clause bsd", "zero clause bsd(?: licen[cs]e)?"),
        (1, 0.9, "bsd zero clause", "{by} bsd zero clause(?: licen[cs]e)?"),
    ],
    "isc": [
        (0, 1.0, "spdx license identifier", "spdx license identifier isc"),
        (0, 1.0, "permission to use copy modify and", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
        (1, 0.9, "in no event shall isc", "in no event shall isc be liable for any special direct indirect or consequential damages"),
        (1, 0.95, "isc licen", "{by} isc licen[cs]e"),
        (1, 0.9, " isc", "{by} isc"),
        (2, 0.85, "isc licen", "isc licen[cs]ed?"),
        (1, 0.95, "opensource org licenses isc", "opensource org licenses isc"),
    ],
    "mpl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier mpl(?: [12] [01])?"),
        (0, 1.0, "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
        (0, 1.0, "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 [01]"),
        (1, 0.95, "mozilla org mpl", "(?:you can obtain one at )?https? (?:www )?mozilla org mpl(?: 2 0)?"),
        (1, 0.95, "incompatible with secondary licenses", "incompatible with secondary licenses as defined by the mozilla public license"),
        (1, 0.95, "mozilla public license", "{by} mozilla public license{v}"),
        (1, 0.95, "mozilla public license", "{under}mozilla public license{v}"),
        (2, 0.85, "mozilla public licen", "mozilla public licen[cs]e{v}"),
        (1, 0.9, " mpl", "{by} mpl ?{v}"),
        (2, 0.8, "mpl", "mpl ?v?[12] [01]"),
        (2, 0.8, "mpl licen", "mpl licen[cs]ed?"),
        (1, 0.9, "begin license block", "begin license block version mpl 1 1 gpl 2 0 lgpl 2 1"),
    ],
    "epl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier epl(?: [12] 0)?"),
        (0, 1.0, "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
        (1, 0.95, "eclipse org legal epl", "eclipse org legal epl(?: v?[12]0| 2 0)?"),
        (1, 0.95, "eclipse public license", "{by} eclipse public license{v}"),
        (2, 0.85, "eclipse public licen", "eclipse public licen[cs]e{v}"),
        (2, 0.85, "eclipse distribution licen", "eclipse distribution licen[cs]e{v}"),
        (1, 0.9, " epl", "{by} epl ?{v}"),
        (2, 0.8, "epl", "epl ?v?[12] 0"),
    ],
    "cddl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier cddl(?: 1 [01])?"),
        (0, 1.0, "common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license"),
        (1, 0.95, "common development and distribution license", "{by} common development and distribution license{v}"),
        (2, 0.85, "common development and distribution licen", "common development and distribution licen[cs]e{v}"),
        (1, 0.9, "cddl header start", "cddl header start"),
        (1, 0.9, "cddl", "{by} cddl ?{v}"),
        (2, 0.8, "cddl", "cddl ?v?1 [01]"),
    ],
    "cpl": [
        (1, 0.95, "common public license", "{by} common public license{v}"),
        (2, 0.85, "common public licen", "common public licen[cs]e{v}"),
        (0, 1.0, "spdx license identifier", "spdx license identifier cpl 1 0"),
    ],
    "ipl": [
        (1, 0.95, "ibm public license", "{by} ibm public license{v}"),
        (2, 0.85, "ibm public licen", "ibm public licen[cs]e{v}"),
    ],
    "cc by": [
        (0, 1.0, "spdx license identifier", "spdx license identifier cc by [1234] [05]"),
        (1, 0.95, "creativecommons org licenses by", "creativecommons org licenses by [1234] [05]"),
        (1, 0.95, "creative commons attribution", "{by} creative commons attribution{cc}(?: licen[cs]e)?"),
        (2, 0.85, "creative commons attribution", "creative commons attribution{cc}(?: public)?(?: licen[cs]e)?"),
        (1, 0.9, "cc by", "{by} cc by{cc}"),
        (2, 0.8, "cc by", "cc by [1234] [05]"),
        (2, 0.8, "cc by", "licen[cs]e (?:is |type |name )?cc by{cc}"),
        (2, 0.7, "cc by licen", "cc by licen[cs]e"),
    ],
    "cc by sa": [
        (0, 1.0, "spdx license identifier", "spdx license identifier cc by sa [1234] [05]"),
        (0, 0.95, "creativecommons org licenses by sa", "creativecommons org licenses by sa [1234] [05]"),
        (0, 0.95, "creative commons attribution share", "{by} creative commons attribution share ?alike{cc}(?: licen[cs]e)?"),
        (1, 0.9, "creative commons attribution share", "creative commons attribution share ?alike{cc}(?: licen[cs]e)?"),
        (0, 0.9, "cc by sa", "{by} cc by sa{cc}"),
        (1, 0.85, "cc by sa", "cc by sa{cc}"),
    ],
    "cc by nd": [
        (0, 1.0, "spdx license identifier", "spdx license identifier cc by nd [1234] [05]"),
        (0, 0.95, "creativecommons org licenses by nd", "creativecommons org licenses by nd [1234] [05]"),
        (0, 0.9, "creative commons attribution no", "creative commons attribution no ?deriv(?:s|atives|ative works)?{cc}"),
        (1, 0.85, "cc by nd", "cc by nd{cc}"),
    ],
    "cc by nc": [
        (0, 1.0, "spdx license identifier", "spdx license identifier cc by nc [1234] [05]"),
        (0, 0.95, "creativecommons org licenses by nc", "creativecommons org licenses by nc [1234] [05]"),
        (0, 0.9, "creative commons attribution non", "creative commons attribution non ?commercial{cc}"),
        (1, 0.85, "cc by nc", "cc by nc{cc}"),
    ],
    "cc by nc sa": [
        (0, 1.0, "spdx license identifier", "spdx license identifier cc by nc sa [1234] [05]"),
        (0, 0.95, "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa [1234] [05]"),
        (0, 0.95, "commercial share", "creative commons attribution non ?commercial share ?alike{cc}"),
        (0, 0.9, "cc by nc sa", "cc by nc sa{cc}"),
    ],
    "cc by nc nd": [
        (0, 1.0, "spdx license identifier", "spdx license identifier cc by nc nd [1234] [05]"),
        (0, 0.95, "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd [1234] [05]"),
        (0, 0.95, "commercial no", "creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)?{cc}"),
        (0, 0.9, "cc by nc nd", "cc by nc nd{cc}"),
    ],
    "cc0": [
        (0, 1.0, "spdx license identifier", "spdx license identifier cc0(?: 1 0)?"),
        (0, 0.95, "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0"),
        (0, 0.95, "creative commons zero", "creative commons zero(?: v?1 0)?(?: universal)?"),
        (0, 0.95, "cc0", "{by} cc0(?: 1 0)?(?: universal)?"),
        (1, 0.9, "cc0 1 0", "cc0 1 0(?: universal)?"),
        (2, 0.8, "cc0 licen", "cc0 licen[cs]ed?"),
        (1, 0.9, "waived all copyright", "has waived all copyright and related or neighboring rights"),
        (2, 0.8, "cc0", "licen[cs]e (?:is |type |name )?cc0(?: 1 0)?"),
    ],
    "public domain": [
        (1, 0.95, "public domain", "{by} public domain(?: dedication)?"),
        (1, 0.9, "public domain", "(?:placed|put|released|dedicated|donated|given|contributed) (?:in|into|to) the public domain"),
        (1, 0.9, "public domain", "(?:is|are) (?:hereby )?(?:in|released into|placed in) the public domain"),
        (1, 0.9, "public domain dedication", "public domain dedication(?: and licen[cs]e)?"),
        (1, 0.9, "public domain mark", "(?:creative commons )?public domain mark(?: 1 0)?"),
        (1, 0.9, "disclaims copyright", "the author (?:hereby )?disclaims copyright to this source code"),
        (1, 0.9, "no copyright is claimed", "no copyright is claimed in the united states under title 17"),
        (2, 0.85, "licen", "licen[cs]e (?:is |type |name )?public domain"),
        (2, 0.8, "no rights reserved", "no rights reserved"),
    ],
    "unlicense": [
        (0, 1.0, "spdx license identifier", "spdx license identifier unlicense"),
        (0, 1.0, "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
        (1, 0.95, "compile sell or distribute", "anyone is free to copy modify publish use compile sell or distribute this software"),
        (1, 0.95, "unlicense org", "unlicense org"),
        (1, 0.95, "unlicense", "{by} unlicense"),
        (2, 0.85, "unlicense", "the unlicense"),
    ],
    "zlib": [
        (0, 1.0, "spdx license identifier", "spdx license identifier zlib"),
        (0, 0.95, "zlib", "{by} zlib(?: libpng)?{lic}"),
        (1, 0.95, "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented"),
        (1, 0.9, "origin of this software", "the origin of this software must not be misrepresented"),
        (1, 0.9, "may not be removed or altered", "this notice may not be removed or altered from any source distribution"),
        (2, 0.85, "zlib licen", "zlib licen[cs]ed?"),
        (2, 0.85, "zlib libpng", "zlib libpng licen[cs]e"),
    ],
    "libpng": [
        (1, 0.95, "libpng licen", "{by} libpng licen[cs]e"),
        (1, 0.9, "disclaim all warranties", "the contributing authors and group 42 inc disclaim all warranties"),
    ],
    "boost": [
        (0, 1.0, "spdx license identifier", "spdx license identifier bsl 1 0"),
        (0, 1.0, "boost software license", "distributed under the boost software license version 1 0"),
        (1, 0.95, "boost org license", "boost org license 1 0 txt"),
        (1, 0.95, "boost software license", "{by} boost software license{v}"),
        (2, 0.85, "boost software licen", "boost software licen[cs]e{v}"),
        (2, 0.8, "boost licen", "boost licen[cs]ed?"),
    ],
    "artistic": [
        (0, 1.0, "spdx license identifier", "spdx license identifier artistic [12] 0"),
        (1, 0.95, "artistic licen", "{by} (?:perl |clarified )?artistic licen[cs]e{v}"),
        (2, 0.85, "artistic licen", "(?:perl |clarified )?artistic licen[cs]e{v}"),
        (1, 0.9, "redistribute it and or modify it under the same", "you can redistribute it and or modify it under the same terms as perl(?: itself)?"),
    ],
    "python": [
        (0, 1.0, "spdx license identifier", "spdx license identifier (?:psf|python) 2 0"),
        (1, 0.95, "python software foundation", "{by} python software foundation{lic}{v}"),
        (2, 0.85, "python software foundation licen", "python software foundation licen[cs]e{v}"),
        (1, 0.95, "psf", "{by} psf{lic}{v}"),
        (2, 0.85, "psf licen", "psf licen[cs]e{v}"),
        (0, 0.95, "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
        (1, 0.9, "beopen python", "beopen python open source license agreement"),
        (2, 0.85, "python licen", "{by} python licen[cs]e"),
    ],
    "postgresql": [
        (0, 1.0, "spdx license identifier", "spdx license identifier postgresql"),
        (1, 0.95, "postgresql licen", "{by} postgresql licen[cs]e"),
        (2, 0.85, "postgresql licen", "postgresql licen[cs]e"),
    ],
    "openssl": [
        (0, 1.0, "software developed by the openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
        (1, 0.95, "openssl licen", "{by} openssl licen[cs]e"),
        (2, 0.85, "openssl licen", "openssl licen[cs]e"),
        (1, 0.9, "cryptographic software written by eric young", "includes cryptographic software written by eric young"),
    ],
    "php": [
        (0, 1.0, "spdx license identifier", "spdx license identifier php 3 01"),
        (1, 0.95, "php licen", "{by} php licen[cs]e{v}"),
        (1, 0.95, " of the php license", "this source file is subject to version 3 (?:0|01) of the php license"),
        (2, 0.85, "php licen", "php licen[cs]e{v}"),
    ],
    "ruby": [
        (0, 1.0, "spdx license identifier", "spdx license identifier ruby"),
        (1, 0.95, "ruby", "{by} (?:same terms as )?ruby(?: s)?(?: licen[cs]e)?"),
        (2, 0.85, "ruby licen", "ruby licen[cs]e"),
        (2, 0.85, "ruby s licen", "ruby s licen[cs]e"),
    ],
    "w3c": [
        (0, 1.0, "spdx license identifier", "spdx license identifier w3c"),
        (1, 0.95, "w3c", "{by} w3c(?: software(?: notice)?(?: and)?)?(?: licen[cs]e)?"),
        (2, 0.85, "w3c software notice", "w3c software notice and licen[cs]e"),
        (2, 0.85, "w3c licen", "w3c licen[cs]e"),
    ],
    "x11": [
        (1, 0.95, "x11 licen", "{by} x11 licen[cs]e"),
        (2, 0.85, "x11 licen", "x11 licen[cs]e"),
    ],
    "ncsa": [
        (0, 1.0, "spdx license identifier", "spdx license identifier ncsa"),
        (1, 0.95, "ncsa", "{by} (?:university of illinois )?ncsa(?: open source)?(?: licen[cs]e)?"),
        (2, 0.85, "ncsa open source licen", "(?:university of illinois )?ncsa open source licen[cs]e"),
    ],
    "ofl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier ofl 1 [01]"),
        (0, 1.0, "open font license", "this font software is licensed under the sil open font license(?: version 1 [01])?"),
        (1, 0.95, "open font license", "{by} (?:sil )?open font license{v}"),
        (2, 0.85, "open font licen", "(?:sil )?open font licen[cs]e{v}"),
        (1, 0.9, "reserved font name", "with reserved font name"),
    ],
    "odbl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier odbl 1 0"),
        (1, 0.95, "open database license", "{by} (?:open data commons )?open database license{v}"),
        (2, 0.85, "open database licen", "(?:open data commons )?open database licen[cs]e{v}"),
        (1, 0.9, "opendatacommons org licenses odbl", "opendatacommons org licenses odbl(?: 1 0)?"),
        (1, 0.9, "odbl", "{by} odbl"),
    ],
    "odc by": [
        (1, 0.95, "open data commons attribution", "{by} open data commons attribution(?: licen[cs]e)?{v}"),
        (2, 0.85, "open data commons attribution", "open data commons attribution licen[cs]e{v}"),
        (1, 0.9, "opendatacommons org licenses by", "opendatacommons org licenses by(?: 1 0)?"),
        (2, 0.8, "odc by", "odc by(?: 1 0)?"),
    ],
    "pddl": [
        (1, 0.9, "opendatacommons org licenses pddl", "opendatacommons org licenses pddl(?: 1 0)?"),
        (2, 0.85, "open data commons public domain", "open data commons public domain dedication(?: and)? licen[cs]e"),
    ],
    "eupl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier eupl 1 [012]"),
        (1, 0.95, "european union public licen", "{by} european union public licen[cs]e{v}"),
        (2, 0.85, "european union public licen", "european union public licen[cs]e{v}"),
        (1, 0.9, "eupl", "{by} eupl ?{v}"),
        (2, 0.8, "eupl", "eupl ?v?1 [012]"),
    ],
    "cecill": [
        (1, 0.95, "cecill", "{by} cecill(?: [abc])?(?: licen[cs]e)?{v}"),
        (0, 0.95, "cecill", "governed by the cecill(?: [abc])? license under french law"),
        (2, 0.85, "cecill", "cecill(?: [abc])? licen[cs]e"),
    ],
    "wtfpl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier wtfpl"),
        (0, 1.0, "you want to public license", "do what the f(?:uck|[a-z]*) you want to public license"),
        (1, 0.95, "wtfpl", "{by} wtfpl{v}"),
        (2, 0.85, "wtfpl", "wtfpl(?: licen[cs]ed?)?"),
    ],
    "beerware": [
        (0, 0.95, "beer ware", "the beer ware licen[cs]e"),
        (1, 0.95, "buy me a beer", "you can buy me a beer in return"),
        (2, 0.85, "beerware", "beerware(?: licen[cs]e)?"),
    ],
    "ms pl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier ms pl"),
        (1, 0.95, "microsoft public license", "{by} microsoft public license"),
        (2, 0.85, "microsoft public licen", "microsoft public licen[cs]e"),
    ],
    "ms rl": [
        (1, 0.95, "microsoft reciprocal license", "{by} microsoft reciprocal license"),
        (2, 0.85, "microsoft reciprocal licen", "microsoft reciprocal licen[cs]e"),
    ],
    "lppl": [
        (0, 1.0, "latex project public license", "this work may be distributed and or modified under the conditions of the latex project public license"),
        (1, 0.95, "latex project public license", "{by} latex project public license{v}"),
        (2, 0.85, "latex project public licen", "latex project public licen[cs]e{v}"),
    ],
    "afl": [
        (1, 0.95, "academic free license", "{by} academic free license{v}"),
        (2, 0.85, "academic free licen", "academic free licen[cs]e{v}"),
        (0, 1.0, "spdx license identifier", "spdx license identifier afl [123] [01]"),
    ],
    "osl": [
        (1, 0.95, "open software license", "{by} open software license{v}"),
        (2, 0.85, "open software licen", "open software licen[cs]e{v}"),
        (0, 1.0, "spdx license identifier", "spdx license identifier osl [123] [01]"),
    ],
    "qpl": [
        (1, 0.95, "q public license", "{by} q public license{v}"),
        (2, 0.85, "q public licen", "the q public licen[cs]e{v}"),
    ],
    "sleepycat": [
        (2, 0.85, "sleepycat licen", "sleepycat licen[cs]e"),
    ],
    "vim": [
        (1, 0.95, "vim licen", "{by} vim licen[cs]e"),
        (2, 0.85, "vim licen", "vim licen[cs]e"),
    ],
    "bsl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier busl 1 1"),
        (1, 0.95, "business source license", "{by} business source license{v}"),
        (2, 0.85, "business source licen", "business source licen[cs]e{v}"),
        (1, 0.9, "the licensor may make", "the licensor may make an additional use grant above permitting limited production use"),
        (1, 0.9, "change license", "change license (?:[a-z0-9]+ ){{1,12}}change date"),
    ],
    "sspl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier sspl 1 0"),
        (1, 0.95, "server side public license", "{by} server side public license{v}"),
        (2, 0.85, "server side public licen", "server side public licen[cs]e{v}"),
        (1, 0.9, "sspl", "{by} sspl ?{v}"),
    ],
    "elastic": [
        (1, 0.95, "elastic licen", "{by} elastic licen[cs]e{v}"),
        (2, 0.85, "elastic licen", "elastic licen[cs]e{v}"),
        (1, 0.9, "you may not provide the software", "you may not provide the software to third parties as a hosted or managed service"),
    ],
    "commons clause": [
        (1, 0.95, "commons clause", "commons clause license condition v?1 0"),
        (2, 0.85, "commons clause", "(?:with|plus|and) (?:the )?commons clause"),
    ],
    "polyform": [
        (1, 0.9, "polyform noncommercial license", "polyform noncommercial license(?: 1 0 [01])?"),
        (1, 0.9, "polyform small business license", "polyform small business license(?: 1 0 [01])?"),
        (1, 0.9, "polyform shield license", "polyform shield license(?: 1 0 [01])?"),
    ],
    "openrail": [
        (1, 0.95, "openrail", "(?:creativeml |bigcode )?openrail(?: [m+]+)?(?: licen[cs]e)?"),
        (2, 0.85, "responsible ai licen", "responsible ai licen[cs]es?"),
    ],
    "upl": [
        (0, 1.0, "spdx license identifier", "spdx license identifier upl 1 0"),
        (1, 0.95, "universal permissive license", "{by} universal permissive license{v}"),
        (2, 0.85, "universal permissive licen", "universal permissive licen[cs]e{v}"),
    ],
    "blueoak": [
        (1, 0.95, "blue oak model license", "{by} blue oak model license{v}"),
        (2, 0.85, "blue oak model licen", "blue oak model licen[cs]e{v}"),
    ],
    "intel": [
        (2, 0.85, "intel simplified software licen", "intel simplified software licen[cs]e"),
        (1, 0.95, "intel simplified software license", "{by} intel simplified software license"),
    ],
    "curl": [
        (1, 0.95, "curl licen", "{by} curl licen[cs]e"),
        (0, 1.0, "spdx license identifier", "spdx license identifier curl"),
    ],
    "icu": [
        (2, 0.85, "icu licen", "icu licen[cs]e(?: icu 1 8 1 and later)?"),
        (0, 1.0, "spdx license identifier", "spdx license identifier icu"),
    ],
    "unicode": [
        (1, 0.95, "unicode inc license agreement", "unicode inc license agreement data files and software"),
        (2, 0.85, "unicode licen", "unicode licen[cs]e{v}"),
        (1, 0.9, "unicode org copyright", "unicode org copyright html"),
    ],
    "json": [
        (1, 0.95, "the software shall be used for good", "the software shall be used for good not evil"),
        (2, 0.8, "json licen", "(?:the )?json licen[cs]e"),
    ],
    "freetype": [
        (1, 0.95, "freetype licen", "{by} freetype licen[cs]e"),
        (2, 0.85, "freetype project licen", "freetype project licen[cs]e"),
    ],
    "ijg": [
        (1, 0.95, "this software is based in part", "this software is based in part on the work of the independent jpeg group"),
        (0, 1.0, "spdx license identifier", "spdx license identifier ijg"),
    ],
    "hpnd": [
        (1, 0.9, "permission to use copy modify and distribute", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)?(?: with or)? without fee is hereby granted"),
        (2, 0.85, "historical permission notice", "historical permission notice and disclaimer"),
    ],
    "ogl": [
        (1, 0.95, "open government licen", "{by} open government licen[cs]e{v}"),
        (2, 0.85, "open government licen", "open government licen[cs]e{v}"),
        (1, 0.9, "contains public sector information", "contains public sector information licensed under the open government licen[cs]e"),
    ],
    "etalab": [
        (1, 0.95, "licence ouverte", "licence ouverte(?: open licence)?(?: etalab)?(?: [12] 0)?"),
        (1, 0.95, "open licence etalab", "open licence etalab(?: [12] 0)?"),
    ],
    "llama": [
        (1, 0.95, "community license", "llama [234](?: [0-9])? community license(?: agreement)?"),
    ],
    "proprietary": [
        (2, 0.8, "proprietary and confidential", "proprietary and confidential"),
        (2, 0.8, "confidential and proprietary", "confidential and proprietary"),
        (2, 0.8, "is strictly prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
        (2, 0.8, "end user license agreement", "end user license agreement(?: eula)?"),
        (2, 0.7, "prior written permission", "may not be (?:reproduced|copied|used)(?: [a-z]+){{0,12}} without (?:the )?(?:express )?prior written permission"),
        (3, 0.5, "all rights reserved", "all rights reserved"),
        (3, 0.5, "for evaluation purposes only", "for evaluation purposes only"),
        (3, 0.5, "not for redistribution", "not for redistribution"),
    ],
    "non commercial": [
        (2, 0.7, "commercial use", "for non ?commercial use only"),
        (2, 0.7, "commercial purposes", "for non ?commercial purposes(?: only)?"),
        (2, 0.7, "commercial use is", "commercial use is (?:strictly )?prohibited"),
        (2, 0.7, "research purposes only", "for (?:academic and )?research purposes only"),
    ],
    "copyleft": [
        (3, 0.5, "copyleft", "copyleft licen[cs]e"),
        (3, 0.5, "share alike licen", "under (?:the same|a similar) share alike licen[cs]e"),
    ],
    "permissive": [
        (3, 0.5, "permissive licen", "permissive licen[cs]e"),
    ],
    "no warranty": [
        (3, 0.4, "without warranty of any kind", "without warranty of any kind"),
        (3, 0.4, "without any warranty", "without any warranty"),
        (3, 0.4, "absolutely no warranty", "absolutely no warranty"),
        (3, 0.4, "without any express or implied warranty", "provided as is without any express or implied warranty"),
        (3, 0.4, "fitness for a particular purpose", "merchantability(?: and| or)?(?: of)? fitness for a particular purpose"),
    ],
}

#: Short strings of which every keyword holds one at least: a text without any of them is tried by no rule.
ANCHORS = (
    "licen", "gpl", "public", "software", "permi", "warrant", "reserved", "copyright", " mit", "expat", "apache", "asl", "bsd", " isc", "mpl", "epl", "cddl", "cc by", "cc0", "creative", "psf", "python", "eupl", "cecill", "odbl",
    "odc by", "sspl", "zlib", "ruby", "w3c", "ncsa", "beer", "commercial", "copyleft", "commons", "distribut", "exception", "purpose", "prohibited", "confidential", "foundation", "invariant", "altered", "wtfpl", "openrail",
    "unicode org", "conditions of any kind", "attribution", "end user", "prior written permission",
)


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, confidence, keyword, pattern)."""
    return [(label, p, c, word, body.format(**FRAGMENTS)) for label, group in RULES.items() for p, c, word, body in group]
