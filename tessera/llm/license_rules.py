"""Ordered signature rules for licence texts, over normalised words (lower case, single blanks).

SIGNATURES are written by hand, one line each: tier, label, keyword, pattern. Tier 0 holds SPDX tags and sentences of the licences' own
texts, tier 1 grants and addresses, tier 2 notices and headings, tier 3 bare names; within a tier the order is the priority, named versions
before families. The keyword is one that every match holds; the pattern runs only where it stands. In patterns a blank stands between
words; version numbers are words of their own, as dots aren't part of words, and a match always is whole words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Beginnings of words that many patterns can't do without, looked for before the keywords; the first that a pattern needs is its gate.
GATES = (" identifier ", " licen", " under ", " org ", " software ", " terms ", " public ", " use ")
#: How sure a detection of each tier is.
CONFIDENCE = (1.0, 0.95, 0.85, 0.7)

SIGNATURES: list[tuple[int, str, str, str]] = [
    # tags
    (0, "mit", "identifier mit", "spdx license identifier mit(?: 0)?"),
    (0, "apache-2.0", "identifier apache", "spdx license identifier apache 2 0"),
    (0, "apache-1.1", "identifier apache", "spdx license identifier apache 1 1"),
    (0, "gpl-2.0", "identifier gpl", "spdx license identifier gpl 2 0(?: only| or later)?"),
    (0, "gpl-3.0", "identifier gpl", "spdx license identifier gpl 3 0(?: only| or later)?"),
    (0, "gpl", "identifier gpl", "spdx license identifier gpl(?: 1 0)?(?: only| or later)?"),
    (0, "lgpl-2.0", "identifier lgpl", "spdx license identifier lgpl 2 0(?: only| or later)?"),
    (0, "lgpl-2.1", "identifier lgpl", "spdx license identifier lgpl 2 1(?: only| or later)?"),
    (0, "lgpl-3.0", "identifier lgpl", "spdx license identifier lgpl 3 0(?: only| or later)?"),
    (0, "agpl-3.0", "identifier agpl", "spdx license identifier agpl 3 0(?: only| or later)?"),
    (0, "bsd-zero", "identifier 0bsd", "spdx license identifier 0bsd"),
    (0, "bsd-2-clause", "identifier bsd", "spdx license identifier bsd 2 clause(?: patent| views)?"),
    (0, "bsd-3-clause", "identifier bsd", "spdx license identifier bsd 3 clause(?: clear| lbnl| attribution)?"),
    (0, "bsd-4-clause", "identifier bsd", "spdx license identifier bsd 4 clause(?: uc)?"),
    (0, "isc", "identifier isc", "spdx license identifier isc"),
    (0, "mpl-1.1", "identifier mpl", "spdx license identifier mpl 1 [01]"),
    (0, "mpl-2.0", "identifier mpl", "spdx license identifier mpl 2 0(?: no copyleft exception)?"),
    (0, "epl-1.0", "identifier epl", "spdx license identifier epl 1 0"),
    (0, "epl-2.0", "identifier epl", "spdx license identifier epl 2 0"),
    (0, "eupl", "identifier eupl", "spdx license identifier eupl 1 [012]"),
    (0, "cddl", "identifier cddl", "spdx license identifier cddl 1 [01]"),
    (0, "cc0", "identifier cc0", "spdx license identifier cc0 1 0"),
    (0, "cc-by-nc-sa", "identifier cc by", "spdx license identifier cc by nc sa [1234] [05]"),
    (0, "cc-by-nc-nd", "identifier cc by", "spdx license identifier cc by nc nd [1234] [05]"),
    (0, "cc-by-nc", "identifier cc by", "spdx license identifier cc by nc [1234] [05]"),
    (0, "cc-by-sa", "identifier cc by", "spdx license identifier cc by sa [1234] [05]"),
    (0, "cc-by-nd", "identifier cc by", "spdx license identifier cc by nd [1234] [05]"),
    (0, "cc-by", "identifier cc by", "spdx license identifier cc by [1234] [05]"),
    (0, "unlicense", "identifier unlicense", "spdx license identifier unlicense"),
    (0, "wtfpl", "identifier wtfpl", "spdx license identifier wtfpl"),
    (0, "zlib", "identifier zlib", "spdx license identifier zlib(?: acknowledgement)?"),
    (0, "bsl-1.0", "identifier bsl", "spdx license identifier bsl 1 0"),
    (0, "artistic-2.0", "identifier artistic", "spdx license identifier artistic 2 0"),
    (0, "artistic", "identifier artistic", "spdx license identifier artistic 1 0(?: perl| cl8)?"),
    (0, "python", "identifier p", "spdx license identifier (?:psf|python) 2 0(?: 1)?"),
    (0, "postgresql", "identifier postgresql", "spdx license identifier postgresql"),
    (0, "openssl", "identifier openssl", "spdx license identifier openssl"),
    (0, "ofl", "identifier ofl", "spdx license identifier ofl 1 [01](?: rfn| no rfn)?"),
    (0, "odbl", "identifier odbl", "spdx license identifier odbl 1 0"),
    (0, "ms-pl", "identifier ms pl", "spdx license identifier ms pl"),
    (0, "ms-rl", "identifier ms rl", "spdx license identifier ms rl"),
    # sentences of the licences' own texts
    (0, "mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (0, "mit", "to deal in the software without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    (0, "mit", "permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (0, "mit", "express or implied including but not limited to", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (0, "mit", "in no event shall the authors", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    (0, "isc", "use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (0, "isc", "the author disclaims all warranties", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    (0, "bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    (0, "bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (0, "bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    (0, "bsd-3-clause", "used to endorse or promote products", "neither the name of (?:the )?(?:copyright holders?|author|organization|university|company) nor the names of (?:its|their|other) contributors may be used to endorse or promote products derived from this software"),
    (0, "bsd-4-clause", "all advertising materials mentioning features", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (0, "bsd", "this software is provided by the copyright holders", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    (0, "apache-2.0", "grants to you a perpetual worldwide", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    (0, "apache-2.0", "terms and conditions for use reproduction", "terms and conditions for use reproduction and distribution"),
    (0, "apache-2.0", "you may not use this file except in compliance", "you may not use this file except in compliance with the license"),
    (0, "apache-2.0", "software distributed under the license is distributed", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    (0, "apache-1.1", "includes software developed by the apache", "this product includes software developed by the apache (?:software foundation|group)"),
    (0, "gpl", "for this general public license is intended", "(?:the gnu general public license is|our general public licenses are) for this general public license is intended"),
    (0, "gpl", "intended to guarantee your freedom", "the (?:gnu )?general public license is intended to guarantee your freedom to share and change (?:free software|all versions of a program)"),
    (0, "gpl", "the licenses for most software", "the licenses for most software (?:and other practical works )?are designed to take away your freedom"),
    (0, "gpl", "redistribute it and or modify it under", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (0, "gpl-2.0", "either version 2 of the license", "published by the free software foundation either version 2 of the license or at your option any later version"),
    (0, "gpl-3.0", "either version 3 of the license", "published by the free software foundation either version 3 of the license or at your option any later version"),
    (0, "gpl-2.0", "activities other than copying distribution", "activities other than copying distribution and modification are not covered by this license"),
    (0, "gpl-3.0", "to propagate a work means", "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable"),
    (0, "gpl", "see the gnu general public license for more details", "see the gnu general public license for more details"),
    (0, "lgpl", "redistribute it and or modify it under", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    (0, "lgpl-2.1", "either version 2 1 of the license", "published by the free software foundation either version 2 1 of the license or at your option any later version"),
    (0, "lgpl-3.0", "permissions listed below", "incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"),
    (0, "lgpl", "see the gnu lesser general public license", "see the gnu lesser general public license for more details"),
    (0, "agpl-3.0", "remote network interaction", "remote network interaction use with the gnu general public license"),
    (0, "agpl", "redistribute it and or modify it under", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    (0, "mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (0, "mpl-2.0", "this source code form is incompatible", "this source code form is incompatible with secondary licenses"),
    (0, "mpl-1.1", "subject to the mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
    (0, "epl-2.0", "this program and the accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version )?2 0"),
    (0, "epl-1.0", "this program and the accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    (0, "epl", "constitutes recipient s acceptance", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    (0, "cddl", "subject to the terms of the common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    (0, "unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    (0, "unlicense", "anyone is free to copy modify publish", "anyone is free to copy modify publish use compile sell or distribute this software"),
    (0, "wtfpl", "do what the fuck you want to", "do what the fuck you want to(?: public license)?"),
    (0, "zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (0, "zlib", "the origin of this software must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (0, "bsl-1.0", "copy of the software and accompanying documentation covered", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (0, "artistic", "intent of this document is to state the conditions", "the intent of this document is to state the conditions under which a package may be copied"),
    (0, "artistic-2.0", "this license establishes the terms under which", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    (0, "python", "python software foundation", "this license agreement is between the python software foundation psf and the individual or organization"),
    (0, "postgresql", "without a written agreement is hereby granted", "for any purpose without fee and without a written agreement is hereby granted"),
    (0, "openssl", "includes software developed by the openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    (0, "ofl", "the fonts including any derivative works", "the fonts including any derivative works can be bundled embedded redistributed and or sold with any software"),
    (0, "odbl", "the open database license odbl is", "the open database license odbl is a license agreement intended to allow users to freely share modify and use this database"),
    (0, "cc0", "has waived all copyright", "(?:to the extent possible under law )?(?:the author|the person who associated a work with this deed) has waived all copyright and related or neighboring rights"),
    (0, "cc-by-sa", "same license as the original", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    (0, "cc-by-nc", "use the material for commercial purposes", "you may not use the material for commercial purposes"),
    (0, "cc-by-nd", "distribute the modified material", "if you remix transform or build upon the material you may not distribute the modified material"),
    # grants
    (1, "mit", "mit", "(?:is |are )?(?:licen[sc]ed|released|distributed|available|published|provided)(?: to you)? under the (?:terms of the )?mit(?: x11)?(?: licen[sc]e)?"),
    (1, "mit", "under mit", "(?:is |are )?(?:licen[sc]ed|released|distributed|available|published|provided)(?: to you)? under mit(?: licen[sc]e)?"),
    (1, "mit", "expat", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?expat(?: licen[sc]e)?"),
    (1, "apache-2.0", "apache", "(?:is |are )?(?:licen[sc]ed|released|distributed|available|published|provided)(?: to you)? under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[sc]e)? (?:v2|(?:version |v )?2(?: 0)?)(?: licen[sc]e)?"),
    (1, "apache", "apache", "(?:is |are )?(?:licen[sc]ed|released|distributed|available|published|provided)(?: to you)? under the (?:terms of the )?apache (?:software |mit )?licen[sc]e"),
    (1, "gpl-2.0", "public license", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:gnu )?general public license (?:v2|(?:version|v) 2(?: 0)?)"),
    (1, "gpl-3.0", "public license", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:gnu )?general public license (?:v3|(?:version|v) 3(?: 0)?)"),
    (1, "gpl", "public license", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:gnu )?general public license"),
    (1, "gpl-2.0", "gpl", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:gnu )?(?:gplv2|gpl(?: version)? 2(?: 0)?|gpl v2)"),
    (1, "gpl-3.0", "gpl", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:gnu )?(?:gplv3|gpl(?: version)? 3(?: 0)?|gpl v3)"),
    (1, "gpl", "gpl", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:gnu )?gpl"),
    (1, "lgpl-2.1", "lesser", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:gnu )?lesser general public license (?:v2 1|(?:version|v) 2 1)"),
    (1, "lgpl-3.0", "lesser", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:gnu )?lesser general public license (?:v3|(?:version|v) 3(?: 0)?)"),
    (1, "lgpl", "lesser", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:gnu )?lesser general public license"),
    (1, "lgpl", "lgpl", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:gnu )?(?:lgpl(?: v?[23](?: [01])?)?|lgplv[23](?: 1)?)"),
    (1, "agpl-3.0", "affero", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:gnu )?affero general public license (?:v3|(?:version|v) 3(?: 0)?)"),
    (1, "agpl", "agpl", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:gnu )?(?:agpl(?: v?3(?: 0)?)?|agplv3)"),
    (1, "bsd-2-clause", "2 clause", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:bsd 2 clause|2 clause bsd)(?: licen[sc]e)?"),
    (1, "bsd-3-clause", "3 clause", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:bsd 3 clause|3 clause bsd)(?: licen[sc]e)?"),
    (1, "bsd", "bsd", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:an? |the )?(?:terms of the )?bsd(?: style| like)?(?: licen[sc]e)?"),
    (1, "isc", "isc", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?isc(?: licen[sc]e)?"),
    (1, "mpl-2.0", "mozilla", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?mozilla public licen[sc]e (?:v2|(?:version |v )?2(?: 0)?)"),
    (1, "mpl", "mpl", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?mpl(?: v?[12](?: [01])?)?"),
    (1, "epl", "eclipse", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?eclipse public licen[sc]e"),
    (1, "cc0", "cc0", "(?:licen[sc]ed|released|dedicated|available)(?: to you)? under (?:the )?(?:creative commons )?cc0(?: 1 0)?"),
    (1, "cc-by-nc-sa", "cc by", "(?:licen[sc]ed|released|distributed|available|published)(?: to you)? under (?:a |the )?(?:creative commons )?cc by nc sa(?: [1234] 0)?"),
    (1, "cc-by-nc-nd", "cc by", "(?:licen[sc]ed|released|distributed|available|published)(?: to you)? under (?:a |the )?(?:creative commons )?cc by nc nd(?: [1234] 0)?"),
    (1, "cc-by-nc", "cc by", "(?:licen[sc]ed|released|distributed|available|published)(?: to you)? under (?:a |the )?(?:creative commons )?cc by nc(?: [1234] 0)?"),
    (1, "cc-by-sa", "cc by", "(?:licen[sc]ed|released|distributed|available|published)(?: to you)? under (?:a |the )?(?:creative commons )?cc by sa(?: [1234] 0)?"),
    (1, "cc-by-nd", "cc by", "(?:licen[sc]ed|released|distributed|available|published)(?: to you)? under (?:a |the )?(?:creative commons )?cc by nd(?: [1234] 0)?"),
    (1, "cc-by", "cc by", "(?:licen[sc]ed|released|distributed|available|published)(?: to you)? under (?:a |the )?(?:creative commons )?cc by(?: [1234] 0)?"),
    (1, "cc-by-sa", "attribution share", "(?:licen[sc]ed|released|available|published)(?: to you)? under (?:a |the )?(?:terms of the )?creative commons attribution share ?alike(?: [1234] 0)?(?: international)?(?: licen[sc]e)?"),
    (1, "cc-by", "commons attribution", "(?:licen[sc]ed|released|available|published)(?: to you)? under (?:a |the )?(?:terms of the )?creative commons attribution(?: [1234] 0)?(?: international)?(?: licen[sc]e)?"),
    (1, "unlicense", "unlicense", "(?:licen[sc]ed|released|dedicated|available)(?: to you)? under the unlicense"),
    (1, "wtfpl", "wtfpl", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?wtfpl"),
    (1, "zlib", "zlib", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?zlib(?: libpng)?(?: licen[sc]e)?"),
    (1, "bsl-1.0", "boost", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?boost software licen[sc]e(?: (?:version |v )?1 0)?"),
    (1, "artistic", "artistic", "(?:licen[sc]ed|released|distributed|available)(?: to you)? under (?:the )?(?:terms of the )?(?:perl )?artistic licen[sc]e"),
    (1, "gpl", "same terms as perl", "under the same terms as perl itself"),
    (1, "ofl", "sil open font", "(?:licen[sc]ed|released|available)(?: to you)? under (?:the )?sil open font licen[sc]e(?: (?:version |v )?1 1)?"),
    (1, "odbl", "open database licen", "(?:licen[sc]ed|released|made available|available)(?: to you)? under (?:the )?open database licen[sc]e"),
    (1, "eupl", "under the eupl", "licen[sc]ed under the eupl(?: version)?(?: 1 [12])?"),
    (1, "proprietary", "proprietary", "(?:licen[sc]ed|provided|distributed) under (?:a |the )?proprietary licen[sc]e"),
    # addresses
    (1, "mit", "opensource org licenses mit", "opensource org licenses mit(?: license)?(?: php| html)?"),
    (1, "isc", "opensource org licenses isc", "opensource org licenses isc"),
    (1, "bsd-2-clause", "opensource org licenses bsd 2", "opensource org licenses bsd 2 clause"),
    (1, "bsd-3-clause", "opensource org licenses bsd 3", "opensource org licenses bsd 3 clause"),
    (1, "bsd", "opensource org licenses bsd", "opensource org licenses bsd license(?: php)?"),
    (1, "apache-2.0", "apache org licenses", "apache org licenses (?:license 2 0|apache 2 0)(?: txt| html)?"),
    (1, "apache-2.0", "opensource org licenses apache", "opensource org licenses apache 2 0"),
    (1, "apache", "apache org licenses", "apache org licenses"),
    (1, "gpl-2.0", "gnu org licenses", "gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?"),
    (1, "gpl-3.0", "gnu org licenses", "gnu org licenses gpl 3 0(?: txt| html)?"),
    (1, "lgpl-2.1", "gnu org licenses", "gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html)?"),
    (1, "lgpl-3.0", "gnu org licenses", "gnu org licenses lgpl 3 0(?: txt| html)?"),
    (1, "agpl-3.0", "gnu org licenses", "gnu org licenses agpl 3 0(?: txt| html)?"),
    (1, "lgpl", "gnu org licenses", "gnu org licenses lgpl(?: html)?"),
    (1, "agpl", "gnu org licenses", "gnu org licenses agpl(?: html)?"),
    (1, "gpl", "gnu org", "gnu org (?:licenses|copyleft)(?: gpl)?(?: html)?"),
    (1, "mpl-2.0", "mozilla org", "mozilla org (?:en us )?mpl 2 0"),
    (1, "mpl-1.1", "mozilla org", "mozilla org mpl (?:mpl )?1 1(?: html)?"),
    (1, "mpl", "mozilla org mpl", "mozilla org mpl"),
    (1, "epl-2.0", "eclipse org", "eclipse org legal epl (?:2 0|v20)(?: html)?"),
    (1, "epl-1.0", "eclipse org", "eclipse org legal epl (?:v10|1 0)(?: html)?"),
    (1, "cc0", "creativecommons org publicdomain", "creativecommons org publicdomain zero 1 0"),
    (1, "public-domain", "creativecommons org publicdomain", "creativecommons org publicdomain mark 1 0"),
    (1, "cc-by-nc-sa", "creativecommons org licenses by nc", "creativecommons org licenses by nc sa [1234] [05]"),
    (1, "cc-by-nc-nd", "creativecommons org licenses by nc", "creativecommons org licenses by nc nd [1234] [05]"),
    (1, "cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc [1234] [05]"),
    (1, "cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa [1234] [05]"),
    (1, "cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd [1234] [05]"),
    (1, "cc-by", "creativecommons org licenses by", "creativecommons org licenses by [1234] [05]"),
    (1, "unlicense", "unlicense org", "unlicense org"),
    (1, "wtfpl", "wtfpl net", "wtfpl net"),
    (1, "bsl-1.0", "boost org", "boost org license 1 0 txt"),
    (1, "ofl", "scripts sil org", "scripts sil org ofl"),
    (1, "odbl", "opendatacommons org", "opendatacommons org licenses odbl(?: 1 0)?"),
    (1, "odc-by", "opendatacommons org", "opendatacommons org licenses by(?: 1 0)?"),
    # notices and headings
    (2, "mit", "license mit", "license mit(?: license)?"),
    (2, "apache-2.0", "license apache", "license apache (?:license )?(?:version |v )?2(?: 0)?"),
    (2, "apache", "license apache", "license apache"),
    (2, "gpl-2.0", "license gpl", "license (?:gplv2|gpl v?2(?: 0)?)(?: only| or later)?"),
    (2, "gpl-3.0", "license gpl", "license (?:gplv3|gpl v?3(?: 0)?)(?: only| or later)?"),
    (2, "gpl", "license gpl", "license gpl"),
    (2, "lgpl", "license lgpl", "license (?:lgplv[23]|lgpl(?: v?[23](?: [01])?)?)"),
    (2, "agpl", "license agpl", "license (?:agplv3|agpl(?: v?3(?: 0)?)?)"),
    (2, "bsd-2-clause", "license bsd", "license bsd 2 clause"),
    (2, "bsd-3-clause", "license bsd", "license bsd 3 clause"),
    (2, "bsd", "license bsd", "license bsd"),
    (2, "isc", "license isc", "license isc"),
    (2, "mpl-2.0", "license mpl", "license mpl v?2(?: 0)?"),
    (2, "cc0", "license cc0", "license cc0(?: 1 0)?"),
    (2, "cc-by-sa", "license cc by sa", "license cc by sa(?: [1234] 0)?"),
    (2, "cc-by", "license cc by", "license cc by(?: [1234] 0)?"),
    (2, "gpl", "copying permission", "gnu gpl see copying permission"),
    (2, "gpl", "dual licensed under", "dual licensed under (?:the )?gpl and (?:a )?commercial license"),
    (2, "mit", "dual licensed under", "dual licensed under (?:the )?mit and (?:the )?(?:apache|gpl|bsd)(?: 2 0)?(?: licenses?)?"),
    (2, "mit", "mit and gpl licenses", "mit and gpl licenses"),
    # names
    (3, "agpl-3.0", "affero", "(?:gnu )?affero general public license (?:v3|(?:version|v) 3(?: 0)?)"),
    (3, "agpl", "affero", "(?:gnu )?affero general public license"),
    (3, "agpl", "affero gpl", "affero gpl(?: v?3)?"),
    (3, "agpl-3.0", "agpl 3", "agpl 3(?: 0)?(?: only| or later)?"),
    (3, "lgpl-2.1", "lesser", "(?:gnu )?lesser general public license (?:v2 1|(?:version|v) 2 1)"),
    (3, "lgpl-3.0", "lesser", "(?:gnu )?lesser general public license (?:v3|(?:version|v) 3(?: 0)?)"),
    (3, "lgpl", "lesser", "(?:gnu )?lesser general public license"),
    (3, "lgpl-2.0", "library general", "(?:gnu )?library general public license(?: (?:version|v) 2(?: 0)?)?"),
    (3, "lgpl", "lgpl", "(?:gnu )?lgpl v?[23](?: [01])?(?: only| or later)?"),
    (3, "lgpl", "gnu lgpl", "gnu lgpl"),
    (3, "gpl-3.0", "general public license", "(?:gnu )?general public license (?:v3|(?:version|v) 3(?: 0)?)(?: or later| or any later version)?"),
    (3, "gpl-2.0", "general public license", "(?:gnu )?general public license (?:v2|(?:version|v) 2(?: 0)?)(?: or later| or any later version)?"),
    (3, "gpl", "general public license", "gnu general public license"),
    (3, "gpl-3.0", "gpl", "(?:gnu )?gpl v?3(?: 0)?(?: only| or later)?"),
    (3, "gpl-2.0", "gpl", "(?:gnu )?gpl v?2(?: 0)?(?: only| or later)?"),
    (3, "gpl", "gnu gpl", "gnu gpl"),
    (3, "apache-2.0", "apache", "apache license (?:v2|(?:version |v )?2(?: 0)?)"),
    (3, "apache-2.0", "apache", "apache (?:v2|(?:version |v )?2(?: 0)?)(?: licen[sc]e)?"),
    (3, "apache-1.1", "apache", "apache (?:software )?license (?:(?:version|v) )?1 1"),
    (3, "apache", "apache", "apache (?:software|public) licen[sc]e"),
    (3, "mit", "mit", "mit x11 licen[sc]e"),
    (3, "mit", "mit", "mit licen[cs]ed"),
    (3, "mit", "expat", "expat licen[sc]e"),
    (3, "mit", "x11", "x11 licen[sc]e"),
    (3, "bsd-2-clause", "clause bsd", "(?:2|two) clause bsd(?: licen[sc]e)?"),
    (3, "bsd-2-clause", "bsd 2 clause", "bsd 2 clause(?: licen[sc]e)?"),
    (3, "bsd-2-clause", "simplified bsd", "simplified bsd licen[sc]e"),
    (3, "bsd-2-clause", "freebsd", "freebsd licen[sc]e"),
    (3, "bsd-3-clause", "clause bsd", "(?:3|three) clause bsd(?: licen[sc]e)?"),
    (3, "bsd-3-clause", "bsd 3 clause", "bsd 3 clause(?: licen[sc]e)?"),
    (3, "bsd-3-clause", "bsd licen", "(?:new|modified|revised) bsd licen[sc]e"),
    (3, "bsd-4-clause", "clause bsd", "(?:4|four) clause bsd(?: licen[sc]e)?"),
    (3, "bsd-4-clause", "bsd 4 clause", "bsd 4 clause(?: licen[sc]e)?"),
    (3, "bsd-4-clause", "bsd licen", "(?:original|old) bsd licen[sc]e"),
    (3, "bsd-zero", "clause bsd", "zero clause bsd(?: licen[sc]e)?"),
    (3, "bsd-zero", "bsd zero", "bsd zero clause(?: licen[sc]e)?"),
    (3, "bsd-zero", "0bsd", "0bsd(?: licen[sc]e)?"),
    (3, "bsd", "bsd", "bsd (?:style |like )?licen[sc]e"),
    (3, "bsd", "berkeley", "berkeley software distribution (?:style )?licen[sc]e"),
    (3, "isc", "isc", "isc licen[sc]e"),
    (3, "isc", "internet s", "internet (?:systems|software) consortium licen[sc]e"),
    (3, "mpl-2.0", "mozilla", "mozilla public licen[sc]e (?:v2|(?:version |v )?2(?: 0)?)"),
    (3, "mpl-1.1", "mozilla", "mozilla public licen[sc]e (?:(?:version|v) )?1 1"),
    (3, "mpl", "mozilla", "mozilla public licen[sc]e"),
    (3, "mpl", "mpl", "mpl v?[12](?: [01])?"),
    (3, "epl-2.0", "eclipse", "eclipse public licen[sc]e (?:v2|(?:version |v )?2(?: 0)?)"),
    (3, "epl-1.0", "eclipse", "eclipse public licen[sc]e (?:v1|(?:version |v )?1(?: 0)?)"),
    (3, "epl", "eclipse", "eclipse public licen[sc]e"),
    (3, "eupl", "european union public", "european union public licen[cs]e(?: (?:version|v) 1 [12])?"),
    (3, "cddl", "common development", "common development and distribution licen[sc]e(?: (?:version|v) 1 [01])?"),
    (3, "cpl", "common public", "common public licen[sc]e(?: (?:version|v) 1 0)?"),
    (3, "cecill", "cecill", "cecill (?:b |c )?(?:free software )?licen[sc]e"),
    (3, "cc0", "cc0", "cc0 (?:1 0(?: universal)?|universal)(?: public domain dedication)?"),
    (3, "cc0", "public domain dedication", "creative commons (?:zero )?public domain dedication"),
    (3, "cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1234] 0)?"),
    (3, "cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1234] 0)?"),
    (3, "cc-by-nc", "cc by nc", "cc by nc(?: [1234] 0)?"),
    (3, "cc-by-sa", "cc by sa", "cc by sa(?: [1234] 0)?"),
    (3, "cc-by-nd", "cc by nd", "cc by nd(?: [1234] 0)?"),
    (3, "cc-by", "cc by", "cc by(?: [1234] 0)?"),
    (3, "cc-by-nc-sa", "commons attribution non", "creative commons attribution non ?commercial share ?alike(?: [1234] 0)?"),
    (3, "cc-by-nc-nd", "commons attribution non", "creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1234] 0)?"),
    (3, "cc-by-nc", "commons attribution non", "creative commons attribution non ?commercial(?: [1234] 0)?"),
    (3, "cc-by-sa", "commons attribution share", "creative commons attribution share ?alike(?: [1234] 0)?"),
    (3, "cc-by-nd", "commons attribution no", "creative commons attribution no ?deriv(?:s|atives)(?: [1234] 0)?"),
    (3, "cc-by", "commons attribution", "creative commons attribution(?: [1234] 0)?"),
    (3, "cc", "creative commons", "creative commons(?: licen[cs]e)?"),
    (3, "unlicense", "the unlicense", "the unlicense"),
    (3, "wtfpl", "wtfpl", "wtfpl (?:version|v) 2"),
    (3, "zlib", "zlib", "zlib(?: libpng)? licen[sc]e"),
    (3, "bsl-1.0", "boost", "boost software licen[sc]e(?: (?:version |v )?1 0)?"),
    (3, "busl-1.1", "business source", "business source licen[sc]e(?: 1 1)?"),
    (3, "sspl-1.0", "server side public", "server side public licen[sc]e(?: (?:version|v) 1)?"),
    (3, "elastic-2.0", "elastic licen", "elastic licen[sc]e(?: 2 0)?"),
    (3, "artistic-2.0", "artistic", "artistic licen[sc]e (?:(?:version|v) )?2 0"),
    (3, "artistic", "artistic", "artistic licen[sc]e"),
    (3, "python", "python software foundation", "python software foundation licen[sc]e(?: (?:version|v) 2)?"),
    (3, "postgresql", "postgresql", "postgresql licen[sc]e"),
    (3, "openssl", "openssl", "openssl licen[sc]e"),
    (3, "php", "php licen", "php licen[sc]e(?: (?:version |v )?3 0[01]?)?"),
    (3, "ruby", "ruby", "ruby (?:s )?licen[sc]e"),
    (3, "ofl", "open font", "(?:sil )?open font licen[sc]e(?: (?:version|v) 1 1)?"),
    (3, "odbl", "open database", "open database licen[sc]e"),
    (3, "gfdl", "free documentation", "(?:gnu )?free documentation licen[sc]e(?: (?:version |v )?1 [123])?"),
    (3, "ms-pl", "microsoft public", "microsoft public licen[sc]e"),
    (3, "ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e"),
    (3, "openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m| m1)?(?: licen[sc]e)?"),
    (3, "public-domain", "public domain", "(?:released |placed |dedicated )?(?:in|into|to) the public domain"),
    (3, "proprietary", "all rights reserved", "all rights reserved"),
    (3, "proprietary", "proprietary", "proprietary and confidential"),
    (3, "proprietary", "proprietary", "proprietary licen[sc]e"),
    (3, "proprietary", "end user", "end user licen[sc]e agreement"),
]

#: The base phrases, with their labels; rules of the last tier that a query counts whether suppressed or not.
BASE: list[tuple[str, str]] = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


@dataclass(frozen=True)
class Rule:
    rank: int  # place in the order of priority
    tier: int
    label: str
    gate: str
    keyword: str
    pattern: str  # matches whole words of " word word ... word "; neither the blank before nor the one after is in it
    confidence: float
    base: bool = False


def needed(pattern: str) -> str:
    """What of a pattern stands in all of its matches, with a mark where something else may."""
    while (less := re.sub(r"\(\?:[^()]*\)\??", "\0", pattern)) != pattern:
        pattern = less
    return f" {re.sub(r'.\?|\[[^]]*\]\??', chr(0), pattern)} "


def gate_of(pattern: str, keyword: str) -> str:
    return next((g for g in GATES if g in needed(pattern)), f" {keyword}")


def rules() -> list[Rule]:
    last = len(CONFIDENCE) - 1
    every = [(t, label, keyword, pattern, False) for t, label, keyword, pattern in SIGNATURES] + [(last, label, phrase, phrase, True) for label, phrase in BASE]
    every.sort(key=lambda r: r[0])  # stable: within a tier as written
    return [Rule(k, t, label, gate_of(pattern, keyword), f" {keyword}", f"(?<= )(?:{pattern})(?= )", CONFIDENCE[t], base) for k, (t, label, keyword, pattern, base) in enumerate(every)]
