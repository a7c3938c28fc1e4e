"""Licence scans by ordered signature rules.

Text is folded to words (A-Z lowered, everything else than digits, letters and non-ASCII characters dropped). A cheap
keyword gate leaves few documents; in those, every rule whose own keyword occurs is matched as a regular expression. Each
match is an interval with a label and a priority; one that lies inside an interval of the same or a higher priority is
suppressed, so that the longest, best signature of a place names the licence.

The rules: every licence name of LICENCES in every wording of WORDINGS, and the signatures of TEXTS, which know a licence
by its own text, notice, disclaimer or address where its name is missing; all written for folded text. Base phrases are places of
their own and always count. Defined cases: a null text is empty; a document without a match has no labels, null places
and score 0; equal intervals leave the higher priority, then the earlier rule; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that count by definition, and their labels
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Label, gate keyword, name as a pattern over folded words (a blank stands between words)
LICENCES = [
    ("gpl-2.0", "gnu", r"gnu general public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu general public licen[cs]e (?:version |v )?3(?: 0)?"),
    ("gpl", "gnu", r"gnu (?:general public licen[cs]e|gpl)"),
    ("gpl", "gpl", r"gpl(?:v| v| version )?[123]?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[cs]e (?:version |v )?2 1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[cs]e (?:version |v )?3(?: 0)?"),
    ("lgpl", "lgpl", r"lgpl(?:v| v| version )?[23]?(?: [01])?"),
    ("agpl-3.0", "affero", r"gnu affero general public licen[cs]e(?: (?:version |v )?3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"agpl(?:v| v| version )?3?(?: 0)?"),
    ("fdl", "documentation", r"gnu free documentation licen[cs]e(?: (?:version |v )?1 [123])?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?"),
    ("apache", "apache", r"apache (?:software |public )?licen[cs]e"),
    ("mit", "mit", r"mit (?:expat |x11 )?licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("bsd-2-clause", "bsd", r"bsd (?:2|two) clause(?: licen[cs]e)?|(?:2|two) clause bsd(?: licen[cs]e)?|simplified bsd licen[cs]e"),
    ("bsd-3-clause", "bsd", r"bsd (?:3|three) clause(?: licen[cs]e)?|(?:3|three) clause bsd(?: licen[cs]e)?|new bsd licen[cs]e|revised bsd licen[cs]e"),
    ("bsd-4-clause", "bsd", r"bsd (?:4|four) clause(?: licen[cs]e)?|original bsd licen[cs]e"),
    ("0bsd", "bsd", r"0bsd|zero clause bsd(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v )?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("mpl", "mpl", r"mpl (?:version |v )?[12](?: [01])?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e(?: (?:version |v )?[12](?: 0)?)?"),
    ("cddl", "cddl", r"cddl(?: (?:version |v )?1 [01])?|common development and distribution licen[cs]e"),
    ("cpl", "common", r"common public licen[cs]e(?: (?:version |v )?1 0)?"),
    ("eupl", "european", r"european union public licen[cs]e(?: (?:version |v )?1 [012])?"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e(?: (?:version |v )?[12](?: 0)?)?"),
    ("boost", "boost", r"boost software licen[cs]e(?: (?:version |v )?1 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("php", "php", r"php licen[cs]e(?: (?:version |v )?3(?: 01?)?)?"),
    ("python", "python", r"python (?:software foundation )?licen[cs]e(?: (?:version |v )?2)?"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e(?: (?:version |v )?1 1)?"),
    ("odbl", "open database", r"open database licen[cs]e"),
    ("odc-by", "open data", r"open data commons attribution licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("sspl", "server side", r"server side public licen[cs]e(?: (?:version |v )?1)?"),
    ("busl", "business source", r"business source licen[cs]e(?: (?:version |v )?1 1)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc0", "creative commons", r"creative commons (?:zero|cc0)(?: 1 0)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1234] [05])?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1234] [05])?"),
    ("cc-by-4.0", "cc by", r"cc by 4 0"),
    ("cc-by", "cc by", r"cc by(?: [123] [05])?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1234] [05])?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1234] [05])?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1234] [05])?"),
    ("public-domain", "public domain", r"public domain(?: dedication)?"),
    ("all-rights-reserved", "all rights", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|software|licen[cs]e)"),
]
# Priority and wording around a licence's name
WORDINGS = [
    (4, r"(?:this|the) (?:work|software|program|library|file|project|content|document|text|code) (?:is|may be) (?:licen[cs]ed|distributed|released|available|provided|published) under (?:the )?(?:terms of )?(?:the |a )?{}"),
    (3, r"(?:licen[cs]ed|distributed|released|available|provided|published) under (?:the )?(?:terms of )?(?:the |a )?{}"),
    (2, r"(?:subject to|terms of|conditions of|covered by|governed by) (?:the )?{}"),
    (2, r"(?:spdx )?licen[cs]e(?: identifier)?(?: is)? {}"),
    (1, r"{}"),
]
# Label, keyword, priority and pattern of a licence's own text (4 a grant or notice that tells the licence, 3 an
# address or a typical clause, 2 a clause or disclaimer that its family shares)
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 4, r"permission is hereby granted free of charge to any person obtaining a copy of this (?:software|work|program)(?: and associated documentation files)?(?: the \W?(?:software|work)\W?)?"),
    ("mit", "to deal in the", 3, r"to deal in the (?:software|work|materials) without restriction(?: including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies)?"),
    ("mit", "the above copyright notice and this permission notice", 3, r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the (?:software|work)"),
    ("mit", "software is provided", 2, r"the software is provided \W?as is\W? without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement"),
    ("mit", "in no event shall the authors or copyright holders", 2, r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", "sell copies of the software and to permit persons", 3, r"sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit", "opensource org licenses mit", 3, r"(?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: (?:php|html))?"),
    ("mit", "mit license org", 3, r"(?:https? )?(?:www )?mit license org"),
    ("x11", "except as contained in this notice the name", 4, r"except as contained in this notice the names? of (?:[^ ]+ ){1,12}?shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("bsd", "redistribution and use in source and binary forms", 4, r"redistribution and use in source and binary forms(?: of (?:the|this) software)? with or without modification(?:s)? are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions of source code must retain", 2, r"redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce", 2, r"redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions and the following disclaimer in the documentation and or other materials"),
    ("bsd-3-clause", "may be used to endorse or promote products", 3, r"neither the names? of (?:[^ ]+ ){1,16}?may be used to endorse or promote products derived from this software without(?: specific)? prior written permission"),
    ("bsd-3-clause", "may not be used to endorse or promote products", 3, r"the names? of (?:[^ ]+ ){1,12}?may not be used to endorse or promote products derived from this software without(?: specific)? prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use", 4, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "any express or implied warranties", 2, r"this software is provided by (?:[^ ]+ ){1,10}?\W?as is\W? and any express or implied warranties including but not limited to the implied warranties"),
    ("bsd", "in no event shall the copyright", 2, r"in no event shall the copyright (?:holder|owner|holders)(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause", 3, r"(?:https? )?(?:www )?opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause", 3, r"(?:https? )?(?:www )?opensource org licenses bsd 3 clause"),
    ("bsd", "opensource org licenses bsd license", 3, r"(?:https? )?(?:www )?opensource org licenses bsd license(?: php)?"),
    ("isc", "permission to use copy modify and or distribute this software", 4, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and distribute this software for any purpose", 4, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims all warranties with regard to this software", 3, r"the software is provided \W?as is\W? and (?:[^ ]+ ){1,6}?disclaims all warranties with regard to this software"),
    ("isc", "opensource org licenses isc", 3, r"(?:https? )?(?:www )?opensource org licenses isc(?: license)?(?: txt)?"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation", 4, r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)?(?: with or)?(?: without fee)? is hereby granted"),
    ("hpnd", "permission to use copy modify distribute and sell this software", 4, r"permission to use copy modify distribute and sell this software and its documentation for any purpose"),
    ("postgresql", "without fee and without a written agreement", 4, r"for any purpose without fee and without a written agreement is hereby granted"),
    ("apache-2.0", "you may obtain a copy of the license at", 4, r"you may not use this file except in compliance with the license you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing", 4, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an \W?as is\W? basis"),
    ("apache-2.0", "hereby grants to you a perpetual worldwide", 3, r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except as stated in this section )?(?:copyright|patent) license"),
    ("apache-2.0", "terms and conditions for use reproduction and distribution", 3, r"terms and conditions for use reproduction and distribution"),
    ("apache-2.0", "licenses this file to you under", 4, r"licenses this file to you under the apache license version 2 0"),
    ("apache-2.0", "apache org licenses license 2 0", 3, r"(?:https? )?(?:www )?apache org licenses license 2 0(?: (?:txt|html))?"),
    ("apache-2.0", "opensource org licenses apache 2 0", 3, r"(?:https? )?(?:www )?opensource org licenses apache 2 0"),
    ("apache-1.1", "this product includes software developed by the apache", 3, r"this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl-2.0", "either version 2 of the license", 4, r"under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "either version 3 of the license", 4, r"under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "under the terms of version 2 of the gnu general", 4, r"under the terms of version 2 of the gnu general public license"),
    ("gpl-3.0", "under the terms of version 3 of the gnu general", 4, r"under the terms of version 3 of the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published", 4, r"under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "free software you can redistribute it and or modify it", 4, r"free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "gnu general public license terms and conditions for copying", 3, r"gnu general public license terms and conditions for copying distribution and modification"),
    ("gpl", "the gnu general public license is intended to guarantee", 3, r"the gnu general public license is intended to guarantee your freedom to share and change"),
    ("gpl-3.0", "the gnu general public license is a free copyleft", 4, r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "gnu org licenses gpl", 3, r"(?:https? )?(?:www )?gnu org licenses gpl(?: (?:html|txt))?"),
    ("gpl-2.0", "gnu org licenses old licenses gpl 2 0", 3, r"(?:https? )?(?:www )?gnu org licenses old licenses gpl 2 0(?: (?:en )?(?:html|txt))?"),
    ("gpl-2.0", "gnu org licenses gpl 2 0", 3, r"(?:https? )?(?:www )?gnu org licenses gpl 2 0(?: (?:html|txt))?"),
    ("gpl-3.0", "gnu org licenses gpl 3 0", 3, r"(?:https? )?(?:www )?gnu org licenses gpl 3 0(?: (?:en )?(?:html|txt))?"),
    ("lgpl", "gnu org licenses lgpl", 3, r"(?:https? )?(?:www )?gnu org licenses lgpl(?: (?:html|txt))?"),
    ("lgpl-2.1", "gnu org licenses old licenses lgpl 2 1", 3, r"(?:https? )?(?:www )?gnu org licenses old licenses lgpl 2 1(?: (?:en )?(?:html|txt))?"),
    ("lgpl-3.0", "gnu org licenses lgpl 3 0", 3, r"(?:https? )?(?:www )?gnu org licenses lgpl 3 0(?: (?:en )?(?:html|txt))?"),
    ("lgpl-2.1", "either version 2 1 of the license", 4, r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0", "lesser general public license as published", 4, r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.0", "gnu library general public license", 3, r"gnu library general public license(?: as published by the free software foundation)?"),
    ("lgpl-3.0", "incorporates the terms and conditions of version 3 of the gnu general", 4, r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3.0", "affero general public license as published", 4, r"under the terms of the gnu affero general public license as published by the free software foundation(?: either version 3 of the license or at your option any later version)?"),
    ("agpl-3.0", "all users interacting with it remotely through a computer network", 4, r"all users interacting with it remotely through a computer network"),
    ("agpl-3.0", "gnu org licenses agpl", 3, r"(?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: (?:en )?(?:html|txt))?"),
    ("fdl", "permission is granted to copy distribute and or modify this document", 4, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("fdl", "no invariant sections", 3, r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    ("fdl", "gnu org licenses fdl", 3, r"(?:https? )?(?:www )?gnu org licenses fdl(?: 1 [123])?(?: (?:html|txt))?"),
    ("mpl-2.0", "this source code form is subject to the terms", 4, r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license", 4, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file", 4, r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "mozilla org mpl 2 0", 3, r"(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla org mpl mpl 1 1", 3, r"(?:https? )?(?:www )?mozilla org mpl mpl 1 1(?: html)?"),
    ("epl", "this program and the accompanying materials are made available", 4, r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: (?:v|version )?[12] ?0)?"),
    ("epl", "eclipse org legal epl", 3, r"(?:https? )?(?:www )?eclipse org legal epl(?: (?:v10|v20|2 0))?(?: html)?"),
    ("cddl", "opensource org licenses cddl", 3, r"(?:https? )?(?:www )?opensource org licenses cddl(?: ?1(?: 0)?)?"),
    ("cpl", "opensource org licenses cpl", 3, r"(?:https? )?(?:www )?opensource org licenses cpl ?1 0"),
    ("eupl", "licensed under the eupl", 4, r"licensed under the eupl(?: (?:version |v )?1 [012])?"),
    ("artistic", "the intent of this document is to state the conditions under which", 4, r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", "opensource org licenses artistic", 3, r"(?:https? )?(?:www )?opensource org licenses artistic license(?: [12] 0)?"),
    ("artistic", "under the same terms as perl itself", 4, r"(?:redistribute it and or modify it )?under the same terms as perl itself"),
    ("boost", "obtaining a copy of the software and accompanying documentation", 4, r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", "boost org license 1 0", 3, r"(?:https? )?(?:www )?boost org license 1 0(?: txt)?"),
    ("zlib", "without any express or implied warranty", 3, r"this software is provided \W?as is\W? without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "the origin of this software must not be misrepresented", 4, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked", 3, r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", "permission is granted to anyone to use this software for any purpose", 4, r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("openssl", "developed by the openssl project", 4, r"this product includes software developed by the openssl project"),
    ("openssl", "cryptographic software written by eric young", 3, r"this product includes cryptographic software written by eric young"),
    ("php", "this product includes php software", 4, r"this product includes php software(?: freely available from)?"),
    ("php", "php net license", 3, r"(?:https? )?(?:www )?php net license(?: 3 0(?:1)?)?(?: txt)?"),
    ("python", "psf hereby grants licensee", 4, r"psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", 4, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute", 4, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "unlicense org", 3, r"(?:https? )?(?:www )?unlicense org"),
    ("wtfpl", "do what the fuck you want to", 4, r"(?:you just )?do what the fuck you want to(?: public license)?"),
    ("wtfpl", "wtfpl net", 3, r"(?:https? )?(?:www )?wtfpl net"),
    ("ofl", "obtaining a copy of the font software", 4, r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ofl", "scripts sil org ofl", 3, r"(?:https? )?(?:www )?scripts sil org ofl"),
    ("ofl", "openfontlicense org", 3, r"(?:https? )?(?:www )?openfontlicense org"),
    ("odbl", "opendatacommons org licenses odbl", 3, r"(?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", "opendatacommons org licenses by", 3, r"(?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0)?"),
    ("pddl", "opendatacommons org licenses pddl", 3, r"(?:https? )?(?:www )?opendatacommons org licenses pddl(?: 1 0)?"),
    ("ms-pl", "opensource org licenses ms pl", 3, r"(?:https? )?(?:www )?opensource org licenses ms pl"),
    ("sspl", "if you make the functionality of the program", 3, r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works", 4, r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("cc0", "creativecommons org publicdomain zero", 3, r"(?:https? )?(?:www )?creativecommons org publicdomain zero 1 0"),
    ("cc0", "waived all copyright and related", 4, r"waived all copyright and related or neighbou?ring rights"),
    ("public-domain", "creativecommons org publicdomain mark", 3, r"(?:https? )?(?:www )?creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons org licenses by", 3, r"(?:https? )?(?:www )?creativecommons org licenses by(?: [123] [05])?"),
    ("cc-by-4.0", "creativecommons org licenses by 4 0", 3, r"(?:https? )?(?:www )?creativecommons org licenses by 4 0"),
    ("cc-by-sa", "creativecommons org licenses by sa", 3, r"(?:https? )?(?:www )?creativecommons org licenses by sa(?: [1234] [05])?"),
    ("cc-by-nd", "creativecommons org licenses by nd", 3, r"(?:https? )?(?:www )?creativecommons org licenses by nd(?: [1234] [05])?"),
    ("cc-by-nc", "creativecommons org licenses by nc", 3, r"(?:https? )?(?:www )?creativecommons org licenses by nc(?: [1234] [05])?"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", 3, r"(?:https? )?(?:www )?creativecommons org licenses by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", 3, r"(?:https? )?(?:www )?creativecommons org licenses by nc nd(?: [1234] [05])?"),
    ("beerware", "as long as you retain this notice you can do whatever you want", 4, r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("proprietary", "unauthori", 3, r"unauthori[sz]ed (?:copying|reproduction|use)(?: or distribution)? of this (?:file|software|document|material)(?: via any medium)? is strictly prohibited"),
    ("all-rights-reserved", "no part of this", 3, r"no part of this (?:publication|book|document|work|site) may be reproduced"),
]
SCORE = {4: 1.0, 3: 0.95, 2: 0.85, 1: 0.7}
BASE_PRIORITY = 1
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = max(SCORE)
PLACES = "array<struct<start:int,minus_stop:int,minus_priority:int,rule:int,label:string>>"
GATES = sorted({x[1] for x in [*LICENCES, *TEXTS]})


def rules() -> list[tuple[int, str, str, int, str]]:
    """(order, label, keyword, priority, pattern) of every rule: licences in order, each in every wording, then texts."""
    out = []
    for label, gate, name in LICENCES:
        for priority, wording in WORDINGS:
            out.append((len(out), label, f" {gate}", priority, " " + wording.format(f"(?:{name})") + "(?= )"))
    for label, gate, priority, text in TEXTS:
        out.append((len(out), label, f" {gate}", priority, f" (?:{text})(?= )"))
    return out


def _count(s: Column, char: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))


def _matches(s: str, rule: Column) -> Column:
    """Places of a rule's pattern as (start, -stop, -priority, rule, label): the text between matches and the matches
    themselves, laid end to end, give the places."""
    pieces = F.arrays_zip(F.split(F.col(s), rule["pattern"], -1).alias("gap"), F.regexp_extract_all(F.col(s), rule["pattern"], F.lit(0)).alias("hit"))
    place = lambda at, x: F.struct(
        at.alias("start"),
        (-(at + F.length(x["hit"]))).alias("minus_stop"),
        (-rule["priority"]).alias("minus_priority"),
        rule["id"].alias("rule"),
        rule["label"].alias("label"),
    )
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
        F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(place(acc["at"] + F.length(x["gap"]), x)))).alias("out"),
    )
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("out")), step, lambda acc: acc["out"])


def _unsuppressed(places: Column) -> Column:
    """Sorted places without those inside a place of the same or a higher priority. Containers sort before what they
    contain, so it is enough to know how far each priority has reached."""
    inside = lambda acc, x: F.exists(F.sequence(-x["minus_priority"], F.lit(TOP)), lambda p: F.get(acc["reach"], p) >= -x["minus_stop"])
    grown = lambda acc, x: F.transform(acc["reach"], lambda r, p: F.when(p == -x["minus_priority"], F.greatest(r, -x["minus_stop"])).otherwise(r))
    step = lambda acc, x: F.when(inside(acc, x), acc).otherwise(F.struct(grown(acc, x).alias("reach"), F.concat(acc["out"], F.array(x)).alias("out")))
    start = F.struct(F.array(*[F.lit(0)] * (TOP + 1)).alias("reach"), F.array().cast(PLACES).alias("out"))
    return F.aggregate(places, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_words, n_base, first_word, last_word, base_labels, labels, score, and found: label,
    priority, start and stop (characters of the folded text) of every detection that was not suppressed."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), NOT_WORD, " "))
    at = docs.select(*keep, words.alias("_t"))
    n_words = F.when(F.col("_t") == "", 0).otherwise(_count(F.col("_t"), " ") + 1).cast("long")
    gate = F.lit(False)
    for word in sorted({g.split(" ")[0] for g in GATES} | {p.split(" ")[0] for p in BASE}):
        gate = gate | F.contains("_t", F.lit(word))
    at = at.select(*keep, n_words.alias("n_words"), F.when(gate, F.concat(F.lit(" "), "_t", F.lit(" "))).alias("_s"))
    by_key: dict[str, list[Column]] = {}  # a keyword is looked for once for all of its rules
    for i, label, key, priority, pattern in rules():
        by_key.setdefault(key, []).append(F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(pattern).alias("pattern")))
    table = F.array(*[F.struct(F.lit(key).alias("key"), F.array(*some).alias("rules")) for key, some in by_key.items()])
    live = F.flatten(F.transform(F.filter(table, lambda k: F.contains("_s", k["key"])), lambda k: k["rules"]))
    hits = F.flatten(F.transform(live, lambda r: _matches("_s", r)))
    at = at.withColumn("_found", F.when(F.col("_s").isNotNull(), _unsuppressed(F.sort_array(hits))).otherwise(F.array().cast(PLACES)))
    # blanks doubled, so that neighbouring places share none; a phrase then splits the text at its places
    doubled = F.coalesce(F.replace("_s", F.lit(" "), F.lit("  ")), F.lit(""))
    at = at.select(*keep, "n_words", "_found", *[F.split(doubled, f" {phrase.replace(' ', '  ')} ", -1).alias(f"_b{i}") for i, phrase in enumerate(BASE)])
    n_base, first, last, named = F.lit(0).cast("long"), [], [], []
    for i, (phrase, label) in enumerate(BASE.items()):
        gaps = F.col(f"_b{i}")
        some = F.size(gaps) > 1
        in_gap = lambda gap: ((_count(gap, " ") - 1) / 2).cast("long")
        n_base = n_base + F.size(gaps) - 1
        first.append(F.when(some, in_gap(F.element_at(gaps, 1))))
        last.append(F.when(some, F.col("n_words") - in_gap(F.element_at(gaps, -1)) - len(phrase.split(" "))))
        named.append(F.when(some, F.lit(label)))
    base = F.array_sort(F.array_compact(F.array(*named)))
    best = F.coalesce(F.array_max(F.transform("_found", lambda x: -x["minus_priority"])), F.lit(0))
    best = F.greatest(best, F.when(n_base > 0, BASE_PRIORITY).otherwise(0))
    score = F.lit(0.0)
    for priority, value in SCORE.items():
        score = F.when(best == priority, value).otherwise(score)
    return at.select(
        *keep,
        "n_words",
        n_base.alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("_found", lambda x: x["label"]))), ",").alias("labels"),
        score.alias("score"),
        F.transform("_found", lambda x: F.struct(x["label"].alias("label"), (-x["minus_priority"]).alias("priority"), x["start"].alias("start"), (-x["minus_stop"]).alias("stop"))).alias("found"),
    )
