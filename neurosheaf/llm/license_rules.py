"""Signature rules for licence notices over normalised words (lower case, one space between).

Fixed values: licence names and notice forms as published by their licensors and the SPDX list.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A regex over ' word word ... ' text, tried only where one of ``keywords`` and, if there are any, one of ``also`` occurs. A lower priority goes first."""

    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str
    weight: float
    also: tuple[str, ...] = ()


#: Base phrases: every place counts, and nothing suppresses their labels.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Licence, keywords of which every name of it has one, and its names in normalised words.
LICENSES = [
    ("mit", " mit | expat ", "mit|expat"),
    ("mit-0", " mit ", "mit 0|mit no attribution"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?1 1"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("0bsd", "bsd", "(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("gpl-1", "general public license|gpl", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?1(?: 0)?"),
    ("gpl-2", "general public license|gpl", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "general public license|gpl", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2", "library general|lgpl", "(?:gnu )?(?:library general public license|lgpl)(?: version| v)? ?2(?: 0)?"),
    ("lgpl-2.1", "lesser general|lgpl", "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?2 1"),
    ("lgpl-3", "lesser general|lgpl", "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "affero|agpl", "(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0)?"),
    ("mpl-1.1", "mozilla| mpl", "(?:mozilla public license|mpl)(?: version| v)? ?1 1"),
    ("mpl-2", "mozilla| mpl", "(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "eclipse| epl", "(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "eclipse| epl", "(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)?"),
    ("cddl-1", "common development|cddl", "(?:common development and distribution license|cddl)(?: version| v)? ?1(?: 0)?"),
    ("eupl-1.2", "european union|eupl", "(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2"),
    ("isc", " isc ", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost-1", "boost", "boost software(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("artistic-2", "artistic", "artistic(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("ofl-1.1", "open font| ofl ", "(?:sil )?(?:open font license|ofl)(?: version| v)? ?1 1"),
    ("wtfpl", "wtfpl|what the fuck", "(?:wtfpl|do what the fuck you want to public license)"),
    ("unlicense", "unlicense", "unlicense"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2", "python software| psf ", "(?:python software foundation|psf)(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("ms-pl", "microsoft public|ms pl", "(?:microsoft public|ms pl)"),
    ("cc0", " cc0 |cc zero|creative commons", "(?:cc0(?: 1 0)?|cc zero|creative commons zero)"),
    ("cc-by", " cc by|creative commons", "(?:cc by|creative commons attribution)(?: [1-4] [05])?"),
    ("cc-by-sa", " cc by|creative commons", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nd", " cc by|creative commons", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] [05])?"),
    ("cc-by-nc", " cc by|creative commons", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", " cc by|creative commons", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nc-nd", " cc by|creative commons", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])?"),
    ("odbl-1", "open database|odbl", "(?:open database license|odbl)(?: version| v)? ?1?(?: 0)?"),
    ("gfdl-1.3", "free documentation|gfdl", "(?:gnu )?(?:free documentation license|gfdl)(?: version| v)? ?1 3"),
]

#: Form of a notice: priority, pattern around {name}, weight, and what every text of the form has beside the name.
FORMS = [
    (10, "spdx license identifier {name}", 1.0, "spdx license identifier"),
    (20, "(?:released|distributed|licensed|published|available|provided|offered)(?: \\w+){0,3}? under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?", 0.95, " under "),
    (30, "under the terms(?: and conditions)? of the {name}(?: licen[cs]e)?", 0.95, "under the terms"),
    (40, "subject to the(?: terms of the)? {name}(?: licen[cs]e)?", 0.9, "subject to the"),
    (50, "under(?: the| an?)? {name}(?: licen[cs]e)?", 0.9, " under "),
    (60, "licen[cs]e {name}", 0.8, " license | licence "),
    (70, "{name} licen[cs]ed?", 0.7, " license| licence"),
]

#: Notices that name a licence by its wording: label, keyword, pattern.
WORDINGS = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", "in advertising", "the name of .{1,80}? shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("json", "not evil", "the software shall be used for good not evil"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("ntp", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("postgresql", "written agreement", "for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd-3-clause", "neither", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote"),
    ("bsd-2-clause", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause-views", "official policies", "the views and conclusions contained in the software and documentation are those of the authors"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-2", "apache", "(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2", "in compliance", "you may not use this file except in compliance with the license"),
    ("apache-2", "agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2-llvm", "llvm", "apache license(?: version| v)? ?2(?: 0)? with llvm exceptions?"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("gpl-3", "gnu", "either version 3 of the license or at your option any later version"),
    ("gpl-2", "gnu", "either version 2 of the license or at your option any later version"),
    ("gpl-2-only", "gnu", "gnu general public license version 2 only"),
    ("gpl-3-only", "gnu", "gnu general public license version 3 only"),
    ("gpl-2-or-later", "gpl", "gpl ?v?(?:ersion )?2(?: 0)? or (?:any )?later(?: version)?"),
    ("gpl-3-or-later", "gpl", "gpl ?v?(?:ersion )?3(?: 0)? or (?:any )?later(?: version)?"),
    ("lgpl-2.1-or-later", "lgpl", "lgpl ?v?(?:ersion )?2 1 or (?:any )?later(?: version)?"),
    ("lgpl-3-or-later", "lgpl", "lgpl ?v?(?:ersion )?3(?: 0)? or (?:any )?later(?: version)?"),
    ("agpl-3-or-later", "agpl", "agpl ?v?(?:ersion )?3(?: 0)? or (?:any )?later(?: version)?"),
    ("lgpl-2.1", "gnu", "either version 2 1 of the license or at your option any later version"),
    ("lgpl", "lesser general", "gnu lesser general public license for more details"),
    ("lgpl", "library general", "gnu library general public license for more details"),
    ("agpl-3", "affero", "gnu affero general public license for more details"),
    ("gpl", "gnu", "gnu general public license for more details"),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gfdl", "gnu", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("classpath-exception", "independent modules", "permission to link this library with independent modules to produce an executable"),
    ("classpath-exception", "classpath", "(?:with )?(?:the )?(?:gnu )?classpath exception"),
    ("gcc-exception", "runtime library exception", "gcc runtime library exception"),
    ("bison-exception", "bison", "you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", "autoconf", "a configuration script generated by autoconf"),
    ("font-exception", "this font", "if you create a document which uses this font and embed this font"),
    ("openssl-exception", "openssl", "permission to link the code of portions of this program with the openssl library"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", " mpl ", "if a copy of the mpl was not distributed with this file"),
    ("mpl-2-no-copyleft-exception", "secondary licenses", "this source code form is incompatible with secondary licenses"),
    ("epl-1", "eclipse", "made available under the terms of the eclipse public license v ?1 0"),
    ("epl-2", "eclipse", "made available under the terms of the eclipse public license(?: v)? ?2 0"),
    ("cddl-1", "common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("python-2", " psf ", "psf is making python available to licensee on an as is basis"),
    ("perl", "as perl itself", "under the same terms as perl itself"),
    ("artistic-1", "artistic", "the artistic license preamble"),
    ("boost-1", "person or organization", "free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "what the fuck", "you just do what the fuck you want to"),
    ("beerware", "a beer", "you can buy me a beer in return"),
    ("zlib", "warranty", "provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such"),
    ("ncsa", "ncsa", "university of illinois(?: ncsa)? open source license"),
    ("ms-pl", "accompanying software", "this license governs use of the accompanying software"),
    ("cc0", "neighboring", "waive all copyright and related or neighboring rights"),
    ("cc0", "waived", "to the extent possible under law .{1,80}? has waived all copyright"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("odbl-1", "odbl", "made available under the open database license odbl v1 0"),
    ("public-domain", "public domain", "(?:is|are) (?:hereby )?(?:in|released into|dedicated to|placed in) the public domain"),
    ("elastic-2", "elastic", "elastic license (?:2 0|v2)"),
    ("sspl-1", "server side", "server side public license(?: version| v)? ?1?"),
    ("busl-1.1", "business source", "business source license(?: version)? 1 1"),
    ("commons-clause", "commons clause", "commons clause license condition"),
    ("openrail", "rail", "(?:bigscience |creativeml )?(?:open)?rail(?: m)? license"),
    ("llama-2", "llama", "llama 2 community license"),
    ("proprietary", "confidential", "proprietary and confidential"),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "reproduced", "no part of this .{1,40}? may be reproduced"),
    ("proprietary", "internal use", "for internal use only"),
]


#: Whole notices, from a wording to one of its last: what lies inside them is part of them. Those that hold more stand first.
NOTICES = [
    ("bsd-4-clause", "advertising materials", "redistribution and use in source and binary forms .{1,600}? all advertising materials mentioning features .{1,600}?(?:endorse or promote products derived|even if advised of the possibility of such damage)"),
    ("bsd-3-clause", "neither the name", "redistribution and use in source and binary forms .{1,900}? neither the name .{1,200}? endorse or promote products derived"),
    ("bsd-3-clause-clear", "no express or implied licenses", "redistribution and use in source and binary forms .{1,1200}? no express or implied licenses to any party s patent rights are granted"),
    ("bsd-2-clause", "redistributions in binary form", "redistribution and use in source and binary forms .{1,400}? redistributions in binary form must reproduce the above copyright notice"),
    ("apache-1.1", "apache software foundation", "redistribution and use in source and binary forms .{1,900}? this product includes software developed by the apache software foundation .{1,600}? products derived from this software may not be called apache"),
    ("apache-2", "in compliance", "licensed under the apache license version 2 0 .{1,300}? unless required by applicable law or agreed to in writing"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation .{1,400}? shall be included in all copies or substantial portions of the software"),
    ("gpl-2-or-later", "or at your option", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version .{1,400}? gnu general public license for more details"),
    ("gpl-3-or-later", "or at your option", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version .{1,400}? gnu general public license for more details"),
    ("lgpl-2.1-or-later", "or at your option", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version .{1,400}? gnu lesser general public license for more details"),
    ("lgpl-3-or-later", "or at your option", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version .{1,400}? gnu lesser general public license for more details"),
    ("agpl-3-or-later", "or at your option", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version .{1,400}? gnu affero general public license for more details"),
    ("gpl-3-only", "version 3 of the license", "under the terms of the gnu general public license as published by the free software foundation version 3 of the license"),
    ("gpl-2-only", "version 2 of the license", "under the terms of the gnu general public license as published by the free software foundation version 2 of the license"),
    ("mpl-2", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0 .{1,200}? you can obtain one at"),
    ("zlib", "altered source", "provided as is without any express or implied warranty .{1,500}? altered source versions must be plainly marked as such"),
    ("boost-1", "accompanying documentation", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license .{1,600}? machine executable object code"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain .{1,300}? by any means"),
    ("isc", "appear in all copies", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ofl-1.1", "font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software .{1,900}? may not be sold by itself"),
]
#: Priority of phrases that stand in notices of most licences: they count where nothing else is found.
PHRASE = 90
PHRASES = [("proprietary", "reserved", "all rights reserved")]


def rules() -> list[Rule]:
    """All rules in order: base phrases, whole notices, wordings, phrases, then each form for each licence."""
    out = [Rule(label, 0, (phrase,), phrase, 1.0) for label, phrase in BASE.items()]
    out += [Rule(label, 3, (keyword,), pattern, 1.0) for label, keyword, pattern in NOTICES]
    out += [Rule(label, PHRASE, (keyword,), pattern, 0.3) for label, keyword, pattern in PHRASES]
    out += [Rule(label, 5, (keyword,), pattern, 1.0 if label != "proprietary" else 0.3) for label, keyword, pattern in WORDINGS]
    for priority, form, weight, also in FORMS:
        out += [Rule(label, priority, tuple(keyword.split("|")), form.replace("{name}", f"(?:{name})"), weight, tuple(also.split("|"))) for label, keyword, name in LICENSES]
    return out
