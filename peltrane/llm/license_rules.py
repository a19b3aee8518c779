"""The ordered signature rules of the license scan: (tier, label, keyword, pattern).

Tier 1 are SPDX identifiers and license urls, tier 2 full names and well-known sentences, tier 3 short mentions. A rule's
keyword must be in the text before its pattern is tried. Patterns are matched on text that is lower-cased and whose words
are separated by single blanks, so `cc-by-sa-4.0` reads `cc by sa 4 0`. They use no look-around, which keeps them linear.
"""

from __future__ import annotations

#: Licenses: label, name, short forms, versions ("": none). Fixed values.
FAMILIES = (
    ("gpl", "gnu general public license", ("gnu gpl", "gpl"), ("1 0", "2 0", "3 0", "2", "3")),
    ("lgpl", "gnu lesser general public license", ("gnu lgpl", "lgpl"), ("2 0", "2 1", "3 0", "3")),
    ("agpl", "gnu affero general public license", ("gnu agpl", "agpl"), ("1 0", "3 0", "3")),
    ("gfdl", "gnu free documentation license", ("gnu fdl", "gfdl"), ("1 1", "1 2", "1 3")),
    ("apache", "apache software license", ("apache license", "apache"), ("1 0", "1 1", "2 0")),
    ("mit", "the mit license", ("mit license", "mit licence", "mit x11 license"), ("",)),
    ("bsd", "berkeley software distribution license", ("bsd license", "bsd licence", "new bsd license", "simplified bsd license", "revised bsd license"), ("0 clause", "2 clause", "3 clause", "4 clause")),
    ("mpl", "mozilla public license", ("mozilla license",), ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public license", ("eclipse license",), ("1 0", "2 0")),
    ("cddl", "common development and distribution license", ("cddl license",), ("1 0", "1 1")),
    ("cpl", "common public license", (), ("1 0",)),
    ("eupl", "european union public licence", ("european union public license",), ("1 0", "1 1", "1 2")),
    ("osl", "open software license", (), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free license", (), ("1 1", "2 0", "2 1", "3 0")),
    ("artistic", "artistic license", ("perl artistic",), ("1 0", "2 0")),
    ("bsl", "boost software license", ("boost license",), ("1 0",)),
    ("isc", "isc license", ("isc licence",), ("",)),
    ("zlib", "zlib libpng license", ("zlib license", "zlib licence"), ("",)),
    ("libpng", "libpng license", ("png reference library license",), ("2 0",)),
    ("unlicense", "the unlicense", (), ("",)),
    ("wtfpl", "wtfpl", (), ("2 0",)),
    ("python", "python software foundation license", ("psf license", "python license"), ("2 0",)),
    ("ruby", "ruby license", (), ("",)),
    ("php", "php license", (), ("3 0", "3 01")),
    ("postgresql", "postgresql license", ("postgresql licence",), ("",)),
    ("openssl", "openssl license", ("openssl ssleay license",), ("",)),
    ("ofl", "sil open font license", ("open font license",), ("1 0", "1 1")),
    ("odbl", "open data commons open database license", ("open database license",), ("1 0",)),
    ("odc-by", "open data commons attribution license", (), ("1 0",)),
    ("pddl", "open data commons public domain dedication and license", (), ("1 0",)),
    ("ncsa", "university of illinois ncsa open source license", ("ncsa license",), ("",)),
    ("ms-pl", "microsoft public license", (), ("",)),
    ("ms-rl", "microsoft reciprocal license", (), ("",)),
    ("qpl", "q public license", (), ("1 0",)),
    ("upl", "universal permissive license", (), ("1 0",)),
    ("sspl", "server side public license", (), ("1 0", "1")),
    ("busl", "business source license", (), ("1 0", "1 1")),
    ("elastic", "elastic license", (), ("1 0", "2 0")),
    ("cecill", "cecill free software license agreement", ("cecill license", "cecill"), ("1 0", "2 0", "2 1")),
    ("ecl", "educational community license", (), ("1 0", "2 0")),
    ("lppl", "latex project public license", (), ("1 0", "1 2", "1 3c")),
    ("rpl", "reciprocal public license", (), ("1 1", "1 5")),
    ("vim", "vim license", (), ("",)),
    ("w3c", "w3c software notice and license", ("w3c license",), ("",)),
    ("zpl", "zope public license", (), ("1 1", "2 0", "2 1")),
    ("blueoak", "blue oak model license", (), ("1 0 0",)),
    ("mulan", "mulan permissive software license", (), ("1", "2")),
    ("openrail", "creativeml openrail m", ("bigscience openrail m", "openrail m"), ("",)),
    ("llama", "llama 2 community license", ("llama 3 community license", "llama community license"), ("",)),
)
#: Creative Commons codes and names, fixed values.
CC = (
    ("by", "attribution"),
    ("by sa", "attribution share ?alike"),
    ("by nd", "attribution no ?deriv(?:ative)?s?"),
    ("by nc", "attribution non ?commercial"),
    ("by nc sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Sentences of license texts and notices: label, keyword, pattern. Fixed values.
SENTENCES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms"),
    ("bsd", "neither the name", "neither the name of (?:[^ ]+ ){1,12}may be used to endorse"),
    ("gpl", "free software", "this program is free software"),
    ("gpl", "either version", "either version [0-9](?: [0-9])? of the license or at your option any later version"),
    ("apache-2.0", "licensed under the apache", "licensed under the apache license version 2 0"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("bsl", "boost", "distributed under the boost software license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "provided as is", "this software is provided as is without any express or implied warranty"),
    ("wtfpl", "public license", "do what the [^ ]+ you want to public license"),
    ("public-domain", "public domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "public domain"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "no rights reserved", "no rights reserved"),
    ("reserved", "some rights reserved", "some rights reserved"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("copyright", "copyright", "copyright (?:c|by|holder|notice|owner)"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "confidential", "confidential and proprietary"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|distribution|reproduction)"),
    ("no-derivatives", "may not be reproduced", "may not be reproduced(?: [^ ]+){0,12} without (?:prior )?(?:written )?permission"),
    ("warranty", "provided", "provided (?:by [^ ]+(?: [^ ]+){0,4} )?as is"),
    ("warranty", "without warranty", "without warranty of any kind"),
    ("licensed", "licensed under", "licensed under(?: the)?(?: terms of)?"),
    # grants, conditions and disclaimers of software licenses
    ("mit", "above copyright notice", "the above copyright notice and this permission notice shall be included in all(?: copies or substantial portions of the software)?"),
    ("mit", "in no event", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "use of this source code", "use of this source code is governed by a bsd style license(?: that can be found in the license file)?"),
    ("gpl", "can redistribute it", "you can redistribute it and or modify it under the terms of (?:version [0-9] of )?the gnu general public license"),
    ("lgpl", "can redistribute it", "you can redistribute it and or modify it under the terms of (?:version [0-9] of )?the gnu (?:lesser|library) general public license"),
    ("agpl", "can redistribute it", "you can redistribute it and or modify it under the terms of (?:version [0-9] of )?the gnu affero general public license"),
    ("gpl", "be useful", "distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received a copy of the gnu", "you should have received a copy of the gnu general public license"),
    ("lgpl", "received a copy of the gnu", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "received a copy of the gnu", "you should have received a copy of the gnu affero general public license"),
    ("gpl", "published by the free software foundation", "as published by the free software foundation"),
    ("gpl-2.0", "temple place", "59 temple place(?: suite 330)?"),
    ("agpl", "remotely through a computer network", "(?:users )?interact(?:ing)? with it remotely through a computer network"),
    ("gfdl", "no invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "permission is granted to copy", "permission is granted to copy distribute and or modify this document"),
    ("apache-2.0", "except in compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "apache org licenses", "www apache org licenses license 2 0"),
    ("apache", "apache software foundation", "software developed (?:by|at) the apache software foundation"),
    ("apache", "contributor license agreements", "(?:asf )?under one or more contributor license agreements"),
    ("mpl", "subject to the mozilla", "the contents of this file are subject to the mozilla public license"),
    ("mpl-2.0", "mpl was not distributed", "if a copy of the mpl was not distributed with this file"),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "common development and distribution", "subject to the terms of the common development and distribution license"),
    ("isc", "appear in all copies", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "author disclaims all warranties", "the author disclaims all warranties with regard to this software"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented"),
    ("zlib", "permission is granted to anyone", "permission is granted to anyone to use this software for any purpose(?: including commercial applications)?"),
    ("bsl-1.0", "license 1 0 txt", "(?:see accompanying file|copy at https? www boost org) license 1 0 txt"),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what", "you just do what the [^ ]+ you want to"),
    ("python", "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("artistic", "same terms as perl", "under the same terms as perl(?: itself)?"),
    ("ofl", "reserved font name", "with reserved font name"),
    ("ofl", "this font software", "this font software is licensed under the sil open font license"),
    ("beer", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("jquery", "dual licensed", "dual licensed under the mit (?:and|or) gpl(?: version 2)? licenses"),
    ("patent", "royalty free", "grants (?:to )?you a (?:perpetual )?(?:worldwide )?(?:non exclusive )?(?:no charge )?royalty free (?:irrevocable )?(?:copyright|patent) license"),
    # public domain and works shared openly
    ("cc0", "waived all copyright", "waived all copyright and related or neighbou?ring rights"),
    ("cc0", "publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    ("public-domain", "not subject to copyright", "not subject to copyright(?: protection)?(?: in the united states)?"),
    ("public-domain", "government", "(?:is )?a work of the (?:u s|united states) (?:federal )?government"),
    ("public-domain", "copyright has expired", "(?:its|whose|the) copyright has expired"),
    ("public-domain", "gutenberg", "the project gutenberg license included with this ebook"),
    ("cc-by", "open access article", "this is an open access article (?:distributed )?under the (?:terms (?:and conditions )?of the )?creative commons attribution(?: cc by)? license"),
    ("cc-by-sa", "share alike license", "text is available under the creative commons attribution share alike license"),
    ("cc-by-sa", "sharealike license", "text is available under the creative commons attribution sharealike license"),
    ("odbl", "openstreetmap contributors", "openstreetmap contributors"),
    ("ogl", "open government", "contains public sector information licensed under the open government licence(?: v[0-9] 0)?"),
    ("cc", "licence creative commons", "mis à disposition selon les termes de la licence creative commons"),
    ("cc-by", "creative commons namensnennung", "creative commons namensnennung"),
    ("cc-by", "creative commons reconocimiento", "creative commons reconocimiento"),
    # reservations and restrictions
    ("reserved", "alle rechte vorbehalten", "alle rechte vorbehalten"),
    ("reserved", "tous droits réservés", "tous droits réservés"),
    ("reserved", "todos los derechos reservados", "todos los derechos reservados"),
    ("reserved", "tutti i diritti riservati", "tutti i diritti riservati"),
    ("reserved", "все права защищены", "все права защищены"),
    ("reserved", "rights not expressly granted", "(?:all )?rights not expressly granted(?: herein)? are reserved"),
    ("no-derivatives", "no part of this", "no part of this (?:publication|book|document|work|website) may be reproduced"),
    ("no-derivatives", "retrieval system", "stored in a retrieval system or transmitted in any form or by any means"),
    ("non-commercial", "non commercial", "for (?:your )?(?:personal (?:and )?)?non commercial (?:use|purposes)(?: only)?"),
    ("non-commercial", "noncommercial", "for (?:your )?(?:personal (?:and )?)?noncommercial (?:use|purposes)(?: only)?"),
    ("non-commercial", "research purposes only", "(?:academic|research) (?:and|or) research purposes only"),
    ("evaluation", "evaluation purposes only", "for evaluation purposes only"),
    ("proprietary", "strictly forbidden", "reproduction of this material is strictly forbidden"),
    ("proprietary", "express written", "without (?:the )?(?:prior )?express written (?:permission|consent)"),
    ("proprietary", "internal use only", "for internal use only"),
    ("proprietary", "trade secrets", "(?:confidential|proprietary) (?:information )?and trade secrets"),
    ("proprietary", "unauthorised", "unauthorised (?:copying|use|distribution|reproduction)"),
    ("proprietary", "end user license agreement", "end user license agreement"),
    ("proprietary", "reverse engineer", "(?:may|shall|must) not (?:[^ ]+ ){0,6}reverse engineer"),
    ("proprietary", "published broadcast rewritten", "may not be published broadcast rewritten or redistributed"),
    ("terms-of-use", "terms of use", "(?:subject to|governed by|agree to) (?:our|the|these) terms of use"),
    ("terms-of-use", "terms of service", "(?:subject to|governed by|agree to) (?:our|the|these) terms of service"),
    ("trademark", "registered trademark", "is a registered trademark of"),
    ("trademark", "registered trademarks", "are registered trademarks of"),
    ("reprint", "with permission", "(?:reprinted|reproduced|used) (?:here )?with permission"),
    ("warranty", "fitness for a particular purpose", "(?:the implied )?warranties of merchantability(?: and)? fitness for a particular purpose"),
    ("warranty", "consequential damages", "incidental(?: special)?(?: exemplary)? or consequential damages"),
)


def gate_words(rules) -> list[str]:
    """A word of each rule's keyword, the longest: a text without any of them has no detection."""
    return sorted({max(k.split(" "), key=len) for _, _, k, _ in rules})


def gate_pattern(words: list[str]) -> str:
    """Any of the words, between blanks; grouped by first letter, so few branches are tried at a place."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ") "


def rules() -> list[tuple[int, str, str, str]]:
    """All rules by priority: hundreds, made from the tables above."""
    out = []
    for label, name, shorts, versions in FAMILIES:
        tag = label.replace("-", " ")
        out.append((1, label, "spdx license identifier", f"spdx license identifier {tag}"))
        out.append((2, label, name, name))
        out += [(3, label, s, s if " " in s else f"{s} v?[0-9](?: [0-9])?") for s in shorts]
        for v in filter(None, versions):
            dated = f"{label}-{v.replace(' ', '-' if 'clause' in v else '.')}"
            out.append((1, dated, "spdx license identifier", f"spdx license identifier {tag} {v}(?: only| or later)?"))
            out += [(2, dated, form, f"{form}(?: version| v)? {v}") for form in (name, *shorts)]
    for code, name in CC:
        tag = "cc-" + code.replace(" ", "-")
        for v in CC_VERSIONS:
            dotted = v.replace(" ", ".")
            out.append((1, f"{tag}-{dotted}", "creativecommons", f"creativecommons org licenses {code} {v}"))
            out.append((2, f"{tag}-{dotted}", f"cc {code}", f"cc {code} {v}"))
            out.append((2, f"{tag}-{dotted}", "creative commons", f"creative commons {name} {v}"))
        out.append((1, tag, "creativecommons", f"creativecommons org licenses {code}"))
        out.append((3, tag, f"cc {code}", f"cc {code}"))
        out.append((3, tag, "creative commons", f"creative commons {name}"))
    return sorted(dict.fromkeys(out + [(2, *s) for s in SENTENCES]), key=lambda r: (r[0], r[1], r[3]))
