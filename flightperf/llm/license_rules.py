"""License signature rules, written by hand.

One rule a line: ``label | kind | keyword | pattern``. A pattern is searched in the lower-cased
words of a text joined by single spaces (punctuation gone: "Apache-2.0" reads "apache 2 0"), and
only when its keyword occurs there. Kinds are ordered by priority; within a kind the earlier
rule comes first.
"""

from __future__ import annotations

# kind: priority (1 is the strongest), confidence of one detection
KINDS = {"spdx": (1, 0.99), "text": (2, 0.97), "notice": (3, 0.95), "name": (4, 0.85), "link": (5, 0.8),
         "hint": (6, 0.4)}

# Fixed values of the contract: phrase words and label.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
                ("mit license", "mit"))

RULES_TEXT = r"""
# GNU General Public License
gpl-1.0 | spdx | gpl | gpl 1 0(?: only| or later)?
gpl-2.0-only | spdx | gpl | gpl 2 0 only
gpl-2.0-or-later | spdx | gpl | gpl 2 0 or later
gpl-3.0-only | spdx | gpl | gpl 3 0 only
gpl-3.0-or-later | spdx | gpl | gpl 3 0 or later
gpl-2.0 | notice | general public license | (?:(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of the )?)?gnu general public license(?: \w+){0,6} version 2(?: 0)?
gpl-3.0 | notice | general public license | (?:(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of the )?)?gnu general public license(?: \w+){0,6} version 3(?: 0)?
gpl-2.0 | notice | general public license | version 2(?: 0)? of the gnu general public license
gpl-3.0 | notice | general public license | version 3(?: 0)? of the gnu general public license
gpl-or-later | notice | any later version | general public license(?: \w+){0,40} or at your option any later version
gpl-2.0 | name | gpl | gpl ?v? ?2(?: 0)?
gpl-3.0 | name | gpl | gpl ?v? ?3(?: 0)?
gpl | text | free software | this program is free software you can redistribute it and or modify it
gpl | text | without even the implied warranty | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | text | received a copy | you should have received a copy of the gnu general public license
gpl | text | gnu general public license | the gnu general public license is a free copyleft license
gpl | name | gnu general public license | gnu general public licenses?
gpl | name | gnu gpl | gnu gpl
gpl | notice | gpl | (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?gpl
gpl | link | gnu org | gnu org licenses gpl(?: \d+ \d+)?
gpl-exception | notice | exception | gpl(?: \w+){0,4} with (?:the )?(?:classpath|gcc runtime library|linking|font|autoconf|bison) exception
# GNU Lesser / Library General Public License
lgpl-2.0 | spdx | lgpl | lgpl 2 0(?: only| or later)?
lgpl-2.1-only | spdx | lgpl | lgpl 2 1 only
lgpl-2.1-or-later | spdx | lgpl | lgpl 2 1 or later
lgpl-3.0-only | spdx | lgpl | lgpl 3 0 only
lgpl-3.0-or-later | spdx | lgpl | lgpl 3 0 or later
lgpl-2.1 | notice | lesser general public license | gnu lesser general public license(?: \w+){0,6} version 2 1
lgpl-3.0 | notice | lesser general public license | gnu lesser general public license(?: \w+){0,6} version 3(?: 0)?
lgpl-2.0 | notice | library general public license | gnu library general public license(?: \w+){0,6} version 2(?: 0)?
lgpl-2.1 | name | lgpl | lgpl ?v? ?2 1
lgpl-3.0 | name | lgpl | lgpl ?v? ?3(?: 0)?
lgpl | text | this library is free software | this library is free software you can redistribute it and or modify it
lgpl | text | received a copy | you should have received a copy of the gnu (?:lesser|library) general public license
lgpl | name | lesser general public license | (?:gnu )?lesser general public license
lgpl | name | library general public license | (?:gnu )?library general public license
lgpl | name | gnu lgpl | gnu lgpl
lgpl | link | gnu org | gnu org licenses lgpl(?: \d+ \d+)?
# GNU Affero General Public License and Free Documentation License
agpl-3.0-only | spdx | agpl | agpl 3 0 only
agpl-3.0-or-later | spdx | agpl | agpl 3 0 or later
agpl-1.0 | spdx | agpl | agpl 1 0(?: only| or later)?
agpl-3.0 | notice | affero general public license | gnu affero general public license(?: \w+){0,6} version 3(?: 0)?
agpl-3.0 | name | agpl | agpl ?v? ?3(?: 0)?
agpl | text | received a copy | you should have received a copy of the gnu affero general public license
agpl | name | affero general public license | (?:gnu )?affero general public license
agpl | name | affero gpl | affero gpl
agpl | link | gnu org | gnu org licenses agpl(?: \d+ \d+)?
gfdl-1.1 | spdx | gfdl | gfdl 1 1(?: only| or later)?
gfdl-1.2 | spdx | gfdl | gfdl 1 2(?: only| or later)?
gfdl-1.3 | spdx | gfdl | gfdl 1 3(?: only| or later)?
gfdl | text | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl-1.2 | notice | free documentation license | gnu free documentation license(?: \w+){0,3} version 1 2
gfdl-1.3 | notice | free documentation license | gnu free documentation license(?: \w+){0,3} version 1 3
gfdl | name | free documentation license | (?:gnu )?free documentation license
gfdl | name | gnu fdl | gnu fdl
# Apache
apache-1.0 | spdx | identifier | spdx license identifier apache 1 0
apache-1.1 | spdx | identifier | spdx license identifier apache 1 1
apache-2.0 | spdx | identifier | spdx license identifier apache 2 0
apache-2.0 | notice | apache license | licensed under the apache license version 2 0
apache-2.0 | text | compliance with the license | you may not use this file except in compliance with the license
apache-2.0 | text | as is basis | distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | text | apache license | apache license version 2 0 january 2004
apache-2.0 | notice | apache | apache(?: software)? license(?: \w+)? (?:version |v ?)?2(?: 0)?
apache-1.1 | notice | apache | apache(?: software)? license(?: \w+)? (?:version |v ?)?1 1
apache-2.0 | name | apache 2 | apache 2(?: 0)?
apache | name | apache license | apache license
apache | name | apache software license | apache software license
apache | name | asl 2 0 | asl 2 0
apache-2.0 | link | apache org | apache org licenses license 2 0
apache | link | apache org | apache org licenses
# MIT and its kin
mit | spdx | identifier | spdx license identifier mit
mit-0 | spdx | identifier | spdx license identifier mit 0
mit | text | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | text | the above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | text | the software is provided | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | notice | mit | (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?mit(?: license)?
mit | name | mit license | (?:the )?mit license
mit | name | expat license | expat license
mit | link | opensource org | opensource org licenses? mit
x11 | name | x11 license | x11 license
mit-0 | name | mit no attribution | mit no attribution
mit-modern | text | hereby granted without written agreement | permission is hereby granted without written agreement and without license or royalty fees
hpnd | text | use copy modify and distribute | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
# BSD and ISC
bsd-2-clause | spdx | bsd 2 clause | bsd 2 clause(?: license)?
bsd-3-clause | spdx | bsd 3 clause | bsd 3 clause(?: license)?
bsd-4-clause | spdx | bsd 4 clause | bsd 4 clause(?: license)?
0bsd | spdx | 0bsd | 0bsd
bsd | text | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd | text | redistributions of source code | redistributions of source code must retain the above copyright notice
bsd | text | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | text | endorse or promote | neither the names? of(?: \w+){1,12} may be used to endorse or promote products derived from this software
bsd-4-clause | text | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | text | this software is provided by | this software is provided by(?: \w+){1,8} as is and any express or implied warranties
bsd-3-clause | name | bsd | (?:new|revised|modified) bsd license
bsd-2-clause | name | license | (?:simplified|freebsd) (?:bsd )?license
bsd-4-clause | name | bsd | (?:original|old) bsd license
bsd | notice | bsd | (?:licensed|released|distributed|available) under (?:the |a )?bsd(?: style)?(?: license)?
bsd | name | bsd | bsd(?: style)? licenses?
isc | spdx | identifier | spdx license identifier isc
isc | text | use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | text | author disclaims all warranties | the author disclaims all warranties with regard to this software
isc | name | isc license | isc license
# Creative Commons
cc-by-1.0 | spdx | cc by | cc by 1 0
cc-by-2.0 | spdx | cc by | cc by 2 0
cc-by-2.5 | spdx | cc by | cc by 2 5
cc-by-3.0 | spdx | cc by | cc by 3 0
cc-by-4.0 | spdx | cc by | cc by 4 0
cc-by-sa-1.0 | spdx | cc by sa | cc by sa 1 0
cc-by-sa-2.0 | spdx | cc by sa | cc by sa 2 0
cc-by-sa-2.5 | spdx | cc by sa | cc by sa 2 5
cc-by-sa-3.0 | spdx | cc by sa | cc by sa 3 0
cc-by-sa-4.0 | spdx | cc by sa | cc by sa 4 0
cc-by-nc-2.0 | spdx | cc by nc | cc by nc 2 0
cc-by-nc-3.0 | spdx | cc by nc | cc by nc 3 0
cc-by-nc-4.0 | spdx | cc by nc | cc by nc 4 0
cc-by-nd-2.0 | spdx | cc by nd | cc by nd 2 0
cc-by-nd-3.0 | spdx | cc by nd | cc by nd 3 0
cc-by-nd-4.0 | spdx | cc by nd | cc by nd 4 0
cc-by-nc-sa-2.0 | spdx | cc by nc sa | cc by nc sa 2 0
cc-by-nc-sa-3.0 | spdx | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa-4.0 | spdx | cc by nc sa | cc by nc sa 4 0
cc-by-nc-nd-2.0 | spdx | cc by nc nd | cc by nc nd 2 0
cc-by-nc-nd-3.0 | spdx | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd-4.0 | spdx | cc by nc nd | cc by nc nd 4 0
cc-by-nc-sa | name | cc by nc sa | cc by nc sa
cc-by-nc-nd | name | cc by nc nd | cc by nc nd
cc-by-nc | name | cc by nc | cc by nc
cc-by-sa | name | cc by sa | cc by sa
cc-by-nd | name | cc by nd | cc by nd
cc-by | name | cc by | cc by
cc0-1.0 | spdx | cc0 | cc0(?: 1 0)?
cc0-1.0 | notice | cc0 | cc0 1 0 universal(?: public domain dedication)?
cc0-1.0 | name | cc zero | cc zero
cc-by-nc-sa | notice | creative commons | creative commons attribution non ?commercial share ?alike(?: \d \d)?(?: international| unported| generic)?
cc-by-nc-nd | notice | creative commons | creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)?(?: \d \d)?(?: international| unported| generic)?
cc-by-nc | notice | creative commons | creative commons attribution non ?commercial(?: \d \d)?(?: international| unported| generic)?
cc-by-sa | notice | creative commons | creative commons attribution share ?alike(?: \d \d)?(?: international| unported| generic)?
cc-by-nd | notice | creative commons | creative commons attribution no ?deriv(?:s|atives|ative works)?(?: \d \d)?(?: international| unported| generic)?
cc-by | notice | creative commons | creative commons attribution(?: \d \d)?(?: international| unported| generic)?(?: license)?
cc0-1.0 | notice | creative commons | creative commons (?:cc0|zero)(?: 1 0)?
cc | name | creative commons | creative commons(?: licenses?| public licenses?)?
cc-by | link | creativecommons org | creativecommons org licenses by(?: \d \d)?
cc-by-sa | link | creativecommons org | creativecommons org licenses by sa(?: \d \d)?
cc-by-nc | link | creativecommons org | creativecommons org licenses by nc(?: \d \d)?
cc-by-nd | link | creativecommons org | creativecommons org licenses by nd(?: \d \d)?
cc-by-nc-sa | link | creativecommons org | creativecommons org licenses by nc sa(?: \d \d)?
cc-by-nc-nd | link | creativecommons org | creativecommons org licenses by nc nd(?: \d \d)?
cc0-1.0 | link | creativecommons org | creativecommons org publicdomain zero(?: \d \d)?
public-domain | link | creativecommons org | creativecommons org publicdomain mark(?: \d \d)?
# Mozilla, Eclipse and other weak copyleft
mpl-1.0 | spdx | mpl | mpl 1 0
mpl-1.1 | spdx | mpl | mpl 1 1
mpl-2.0 | spdx | mpl | mpl 2 0
mpl-2.0 | text | source code form is subject | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | text | the contents of this file | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | notice | mozilla public license | mozilla public license(?: \w+)? (?:version |v )?2(?: 0)?
mpl-1.1 | notice | mozilla public license | mozilla public license(?: \w+)? (?:version |v )?1 1
mpl | name | mozilla public license | mozilla public license
mpl | link | mozilla org | mozilla org mpl(?: \d \d)?
epl-1.0 | spdx | epl | epl 1 0
epl-2.0 | spdx | epl | epl 2 0
epl-2.0 | notice | eclipse public license | eclipse public license(?: \w+)? (?:version |v ?)?2(?: 0)?
epl-1.0 | notice | eclipse public license | eclipse public license(?: \w+)? (?:version |v ?)?1(?: 0)?
epl | name | eclipse public license | eclipse public license
edl-1.0 | name | eclipse distribution license | eclipse distribution license(?: v? ?1 0)?
cpl-1.0 | name | common public license | common public license(?: version)?(?: 1 0)?
ipl-1.0 | name | ibm public license | ibm public license(?: version)?(?: 1 0)?
cddl-1.0 | spdx | cddl | cddl 1 0
cddl-1.1 | spdx | cddl | cddl 1 1
cddl | name | common development and distribution license | common development and distribution license
cddl | name | cddl | cddl
cpal-1.0 | name | common public attribution license | common public attribution license
eupl-1.1 | spdx | eupl | eupl ?v? ?1 1
eupl-1.2 | spdx | eupl | eupl ?v? ?1 2
eupl | name | european union public licen | european union public licen[cs]e
ms-pl | name | microsoft public license | microsoft public license
ms-rl | name | microsoft reciprocal license | microsoft reciprocal license
osl-3.0 | name | open software license | open software license(?: v? ?(?:version )?3 0)?
afl-3.0 | name | academic free license | academic free license(?: v? ?(?:version )?3 0)?
artistic-2.0 | notice | artistic license | artistic license(?: \w+)? 2 0
artistic-1.0 | notice | artistic license | artistic license(?: \w+)? 1 0
artistic | name | artistic license | (?:perl )?artistic license
perl | notice | same terms as perl | under the same terms as perl(?: itself)?
lppl | name | latex project public license | latex project public license(?: version)?(?: 1 \d\w?)?
sissl | name | sun industry standards | sun industry standards source license
npl | name | netscape public license | netscape public license
qpl | name | q public license | q public license
# permissive, others
bsl-1.0 | spdx | bsl 1 0 | bsl 1 0
bsl-1.0 | text | boost software license | boost software license version 1 0 august 17th 2003
bsl-1.0 | name | boost software license | boost software license(?: version 1 0)?
zlib | text | altered source versions | altered source versions must be plainly marked as such
zlib | text | the origin of this software | the origin of this software must not be misrepresented
zlib | name | zlib | zlib(?: libpng)? license
libpng | name | libpng license | libpng license
unlicense | text | released into the public domain | this is free and unencumbered software released into the public domain
unlicense | name | unlicense | (?:the )?unlicense
wtfpl | name | wtfpl | wtfpl
wtfpl | name | do what the | do what the f\w+ you want to public license
beerware | name | beer ware license | beer ware license
python-2.0 | name | python software foundation license | python software foundation license(?: version 2)?
psf | name | psf license | psf license
postgresql | name | postgresql licen | postgresql licen[cs]e
php-3.01 | name | php license | php license(?: version)?(?: 3 0\d?)?
ruby | name | ruby | ruby(?: s)? license
openssl | name | openssl license | openssl license
openssl | text | openssl toolkit | software developed by the openssl project for use in the openssl toolkit
ssleay | text | cryptographic software written by | this product includes cryptographic software written by eric young
curl | name | curl license | curl license
ncsa | name | ncsa open source license | university of illinois ncsa open source license
w3c | name | w3c software | w3c software(?: notice)?(?: and)? license
unicode | name | unicode license | unicode license(?: agreement)?
icu | name | icu license | icu license
ofl-1.1 | spdx | ofl 1 1 | ofl 1 1
ofl-1.1 | text | sil open font license | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | name | open font license | (?:sil )?open font license
tcl | name | tcl tk license | tcl tk license
vim | name | vim license | vim license
json | text | used for good not evil | the software shall be used for good not evil
mulan | name | mulan psl | mulan psl(?: v2)?
upl-1.0 | name | universal permissive license | universal permissive license(?: v? ?1 0)?
blueoak | name | blue oak model license | blue oak model license
# data, models and source-available
odbl-1.0 | name | open database license | (?:open data commons )?open database license
odc-by | name | open data commons attribution | open data commons attribution license
pddl | name | public domain dedication and license | (?:open data commons )?public domain dedication and license
cdla | name | community data license agreement | community data license agreement(?: permissive| sharing)?
ogl | name | open government licen | open government licen[cs]e(?: v? ?\d(?: 0)?)?
etalab | name | etalab | licence ouverte(?: \w+)? etalab|etalab(?: 2 0)?
openrail | name | openrail | (?:creativeml )?openrail(?: m)?(?: license)?
rail | name | responsible ai license | responsible ai licenses?
sspl-1.0 | name | server side public license | server side public license
busl-1.1 | name | business source license | business source license(?: 1 1)?
elastic-2.0 | name | elastic license | elastic license(?: 2 0)?
commons-clause | name | commons clause | commons clause(?: license condition)?
polyform | name | polyform | polyform (?:noncommercial|shield|small business|strict|perimeter)(?: license)?
# public domain, restrictions, hints
public-domain | notice | public domain | (?:released|placed|dedicated)(?: \w+){0,3} (?:into|in|to) the public domain
public-domain | notice | public domain | (?:is|are) in the public domain
public-domain | hint | public domain | public domain
proprietary | notice | all rights reserved | copyright(?: \w+){1,10} all rights reserved
proprietary | hint | all rights reserved | all rights reserved
proprietary | notice | proprietary | proprietary and confidential
proprietary | text | strictly prohibited | unauthorized copying of this file(?: \w+){0,6} is strictly prohibited
proprietary | notice | may not be reproduced | may not be reproduced(?: \w+){0,12} without(?: \w+){0,4} written permission
proprietary | notice | end user license agreement | end user license agreement
non-commercial | hint | commercial use | for non ?commercial use only
non-commercial | hint | commercial purposes | for non ?commercial purposes(?: only)?
copyright | hint | copyright | copyright(?: c)? (?:19|20)\d\d
copyleft | hint | copyleft | copyleft
dual-license | hint | dual licen | dual licen[cs]ed
unknown-license | hint | licen | (?:licen[cs]ed|released|distributed|published|available) under (?:the |a )?(?:\w+ ){1,6}licen[cs]e
unknown-license | hint | identifier | spdx license identifier \w+
permission-notice | hint | reprinted with permission | reprinted with permission
"""


def parse_rules(text: str = RULES_TEXT) -> list[tuple[str, str, str, str]]:
    """(label, kind, keyword, pattern) in order."""
    rules = []
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            label, kind, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
            rules.append((label, kind, keyword, pattern))
    return rules
