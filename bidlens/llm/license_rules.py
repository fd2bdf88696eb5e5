"""Signatures of licenses: fixed values, written by hand.

A line is `label | class | keyword | pattern`. Patterns are regular expressions over a text's lower-case words joined by single
spaces, so they hold no punctuation: `apache 2 0`, not `Apache-2.0`. They begin and end at words. A rule is only tried on texts
that hold its keyword as a word, which is the rarest word that every match has. Classes, the best first: 1 a license with its version, or
the words of its text; 2 a license by name; 3 a hint. Earlier rules go before later ones of their class.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Scores of the classes; 0 are identifiers behind their tag, which are derived from the labels.
SCORES = (1.0, 0.9, 0.7, 0.4)

#: Short forms inside patterns.
SHORT = {"{lic}": "licen[cs]e", "{v} ": "(?: version| ver| v)? v?", "{later}": "or (?:at your option )?(?:any )?later(?: version)?", "{cc}": "(?:cc|creative commons(?: attribution)?)"}

#: The base: these phrases alone.
BASE = """
gpl | 2 | gnu | gnu general public license
apache | 2 | apache | apache license
cc-by | 2 | cc | cc by
mit | 2 | license | mit license
"""

SIGNATURES = r"""
gpl-3.0-or-later | 1 | general | (?:gnu )?general public {lic}(?: gpl)?{v} 3(?: 0)? {later}
gpl-3.0-or-later | 1 | later | gpl(?:v3|{v} 3)(?: 0)? {later}
gpl-3.0-or-later | 1 | general | general public {lic} as published by the free software foundation either version 3 of the {lic} {later}
gpl-3.0-only | 1 | only | gpl(?:v3|{v} 3)(?: 0)? only
gpl-3.0 | 1 | general | (?:gnu )?general public {lic}(?: gpl)?{v} 3(?: 0)?
gpl-3.0 | 1 | gplv3 | (?:gnu )?gplv3(?: 0)?
gpl-3.0 | 1 | gpl | (?:gnu )?gpl{v} 3(?: 0)?
gpl-3.0 | 1 | gpl3 | gpl3
gpl-2.0-or-later | 1 | general | (?:gnu )?general public {lic}(?: gpl)?{v} 2(?: 0)? {later}
gpl-2.0-or-later | 1 | later | gpl(?:v2|{v} 2)(?: 0)? {later}
gpl-2.0-or-later | 1 | general | general public {lic} as published by the free software foundation either version 2 of the {lic} {later}
gpl-2.0-only | 1 | only | gpl(?:v2|{v} 2)(?: 0)? only
gpl-2.0-with-classpath-exception | 1 | classpath | gpl(?:v2|{v} 2)?(?: 0)?(?: only)? with (?:the )?classpath exception
gpl-2.0 | 1 | general | (?:gnu )?general public {lic}(?: gpl)?{v} 2(?: 0)?
gpl-2.0 | 1 | gplv2 | (?:gnu )?gplv2(?: 0)?
gpl-2.0 | 1 | gpl | (?:gnu )?gpl{v} 2(?: 0)?
gpl-2.0 | 1 | gpl2 | gpl2
gpl-1.0 | 1 | gpl | (?:gnu )?gpl{v} 1(?: 0)?
gpl-1.0 | 1 | general | (?:gnu )?general public {lic}{v} 1(?: 0)?
gpl-url | 1 | gnu | gnu org licenses (?:old licenses )?gpl(?: (?:2|3) 0)?(?: en)?(?: html| txt)?
gpl-family | 2 | gpl | (?:gnu )?gpl(?: {lic})?
gpl-family | 2 | general | general public {lic}
lgpl-3.0-or-later | 1 | lesser | lesser general public {lic}(?: lgpl)?{v} 3(?: 0)? {later}
lgpl-3.0 | 1 | lesser | (?:gnu )?lesser general public {lic}(?: lgpl)?{v} 3(?: 0)?
lgpl-3.0 | 1 | lgplv3 | lgplv3(?: 0)?
lgpl-3.0 | 1 | lgpl | lgpl{v} 3(?: 0)?
lgpl-2.1-or-later | 1 | lesser | lesser general public {lic}(?: lgpl)?{v} 2 1 {later}
lgpl-2.1-or-later | 1 | lesser | lesser general public {lic} as published by the free software foundation either version 2 1 of the {lic} {later}
lgpl-2.1 | 1 | lesser | (?:gnu )?lesser general public {lic}(?: lgpl)?{v} 2 1
lgpl-2.1 | 1 | lgpl | lgpl{v} 2 1
lgpl-2.1 | 1 | lgplv2 | lgplv2 1
lgpl-2.0 | 1 | library | (?:gnu )?library general public {lic}(?: lgpl)?{v} 2(?: 0)?
lgpl-2.0 | 1 | lgpl | lgpl{v} 2(?: 0)?
lgpl-family | 2 | lesser | (?:gnu )?lesser general public {lic}
lgpl-family | 2 | library | gnu library general public {lic}
lgpl-family | 2 | lgpl | (?:gnu )?lgpl
agpl-3.0-or-later | 1 | affero | affero general public {lic}(?: agpl)?{v} 3(?: 0)? {later}
agpl-3.0 | 1 | affero | (?:gnu )?affero general public {lic}(?: agpl)?{v} 3(?: 0)?
agpl-3.0 | 1 | agplv3 | agplv3(?: 0)?
agpl-3.0 | 1 | agpl | agpl{v} 3(?: 0)?
agpl-1.0 | 1 | affero | affero general public {lic}{v} 1(?: 0)?
agpl-family | 2 | affero | (?:gnu )?affero general public {lic}
agpl-family | 2 | agpl | (?:gnu )?agpl
gfdl-1.3 | 1 | documentation | (?:gnu )?free documentation {lic}{v} 1 3
gfdl-1.2 | 1 | documentation | (?:gnu )?free documentation {lic}{v} 1 2
gfdl-1.1 | 1 | documentation | (?:gnu )?free documentation {lic}{v} 1 1
gfdl-family | 2 | documentation | (?:gnu )?free documentation {lic}
gfdl-family | 2 | gfdl | gfdl
apache-2.0 | 1 | apache | apache (?:software )?{lic}(?: asl)?{v} 2(?: 0)?
apache-2.0 | 1 | apache | apache{v} 2(?: 0)?(?: {lic})?
apache-2.0 | 1 | apache | apache org licenses {lic} 2 0(?: txt| html)?
apache-2.0 | 1 | asl | asl{v} 2(?: 0)?
apache-2.0 | 1 | conditions | without warranties or conditions of any kind either express or implied see the {lic} for the specific language
apache-1.1 | 1 | apache | apache (?:software )?{lic}{v} 1 1
apache-1.1 | 1 | apache | apache{v} 1 1
apache-1.0 | 1 | apache | apache (?:software )?{lic}{v} 1(?: 0)?
apache-family | 2 | apache | apache (?:software )?licen[cs]ed?
mit | 1 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
mit-0 | 1 | attribution | mit no attribution(?: {lic})?
mit-0 | 1 | 0 | mit 0(?: {lic})?
mit-modern | 2 | modern | mit {lic} modern variant
mit-family | 2 | license | (?:the )?mit (?:x11 |x consortium |expat )?license
mit-family | 2 | licence | (?:the )?mit (?:x11 |x consortium |expat )?licence
mit-family | 2 | licensed | mit licensed
mit-url | 1 | opensource | opensource org licenses mit(?: license)?(?: php| html)?
x11 | 2 | x11 | (?:mit )?x11 {lic}
expat | 2 | expat | expat {lic}
bsd-4-clause | 1 | acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause | 1 | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: {lic})?
bsd-3-clause-clear | 1 | clear | (?:clear bsd|bsd 3 clause clear)(?: {lic})?
bsd-3-clause | 1 | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 1 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: {lic})?
bsd-2-clause-patent | 1 | patent | bsd 2 clause (?:plus )?patent(?: {lic})?
bsd-2-clause | 1 | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd bsd)(?: {lic})?
bsd-2-clause | 1 | freebsd | freebsd {lic}
bsd-1-clause | 1 | bsd | (?:bsd 1 clause|1 clause bsd)(?: {lic})?
0bsd | 1 | 0bsd | 0bsd(?: {lic})?
0bsd | 1 | bsd | (?:bsd zero clause|zero clause bsd|bsd 0 clause)(?: {lic})?
bsd-text | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-family | 2 | bsd | bsd(?: style)? {lic}
bsd-family | 2 | bsd | bsd licensed
isc | 1 | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | isc {lic}
isc | 2 | consortium | internet (?:systems|software) consortium {lic}
cc-by-nc-nd-4.0 | 1 | nd | {cc} by nc nd 4 0(?: international)?
cc-by-nc-nd-3.0 | 1 | nd | {cc} by nc nd 3 0(?: unported)?
cc-by-nc-nd-2.0 | 1 | nd | {cc} by nc nd 2 [05]
cc-by-nc-nd | 2 | nd | {cc} by nc nd
cc-by-nc-nd | 2 | noderivatives | (?:attribution )?noncommercial noderivatives(?: [1-4] [05])?
cc-by-nc-sa-4.0 | 1 | sa | {cc} by nc sa 4 0(?: international)?
cc-by-nc-sa-3.0 | 1 | sa | {cc} by nc sa 3 0(?: unported)?
cc-by-nc-sa-2.0 | 1 | sa | {cc} by nc sa 2 [05]
cc-by-nc-sa | 2 | sa | {cc} by nc sa
cc-by-nc-sa | 2 | sharealike | (?:attribution )?noncommercial sharealike(?: [1-4] [05])?
cc-by-nc-4.0 | 1 | nc | {cc} by nc 4 0(?: international)?
cc-by-nc-3.0 | 1 | nc | {cc} by nc 3 0(?: unported)?
cc-by-nc-2.0 | 1 | nc | {cc} by nc 2 [05]
cc-by-nc | 2 | nc | {cc} by nc
cc-by-nc | 2 | noncommercial | attribution noncommercial(?: [1-4] [05])?
cc-by-nd-4.0 | 1 | nd | {cc} by nd 4 0(?: international)?
cc-by-nd-3.0 | 1 | nd | {cc} by nd 3 0(?: unported)?
cc-by-nd | 2 | nd | {cc} by nd
cc-by-nd | 2 | noderivatives | attribution noderivatives(?: [1-4] [05])?
cc-by-sa-4.0 | 1 | sa | {cc} by sa 4 0(?: international)?
cc-by-sa-3.0 | 1 | sa | {cc} by sa 3 0(?: unported)?
cc-by-sa-2.0 | 1 | sa | {cc} by sa 2 [05]
cc-by-sa | 2 | sa | {cc} by sa
cc-by-sa | 2 | sharealike | attribution sharealike(?: [1-4] [05])?
cc-by-4.0 | 1 | cc | cc by 4 0(?: international)?
cc-by-4.0 | 1 | commons | creative commons attribution 4 0(?: international)?
cc-by-3.0 | 1 | cc | cc by 3 0(?: unported)?
cc-by-3.0 | 1 | commons | creative commons attribution 3 0(?: unported)?
cc-by-2.0 | 1 | cc | cc by 2 [05]
cc-by-2.0 | 1 | commons | creative commons attribution 2 [05]
cc-by-1.0 | 1 | cc | cc by 1 0
cc-by-family | 2 | commons | creative commons attribution(?: {lic})?
cc-url | 1 | creativecommons | creativecommons org licenses by(?: nc)?(?: nd| sa)? [1-4] [05]
cc0-1.0 | 1 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 1 | creativecommons | creativecommons org publicdomain zero 1 0
cc-public-domain-mark | 1 | creativecommons | creativecommons org publicdomain mark 1 0
cc-family | 3 | commons | creative commons(?: {lic})?
mpl-2.0 | 1 | mozilla | mozilla public {lic}(?: mpl)?{v} 2(?: 0)?
mpl-2.0 | 1 | mpl | mpl{v} 2(?: 0)?
mpl-2.0 | 1 | mozilla | this source code form is subject to the terms of the mozilla public {lic}
mpl-1.1 | 1 | mozilla | mozilla public {lic}(?: mpl)?{v} 1 1
mpl-1.1 | 1 | mpl | mpl{v} 1 1
mpl-1.0 | 1 | mozilla | mozilla public {lic}{v} 1 0
mpl-family | 2 | mozilla | mozilla public {lic}
npl-1.1 | 1 | netscape | netscape public {lic}{v} 1 [01]
epl-2.0 | 1 | eclipse | eclipse public {lic}(?: epl)?{v} 2(?: 0)?
epl-2.0 | 1 | epl | epl{v} 2(?: 0)?
epl-1.0 | 1 | eclipse | eclipse public {lic}(?: epl)?{v} 1(?: 0)?
epl-1.0 | 1 | epl | epl{v} 1(?: 0)?
epl-family | 2 | eclipse | eclipse public {lic}
edl-1.0 | 1 | eclipse | eclipse distribution {lic}(?:{v} 1(?: 0)?)?
cpl-1.0 | 1 | common | common public {lic}(?:{v} 1(?: 0)?)?
ipl-1.0 | 1 | ibm | ibm public {lic}(?:{v} 1(?: 0)?)?
cddl-1.1 | 1 | cddl | cddl{v} 1 1
cddl-1.0 | 1 | cddl | cddl{v} 1(?: 0)?
cddl-family | 2 | distribution | common development and distribution {lic}
cddl-family | 2 | cddl | cddl
cpal-1.0 | 1 | attribution | common public attribution {lic}(?:{v} 1(?: 0)?)?
eupl-1.2 | 1 | eupl | eupl{v} 1 2
eupl-1.1 | 1 | eupl | eupl{v} 1 1
eupl-family | 2 | european | european union public {lic}
artistic-2.0 | 1 | artistic | artistic {lic}{v} 2(?: 0)?
artistic-1.0 | 1 | artistic | artistic {lic}{v} 1(?: 0)?
artistic-family | 2 | artistic | artistic {lic}
perl | 2 | perl | same terms as perl(?: itself)?
psf-2.0 | 2 | python | python software foundation {lic}(?:{v} 2(?: 0)?)?
python | 2 | python | python {lic}
ruby | 2 | ruby | ruby {lic}
php-3.01 | 1 | php | php {lic}{v} 3(?: 01?)?
zlib | 1 | anyone | permission is granted to anyone to use this software for any purpose including commercial applications
zlib | 2 | zlib | zlib(?: libpng)? {lic}
libpng | 2 | libpng | libpng {lic}
bsl-1.0 | 1 | boost | boost software {lic}(?:{v} 1(?: 0)?)?
unlicense | 1 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | (?:the )?unlicense
wtfpl | 1 | wtfpl | wtfpl(?:{v} 2)?
wtfpl | 1 | want | do what the f\w+ you want to public {lic}
ofl-1.1 | 1 | sil | sil open font {lic}(?:{v} 1 1)?
ofl-1.1 | 1 | ofl | ofl{v} 1 1
vim | 2 | vim | vim {lic}
openssl | 2 | openssl | openssl {lic}
postgresql | 2 | postgresql | postgresql {lic}
ncsa | 2 | ncsa | (?:university of illinois )?ncsa(?: open source)? {lic}
w3c | 2 | w3c | w3c software(?: notice and)? {lic}
ms-pl | 2 | microsoft | microsoft public {lic}
ms-rl | 2 | microsoft | microsoft reciprocal {lic}
afl-3.0 | 1 | academic | academic free {lic}(?:{v} 3(?: 0)?)?
osl-3.0 | 1 | osl | osl{v} 3(?: 0)?
osl-3.0 | 2 | open | open software {lic}(?:{v} 3(?: 0)?)?
apsl-2.0 | 2 | apple | apple public source {lic}(?:{v} [12](?: \d)?)?
qpl-1.0 | 2 | public | q public {lic}
sleepycat | 2 | sleepycat | sleepycat(?: software)? {lic}
sspl-1.0 | 1 | side | server side public {lic}(?:{v} 1)?
sspl-1.0 | 1 | sspl | sspl(?:{v} 1(?: 0)?)?
busl-1.1 | 1 | business | business source {lic}(?:{v} 1 1)?
elastic-2.0 | 1 | elastic | elastic {lic}(?:{v} 2(?: 0)?)?
commons-clause | 2 | clause | commons clause(?: {lic} condition)?
polyform | 2 | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter)(?: {lic})?
openrail | 2 | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: {lic})?
rail | 2 | responsible | responsible ai {lic}
llama | 2 | llama | llama [23](?: [123])? community {lic}
odbl-1.0 | 1 | database | open (?:data commons open )?database {lic}
odbl-1.0 | 1 | odbl | odbl(?:{v} 1(?: 0)?)?
odc-by-1.0 | 1 | odc | odc by(?: 1 0)?
odc-by-1.0 | 1 | data | open data commons attribution {lic}
pddl-1.0 | 1 | dedication | public domain dedication and {lic}
cern-ohl-2.0 | 1 | cern | cern open hardware {lic}(?:{v} 2)?
tapr-ohl-1.0 | 2 | tapr | tapr open hardware {lic}
solderpad-2.1 | 2 | solderpad | solderpad hardware {lic}(?:{v} [02](?: \d+)?)?
beerware | 2 | beerware | (?:the )?beerware {lic}
json | 1 | evil | the software shall be used for good not evil
ftl | 2 | freetype | freetype(?: project)? {lic}
icu | 2 | icu | icu {lic}
unicode | 2 | unicode | unicode(?: inc)? {lic}(?: agreement)?
openldap | 2 | openldap | openldap public {lic}
lppl-1.3c | 2 | latex | latex project public {lic}(?:{v} 1(?: 3c?)?)?
cecill | 2 | cecill | cecill(?: [abc])?(?: {lic})?
mulanpsl-2.0 | 2 | mulan | mulan (?:permissive software|psl)(?:{v} 2)?
hippocratic | 2 | hippocratic | hippocratic {lic}(?:{v} [123])?
blueoak-1.0.0 | 2 | oak | blue oak model {lic}
upl-1.0 | 2 | universal | universal permissive {lic}
rpl-1.5 | 2 | reciprocal | reciprocal public {lic}(?:{v} 1 [15])?
sissl | 2 | sun | sun industry standards source {lic}
zpl-2.1 | 2 | zope | zope public {lic}(?:{v} 2(?: [01])?)?
nasa-1.3 | 2 | nasa | nasa open source agreement
ogl-uk-3.0 | 2 | government | open government {lic}(?:{v} [123](?: 0)?)?
etalab-2.0 | 2 | etalab | etalab(?: open)? {lic}|licence ouverte etalab
public-domain | 2 | domain | (?:released|placed|dedicated)(?: in)?(?: to)? the public domain
public-domain | 3 | domain | public domain
proprietary | 2 | proprietary | (?:confidential and proprietary|proprietary and confidential)
proprietary | 2 | unauthorized | unauthorized (?:copying|reproduction|use) (?:\w+ ){0,6}is strictly prohibited
all-rights-reserved | 3 | reserved | all rights reserved
copyright-notice | 3 | copyright | copyright (?:c )?(?:19|20)\d\d
licensed-under | 3 | licensed | licensed under(?: the)?(?: terms of)?(?: the)?
license-file | 3 | license | see (?:the )?(?:accompanying )?license(?: file| txt| md)
free-to-use | 3 | free | free for (?:personal|commercial|non commercial|noncommercial) use
"""


@dataclass(frozen=True)
class Rule:
    label: str
    rank: int
    keyword: str
    pattern: str
    base: bool = False

    @property
    def score(self) -> float:
        return SCORES[self.rank]


def _read(lines: str, base: bool) -> list[Rule]:
    out = []
    for line in filter(None, lines.splitlines()):
        label, rank, keyword, pattern = line.split(" | ", 3)
        for short, long in SHORT.items():
            pattern = pattern.replace(short, long)
        out.append(Rule(label, int(rank), keyword, f"(?<= )(?:{pattern.strip()})(?= )", base))
    return out


def _tags(rules: list[Rule]) -> list[Rule]:
    """A rule for each label behind the tag of machine-readable identifiers."""
    labels = dict.fromkeys(r.label for r in rules if not r.label.endswith(("-family", "-url", "-text")) and r.rank < 3)
    return [Rule(x, 0, "spdx", f"(?<= )(?:spdx license identifier {re.sub('[^a-z0-9]+', ' ', x)})(?= )") for x in labels]


_hand = _read(BASE, True) + _read(SIGNATURES, False)
#: All rules in order: identifiers behind their tag, the longest first, and those written by hand.
RULES: tuple[Rule, ...] = (*sorted(_tags(_hand), key=lambda r: (-len(r.label), r.label)), *_hand)
