"""The signature rules of the license scan, in order: label, rank, keyword, pattern over words.

Patterns match lower-case words that single spaces part, whole words only, so `gpl-3.0` is `gpl 3 0`. A rule is looked at only
where its keyword occurs. Ranks: 1 text of a grant, 2 a version or an identifier, 3 a name, 4 a hint. {L} stands for license or licence,
{V} for an optional word before a version.
"""

from __future__ import annotations

from dataclasses import dataclass

L, V = "licen[cs]e", "(?: version| ver| v)?"

PERMISSIVE = """
mit | 1 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 1 | copies | to use copy modify merge publish distribute sublicen[cs]e and or sell copies
mit | 2 | identifier mit | spdx {L} identifier mit
mit | 3 | mit | mit {L}
mit | 3 | mit | licen[cs]ed under (?:the )?mit
mit | 3 | mit | (?:released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit {L}
mit | 3 | expat | expat {L}
mit | 3 | x11 | (?:mit )?x11 {L}
mit-0 | 2 | no attribution | mit no attribution
mit-0 | 2 | mit 0 | (?:spdx {L} identifier mit 0|mit 0 {L})
isc | 1 | with or without fee is hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | spdx {L} identifier isc
isc | 3 | isc | isc {L}
0bsd | 2 | 0bsd | (?:spdx {L} identifier 0bsd|0bsd {L}|licen[cs]ed under (?:the )?0bsd)
0bsd | 2 | zero clause bsd | zero clause bsd {L}
bsd | 1 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd | 3 | bsd | bsd (?:style )?{L}
bsd | 3 | bsd | licen[cs]ed under (?:the |a )?bsd
bsd-1-clause | 2 | bsd 1 clause | bsd 1 clause(?: {L})?
bsd-2-clause | 2 | bsd 2 clause | bsd 2 clause(?: {L})?
bsd-2-clause | 2 | clause bsd | (?:2|two) clause bsd(?: {L})?
bsd-2-clause | 2 | simplified bsd | simplified bsd {L}
bsd-2-clause | 2 | freebsd | freebsd {L}
bsd-3-clause | 1 | endorse or promote products derived | (?:neither the name of|the names? of) (?:[^ ]+ ){1,8}(?:may )?(?:be )?used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 2 | bsd 3 clause | bsd 3 clause(?: {L})?
bsd-3-clause | 2 | clause bsd | (?:3|three) clause bsd(?: {L})?
bsd-3-clause | 2 | bsd | (?:new|modified|revised) bsd {L}
bsd-3-clause-clear | 2 | clear | (?:bsd 3 clause clear(?: {L})?|clear bsd {L})
bsd-4-clause | 1 | advertising materials | all advertising materials mentioning features or use of this software must display
bsd-4-clause | 2 | bsd 4 clause | bsd 4 clause(?: {L})?
bsd-4-clause | 2 | original bsd | original bsd {L}
apache-1.0 | 2 | apache | apache (?:software )?{L}{V} 1 0
apache-1.1 | 2 | apache | apache (?:software )?{L}{V} 1 1
apache-2.0 | 1 | you may not use this file except | licen[cs]ed under the apache {L} version 2 0 the {L} you may not use this file except in compliance with the {L}
apache-2.0 | 2 | apache | apache (?:software )?{L}{V} 2(?: 0)?
apache-2.0 | 2 | apache 2 | (?:spdx {L} identifier apache 2 0|apache 2(?: 0)? {L}|licen[cs]ed under (?:the )?apache 2(?: 0)?)
apache-2.0 | 2 | www apache org | www apache org licenses license 2 0
apache | 3 | apache | apache (?:software |public )?{L}
apache | 3 | apache | licen[cs]ed under (?:the )?apache
zlib | 1 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 2 | zlib | spdx {L} identifier zlib
zlib | 3 | zlib | zlib(?: libpng)? {L}
libpng | 3 | png | (?:the )?png reference library {L}|libpng {L}
bsl-1.0 | 1 | boost | boost software {L} version 1 0
bsl-1.0 | 2 | bsl 1 0 | (?:spdx {L} identifier bsl 1 0|bsl 1 0 {L})
bsl-1.0 | 3 | boost | boost (?:software )?{L}
unlicense | 1 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 3 | unlicense | (?:the )?unlicense
wtfpl | 1 | what the fuck | do what the fuck you want to(?: public {L})?
wtfpl | 3 | wtfpl | wtfpl
afl-3.0 | 2 | academic free | academic free {L}{V} 3 0
afl-2.1 | 2 | academic free | academic free {L}{V} 2 1
afl | 3 | academic free | academic free {L}
artistic-1.0 | 2 | artistic | artistic {L}{V} 1 0
artistic-2.0 | 2 | artistic | artistic {L}{V} 2 0
artistic | 3 | artistic | (?:perl )?artistic {L}
postgresql | 3 | postgresql | postgresql {L}
python | 2 | python software foundation | python software foundation {L}{V}(?: 2)?
python | 3 | python | python {L}
python | 3 | psf | psf {L}
ruby | 3 | ruby | ruby(?: s)? {L}
php | 2 | php | php {L}{V} 3 01?
php | 3 | php | php {L}
openssl | 3 | openssl | openssl (?:combined )?{L}
ssleay | 3 | ssleay | (?:original )?ssleay {L}
w3c | 3 | w3c | w3c (?:software )?(?:notice and )?{L}
ncsa | 3 | ncsa | (?:university of illinois )?ncsa (?:open source )?{L}
ncsa | 3 | university of illinois | university of illinois (?:open source )?{L}
upl-1.0 | 2 | universal permissive | universal permissive {L}(?:{V} 1 0)?
blueoak-1.0.0 | 2 | blue oak | blue oak model {L}(?:{V} 1 0 0)?
mulan-psl-2.0 | 2 | mulan | mulan (?:psl|permissive software {L}){V} 2
mulan-psl | 3 | mulan | mulan permissive software {L}
ecl-2.0 | 2 | educational community | educational community {L}(?:{V} 2 0)?
efl-2.0 | 2 | eiffel forum | eiffel forum {L}(?:{V} 2)?
fair | 3 | fair | fair {L}
beerware | 3 | beer | (?:the )?beer ?ware {L}(?: revision 42)?
curl | 3 | curl | curl {L}
icu | 3 | icu | icu {L}
unicode | 3 | unicode | unicode (?:data files and software )?{L}(?: agreement)?
vim | 3 | vim | vim {L}
tcl | 3 | tcl | tcl(?: tk)? {L}
x-consortium | 3 | x consortium | x consortium {L}
hpnd | 3 | historical permission notice | historical permission notice and disclaimer(?: {L})?
ms-pl | 2 | microsoft public | microsoft public {L}
ms-rl | 2 | microsoft reciprocal | microsoft reciprocal {L}
naist-2003 | 3 | nara institute | nara institute of science and technology {L}
json | 1 | good not evil | the software shall be used for good not evil
json | 3 | json | json {L}
ofl-1.1 | 1 | sil open font | this font software is licen[cs]ed under the sil open font {L} version 1 1
ofl-1.1 | 2 | open font | (?:sil )?open font {L}{V} 1 1
ofl | 3 | open font | (?:sil )?open font {L}
ubuntu-font-1.0 | 2 | ubuntu font | ubuntu font {L}(?:{V} 1 0)?
"""

COPYLEFT = """
gpl | 1 | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu general public {L}
gpl | 3 | general public | (?:gnu )?general public {L}
gpl | 3 | gnu | gnu (?:public )?{L}
gpl | 3 | gpl | (?:gnu )?gpl {L}
gpl | 3 | gpl | licen[cs]ed under (?:the )?(?:gnu )?gpl
lgpl | 3 | lesser general public | (?:gnu )?lesser general public {L}
lgpl | 3 | library general public | (?:gnu )?library general public {L}
lgpl | 3 | lgpl | (?:gnu )?lgpl(?: {L})?
agpl | 3 | affero | (?:gnu )?affero (?:general )?public {L}
agpl | 3 | agpl | (?:gnu )?agpl(?: {L})?
gfdl | 3 | free documentation | (?:gnu )?free documentation {L}
gfdl-1.2 | 2 | free documentation | (?:gnu )?free documentation {L}{V} 1 2
gfdl-1.3 | 2 | free documentation | (?:gnu )?free documentation {L}{V} 1 3
gpl-exception-classpath | 2 | classpath | (?:gnu )?classpath exception
gpl-exception-gcc | 2 | gcc runtime | gcc runtime library exception
gpl-exception-font | 2 | font exception | gpl font exception
mpl-1.0 | 2 | mozilla public | mozilla public {L}{V} 1 0
mpl-1.1 | 2 | mozilla public | mozilla public {L}{V} 1 1
mpl-2.0 | 1 | mozilla public | this source code form is subject to the terms of the mozilla public {L} v 2 0
mpl-2.0 | 2 | mozilla public | mozilla public {L}{V} 2 0
mpl-2.0 | 2 | mpl 2 0 | (?:spdx {L} identifier mpl 2 0|mpl 2 0 {L}|licen[cs]ed under (?:the )?mpl 2 0)
mpl | 3 | mozilla public | mozilla public {L}
epl-1.0 | 2 | eclipse public | eclipse public {L}{V} 1 0
epl-2.0 | 2 | eclipse public | eclipse public {L}{V} 2 0
epl-2.0 | 2 | epl 2 0 | (?:spdx {L} identifier epl 2 0|epl 2 0 {L})
epl | 3 | eclipse public | eclipse public {L}
edl-1.0 | 2 | eclipse distribution | eclipse distribution {L}(?:{V} 1 0)?
cddl-1.0 | 2 | common development and distribution | common development and distribution {L}{V} 1 0
cddl-1.1 | 2 | common development and distribution | common development and distribution {L}{V} 1 1
cddl | 3 | common development and distribution | common development and distribution {L}
cddl | 3 | cddl | cddl {L}
cpl-1.0 | 2 | common public | common public {L}(?:{V} 1 0)
cpl | 3 | common public | common public {L}
ibmpl-1.0 | 2 | ibm public | ibm public {L}(?:{V} 1 0)?
eupl-1.1 | 2 | european union public | european union public {L}{V} 1 1
eupl-1.2 | 2 | european union public | european union public {L}{V} 1 2
eupl | 3 | european union public | european union public {L}
eupl | 3 | eupl | eupl {L}
osl-3.0 | 2 | open software | open software {L}{V} 3 0
osl | 3 | open software | open software {L}
qpl-1.0 | 2 | q public | q public {L}(?:{V} 1 0)?
sleepycat | 3 | sleepycat | sleepycat {L}
sissl | 3 | sun industry standards | sun industry standards source {L}
spl-1.0 | 2 | sun public | sun public {L}(?:{V} 1 0)?
npl-1.1 | 2 | netscape public | netscape public {L}(?:{V} 1 1)?
apsl-2.0 | 2 | apple public source | apple public source {L}(?:{V} 2 0)?
cecill-2.1 | 2 | cecill | cecill(?: free software)? {L}(?: agreement)?{V} 2 1
cecill-b | 2 | cecill b | cecill b(?: free software)? {L}(?: agreement)?
cecill-c | 2 | cecill c | cecill c(?: free software)? {L}(?: agreement)?
cecill | 3 | cecill | cecill(?: free software)? {L}
rpl-1.5 | 2 | reciprocal public | reciprocal public {L}(?:{V} 1 5)?
cpal-1.0 | 2 | common public attribution | common public attribution {L}(?:{V} 1 0)?
copyleft-next | 3 | copyleft next | copyleft next(?: 0 3 1)?(?: {L})?
copyleft | 4 | copyleft | (?:strong |weak )?copyleft
"""

LIMITED = """
bsl-1.1 | 2 | business source | business source {L}{V} 1 1
bsl | 3 | business source | business source {L}
sspl-1.0 | 2 | server side public | server side public {L}{V} 1
sspl | 3 | server side public | server side public {L}
elastic-2.0 | 2 | elastic | elastic {L}{V} 2 0
elastic | 3 | elastic | elastic {L}
commons-clause | 2 | commons clause | commons clause(?: {L} condition{V} 1 0)?
polyform-noncommercial | 2 | polyform noncommercial | polyform noncommercial {L}(?: 1 0 0)?
polyform-shield | 2 | polyform shield | polyform shield {L}(?: 1 0 0)?
polyform-small-business | 2 | polyform small business | polyform small business {L}(?: 1 0 0)?
prosperity | 3 | prosperity public | prosperity public {L}
parity | 3 | parity public | parity public {L}
hippocratic | 3 | hippocratic | hippocratic {L}
fsl-1.1 | 2 | functional source | functional source {L}(?:{V} 1 1)?
confluent | 3 | confluent community | confluent community {L}
timescale | 3 | timescale | timescale {L}
redis-source-available | 3 | redis source available | redis source available {L}
openrail-m | 2 | openrail m | (?:creative ml |bigscience |bigcode )?openrail m {L}
openrail | 3 | openrail | (?:bigscience )?openrail {L}
rail | 3 | responsible ai | responsible ai {L}
llama-community | 2 | llama | llama(?: 2| 3| 3 1| 3 2)? community {L}(?: agreement)?
gemma-terms | 3 | gemma | gemma (?:terms of use|{L})
odc-by-1.0 | 2 | open data commons attribution | open data commons attribution {L}(?:{V} 1 0)?
odc-by | 3 | odc by | odc by {L}
odbl-1.0 | 2 | open database | open (?:data commons open )?database {L}{V} 1 0
odbl | 3 | open database | (?:open data commons )?open database {L}
odbl | 3 | odbl | odbl {L}
pddl-1.0 | 2 | public domain dedication and | (?:open data commons )?public domain dedication and {L}(?:{V} 1 0)?
cdla-permissive | 2 | community data | community data {L} agreement permissive
cdla-sharing | 2 | community data | community data {L} agreement sharing
ogl-uk-3.0 | 2 | open government | open government {L}{V} 3 0
ogl-uk | 3 | open government | open government {L}
etalab-2.0 | 2 | licence ouverte | licence ouverte(?: open licence)?(?:{V} 2 0)?
dl-de-by-2.0 | 2 | datenlizenz deutschland | datenlizenz deutschland namensnennung(?:{V} 2 0)?
cc0-1.0 | 1 | to the extent possible under law | to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright and related or neighboring rights
cc0-1.0 | 2 | cc0 1 0 | cc0 1 0 universal(?: public domain dedication| {L})?
cc0-1.0 | 2 | cc0 | (?:spdx {L} identifier cc0 1 0|licen[cs]ed under (?:the )?cc0(?: 1 0)?|cc0(?: 1 0)? {L})
cc0 | 3 | cc0 | cc0 public domain(?: dedication)?
cc | 3 | creative commons | creative commons (?:public )?{L}
cc | 3 | commons org licenses | creativecommons org licenses
cc-pdm | 2 | public domain mark | public domain mark(?: 1 0)?
public-domain | 2 | dedicated to the public domain | (?:is|are|hereby|been) dedicated to the public domain
public-domain | 2 | public domain | (?:placed|released) (?:in|into) the public domain
public-domain | 3 | public domain | (?:is|are) in the public domain
public-domain | 4 | public domain | public domain
"""

NOTICES = """
all-rights-reserved | 2 | all rights reserved | copyright (?:[^ ]+ ){1,8}all rights reserved
all-rights-reserved | 3 | all rights reserved | all rights reserved
some-rights-reserved | 3 | some rights reserved | some rights reserved
no-rights-reserved | 3 | reserved | no (?:copyright|rights) reserved
proprietary | 1 | proprietary and confidential | (?:this (?:software|document|file|work) is )?proprietary and confidential
proprietary | 1 | unauthorized copying | unauthorized copying of this (?:file|software|document|work) via any medium is strictly prohibited proprietary
proprietary | 3 | proprietary | proprietary {L}
proprietary | 3 | end user | end user {L} agreement
proprietary | 3 | may not be reproduced | may not be reproduced (?:[^ ]+ ){0,10}without (?:the )?(?:prior |express |written ){0,3}permission
commercial | 3 | commercial | commercial {L}
non-commercial | 3 | non commercial | (?:for )?non commercial (?:use )?only {L}|non commercial {L}
non-commercial | 3 | noncommercial | noncommercial {L}
academic | 3 | academic | academic (?:use )?(?:only )?{L}
evaluation | 3 | evaluation | evaluation {L}
shareware | 3 | shareware | shareware {L}
freeware | 3 | freeware | freeware {L}
royalty-free | 3 | royalty free | royalty free {L}
perpetual | 4 | perpetual | perpetual (?:worldwide |non exclusive |irrevocable |royalty free ){0,4}{L}
patent-grant | 3 | patent | (?:grant of )?patent {L}
dual | 3 | dual | dual licen[cs]ed
multi | 3 | licensed under either | licensed under either of
warranty-disclaimer | 1 | without warranty of any kind | (?:is )?provided as is (?:and )?without warranty of any kind(?: express or implied)?
warranty-disclaimer | 3 | warranty | without (?:any )?(?:express or implied )?warranty
warranty-disclaimer | 3 | no warranty | absolutely no warranty
warranty-disclaimer | 3 | merchantability | implied warranty of merchantability or fitness for a particular purpose
attribution-required | 3 | attribution | attribution (?:is )?required
contributor-agreement | 3 | contributor | contributor {L} agreement
notice | 4 | see | see (?:the )?{L} (?:file )?for (?:more )?(?:details|information)
notice | 4 | full | (?:the )?full {L} text
licensed | 4 | licensed under | licensed under
licensed | 4 | licenced under | licenced under
licensed | 4 | terms of the | (?:under )?the terms of the {L}
spdx | 4 | spdx | spdx {L} identifier
copyright | 4 | copyright | copyright (?:c )?(?:19|20)[0-9][0-9]
"""


def _by_version() -> list[str]:
    """Families whose members differ by a version, by who may choose a later one, and by the conditions that they join."""
    out = []
    for short, name, versions in (("gpl", "general public", ("1", "2", "3")), ("lgpl", "(?:lesser|library) general public", ("2", "2.1", "3")), ("agpl", "affero general public", ("1", "3"))):
        word = name.split("|")[0].strip("(?:") if short != "lgpl" else "general public"
        for v in versions:
            said = v.replace(".", " ") + ("" if "." in v else "(?: 0)?")
            full = v if "." in v else f"{v}.0"
            later = f"{short}-{full}-or-later"
            out += [
                f"{short}-{full} | 2 | {word} | (?:gnu )?{name} {{L}}{{V}} {said}",
                f"{later} | 2 | {word} | (?:gnu )?{name} {{L}}{{V}} {said} or (?:at your option )?(?:any )?later(?: version)?",
                f"{later} | 1 | {word} | (?:either )?version {said} of the (?:gnu )?{name} {{L}} or (?:at your option )?any later version",
                f"{short}-{full} | 2 | {short} | (?:gnu )?{short}(?: v)? ?{said} {{L}}",
                f"{short}-{full} | 2 | {short} | (?:gnu )?{short} {{L}}{{V}} {said}",
                f"{short}-{full} | 2 | identifier {short} | spdx {{L}} identifier {short} {said}(?: only)?",
                f"{later} | 2 | identifier {short} | spdx {{L}} identifier {short} {said} or later",
                f"{short}-{full} | 2 | {short}v | {short}v{said}(?: {{L}})?",
            ]
    long = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s", "sa": "share ?alike"}
    for parts in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        label, short, name = "-".join(parts), " ".join(parts), " ".join(long[p] for p in parts)
        out += [
            f"cc-{label} | 3 | cc {short} | licen[cs]ed under (?:a |the )?cc {short}",
            f"cc-{label} | 3 | cc {short} | cc {short} {{L}}",
            f"cc-{label} | 3 | creative commons attribution | creative commons {name} {{L}}",
        ]
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            said = v.replace(".", " ")
            out += [
                f"cc-{label}-{v} | 2 | cc {short} {said} | (?:licen[cs]ed under (?:a |the )?cc {short} {said}|cc {short} {said} {{L}}|spdx {{L}} identifier cc {short} {said})",
                f"cc-{label}-{v} | 2 | creative commons attribution | creative commons {name} {said} (?:international |unported |generic )?{{L}}",
            ]
    return out


@dataclass(frozen=True)
class Rule:
    label: str
    rank: int
    keyword: str
    pattern: str


def rules() -> list[Rule]:
    """All rules in order: of rules of one rank the earlier one goes first."""
    lines = [x for part in (PERMISSIVE, COPYLEFT, LIMITED, NOTICES) for x in part.strip().splitlines()] + _by_version()
    out = []
    for line in lines:
        label, rank, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        out.append(Rule(label, int(rank), keyword, f"(?:{pattern})".replace("{L}", L).replace("{V}", V)))
    return out


#: Parts of words one of which stands in every match: a text without any of them is read no further.
STEMS = ("licen", "lizenz", "copyright", "copyleft", "warrant", "domain", "reserved", "wtfpl", "gpl", "clause", "proprietary", "redistribut", "advertising", "exception", "misrepresented", "evil", "attribution", "fuck", "gemma", "permission", "mulan", "cc0")
