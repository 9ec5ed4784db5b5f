"""Signatures of licences, over lower-cased words joined by single blanks.

A line is ``label | keyword | pattern``. The keyword is a piece of plain text that every match of the pattern holds:
texts without it never meet the pattern. Order is priority: earlier lines win over later ones. Punctuation is a blank,
so "version 2.0" reads "version 2 0" and a link reads as its words. Gaps are bounded.
"""

#: Wordings of notices and texts, each only used by its licence.
NOTICES = r"""
apache-2.0 | apache | licensed under the apache licen[sc]e,?(?: version)? 2(?: 0)?
apache-2.0 | apache | licensed to the apache software foundation(?: asf)? under one or more contributor licen[sc]e agreements
apache-2.0 | apache | http www apache org licenses license 2 0(?: txt| html)?
apache-2.0 | apache | apache licen[sc]e version 2 0 january 2004
apache-1.1 | apache | apache software licen[sc]e version 1 1
apache-1.0 | apache | apache software licen[sc]e version 1 0
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | mit licen | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e
mit | opensource org | opensource org licenses mit(?: license)?(?: php| html)?
mit-0 | mit no attribution | mit no attribution(?: licen[sc]e)?
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used
isc | permission to use copy modify and | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | permission to use copy modify | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
bsd-3-clause | endorse or promote | neither the names? of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products
bsd-2-clause | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | bsd | opensource org licenses bsd 3 clause
bsd-2-clause | bsd | opensource org licenses bsd 2 clause
0bsd | bsd | zero clause bsd(?: licen[sc]e)?|bsd zero clause(?: licen[sc]e)?
bsd-3-clause-clear | bsd | (?:the )?clear bsd licen[sc]e
agpl-3.0 | affero general public | gnu affero general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3(?: 0)?
agpl-1.0 | affero general public | affero general public licen[sc]e v(?:ersion )?1(?: 0)?
lgpl-3.0 | lesser general public | gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3(?: 0)?
lgpl-2.1 | lesser general public | gnu lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2 1
lgpl-2.0 | library general public | gnu library general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: v(?:ersion )?2(?: 0)?)?
gpl-3.0 | general public licen | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3(?: 0)?
gpl-2.0 | general public licen | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2(?: 0)?
gpl-1.0 | general public licen | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?1(?: 0)?
agpl-3.0 | gnu org licenses | (?:http |https )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
lgpl-2.1 | gnu org licenses | (?:http |https )?(?:www )?gnu org licenses(?: old licenses)? lgpl 2 1(?: html| txt)?
lgpl-3.0 | gnu org licenses | (?:http |https )?(?:www )?gnu org licenses lgpl(?: 3 0)?(?: html| txt)?
gpl-2.0 | gnu org licenses | (?:http |https )?(?:www )?gnu org licenses(?: old licenses)? gpl 2 0(?: html| txt)?
gpl-3.0 | gnu org licenses | (?:http |https )?(?:www )?gnu org licenses gpl(?: 3 0)?(?: html| txt)?
gpl-2.0-classpath | classpath | gnu general public licen[sc]e(?: version)? 2(?: 0)? with(?: the)? classpath exception
gpl-classpath-exception | as a special exception | as a special exception the copyright holders of this library give you permission to link this library
gpl-bison-exception | bison | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gcc-runtime-exception | runtime library exception | gcc runtime library exception(?: v(?:ersion )?3 1)?
gfdl-1.3 | free documentation | gnu free documentation licen[sc]e v(?:ersion )?1 3
gfdl-1.2 | free documentation | gnu free documentation licen[sc]e v(?:ersion )?1 2
gfdl-1.1 | free documentation | gnu free documentation licen[sc]e v(?:ersion )?1 1
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-2.0 | mozilla | (?:https |http )?(?:www )?mozilla org mpl 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl-1.1 | mozilla | (?:https |http )?(?:www )?mozilla org mpl(?: mpl)? 1 1(?: html)?
mpl-2.0-no-copyleft-exception | incompatible with secondary | this source code form is incompatible with secondary licenses
epl-2.0 | eclipse | (?:https |http )?(?:www )?eclipse org legal epl (?:v20|2 0|v2 0)(?: html)?
epl-1.0 | eclipse | (?:https |http )?(?:www )?eclipse org legal epl (?:v10|1 0|v1 0)(?: html)?
edl-1.0 | eclipse | eclipse distribution licen[sc]e(?: v(?:ersion )?1 0)?
cddl-1.1 | common development and distribution | common development and distribution licen[sc]e(?: cddl)? v(?:ersion )?1 1
cddl-1.0 | common development and distribution | common development and distribution licen[sc]e(?: cddl)?(?: v(?:ersion )?1 0)?
cc0-1.0 | creativecommons | (?:https |http )?creativecommons org publicdomain zero 1 0(?: legalcode)?
cc-pdm-1.0 | creativecommons | (?:https |http )?creativecommons org publicdomain mark 1 0
unlicense | released into the public domain | this is free and unencumbered software released into the public domain
unlicense | unlicense | (?:https |http )?(?:www )?unlicense org
wtfpl | do what the fuck | do what the fuck you want to public licen[sc]e
zlib | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
bsl-1.0 | boost | boost software licen[sc]e version 1 0
bsl-1.0 | boost | (?:https |http )?(?:www )?boost org license 1 0(?: txt)?
artistic-2.0 | artistic | artistic licen[sc]e 2 0|artistic licen[sc]e version 2 0
artistic-1.0 | artistic | (?:clarified )?artistic licen[sc]e(?: version)? 1 0
perl-5 | same terms as perl | (?:under )?the same terms as perl itself
python-2.0 | python software foundation | python software foundation licen[sc]e(?: agreement)?(?: for python [0-9])?(?: version 2)?
postgresql | postgresql | (?:released|licensed|distributed) under the postgresql licen[sc]e
openssl | openssl | this product includes software developed by the openssl project
ssleay | eric young | this product includes cryptographic software written by eric young
php-3.01 | php | php licen[sc]e(?: v(?:ersion )?)? ?3 01
php-3.0 | php | php licen[sc]e(?: v(?:ersion )?)? ?3 0
w3c | w3c | w3c software(?: and document)? (?:notice and )?licen[sc]e
ofl-1.1 | open font | sil open font licen[sc]e(?: v(?:ersion )?1 1)?
ofl-1.1 | scripts sil org | (?:https |http )?scripts sil org ofl
ms-pl | microsoft | microsoft public licen[sc]e(?: ms pl)?
ms-rl | microsoft | microsoft reciprocal licen[sc]e(?: ms rl)?
eupl-1.2 | european union public | european union public licen[sc]e(?: eupl)? v(?:ersion )?1 2
eupl-1.1 | european union public | european union public licen[sc]e(?: eupl)? v(?:ersion )?1 1
cecill-2.1 | cecill | cecill(?: free software licen[sc]e)?(?: agreement)? v(?:ersion )?2 1
cecill-b | cecill | cecill b(?: free software licen[sc]e)?
cecill-c | cecill | cecill c(?: free software licen[sc]e)?
odbl-1.0 | open database | open data commons open database licen[sc]e|open database licen[sc]e(?: odbl)?(?: v(?:ersion )?1 0)?
pddl-1.0 | public domain dedication | open data commons public domain dedication(?: and)? licen[sc]e(?: pddl)?
odc-by-1.0 | open data commons | open data commons attribution licen[sc]e(?: odc by)?(?: v(?:ersion )?1 0)?
cdla-permissive-2.0 | community data | community data licen[sc]e agreement permissive(?: version)? 2 0
cdla-permissive-1.0 | community data | community data licen[sc]e agreement permissive(?: version)? 1 0
cdla-sharing-1.0 | community data | community data licen[sc]e agreement sharing(?: version)? 1 0
ogl-uk-3.0 | open government | open government licen[sc]e(?: for public sector information)? v(?:ersion )?3(?: 0)?
ogl-uk-2.0 | open government | open government licen[sc]e(?: for public sector information)? v(?:ersion )?2(?: 0)?
sspl-1.0 | server side public | server side public licen[sc]e(?: v(?:ersion )?1(?: 0)?)?
busl-1.1 | business source | business source licen[sc]e(?: v(?:ersion )?)?(?: ?1 1)?
elastic-2.0 | elastic | elastic licen[sc]e(?: v(?:ersion )?)? ?2(?: 0)?
commons-clause | commons clause | commons clause(?: licen[sc]e)? condition(?: v(?:ersion )?1 0)?
polyform-noncommercial-1.0.0 | polyform | polyform noncommercial licen[sc]e(?: 1 0 0)?
polyform-small-business-1.0.0 | polyform | polyform small business licen[sc]e(?: 1 0 0)?
openrail-m | openrail | (?:creativeml )?openrail m(?: licen[sc]e)?
bigscience-rail-1.0 | bigscience | bigscience (?:bloom )?rail(?: licen[sc]e)?(?: v?1 0)?
llama-2-community | llama 2 | llama 2 community licen[sc]e(?: agreement)?
llama-3-community | llama 3 | llama 3(?: [0-9])? community licen[sc]e(?: agreement)?
ncsa | ncsa | university of illinois ncsa open source licen[sc]e|illinois ncsa open source licen[sc]e
afl-3.0 | academic free | academic free licen[sc]e(?: v(?:ersion )?)? ?3 0
afl-2.1 | academic free | academic free licen[sc]e(?: v(?:ersion )?)? ?2 1
osl-3.0 | open software licen | open software licen[sc]e(?: v(?:ersion )?)? ?3 0
cpl-1.0 | common public | common public licen[sc]e(?: v(?:ersion )?)?(?: ?1 0)?
ipl-1.0 | ibm public | ibm public licen[sc]e(?: v(?:ersion )?)?(?: ?1 0)?
qpl-1.0 | q public | q public licen[sc]e(?: v(?:ersion )?)?(?: ?1 0)?
lppl-1.3c | latex project public | latex project public licen[sc]e(?: either)? v(?:ersion )?1 3c?
upl-1.0 | universal permissive | universal permissive licen[sc]e(?: upl)?(?: v(?:ersion )?)?(?: ?1 0)?
ecl-2.0 | educational community | educational community licen[sc]e(?: v(?:ersion )?)?(?: ?2 0)?
mulan-psl-2.0 | mulan | mulan (?:psl|permissive software licen[sc]e) ?v?2(?: 0)?
vim | vim licen | vim licen[sc]e
ruby | ruby licen | (?:under )?(?:the )?ruby licen[sc]e
blueoak-1.0.0 | blue oak | blue oak model licen[sc]e(?: 1 0 0)?
hippocratic-2.1 | hippocratic | hippocratic licen[sc]e(?: v(?:ersion )?)?(?: ?2 1)?
json | for good not evil | the software shall be used for good not evil
beerware | beer | beer ?ware licen[sc]e|buy me a beer in return
public-domain | public domain | (?:dedicated|released|placed|put|donated) (?:in)?to the public domain
public-domain | public domain | (?:this (?:work|file|text|software) is )in the public domain
us-government-work | work of the | work of the (?:united states|u s|us) government
non-commercial | commercial | (?:for )?non ?commercial (?:use|purposes?) only
no-derivatives | derivative | no derivative works (?:are )?(?:allowed|permitted)
proprietary | proprietary | (?:confidential and proprietary|proprietary and confidential)
proprietary | unauthorized | unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: or distribution)? of this (?:file|work|document|material|text)(?: via any medium)? is (?:strictly )?prohibited
proprietary | may not be reproduced | (?:may not|no part of this [^ ]+ may) be reproduced(?: [^ ]+){0,12} without(?: the)?(?: prior| express)?(?: written)? permission
"""

#: Names without a notice around them; any notice that holds one wins.
NAMES = r"""
apache-2.0 | apache | apache(?: software)? licen[sc]e(?: version| v)? ?2(?: 0)?
apache-2.0 | apache 2 | apache 2(?: 0)?(?: licen[sc]ed?)?
apache | apache | apache(?: software)? licen[sc]e
mit | mit licen | (?:the )?mit licen[sc]ed?
mit | expat | (?:the )?expat licen[sc]e
isc | isc licen | (?:the )?isc licen[sc]e
bsd-3-clause | bsd | bsd(?: licen[sc]e)? 3 clause|(?:3|three) clause bsd(?: licen[sc]e)?|(?:new|modified|revised) bsd licen[sc]e
bsd-2-clause | bsd | bsd(?: licen[sc]e)? 2 clause|(?:2|two) clause bsd(?: licen[sc]e)?|simplified bsd licen[sc]e|freebsd licen[sc]e
bsd-4-clause | bsd | bsd(?: licen[sc]e)? 4 clause|(?:4|four) clause bsd(?: licen[sc]e)?|original bsd licen[sc]e
bsd | bsd | bsd(?: style)? licen[sc]ed?
agpl-3.0 | agpl | agpl ?v?3(?: 0)?(?: only| or later)?
agpl | agpl | agpl
agpl | affero general public | (?:gnu )?affero general public licen[sc]e
lgpl-3.0 | lgpl | lgpl ?v?3(?: 0)?(?: only| or later)?
lgpl-2.1 | lgpl | lgpl ?v?2 1(?: only| or later)?
lgpl | lgpl | lgpl
lgpl | lesser general public | (?:gnu )?lesser general public licen[sc]e
gpl-3.0 | gpl | gpl ?v?3(?: 0)?(?: only| or later)?
gpl-2.0 | gpl | gpl ?v?2(?: 0)?(?: only| or later)?
gpl-1.0 | gpl | gpl ?v?1(?: 0)?(?: only| or later)?
gpl | gpl | gpl
gpl | general public licen | (?:gnu )?general public licen[sc]e
gfdl | free documentation | (?:gnu )?free documentation licen[sc]e
gfdl | gfdl | gfdl
mpl-2.0 | mozilla | mozilla public licen[sc]e(?: v(?:ersion )?)? ?2(?: 0)?
mpl-1.1 | mozilla | mozilla public licen[sc]e(?: v(?:ersion )?)? ?1 1
mpl | mozilla | mozilla public licen[sc]e
mpl-2.0 | mpl 2 | mpl 2(?: 0)?
epl-2.0 | eclipse | eclipse public licen[sc]e(?: v(?:ersion )?)? ?2(?: 0)?
epl-1.0 | eclipse | eclipse public licen[sc]e(?: v(?:ersion )?)? ?1(?: 0)?
epl | eclipse | eclipse public licen[sc]e
cddl | cddl | cddl(?: 1 [01])?
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | creative commons | creative commons zero(?: v?1 0)?(?: universal)?
boost | boost | boost(?: software)? licen[sc]e
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
zlib | zlib | zlib(?: libpng)? licen[sc]e
artistic | artistic | artistic licen[sc]e
psf | psf licen | psf licen[sc]e
ofl | open font | open font licen[sc]e
eupl | eupl | eupl
cecill | cecill | cecill
odbl | odbl | odbl
postgresql | postgresql | postgresql licen[sc]e
ogl | open government | open government licen[sc]e
sspl-1.0 | sspl | sspl
creative-commons | creative commons | creative commons(?: [^ ]+){0,3} licen[sc]e
creative-commons | creativecommons | creativecommons org
"""

#: Signs of a licence or a right, without a name.
HINTS = r"""
notice | copyright | copyright(?: c)?(?: [0-9]{4})+
notice | copyright | copyright c
notice | rights reserved | some rights reserved
notice | licensed under | licensed under(?: the)?(?: terms of)?(?: the)?
notice | licence | see(?: the)?(?: file)? licence(?: file)? for (?:details|more)
notice | license | see(?: the)?(?: file)? license(?: file)? for (?:details|more)
notice | subject to the | subject to the (?:terms|following) (?:of|conditions)
notice | terms of use | terms of use
notice | trademark | (?:are|is)(?: a)?(?: registered)? trademarks? of
"""

#: Words of Creative Commons licences in their order; their rules come from ``creative_commons``.
CC_KINDS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Fixed phrases and their labels: every place counts, whatever else is found there.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: What a kind of signature is worth as evidence, in order of priority.
WORTH = {"tag": 0.99, "notice": 0.95, "name": 0.8, "hint": 0.4, "base": 0.7}


def parsed(lines: str, kind: str) -> list[tuple[str, str, str, str]]:
    return [(kind, *(x.strip() for x in line.split("|", 2))) for line in lines.strip().splitlines()]


def creative_commons() -> list[tuple[str, str, str, str]]:
    """Abbreviations, names and links of each kind, in each version and without one; longer kinds before shorter."""
    out = []
    for kind in sorted(CC_KINDS, key=len, reverse=True):
        label, name = f"cc-{kind.replace(' ', '-')}", " ".join(CC_NAMES[x] for x in kind.split())
        for version in CC_VERSIONS:
            exact = f"{label}-{version.replace(' ', '.')}"
            out.append(("notice", exact, "cc by", f"cc {kind}(?: licen[sc]e)? {version}"))
            out.append(("notice", exact, "creative commons", f"creative commons {name}(?: licen[sc]e)? {version}(?: international| unported| generic)?(?: licen[sc]e)?"))
            out.append(("notice", exact, "creativecommons org", f"(?:https |http )?creativecommons org licenses {kind} {version}"))
        out.append(("name", label, "cc by", f"cc {kind}(?: licen[sc]e)?"))
        out.append(("name", label, "creative commons", f"creative commons {name}(?: licen[sc]e)?"))
    return out


def tags(labels: list[str]) -> list[tuple[str, str, str, str]]:
    """The machine-readable line of each licence that has an identifier of its own."""
    return [("tag", x, "spdx license identifier", f"spdx license identifier {x.replace('-', ' ').replace('.', ' ')}(?: only| or later)?") for x in labels]


def rules() -> list[tuple[str, str, str, str]]:
    """(kind, label, keyword, pattern) of every rule, first in priority first; the base phrases come last."""
    made, names = creative_commons(), parsed(NAMES, "name")
    notices = parsed(NOTICES, "notice") + [x for x in made if x[0] == "notice"]
    names = [x for x in made if x[0] == "name"] + names
    labels = sorted({x[1] for x in notices + names}, key=lambda x: (-len(x), x))
    base = [("base", label, phrase, phrase) for phrase, label in BASE]
    return tags(labels) + notices + names + parsed(HINTS, "hint") + base
