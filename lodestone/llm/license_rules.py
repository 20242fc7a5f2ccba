"""The signature rules of the license scan, one a line, in order of groups.

A line is ``label | keywords | pattern``. Words are lower-cased and parted by one space, so "GPL-2.0+" reads "gpl 2 0" and
"GPLv2" reads "gplv2". A rule is tried where one of its keywords (parted by commas; a space is a word's edge) occurs; every
text that the pattern matches holds one of them. V stands for an optional "v", "version" or ", version".
"""

V = r"(?: v| version| ver)? ?v?"

#: Full names and their short forms. Confidence 0.8 alone; higher where a form of reference stands before them.
NAMES = r"""
AFL-2.1 | academic free | academic free licen[cs]eV2 1
AFL-3.0 | academic free | academic free licen[cs]eV3(?: 0)?
AFL | academic free | academic free licen[cs]e
AFL-3.0 | afl | aflV3(?: 0)?
AGPL-3.0 | affero | (?:gnu )?affero (?:general )?public licen[cs]eV3(?: 0)?
AGPL-1.0 | affero | affero general public licen[cs]eV1(?: 0)?
AGPL | affero | (?:gnu )?affero (?:general )?public licen[cs]e
AGPL-3.0 | agpl | (?:gnu )?agpl ?v?3(?: 0)?(?: only| or later)?
AGPL | agpl licen | agpl licen[cs]ed?
Aladdin | aladdin | aladdin free public licen[cs]e
Apache-1.0 | apache | apache (?:software )?licen[cs]eV1 0
Apache-1.1 | apache | apache (?:software )?licen[cs]eV1 1
Apache-2.0 | apache | apache (?:software )?licen[cs]eV2(?: 0)?
Apache-2.0 | apache | apache(?: v| version)? ?2(?: 0| licen[cs]ed?| 0 licen[cs]ed?)
Apache-2.0 | asl | aslV2(?: 0)?
Apache | apache software licen | apache software licen[cs]e
APSL-2.0 | apple public | apple public source licen[cs]eV2(?: 0)?
APSL | apple public | apple public source licen[cs]e
Artistic-1.0 | artistic | artistic licen[cs]eV1(?: 0)?
Artistic-2.0 | artistic | artistic licen[cs]eV2(?: 0)?
Artistic | artistic | (?:perl |clarified )?artistic licen[cs]e
Perl | terms as perl | same terms as perl(?: itself| 5)?
Beerware | beerware,beer ware | beer ?ware(?: licen[cs]e)?(?: revision 42)?
BitTorrent-1.1 | bittorrent | bittorrent open source licen[cs]eV1 1
Bouncy-Castle | bouncy castle | bouncy castle licen[cs]e
BSD-1-Clause | bsd,1 clause | (?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?
BSD-2-Clause | bsd | (?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
BSD-2-Clause-Patent | bsd | bsd 2 clause (?:plus )?patent(?: licen[cs]e)?
BSD-3-Clause | bsd | (?:bsd 3 clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
BSD-3-Clause-Clear | bsd | (?:clear bsd|bsd 3 clause clear)(?: licen[cs]e)?
BSD-4-Clause | bsd | (?:bsd 4 clause|(?:4|four) clause bsd|original bsd|old bsd)(?: licen[cs]e)?
BSD-0-Clause | bsd,free public | (?:0bsd|zero clause bsd|bsd zero clause|free public licen[cs]e 1 0 0)(?: licen[cs]e)?
BSD | bsd | bsd (?:style )?licen[cs]ed?
BSL-1.0 | boost | boost software licen[cs]e(?:V1(?: 0)?)?
BUSL-1.1 | business source | business source licen[cs]e(?:V1 1)?
BUSL-1.1 | busl | busl 1 1
CAL-1.0 | cryptographic | cryptographic autonomy licen[cs]e(?:V1(?: 0)?)?
CATOSL-1.1 | computer associates | computer associates trusted open source licen[cs]e 1 1
CC0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
CC0-1.0 | creative commons zero | creative commons zero(?:V1 0)?(?: universal)?
CC-PDDC | public domain dedication | creative commons public domain dedication(?: and certification)?
CC-BY-1.0 | creative commons | creative commons attribution 1 0(?: generic)?(?: licen[cs]e)?
CC-BY-2.0 | creative commons | creative commons attribution 2 0(?: generic)?(?: licen[cs]e)?
CC-BY-2.5 | creative commons | creative commons attribution 2 5(?: generic)?(?: licen[cs]e)?
CC-BY-3.0 | creative commons | creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?
CC-BY-4.0 | creative commons | creative commons attribution 4 0(?: international)?(?: public)?(?: licen[cs]e)?
CC-BY-SA-2.0 | creative commons | creative commons attribution share ?alike 2 0(?: generic)?(?: licen[cs]e)?
CC-BY-SA-2.5 | creative commons | creative commons attribution share ?alike 2 5(?: generic)?(?: licen[cs]e)?
CC-BY-SA-3.0 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?(?: licen[cs]e)?
CC-BY-SA-4.0 | creative commons | creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: licen[cs]e)?
CC-BY-NC-3.0 | creative commons | creative commons attribution non ?commercial 3 0(?: unported)?(?: licen[cs]e)?
CC-BY-NC-4.0 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?(?: licen[cs]e)?
CC-BY-ND-3.0 | creative commons | creative commons attribution no ?deriv(?:ative)?s? 3 0(?: unported)?(?: licen[cs]e)?
CC-BY-ND-4.0 | creative commons | creative commons attribution no ?deriv(?:ative)?s? 4 0(?: international)?(?: licen[cs]e)?
CC-BY-NC-SA-3.0 | creative commons | creative commons attribution non ?commercial share ?alike 3 0(?: unported)?(?: licen[cs]e)?
CC-BY-NC-SA-4.0 | creative commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: licen[cs]e)?
CC-BY-NC-ND-3.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s? 3 0(?: unported)?(?: licen[cs]e)?
CC-BY-NC-ND-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s? 4 0(?: international)?(?: licen[cs]e)?
CC | creative commons licen | creative commons licen[cs]e
CC-BY | cc by | cc by(?: licen[cs]e)?
CC-BY-3.0 | cc by | cc by 3 0
CC-BY-4.0 | cc by | cc by 4 0
CC-BY-SA-3.0 | cc by | cc by sa 3 0
CC-BY-SA-4.0 | cc by | cc by sa 4 0
CC-BY-NC-4.0 | cc by | cc by nc 4 0
CC-BY-ND-4.0 | cc by | cc by nd 4 0
CC-BY-NC-SA-4.0 | cc by | cc by nc sa 4 0
CC-BY-NC-ND-4.0 | cc by | cc by nc nd 4 0
CDDL-1.0 | common development | common development and distribution licen[cs]e(?:V1 0)?
CDDL-1.1 | common development | common development and distribution licen[cs]eV1 1
CDDL-1.0 | cddl | cddlV1(?: 0)?
CDDL-1.1 | cddl | cddlV1 1
CDLA-Permissive-2.0 | community data | community data licen[cs]e agreement permissive(?:V2(?: 0)?)?
CDLA-Sharing-1.0 | community data | community data licen[cs]e agreement sharing(?:V1(?: 0)?)?
CECILL-1.0 | cecill | cecill(?: licen[cs]e)?V1(?: 0)?
CECILL-2.0 | cecill | cecill(?: licen[cs]e)?V2(?: 0)?
CECILL-2.1 | cecill | cecill(?: licen[cs]e)?V2 1
CECILL-B | cecill | cecill b(?: licen[cs]e)?
CECILL-C | cecill | cecill c(?: licen[cs]e)?
CNRI-Python | cnri | cnri (?:python )?(?:open source )?licen[cs]e
CPAL-1.0 | common public attribution | common public attribution licen[cs]e(?:V1(?: 0)?)?
CPL-1.0 | common public licen | common public licen[cs]e(?:V1(?: 0)?)?
CPOL-1.02 | code project | code project open licen[cs]e(?:V1 02)?
Condor-1.1 | condor | condor public licen[cs]e(?:V1 1)?
curl | curl licen | curl licen[cs]e
ECL-2.0 | educational community | educational community licen[cs]e(?:V2(?: 0)?)?
EFL-2.0 | eiffel | eiffel forum licen[cs]e(?:V2)?
Elastic-2.0 | elastic licen | elastic licen[cs]e(?:V2(?: 0)?)?
EPL-1.0 | eclipse public | eclipse public licen[cs]eV1(?: 0)?
EPL-2.0 | eclipse public | eclipse public licen[cs]eV2(?: 0)?
EPL-1.0 | epl | eplV1(?: 0)?
EPL-2.0 | epl | eplV2(?: 0)?
EDL-1.0 | eclipse distribution | eclipse distribution licen[cs]e(?:V1(?: 0)?)?
EUDatagrid | datagrid | eu datagrid software licen[cs]e
EUPL-1.0 | european union | european union public licen[cs]eV1 0
EUPL-1.1 | european union | european union public licen[cs]eV1 1
EUPL-1.2 | european union | european union public licen[cs]eV1 2
EUPL-1.2 | eupl | euplV1 2
FSFAP | all permissive | (?:gnu|fsf) all permissive licen[cs]e
FTL | freetype | freetype (?:project )?licen[cs]e
GFDL-1.1 | free documentation | (?:gnu )?free documentation licen[cs]eV1 1
GFDL-1.2 | free documentation | (?:gnu )?free documentation licen[cs]eV1 2
GFDL-1.3 | free documentation | (?:gnu )?free documentation licen[cs]eV1 3
GFDL | free documentation,gfdl | (?:(?:gnu )?free documentation licen[cs]e|gfdl)
GPL-1.0 | general public | (?:gnu )?general public licen[cs]e(?: gpl)?V1(?: 0)?
GPL-2.0 | general public | (?:gnu )?general public licen[cs]e(?: gpl)?V2(?: 0)?
GPL-2.0-or-later | general public | (?:gnu )?general public licen[cs]e(?: gpl)?V2(?: 0)? or(?: at your option)? (?:any )?later(?: version)?
GPL-3.0 | general public | (?:gnu )?general public licen[cs]e(?: gpl)?V3(?: 0)?
GPL-3.0-or-later | general public | (?:gnu )?general public licen[cs]e(?: gpl)?V3(?: 0)? or(?: at your option)? (?:any )?later(?: version)?
GPL | gnu general public | gnu general public licen[cs]e
GPL-2.0 | gpl | (?:gnu )?gpl ?v?2(?: 0)?(?: only)?(?: licen[cs]e)?
GPL-2.0-or-later | gpl | (?:gnu )?gpl ?v?2(?: 0)? or later
GPL-3.0 | gpl | (?:gnu )?gpl ?v?3(?: 0)?(?: only)?(?: licen[cs]e)?
GPL-3.0-or-later | gpl | (?:gnu )?gpl ?v?3(?: 0)? or later
GPL | gnu gpl,gpl licen | (?:gnu gpl|gpl licen[cs]ed?)
HPND | historical permission | historical permission notice(?: and disclaimer)?
ICU | icu licen | icu licen[cs]e
IJG | independent jpeg | independent jpeg group(?: s)? licen[cs]e
Info-ZIP | info zip | info zip licen[cs]e
Intel | intel open | intel open source licen[cs]e
IPA | ipa font | ipa font licen[cs]e
IPL-1.0 | ibm public | ibm public licen[cs]e(?:V1(?: 0)?)?
ISC | isc,internet systems | (?:isc licen[cs]ed?|internet systems consortium licen[cs]e)
JSON | json licen | json licen[cs]e
LGPL-2.0 | library general,lesser general | (?:gnu )?(?:library|lesser) general public licen[cs]e(?: lgpl)?V2(?: 0)?
LGPL-2.1 | lesser general | (?:gnu )?lesser general public licen[cs]e(?: lgpl)?V2 1
LGPL-3.0 | lesser general | (?:gnu )?lesser general public licen[cs]e(?: lgpl)?V3(?: 0)?
LGPL | library general,lesser general | (?:gnu )?(?:library|lesser) general public licen[cs]e
LGPL-2.1 | lgpl | (?:gnu )?lgpl ?v?2 1(?: only| or later)?
LGPL-3.0 | lgpl | (?:gnu )?lgpl ?v?3(?: 0)?(?: only| or later)?
LGPL | gnu lgpl,lgpl licen | (?:gnu lgpl|lgpl licen[cs]ed?)
LPL-1.02 | lucent public | lucent public licen[cs]e(?:V1 02)?
LPPL-1.3c | latex project | latex project public licen[cs]e(?:V1 3c?)?
Libpng | libpng,png reference | (?:libpng licen[cs]e|png reference library licen[cs]e)
MirOS | miros | miros licen[cs]e
MIT | mit | (?:the )?mit licen[cs]ed?
MIT | expat | expat licen[cs]e
MIT | x11 | (?:mit x11|x11 mit)(?: licen[cs]e)?
X11 | x11 | x11 licen[cs]e
MIT-0 | no attribution | mit no attribution(?: licen[cs]e)?
MPL-1.0 | mozilla public | mozilla public licen[cs]eV1 0
MPL-1.1 | mozilla public | mozilla public licen[cs]eV1 1
MPL-2.0 | mozilla public | mozilla public licen[cs]eV2(?: 0)?
MPL | mozilla public | mozilla public licen[cs]e
MPL-1.1 | mpl | mplV1 1
MPL-2.0 | mpl | mplV2(?: 0)?
MS-PL | microsoft public,ms pl | (?:microsoft public licen[cs]e|ms pl)
MS-RL | microsoft reciprocal,ms rl | (?:microsoft reciprocal licen[cs]e|ms rl)
MulanPSL-2.0 | mulan | mulan (?:permissive software licen[cs]e|psl)(?:V2)?
NASA-1.3 | nasa open | nasa open source agreement(?:V1 3)?
Naumen | naumen | naumen public licen[cs]e
NCSA | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
NetCDF | netcdf | netcdf licen[cs]e
Nokia | nokia | nokia open source licen[cs]e
NPL-1.1 | netscape public | netscape public licen[cs]e(?:V1 1)?
NTP | ntp licen | ntp licen[cs]e
ODbL-1.0 | open database,odbl | (?:open data commons open database licen[cs]e|open database licen[cs]e(?:V1 0)?|odbl(?: 1 0)?)
ODC-BY-1.0 | open data commons | open data commons attribution licen[cs]e(?:V1 0)?
PDDL-1.0 | public domain dedication,pddl | (?:open data commons public domain dedication and licen[cs]e|pddl(?: 1 0)?)
OFL-1.0 | open font | (?:sil )?open font licen[cs]eV1 0
OFL-1.1 | open font | (?:sil )?open font licen[cs]e(?:V1 1)?
OGL-3.0 | open government | open government licen[cs]e(?:V3(?: 0)?)?
OLDAP-2.8 | openldap | openldap public licen[cs]e(?:V2 8)?
OpenSSL | openssl | openssl licen[cs]e
OSET-PL-2.1 | oset | oset public licen[cs]e(?:V2 1)?
OSL-1.0 | open software licen | open software licen[cs]eV1 0
OSL-2.1 | open software licen | open software licen[cs]eV2 1
OSL-3.0 | open software licen | open software licen[cs]eV3(?: 0)?
Parity-7.0.0 | parity public | parity public licen[cs]e(?:V7(?: 0 0)?)?
PHP-3.01 | php licen | php licen[cs]e(?:V3 0?1)?
PolyForm-Noncommercial-1.0.0 | polyform | polyform noncommercial licen[cs]e(?: 1 0 0)?
PostgreSQL | postgresql | postgresql licen[cs]e
PSF-2.0 | python software,psf | (?:python software foundation|psf) licen[cs]e(?:V2)?
Python-2.0 | python licen | python licen[cs]e(?:V2(?: 0)?)?
QPL-1.0 | q public | q public licen[cs]e(?:V1(?: 0)?)?
RPL-1.5 | reciprocal public | reciprocal public licen[cs]e(?:V1 5)?
RPSL-1.0 | realnetworks | realnetworks public source licen[cs]e(?:V1 0)?
Ruby | ruby licen | ruby licen[cs]e
Sendmail | sendmail | sendmail licen[cs]e
SGI-B-2.0 | sgi free | sgi free software licen[cs]e b(?:V2 0)?
SISSL | sun industry | sun industry standards source licen[cs]e
Sleepycat | sleepycat | sleepycat licen[cs]e
SPL-1.0 | sun public | sun public licen[cs]e(?:V1 0)?
SSPL-1.0 | server side public,sspl | (?:server side public licen[cs]e(?:V1)?|sspl(?: 1 0)?)
TCL | tcl | tcl(?: tk)? licen[cs]e
Unicode | unicode licen | unicode licen[cs]e(?: agreement)?
Unlicense | unlicense | (?:the )?unlicense
UPL-1.0 | universal permissive | universal permissive licen[cs]e(?:V1 0)?
Vim | vim licen | vim licen[cs]e
W3C | w3c software | w3c software (?:and document )?(?:notice and )?licen[cs]e
WTFPL | what the,wtfpl | (?:do what the [a-z]+ you want to public licen[cs]e|wtfpl(?:V2)?)
wxWindows | wxwindows | wxwindows library licen[cs]e
XFree86-1.1 | xfree86 | xfree86 licen[cs]e(?:V1 1)?
Xnet | xnet,x net | x ?net licen[cs]e
ZPL-2.0 | zope public | zope public licen[cs]eV2(?: 0)?
ZPL-2.1 | zope public | zope public licen[cs]e(?:V2 1)?
Zlib | zlib | (?:zlib(?: libpng)?|zlib png) licen[cs]e
"""

#: Passages of license texts and notices. Confidence 0.9.
PASSAGES = r"""
Apache-2.0 | you may not use this file | you may not use this file except in compliance with the licen[cs]e
Apache-2.0 | as is basis | distributed on an as is basis without warranties or conditions of any kind
Apache-2.0 | irrevocable | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)? ?licen[cs]e
Apache-1.1 | developed by the apache | this product includes software developed by the apache software foundation
Artistic | standard version | reproduce and give away verbatim copies of the source form of the standard version
Beerware | buy me a beer | you can buy me a beer in return
BSD | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
BSD | above copyright notice | redistributions of source code must retain the above copyright notice
BSD | binary form must | redistributions in binary form must reproduce the above copyright notice
BSD-3-Clause | endorse or promote | (?:neither the name|the names?) of [a-z0-9 ]{1,120}? may(?: not)? be used to endorse or promote products
BSD-4-Clause | advertising materials | all advertising materials mentioning features or use of this software must display
BSL-1.0 | covered by this licen | copy of the software and accompanying documentation covered by this licen[cs]e
CC0-1.0 | work worldwide | waives? all (?:of )?(?:his or her |its )?rights to the work worldwide under copyright
CC0-1.0 | extent possible under law | to the extent possible under law the (?:author|person)[a-z ]{0,80}? (?:has|have) waived all copyright
CDDL | covered software | conditions of the licen[cs]e governing (?:the use of )?covered software
EPL | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse
FSFAP | copying and distribution | copying and distribution of this file with or without modification are permitted in any medium without royalty
FTL | freetype project | portions of this software are copyright [a-z0-9 ]{0,60}?the freetype project
GFDL | invariant sections | with no invariant sections no front cover texts and no back cover texts
GPL | redistribute it | free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
GPL | received a copy | you should have received a copy of the gnu general public licen[cs]e
GPL | verbatim copies | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document
GPL | free software foundation | published by the free software foundation either version [0-9] of the licen[cs]e
LGPL | redistribute it | free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
LGPL | received a copy | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
AGPL | redistribute it | free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
AGPL | received a copy | you should have received a copy of the gnu affero general public licen[cs]e
HPND | fee is | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
ICU | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
IJG | independent jpeg | this software is based in part on the work of the independent jpeg group
ISC | fee is | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
JSON | good not evil | the software shall be used for good not evil
LPPL-1.3c | maintenance status | this work has the lppl maintenance status
MIT | hereby granted | permission is hereby granted free of charge to any person obtaining a copy
MIT | above copyright notice | the above copyright notice and this permission notice shall be included in all copies
MIT | express or implied | the software is provided as is without warranty of any kind express or implied
MPL-1.1 | contents of this file | the contents of this file are subject to the mozilla public licen[cs]eV1 1
MPL-2.0 | source code form | this source code form is subject to the terms of the mozilla public licen[cs]eV2 0
MS-PL | contributor grants | each contributor grants you a non exclusive worldwide royalty free copyright licen[cs]e
NCSA | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software
OFL-1.1 | font software | this font software is licen[cs]ed under the sil open font licen[cs]e
OpenSSL | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
PHP-3.01 | php software | this product includes php software freely available
PostgreSQL | without a written agreement | without fee and without a written agreement is hereby granted
PSF-2.0 | python software | python software foundation all rights reserved
Sleepycat | complete source code | redistributions in any form must be accompanied by information on how to obtain complete source code
Unlicense | unencumbered | this is free and unencumbered software released into the public domain
W3C | copyright holders | this work is being provided by the copyright holders under the (?:following |w3c )?licen[cs]e
WTFPL | you just do | you just do what the [a-z]+ you want to
Zlib | express or implied | this software is provided as is without any express or implied warranty
Zlib | misrepresented | the origin of this software must not be misrepresented
public-domain | public domain | (?:released|dedicated|placed|is) (?:in|into|to)(?: the)? public domain
public-domain | public domain | no copyright(?: is)? (?:claimed|asserted)[a-z ]{0,60}? public domain
proprietary | confidential | proprietary and confidential(?: information)?
proprietary | unauthorized copying | unauthorized copying of this (?:file|software)(?: via any medium)? is strictly prohibited
"""

#: Weak notices: (confidence, line).
WEAK = [
    (0.5, "all-rights-reserved | rights reserved | all rights reserved"),
    (0.4, "warranty-disclaimer | warranty | without(?: any)? warranty(?: of any kind)?"),
    (0.4, "see-license | licen | (?:see|refer to)(?: the)?(?: accompanying| included)? licen[cs]e(?: file| txt| md)?(?: for details)?"),
]

#: Forms of reference that may stand before a name: priority, confidence, pattern.
FORMS = [
    (2, 0.98, r"(?:licen[cs]ed|released|distributed|published|available|provided|redistributed)(?: to you)? under(?: the)?(?: terms(?: and conditions)? of)?(?: the)?"),
    (2, 0.98, r"(?:is|are|be) (?:licen[cs]ed|released|distributed|governed|covered) (?:under|by)(?: the)?(?: terms of)?(?: the)?"),
    (3, 0.95, r"subject to(?: the)?(?: terms(?: and conditions)? of)?(?: the)?"),
    (3, 0.95, r"(?:a copy of|under the terms of|in compliance with|compliance with|see)(?: the)?"),
    (4, 0.9, r"(?:licen[cs]es?|copying|classifier licen[cs]e osi approved)"),
]
