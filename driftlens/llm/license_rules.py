"""Signature rules of the license scan, by hand.

Under each label a rule a line: priority (0 first), confidence, keyword | pattern. Patterns are over lower-case words
joined by single spaces; the keyword stands in whatever the pattern can match.
"""

# Parts of patterns.
MACROS = {
    "grant": "(?:licensed|released|distributed|available|published|provided|offered|made available)(?: to you)? (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?",
    "under": "(?:under|per|subject to|covered by|governed by)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?",
    "lic": "(?: licen[cs]e)?",
    "v1": "(?: licen[cs]e)?(?: version)? v?1(?: 0)?", "v1.1": "(?: licen[cs]e)?(?: version)? v?1 1", "v1.2": "(?: licen[cs]e)?(?: version)? v?1 2", "v1.3": "(?: licen[cs]e)?(?: version)? v?1 3",
    "v2": "(?: licen[cs]e)?(?: version)? v?2(?: 0)?", "v2.1": "(?: licen[cs]e)?(?: version)? v?2 1", "v3": "(?: licen[cs]e)?(?: version)? v?3(?: 0)?",
    "later": "(?: only| or(?: at your option)?(?: any)? later(?: version)?)?",
}

# The rules.
RULES = r"""
mit
 0 1.0  spdx | spdx license identifier mit
 1 0.95 permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
 1 0.9  permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
 1 0.9  portions of the software | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
 1 0.85 without warranty of any kind | the software is provided as is without warranty of any kind
 2 0.95 mit | {grant} mit(?: expat| x11)?{lic}
 2 0.9  mit | {under} mit(?: expat| x11)? licen[cs]e
 3 0.8  mit | licen[cs]e (?:is )?(?:the )?mit
 4 0.7  mit | (?:the )?mit licen[cs]ed?
 4 0.7  expat | expat licen[cs]e
apache-2
 0 1.0  spdx | spdx license identifier apache 2(?: 0)?
 1 0.95 apache license version | licensed under the apache license version 2(?: 0)? the license you may not use this file except in compliance with the license
 1 0.9  except in compliance | you may not use this file except in compliance with the license
 1 0.9  apache org licenses | www apache org licenses license 2 0
 2 0.95 apache | {grant} apache(?: software)?{v2}{lic}
 2 0.9  apache | {under} apache(?: software)?{v2}{lic}
 3 0.8  apache | licen[cs]e (?:is )?(?:the )?apache{v2}
 4 0.7  apache | apache(?: software)?{v2} licen[cs]ed?
 5 0.6  apache | apache(?: software)?{v2}
 5 0.6  asl | asl v?2(?: 0)?
apache-1.1
 0 1.0  spdx | spdx license identifier apache 1 1
 2 0.95 apache | {grant} apache(?: software)?{v1.1}
 2 0.8  apache software foundation | this product includes software developed by the apache software foundation
 5 0.6  apache | apache(?: software)?{v1.1}
gpl-2
 0 1.0  spdx | spdx license identifier gpl 2(?: 0)?(?: only| or later)?
 1 0.95 general public license | gnu general public license as published by the free software foundation either version 2 of the license
 1 0.9  general public license | gnu general public license version 2 june 1991
 2 0.95 general public | {grant} gnu general public{v2}{later}
 2 0.95 gpl | {grant} (?:gnu )?(?:gpl(?: version)? v?|gplv)2(?: 0)?{later}
 4 0.7  general public | (?<!lesser )(?<!library )(?<!affero )(?:gnu )?general public licen[cs]e(?: version)? v?2(?: 0)?{later}
 5 0.6  general public | gnu general public{v2}{later}
 5 0.6  gpl | (?<!lesser )(?<!library )(?<!affero )(?:gpl(?: version)? v?|gplv)2(?: 0)?{later}
gpl-3
 0 1.0  spdx | spdx license identifier gpl 3(?: 0)?(?: only| or later)?
 1 0.95 general public license | gnu general public license as published by the free software foundation either version 3 of the license
 1 0.9  general public license | gnu general public license version 3 29 june 2007
 2 0.95 general public | {grant} gnu general public{v3}{later}
 2 0.95 gpl | {grant} (?:gnu )?(?:gpl(?: version)? v?|gplv)3(?: 0)?{later}
 4 0.7  general public | (?<!lesser )(?<!library )(?<!affero )(?:gnu )?general public licen[cs]e(?: version)? v?3(?: 0)?{later}
 5 0.6  general public | gnu general public{v3}{later}
 5 0.6  gpl | (?<!lesser )(?<!library )(?<!affero )(?:gpl(?: version)? v?|gplv)3(?: 0)?{later}
gpl
 1 0.8  free software you can redistribute | free software you can redistribute it and or modify
 2 0.9  gpl | {grant} (?:gnu )?gpl
 2 0.9  gpl | {under} (?:gnu )?gpl
 4 0.7  gpl | (?:gnu )?gpl licen[cs]ed?
 4 0.6  general public | gnu general public licen[cs]e
 4 0.6  gpl | gnu gpl
lgpl-2.1
 0 1.0  spdx | spdx license identifier lgpl 2 1(?: only| or later)?
 1 0.95 general public license | gnu lesser general public license as published by the free software foundation either version 2 1 of the license
 2 0.95 lesser general public | {grant} gnu lesser general public{v2.1}{later}
 2 0.95 lgpl | {grant} (?:gnu )?(?:lgpl(?: version)? v?|lgplv)2 1{later}
 5 0.6  lesser general public | (?:gnu )?lesser general public{v2.1}{later}
 5 0.6  gpl | (?:gnu )?(?:lgplv|(?:lgpl|lesser gpl)(?: version)? v?)2 1{later}
lgpl-2
 0 1.0  spdx | spdx license identifier lgpl 2 0(?: only| or later)?
 5 0.6  library general public | gnu library general public{v2}{later}
 5 0.6  gpl | (?:lgplv|(?:lgpl|library gpl)(?: version)? v?)2(?: 0)?(?! 1\b){later}
lgpl-3
 0 1.0  spdx | spdx license identifier lgpl 3(?: 0)?(?: only| or later)?
 1 0.95 general public license | gnu lesser general public license as published by the free software foundation either version 3 of the license
 2 0.95 lesser general public | {grant} gnu lesser general public{v3}{later}
 5 0.6  lesser general public | (?:gnu )?lesser general public{v3}{later}
 5 0.6  gpl | (?:gnu )?(?:lgplv|(?:lgpl|lesser gpl)(?: version)? v?)3(?: 0)?{later}
agpl-3
 0 1.0  spdx | spdx license identifier agpl 3(?: 0)?(?: only| or later)?
 1 0.95 general public license | gnu affero general public license as published by the free software foundation either version 3 of the license
 1 0.9  affero general public license | gnu affero general public license version 3 19 november 2007
 2 0.95 affero general public | {grant} gnu affero general public{v3}{later}
 2 0.95 agpl | {grant} (?:gnu )?(?:agpl(?: version)? v?|agplv)3(?: 0)?{later}
 5 0.6  affero general public | (?:gnu )?affero general public{v3}{later}
 5 0.6  gpl | (?:gnu )?(?:agplv|(?:agpl|affero gpl)(?: version)? v?)3(?: 0)?{later}
bsd-2
 0 1.0  spdx | spdx license identifier bsd 2 clause
 2 0.95 bsd | {grant} (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd){lic}
 4 0.7  bsd | (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd) licen[cs]ed?
 5 0.6  bsd | (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd)
bsd-3
 0 1.0  spdx | spdx license identifier bsd 3 clause
 1 0.9  endorse or promote | neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
 1 0.85 endorse or promote products | may be used to endorse or promote products derived from this software without specific prior written permission
 2 0.95 bsd | {grant} (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd){lic}
 4 0.7  bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[cs]ed?
 5 0.6  bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)
bsd-4
 0 1.0  spdx | spdx license identifier bsd 4 clause
 1 0.85 advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledgement
 5 0.6  bsd | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd){lic}
bsd
 1 0.8  redistribution and use | redistribution and use in source and binary forms
 2 0.9  bsd | {grant} bsd(?: style)?{lic}
 2 0.9  bsd | {under} bsd(?: style)? licen[cs]e
 4 0.7  bsd | bsd(?: style)? licen[cs]ed?
isc
 0 1.0  spdx | spdx license identifier isc
 1 0.9  permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
 1 0.8  permission to use copy modify | permission to use copy modify and or distribute this software
 2 0.95 isc | {grant} isc{lic}
 2 0.9  isc | {under} isc licen[cs]e
 4 0.7  isc | (?:the )?isc licen[cs]ed?
mpl-2
 0 1.0  spdx | spdx license identifier mpl 2(?: 0)?
 1 0.95 mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
 2 0.95 mozilla public | {grant} mozilla public{v2}
 5 0.6  mozilla public | mozilla public{v2}
 5 0.6  mpl | mpl(?: version)? v?2(?: 0)?
mpl-1.1
 0 1.0  spdx | spdx license identifier mpl 1 1
 2 0.95 mozilla public | the contents of this file are subject to the mozilla public license version 1 1
 5 0.6  mozilla public | mozilla public{v1.1}
 5 0.6  mpl | mpl(?: version)? v?1 1
epl-1
 0 1.0  spdx | spdx license identifier epl 1(?: 0)?
 2 0.95 eclipse public | {grant} eclipse public{v1}
 5 0.6  eclipse public | eclipse public{v1}
 5 0.6  epl | epl(?: version)? v?1(?: 0)?
epl-2
 0 1.0  spdx | spdx license identifier epl 2(?: 0)?
 1 0.9  eclipse org legal | www eclipse org legal epl 2 0
 2 0.95 eclipse public | {grant} eclipse public{v2}
 5 0.6  eclipse public | eclipse public{v2}
 5 0.6  epl | epl(?: version)? v?2(?: 0)?
cddl-1
 0 1.0  spdx | spdx license identifier cddl 1(?: 0)?
 2 0.95 development and distribution | {grant} common development and distribution{lic}(?: version)?(?: v?1(?: 0)?)?
 5 0.6  development and distribution | common development and distribution{lic}(?: version)?(?: v?1(?: 0)?)?
 5 0.6  cddl | cddl(?: version)?(?: v?1(?: 0)?)?
cc0
 0 1.0  spdx | spdx license identifier cc0 1 0
 1 0.9  waived all copyright | has waived all copyright and related or neighboring rights to this work
 1 0.9  creativecommons org | creativecommons org publicdomain zero(?: 1 0)?
 2 0.95 cc0 | {grant} cc0(?: 1 0)?{lic}
 5 0.6  cc0 | cc0(?: 1 0)?(?: universal)?
 5 0.6  creative commons zero | creative commons zero(?: 1 0)?(?: universal)?
cc-by
 0 1.0  spdx | spdx license identifier cc by [1-4] 0
 1 0.9  creativecommons org | creativecommons org licenses by [1-4] 0
 2 0.95 cc by | {grant} cc by(?: [1-4] 0)?(?! [ns][cda]\b){lic}
 2 0.9  creative commons attribution | {grant} creative commons attribution(?: [1-4] 0)?(?: international)?(?! (?:noncommercial|non|share|no)){lic}
 4 0.7  cc by | cc by(?: [1-4] 0)?(?! [ns][cda]\b) licen[cs]ed?
 4 0.7  creative commons attribution | creative commons attribution(?: [1-4] 0)?(?: international)? licen[cs]e
 5 0.6  cc by | cc by [1-4] 0
cc-by-sa
 0 1.0  spdx | spdx license identifier cc by sa(?: [1-4] 0)?
 1 0.9  creativecommons org | creativecommons org licenses by sa(?: [1-4] 0)?
 2 0.95 cc by sa | {grant} cc by sa(?: [1-4] 0)?{lic}
 5 0.6  cc by sa | cc by sa(?: [1-4] 0)?
 5 0.6  creative commons attribution | creative commons attribution share ?alike(?: [1-4] 0)?
cc-by-nd
 0 1.0  spdx | spdx license identifier cc by nd(?: [1-4] 0)?
 1 0.9  creativecommons org | creativecommons org licenses by nd(?: [1-4] 0)?
 5 0.6  cc by nd | cc by nd(?: [1-4] 0)?
 5 0.6  creative commons attribution | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] 0)?
cc-by-nc
 0 1.0  spdx | spdx license identifier cc by nc(?: [1-4] 0)?(?! [ns][da]\b)
 1 0.9  creativecommons org | creativecommons org licenses by nc(?: [1-4] 0)?(?! [ns][da]\b)
 2 0.95 cc by nc | {grant} cc by nc(?: [1-4] 0)?(?! [ns][da]\b){lic}
 5 0.6  cc by nc | cc by nc(?: [1-4] 0)?(?! [ns][da]\b)
 5 0.6  creative commons attribution | creative commons attribution non ?commercial(?: [1-4] 0)?(?! (?:share|no))
cc-by-nc-sa
 0 1.0  spdx | spdx license identifier cc by nc sa(?: [1-4] 0)?
 1 0.9  creativecommons org | creativecommons org licenses by nc sa(?: [1-4] 0)?
 2 0.95 cc by nc sa | {grant} cc by nc sa(?: [1-4] 0)?{lic}
 5 0.6  cc by nc sa | cc by nc sa(?: [1-4] 0)?
 5 0.6  creative commons attribution | creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?
cc-by-nc-nd
 0 1.0  spdx | spdx license identifier cc by nc nd(?: [1-4] 0)?
 1 0.9  creativecommons org | creativecommons org licenses by nc nd(?: [1-4] 0)?
 5 0.6  cc by nc nd | cc by nc nd(?: [1-4] 0)?
 5 0.6  creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] 0)?
unlicense
 0 1.0  spdx | spdx license identifier unlicense
 1 0.95 unencumbered software | this is free and unencumbered software released into the public domain
 2 0.95 unlicense | {grant} unlicense
 4 0.7  unlicense | the unlicense
wtfpl
 0 1.0  spdx | spdx license identifier wtfpl
 5 0.6  what the fuck you want | do what the fuck you want to public licen[cs]e
 5 0.6  wtfpl | wtfpl(?: version)?(?: v?2)?
zlib
 0 1.0  spdx | spdx license identifier zlib
 1 0.9  misrepresented | the origin of this software must not be misrepresented
 2 0.95 zlib | {grant} zlib(?: libpng)?{lic}
 4 0.7  zlib | zlib(?: libpng)? licen[cs]e
boost-1
 0 1.0  spdx | spdx license identifier bsl 1 0
 1 0.95 boost software license | distributed under the boost software license version 1 0
 2 0.95 boost | {grant} boost software{v1}
 5 0.6  boost | boost software{v1}
 5 0.6  bsl | bsl 1 0
bsl-1.1
 0 1.0  spdx | spdx license identifier busl 1 1
 2 0.95 business source | {grant} business source{lic}(?: version)?(?: 1 1)?
 5 0.6  business source | business source licen[cs]e(?: version)?(?: 1 1)?
 5 0.6  business source | business source 1 1
 5 0.6  bsl | bsl 1 1
 5 0.6  busl | busl 1 1
artistic-2
 0 1.0  spdx | spdx license identifier artistic 2 0
 2 0.95 artistic | {grant} artistic{v2}
 5 0.6  artistic | artistic{v2}
artistic-1
 0 1.0  spdx | spdx license identifier artistic 1 0(?: perl)?
 5 0.6  artistic | artistic licen[cs]e(?: version)? v?1(?: 0)?
 5 0.6  same terms as perl | under the same terms as perl itself
eupl-1.2
 0 1.0  spdx | spdx license identifier eupl 1 2
 5 0.6  european union public | european union public{v1.2}
 5 0.6  eupl | eupl(?: version)? v?1 2
ofl-1.1
 0 1.0  spdx | spdx license identifier ofl 1 1
 2 0.95 open font | {grant} sil open font{v1.1}
 5 0.6  open font | sil open font{v1.1}
 5 0.6  ofl | (?:sil )?ofl(?: version)? v?1 1
odbl-1
 0 1.0  spdx | spdx license identifier odbl 1 0
 1 0.9  open database license | made available under the open database license
 5 0.6  open database | open database licen[cs]e(?: version)?(?: v?1(?: 0)?)?
 5 0.6  odbl | odbl(?: v?1(?: 0)?)?
odc-by-1
 0 1.0  spdx | spdx license identifier odc by 1 0
 5 0.6  open data commons attribution | open data commons attribution{lic}(?: version)?(?: v?1(?: 0)?)?
pddl-1
 0 1.0  spdx | spdx license identifier pddl 1 0
 5 0.6  public domain dedication | public domain dedication and licen[cs]e(?: version)?(?: v?1(?: 0)?)?
psf-2
 0 1.0  spdx | spdx license identifier psf 2 0
 5 0.6  python software foundation | python software foundation licen[cs]e(?: version)?(?: 2(?: 0)?)?
ruby
 0 1.0  spdx | spdx license identifier ruby
 2 0.9  ruby | {grant} ruby licen[cs]e
 5 0.6  same terms as ruby | under the same terms as ruby
php-3.01
 0 1.0  spdx | spdx license identifier php 3 01
 2 0.9  php | this source file is subject to version 3 01 of the php license
 5 0.6  php | php{lic}(?: version)? 3 0?1
postgresql
 0 1.0  spdx | spdx license identifier postgresql
 2 0.9  postgresql | {grant} postgresql licen[cs]e
 4 0.7  postgresql | postgresql licen[cs]e
openssl
 0 1.0  spdx | spdx license identifier openssl
 1 0.85 openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
 4 0.7  openssl | openssl licen[cs]e
ms-pl
 0 1.0  spdx | spdx license identifier ms pl
 5 0.6  microsoft public | microsoft public licen[cs]e(?: ms pl)?
ms-rl
 0 1.0  spdx | spdx license identifier ms rl
 5 0.6  microsoft reciprocal | microsoft reciprocal licen[cs]e(?: ms rl)?
cecill-2.1
 0 1.0  spdx | spdx license identifier cecill 2 1
 5 0.6  cecill | cecill{v2.1}
gfdl-1.3
 0 1.0  spdx | spdx license identifier gfdl 1 3(?: only| or later)?
 1 0.9  free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
 5 0.6  free documentation | gnu free documentation{v1.3}{later}
 5 0.6  gfdl | gfdl(?: version)? v?1 3
rail
 2 0.95 rail | {grant} (?:creativeml )?open ?rail(?: m)?{lic}
 4 0.7  rail | (?:creativeml )?open ?rail(?: m)? licen[cs]e
llama
 2 0.95 llama | {grant} llama [234](?: [0-9])? community licen[cs]e
 5 0.6  llama | (?:meta )?llama [234](?: [0-9])? community(?: licen[cs]e)?(?: agreement)?
elastic-2
 0 1.0  spdx | spdx license identifier elastic 2 0
 2 0.95 elastic | {grant} elastic{v2}
 5 0.6  elastic | elastic{v2}
sspl-1
 0 1.0  spdx | spdx license identifier sspl 1 0
 5 0.6  server side public | server side public licen[cs]e(?: version)?(?: v?1)?
 5 0.6  sspl | sspl(?: v?1(?: 0)?)?
0bsd
 0 1.0  spdx | spdx license identifier 0bsd
 5 0.6  0bsd | 0bsd{lic}
 5 0.6  zero clause | (?:bsd zero clause|zero clause bsd){lic}
upl-1
 0 1.0  spdx | spdx license identifier upl 1 0
 5 0.6  universal permissive | universal permissive{v1}
ncsa
 0 1.0  spdx | spdx license identifier ncsa
 5 0.6  ncsa | (?:university of illinois )?ncsa open source licen[cs]e
afl-3
 0 1.0  spdx | spdx license identifier afl 3 0
 5 0.6  academic free | academic free{v3}
osl-3
 0 1.0  spdx | spdx license identifier osl 3 0
 5 0.6  open software license | open software license(?: version)? v?3(?: 0)?
ecl-2
 0 1.0  spdx | spdx license identifier ecl 2 0
 5 0.6  educational community | educational community{v2}
polyform
 2 0.9  polyform | {grant} polyform (?:noncommercial|small business|strict|shield)
 5 0.6  polyform | polyform (?:noncommercial|small business|strict|shield)(?: licen[cs]e)?
hippocratic
 5 0.6  hippocratic | hippocratic licen[cs]e(?: version)?(?: [0-9](?: [0-9])?)?
beerware
 0 1.0  spdx | spdx license identifier beerware
 5 0.6  beer ware | the beer ware licen[cs]e
public-domain
 2 0.7  public domain | (?:released|placed) into the public domain
 2 0.7  public domain | dedicated to the public domain
 2 0.7  public domain | in the public domain
proprietary
 2 0.8  proprietary | {grant} (?:a )?proprietary licen[cs]e
 2 0.7  proprietary and confidential | proprietary and confidential
 4 0.7  proprietary | proprietary licen[cs]e
 2 0.7  unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
all-rights-reserved
 2 0.6  all rights reserved | all rights reserved
"""
