"""The signature rules of the license scan: hand-written, in order of priority.

A line is ``label | confidence | keyword | regex``. Rules read a text of plain
words: A-Z as a-z, whatever is neither digit, letter nor beyond ASCII is one
blank, so ``GPL-3.0+`` is ``gpl 3 0``. A regex matches whole words, and each of its
matches contains the keyword, by which texts are filtered before it runs.
Of two detections, the later rule's goes if it lies within the earlier rule's.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Phrases that always count: they come first, so nothing can suppress them.
BASE = """
mit | 1.0 | mit license | under the mit license
apache-2 | 1.0 | apache license | apache license version 2
cc-by-nc | 1.0 | cc by nc | cc by nc
"""

#: Declarations by identifier.
IDENTIFIERS = """
dual | 1.0 | spdx license identifier | spdx license identifier \\w+(?: \\d+){0,2}(?: (?:only|clause))?(?: or later)? or \\w+(?: \\d+){0,2}
agpl-3 | 1.0 | spdx license identifier agpl | spdx license identifier agpl 3 0(?: only| or later)?
agpl-1 | 1.0 | spdx license identifier agpl | spdx license identifier agpl 1 0(?: only| or later)?
lgpl-3 | 1.0 | spdx license identifier lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 | 1.0 | spdx license identifier lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2 | 1.0 | spdx license identifier lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
gpl-3 | 1.0 | spdx license identifier gpl | spdx license identifier gpl 3 0(?: only| or later)?
gpl-2 | 1.0 | spdx license identifier gpl | spdx license identifier gpl 2 0(?: only| or later)?(?: with linux syscall note)?
gpl-1 | 1.0 | spdx license identifier gpl | spdx license identifier gpl 1 0(?: only| or later)?
apache-2 | 1.0 | spdx license identifier apache | spdx license identifier apache 2 0(?: with llvm exception)?
apache-1.1 | 1.0 | spdx license identifier apache | spdx license identifier apache 1 1
apache-1 | 1.0 | spdx license identifier apache | spdx license identifier apache 1 0
mit-0 | 1.0 | spdx license identifier mit | spdx license identifier mit 0
mit | 1.0 | spdx license identifier mit | spdx license identifier mit
bsd-4-clause | 1.0 | spdx license identifier bsd | spdx license identifier bsd 4 clause
bsd-3-clause | 1.0 | spdx license identifier bsd | spdx license identifier bsd 3 clause(?: clear)?
bsd-2-clause | 1.0 | spdx license identifier bsd | spdx license identifier bsd 2 clause(?: patent)?
0bsd | 1.0 | spdx license identifier 0bsd | spdx license identifier 0bsd
isc | 1.0 | spdx license identifier isc | spdx license identifier isc
mpl-2 | 1.0 | spdx license identifier mpl | spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-1.1 | 1.0 | spdx license identifier mpl | spdx license identifier mpl 1 1
epl-2 | 1.0 | spdx license identifier epl | spdx license identifier epl 2 0
epl-1 | 1.0 | spdx license identifier epl | spdx license identifier epl 1 0
eupl | 1.0 | spdx license identifier eupl | spdx license identifier eupl 1 [012]
cddl | 1.0 | spdx license identifier cddl | spdx license identifier cddl 1 [01]
unlicense | 1.0 | spdx license identifier unlicense | spdx license identifier unlicense
zlib | 1.0 | spdx license identifier zlib | spdx license identifier zlib
bsl-1 | 1.0 | spdx license identifier bsl | spdx license identifier bsl 1 0
busl | 1.0 | spdx license identifier busl | spdx license identifier busl 1 1
wtfpl | 1.0 | spdx license identifier wtfpl | spdx license identifier wtfpl
artistic-2 | 1.0 | spdx license identifier artistic | spdx license identifier artistic 2 0
ofl | 1.0 | spdx license identifier ofl | spdx license identifier ofl 1 [01]
cc0 | 1.0 | spdx license identifier cc0 | spdx license identifier cc0 1 0
cc-by-nc-nd | 1.0 | spdx license identifier cc | spdx license identifier cc by nc nd [1-4] [05]
cc-by-nc-sa | 1.0 | spdx license identifier cc | spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc | 1.0 | spdx license identifier cc | spdx license identifier cc by nc [1-4] [05]
cc-by-nd | 1.0 | spdx license identifier cc | spdx license identifier cc by nd [1-4] [05]
cc-by-sa | 1.0 | spdx license identifier cc | spdx license identifier cc by sa [1-4] [05]
cc-by | 1.0 | spdx license identifier cc | spdx license identifier cc by [1-4] [05]
proprietary | 1.0 | spdx license identifier licenseref | spdx license identifier licenseref (?:proprietary|commercial)(?: \\w+)?
other | 0.8 | spdx license identifier | spdx license identifier \\w+(?: \\d+){0,2}
"""

#: Sentences of license texts and of the notices that files carry.
NOTICES = """
mit | 1.0 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
bsl-1 | 1.0 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
ofl | 1.0 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of the font software
unicode | 1.0 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
mit | 0.8 | the above copyright notice and this permission notice | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
x11 | 0.9 | x consortium | except as contained in this notice the name of the x consortium shall not be used
isc | 1.0 | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | 1.0 | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 0.9 | permission to use copy modify and distribute | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
hpnd | 1.0 | permission to use copy modify and distribute | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
ntp | 1.0 | permission to use copy modify and distribute | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
postgresql | 0.9 | without a written agreement | without fee and without a written agreement is hereby granted
bsd-4-clause | 1.0 | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | 1.0 | used to endorse or promote products | neither the names? of .{1,80}? (?:nor|or) the names of its contributors may be used to endorse or promote products
bsd-3-clause | 0.9 | used to endorse or promote products | (?:may|must) not be used to endorse or promote products derived from this software
bsd-2-clause | 0.9 | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-2-clause | 0.8 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that
bsd-source-code | 0.8 | redistributions of source code | redistributions of source code must retain the above copyright notice
apache-2 | 1.0 | you may not use this file except in compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 0.9 | licensed to the apache software foundation | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2 | 1.0 | apache org licenses license 2 0 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-1.1 | 1.0 | apache software foundation | this product includes software developed by the apache software foundation
apache | 0.6 | you may not use this file except in compliance | you may not use this file except in compliance with the license
agpl-3 | 1.0 | affero general public license | under the terms of the gnu affero general public license(?: as published by the free software foundation)? (?:either )?version 3
lgpl-3 | 1.0 | lesser general public license | under the terms of the gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 3
lgpl-2.1 | 1.0 | lesser general public license | under the terms of the gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 2 1
lgpl-2 | 1.0 | library general public license | under the terms of the gnu library general public license(?: as published by the free software foundation)? (?:either )?version 2
gpl-3 | 1.0 | gnu general public license | under the terms of the gnu general public license(?: as published by the free software foundation)? (?:either )?version 3
gpl-2 | 1.0 | gnu general public license | under the terms of the gnu general public license(?: as published by the free software foundation)? (?:either )?version 2
gpl | 0.9 | gnu general public license | under the terms of the gnu general public license
gpl | 0.8 | see the gnu general public license | see the gnu general public license for more details
lgpl | 0.8 | see the gnu lesser general public license | see the gnu lesser general public license for more details
agpl | 0.8 | see the gnu affero general public license | see the gnu affero general public license for more details
gpl | 0.7 | you should have received a copy of the gnu | you should have received a copy of the gnu (?:affero |lesser |library )?general public license
mpl-2 | 1.0 | mozilla public license v 2 0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 1.0 | mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
cddl | 1.0 | common development and distribution license | subject to the terms of the common development and distribution license
epl-1 | 1.0 | eclipse public license v1 0 | made available under the terms of the eclipse public license v1 0
epl-2 | 1.0 | eclipse public license | made available under the terms of the eclipse public license(?: v)? ?2 0
unlicense | 1.0 | free and unencumbered software | this is free and unencumbered software released into the public domain
zlib | 1.0 | this software is provided as is | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 0.8 | must not be misrepresented | the origin of this software must not be misrepresented
wtfpl | 1.0 | you just do what the | you just do what the \\w+ you want to
beerware | 1.0 | buy me a beer | you can buy me a beer in return
jsmin | 1.0 | shall be used for good not evil | the software shall be used for good not evil
cc0 | 1.0 | the person who associated | the person who associated a work with this deed has dedicated the work
cc0 | 1.0 | waived all copyright | to the extent possible under law .{1,80}? waived all copyright
artistic | 0.9 | same terms as perl | under the same terms as perl itself
python-2 | 0.9 | python software foundation license | python software foundation license version 2
warranty | 0.4 | without warranty of any kind | the software is provided as is without warranty of any kind express or implied
warranty | 0.4 | without any warranty | but without any warranty without even the implied warranty of merchantability
"""

#: Works of art, text and data.
CONTENT = """
cc-by-nc-nd | 1.0 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa | 1.0 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc | 1.0 | creativecommons org licenses by nc | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | 1.0 | creativecommons org licenses by nd | creativecommons org licenses by nd [1-4] [05]
cc-by-sa | 1.0 | creativecommons org licenses by sa | creativecommons org licenses by sa [1-4] [05]
cc-by | 1.0 | creativecommons org licenses by | creativecommons org licenses by [1-4] [05]
cc0 | 1.0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
public-domain | 1.0 | creativecommons org publicdomain mark | creativecommons org publicdomain mark 1 0
cc-by-nc-nd | 1.0 | creative commons attribution non ?commercial no ?deriv | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc-sa | 1.0 | creative commons attribution non ?commercial share ?alike | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc | 1.0 | creative commons attribution non ?commercial | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nd | 1.0 | creative commons attribution no ?deriv | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-sa | 1.0 | creative commons attribution share ?alike | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by | 0.9 | creative commons attribution | creative commons attribution(?: [1-4] [05])?
cc0 | 0.9 | creative commons zero | creative commons zero(?: v?1 0)?
cc | 0.6 | creative commons licen | creative commons licen[cs]es?
cc-by-nc-nd | 0.9 | cc by nc nd | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 0.9 | cc by nc sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc | 0.9 | cc by nc | cc by nc [1-4] [05]
cc-by-nd | 0.9 | cc by nd | cc by nd(?: [1-4] [05])?
cc-by-sa | 0.9 | cc by sa | cc by sa(?: [1-4] [05])?
cc-by | 0.8 | cc by | cc by [1-4] [05]
cc-by | 0.7 | under cc by | licen[cs]ed under cc by(?! nc| nd| sa)
cc0 | 0.9 | cc0 | cc0(?: 1 0)?(?: universal)?
odbl | 1.0 | open database licen | (?:open data commons )?open database licen[cs]e(?: odbl)?(?: v?1 0)?
odbl | 0.8 | odbl | odbl(?: 1 0)?
odc-by | 1.0 | open data commons attribution | open data commons attribution licen[cs]e
pddl | 1.0 | public domain dedication and licen | (?:open data commons )?public domain dedication and licen[cs]e
gfdl | 1.0 | gnu free documentation licen | gnu free documentation licen[cs]e(?: version 1 [123])?
gfdl | 0.7 | gfdl | gfdl(?: 1 [123])?
ogl-uk | 1.0 | open government licen | open government licen[cs]e(?: v ?[123](?: 0)?)?
etalab | 1.0 | licence ouverte | licence ouverte(?: open licence)?(?: version)?(?: [12] 0)?
dl-de | 1.0 | datenlizenz deutschland | datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?
cdla-permissive | 1.0 | community data license agreement | community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | 1.0 | community data license agreement | community data license agreement sharing(?: version)?(?: 1 0)?
ofl | 1.0 | sil open font licen | sil open font licen[cs]e(?: version)?(?: 1 [01])?
free-art | 1.0 | free art licen | free art licen[cs]e(?: 1 [123])?
open-rail | 1.0 | open rail | (?:creativeml |bigscience )?open rail (?:m|d|s|ms)(?: licen[cs]e)?
open-rail | 0.9 | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?
public-domain | 0.9 | released into the public domain | (?:is |are |been |hereby )?released into the public domain
public-domain | 0.9 | dedicated to the public domain | (?:is |are |been |hereby )?dedicated to the public domain
public-domain | 0.8 | in the public domain | (?:this work|this text|this book|this file|this image|this software) is in the public domain
public-domain | 0.7 | domaine public | (?:est|sont) dans le domaine public
public-domain | 0.7 | dominio p | es(?:t[aá]n?)? (?:de|en el) dominio p\\S+blico
public-domain | 0.7 | gemeinfrei | (?:ist|sind) gemeinfrei
"""

#: Software licenses by name and version.
VERSIONED = """
agpl-3 | 1.0 | affero general public licen | (?:gnu )?affero general public licen[cs]e (?:v|version )?3(?: 0)?(?: or (?:any )?later(?: version)?)?
agpl | 0.9 | affero general public licen | (?:gnu )?affero general public licen[cs]e
agpl-3 | 0.9 | agpl | (?:gnu )?agpl ?(?:v|version )? ?3(?: 0)?(?: only| or later)?
agpl | 0.7 | agpl | agpl
lgpl-3 | 1.0 | lesser general public licen | (?:gnu )?lesser general public licen[cs]e (?:v|version )?3(?: 0)?(?: or (?:any )?later(?: version)?)?
lgpl-2.1 | 1.0 | lesser general public licen | (?:gnu )?lesser general public licen[cs]e (?:v|version )?2 1(?: or (?:any )?later(?: version)?)?
lgpl-2 | 1.0 | library general public licen | (?:gnu )?library general public licen[cs]e (?:v|version )?2(?: 0)?(?: or (?:any )?later(?: version)?)?
lgpl | 0.9 | general public licen | (?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl-3 | 0.9 | lgpl | (?:gnu )?lgpl ?(?:v|version )? ?3(?: 0)?(?: only| or later)?
lgpl-2.1 | 0.9 | lgpl | (?:gnu )?lgpl ?(?:v|version )? ?2 1(?: only| or later)?
lgpl-2 | 0.9 | lgpl | (?:gnu )?lgpl ?(?:v|version )? ?2(?: 0)?(?: only| or later)?
lgpl | 0.7 | lgpl | lgpl
gpl-3 | 1.0 | general public licen | (?:gnu )?general public licen[cs]e (?:v|version )?3(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl-2 | 1.0 | general public licen | (?:gnu )?general public licen[cs]e (?:v|version )?2(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl-1 | 1.0 | general public licen | (?:gnu )?general public licen[cs]e (?:v|version )?1(?: 0)?(?: or (?:any )?later(?: version)?)?
gpl | 0.9 | gnu general public licen | gnu general public licen[cs]e
gpl | 0.6 | general public licen | general public licen[cs]e
gpl-3 | 0.9 | gpl | (?:gnu )?gpl ?(?:v|version )? ?3(?: 0)?(?: only| or later)?
gpl-2 | 0.9 | gpl | (?:gnu )?gpl ?(?:v|version )? ?2(?: 0)?(?: only| or later)?
gpl | 0.8 | gnu gpl | gnu gpl
gpl | 0.6 | gpl | (?:the|under) gpl(?: licen[cs]e)?
apache-2 | 1.0 | apache | apache (?:software )?licen[cs]e (?:v ?|version )?2(?: 0)?
apache-2 | 1.0 | apache | apache 2(?: 0)? licen[cs]e
apache-1.1 | 1.0 | apache | apache (?:software )?licen[cs]e (?:v ?|version )?1 1
apache-1 | 1.0 | apache | apache (?:software )?licen[cs]e (?:v ?|version )?1 0
apache-2 | 0.7 | apache 2 0 | apache 2 0
apache | 0.7 | apache | apache (?:software )?licen[cs]e
mit-0 | 1.0 | mit no attribution | mit no attribution(?: licen[cs]e)?
mit | 0.9 | mit x11 | mit x11(?: licen[cs]e)?
mit | 0.9 | mit licen | (?:the )?mit licen[cs]ed?
mit | 0.9 | expat licen | (?:mit )?expat licen[cs]e
mit | 0.8 | mit lizenz | mit lizenz
mit | 0.8 | licence mit | licence mit
mit | 0.8 | licencia mit | licencia mit
bsd-4-clause | 1.0 | bsd | (?:original |4 clause )bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?
bsd-3-clause | 1.0 | bsd | (?:new |modified |revised |3 clause |three clause )bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?
bsd-2-clause | 1.0 | bsd | (?:simplified |free |2 clause |two clause )bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?
0bsd | 1.0 | bsd | (?:zero clause |0 clause )bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)?
bsd | 0.7 | bsd | bsd (?:style )?licen[cs]ed?
isc | 0.9 | isc licen | isc licen[cs]e
mpl-2 | 1.0 | mozilla public licen | mozilla public licen[cs]e (?:v ?|version )?2(?: 0)?
mpl-1.1 | 1.0 | mozilla public licen | mozilla public licen[cs]e (?:v ?|version )?1 1
mpl-1 | 1.0 | mozilla public licen | mozilla public licen[cs]e (?:v ?|version )?1 0
mpl | 0.8 | mozilla public licen | mozilla public licen[cs]e
mpl-2 | 0.8 | mpl | mpl (?:v ?|version )?2(?: 0)?
epl-2 | 1.0 | eclipse public licen | eclipse public licen[cs]e (?:v ?|version )?2(?: 0)?
epl-1 | 1.0 | eclipse public licen | eclipse public licen[cs]e (?:v ?|version )?1(?: 0)?
epl | 0.8 | eclipse public licen | eclipse public licen[cs]e
eupl | 1.0 | european union public licen | european union public licen[cs]e(?: (?:v ?|version )?1 [012])?
eupl | 0.8 | eupl | eupl(?: (?:v ?|version )?1 [012])?
cddl | 0.9 | common development and distribution licen | common development and distribution licen[cs]e(?: (?:v ?|version )?1 [01])?
cddl | 0.7 | cddl | cddl(?: (?:v ?|version )?1 [01])?
cpl | 0.9 | common public licen | common public licen[cs]e(?: (?:v ?|version )?1 0)?
ipl | 0.9 | ibm public licen | ibm public licen[cs]e(?: (?:v ?|version )?1 0)?
osl-3 | 1.0 | open software licen | open software licen[cs]e (?:v ?|version )?3(?: 0)?
osl | 0.8 | open software licen | open software licen[cs]e
afl-3 | 1.0 | academic free licen | academic free licen[cs]e (?:v ?|version )?3(?: 0)?
afl | 0.8 | academic free licen | academic free licen[cs]e
artistic-2 | 1.0 | artistic licen | artistic licen[cs]e (?:v ?|version )?2(?: 0)?
artistic-1 | 1.0 | artistic licen | artistic licen[cs]e (?:v ?|version )?1(?: 0)?
artistic | 0.8 | artistic licen | artistic licen[cs]e
zlib | 0.9 | zlib | zlib (?:libpng )?licen[cs]e
libpng | 0.9 | libpng licen | libpng licen[cs]e
bsl-1 | 1.0 | boost software licen | boost software licen[cs]e(?: (?:v ?|version )?1 0)?
busl | 1.0 | business source licen | business source licen[cs]e(?: (?:v ?|version )?1 1)?
sspl | 1.0 | server side public licen | server side public licen[cs]e(?: (?:v ?|version )?1)?
elastic-2 | 1.0 | elastic licen | elastic licen[cs]e (?:v ?|version )?2(?: 0)?
elastic | 0.9 | elastic licen | elastic licen[cs]e
commons-clause | 1.0 | commons clause | commons clause(?: licen[cs]e)?(?: condition)?
polyform-noncommercial | 1.0 | polyform noncommercial | polyform noncommercial licen[cs]e(?: 1 0 0)?
polyform-small | 1.0 | polyform small business | polyform small business licen[cs]e(?: 1 0 0)?
prosperity | 1.0 | prosperity public licen | prosperity public licen[cs]e(?: 3 0 0)?
parity | 1.0 | parity public licen | parity public licen[cs]e(?: 7 0 0)?
cecill-c | 1.0 | cecill c | cecill c(?: licen[cs]e)?
cecill-b | 1.0 | cecill b | cecill b(?: licen[cs]e)?
cecill | 0.9 | cecill | cecill(?: (?:v ?|version )?2(?: [01])?)?
mulan-psl-2 | 1.0 | mulan permissive software licen | mulan permissive software licen[cs]e(?: (?:v ?|version )?2)?
ms-pl | 0.9 | microsoft public licen | microsoft public licen[cs]e
ms-rl | 0.9 | microsoft reciprocal licen | microsoft reciprocal licen[cs]e
ncsa | 0.9 | ncsa open source licen | (?:university of illinois )?ncsa open source licen[cs]e
openssl | 0.9 | openssl licen | (?:the )?openssl licen[cs]e
php-3 | 0.9 | php licen | php licen[cs]e(?: (?:v ?|version )?3(?: 0(?: 1)?)?)?
postgresql | 0.9 | postgresql licen | postgresql licen[cs]e
python-2 | 0.9 | python software foundation licen | python software foundation licen[cs]e(?: (?:v ?|version )?2)?
ruby | 0.8 | ruby licen | (?:the )?ruby licen[cs]e
unlicense | 0.9 | the unlicense | (?:under )?the unlicense
upl | 0.9 | universal permissive licen | universal permissive licen[cs]e(?: (?:v ?|version )?1(?: 0)?)?
vim | 0.9 | vim licen | vim licen[cs]e
w3c | 0.9 | w3c software | w3c software (?:notice and|and document) licen[cs]e
wtfpl | 0.9 | wtfpl | wtfpl(?: (?:v ?|version )?2)?
llama-2 | 1.0 | llama 2 community licen | llama 2 community licen[cs]e(?: agreement)?
llama-3 | 1.0 | community licen | (?:meta )?llama 3(?: [1-3])? community licen[cs]e(?: agreement)?
gemma | 0.9 | gemma terms of use | gemma terms of use
"""

#: Statements that forbid or reserve, and loose hints.
HINTS = """
all-rights-reserved | 0.8 | all rights reserved | copyright .{0,60}?all rights reserved
all-rights-reserved | 0.7 | all rights reserved | all rights reserved
all-rights-reserved | 0.7 | tous droits r | tous droits r\\S+serv\\S+s
all-rights-reserved | 0.7 | todos los derechos reservados | todos los derechos reservados
all-rights-reserved | 0.7 | alle rechte vorbehalten | alle rechte vorbehalten
proprietary | 0.8 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 0.7 | unauthorized copying | unauthorized copying of (?:this|these) \\w+
proprietary | 0.7 | may not be reproduced | may not be reproduced(?: distributed)?(?: or transmitted)? (?:in any form|without)
proprietary | 0.6 | end user licen | end user licen[cs]e agreement
proprietary | 0.6 | commercial licen | commercial licen[cs]e(?: agreement| is required)
no-ai-training | 0.9 | train | (?:may|must|shall) not be used (?:to train|for training|for the training of) .{0,40}?(?:models?|systems?|intelligence|ai)
no-ai-training | 0.9 | text and data mining | (?:rights? )?reserved? .{0,30}?text and data mining
non-commercial | 0.7 | commercial | (?:for )?non ?commercial (?:use|purposes)(?: only)?
non-commercial | 0.6 | commercial use | (?:no|not for) commercial use
research-only | 0.7 | only | (?:for )?(?:academic|research|educational) (?:use|purposes) only
dual | 0.7 | dual licen | dual licen[cs]ed(?: under)?
source-available | 0.6 | source available licen | source available licen[cs]e
open-source | 0.4 | open source licen | open source licen[cs]e
free-software | 0.4 | free software | this program is free software|this is free software
permission | 0.5 | with permission | (?:reprinted|reproduced|used) with permission
license | 0.3 | licen | (?:re)?licen[cs]ed under(?: the)?
license | 0.3 | licen | see (?:the )?licen[cs]e(?: file| txt| md)?(?: for details)?
license | 0.2 | licen | subject to (?:the|this) licen[cs]e
copyright | 0.2 | copyright | copyright (?:c )?(?:by )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)*
"""


class Rule(NamedTuple):
    """One signature; ``order`` is its priority, 0 the highest."""

    order: int
    label: str
    confidence: float
    keyword: str
    regex: re.Pattern


def _read(table: str, first: int) -> list[Rule]:
    rules = []
    for line in table.strip().splitlines():
        label, confidence, keyword, pattern = line.split(" | ", 3)
        # Of a keyword with an optional blank the part before it is what always occurs.
        rules.append(Rule(first + len(rules), label, float(confidence), keyword.split(" ?")[0], re.compile(f"(?<= )(?:{pattern})(?= )", re.ASCII)))
    return rules


BASE_RULES = _read(BASE, 0)
RULES = list(BASE_RULES)
for _table in (IDENTIFIERS, NOTICES, CONTENT, VERSIONED, HINTS):
    RULES += _read(_table, len(RULES))
