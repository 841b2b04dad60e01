"""DuckDB SQL of the licence scan, from its own literals: sentences as RE2 patterns with what replaces them, and the rules."""

from __future__ import annotations

#: What a sentence becomes, and its pattern; | stands between sentences.
_SENTENCES = r"""
|<MitPermission> = \|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
|<MitConditions>| = \|the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software\|
|<IscPermission>| = \|permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies\|
|<ZlibPermission>| = \|permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions\|
|<ZlibOrigin> = \|the origin of this software must not be misrepresented
|<BoostPermission> = \|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
<BoostGrant> = distributed under the boost software license version 1 0
|<SoftwareAsIs> = \|the software is provided as is (?:without warranty of any kind|and the author disclaims all warranties)
|<BsdRedistribution> = \|redistribution and use in source and binary forms
|<BsdSource>| = \|redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer\|
|<BsdBinary>| = \|redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution\|
|<BsdAdvertising>| = \|all advertising materials mentioning features or use of this software must display the following acknowledgement\|
<BsdEndorse> = used to endorse or promote products derived from this software
|<BsdAsIs> = \|this software is provided by [a-z0-9 ]*as is and any express or implied warranties
<ApacheGrant> = licensed under the apache license version 2 0
<ApacheCompliance>| = you may not use this file except in compliance with the license\|
|<ApacheCopy>| = \|you may obtain a copy of the license at\|
<ApacheAsIs> = distributed under the license is distributed on an as is basis
<ApacheTitle> = apache license version 2 0 january 2004
<GplFree> = is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
<LgplFree> = is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation
<AgplFree> = is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation
<GnuFree>| = is free software\|
|<GplTerms> = \|you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
|<LgplTerms> = \|you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation
|<AgplTerms> = \|you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation
<Gpl2Published> = the gnu general public license version 2(?: only)? as published by the free software foundation
<Gpl3Published> = the gnu general public license version 3(?: only)? as published by the free software foundation
<Lgpl21Published> = the gnu (?:lesser|library) general public license version 2 1(?: only)? as published by the free software foundation
<Lgpl2Published> = the gnu (?:lesser|library) general public license version 2(?: only)? as published by the free software foundation
<Lgpl3Published> = the gnu (?:lesser|library) general public license version 3(?: only)? as published by the free software foundation
<Agpl3Published> = the gnu affero general public license version 3(?: only)? as published by the free software foundation
<Either3> = either version 3 of the license or at your option any later version
<Either21> = either version 2 1 of the license or at your option any later version
<Either2> = either version 2 of the license or at your option any later version
<Only3> = version 3 of the license
<Only21> = version 2 1 of the license
<Only2> = version 2 of the license
<Gpl3Title> = gnu general public license version 3 29 june 2007
<Gpl2Title> = gnu general public license version 2 june 1991
<Lgpl3Title> = gnu lesser general public license version 3 29 june 2007
<Lgpl21Title> = gnu lesser general public license version 2 1 february 1999
<Agpl3Title> = gnu affero general public license version 3 19 november 2007
<GnuHope> = distributed in the hope that it will be useful but without any warranty
<Gpl3Grant> = (?:released|licensed|distributed) under (?:the )?(?:terms of the )?(?:gnu )?(?:general public license|gpl) ?(?:version |v)?3
<Gpl2Grant> = (?:released|licensed|distributed) under (?:the )?(?:terms of the )?(?:gnu )?(?:general public license|gpl) ?(?:version |v)?2
<Lgpl3Grant> = (?:released|licensed|distributed) under (?:the )?(?:terms of the )?(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v)?3
<Lgpl21Grant> = (?:released|licensed|distributed) under (?:the )?(?:terms of the )?(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v)?2 1
<LgplGrant> = (?:released|licensed|distributed) under (?:the )?(?:terms of the )?(?:gnu )?(?:lesser general public license|lgpl)
<Agpl3Grant> = (?:released|licensed|distributed) under (?:the )?(?:terms of the )?(?:gnu )?(?:affero general public license|agpl) ?(?:version |v)?3
<AgplGrant> = (?:released|licensed|distributed) under (?:the )?(?:terms of the )?(?:gnu )?(?:affero general public license|agpl)
<Mpl2>| = subject to the terms of the mozilla public license v 2 0\|
<Epl2> = under the terms of the eclipse public license (?:v )?2 0
|<UnlicenseDomain>| = \|this is free and unencumbered software released into the public domain\|
|<UnlicenseAnyone> = \|anyone is free to copy modify publish use compile sell or distribute this software
<WtfplTitle> = do what the fuck you want to public license
<MitGrant> = (?:released|licensed|distributed) under the (?:terms of the )?mit license
<BsdGrant> = (?:released|licensed|distributed) under the bsd (?:license|licence)
<CcByNcSa> = licensed under (?:a )?(?:cc by nc sa 4 0|creative commons attribution noncommercial sharealike 4 0)
<CcByNc> = licensed under (?:a )?(?:cc by nc 4 0|creative commons attribution noncommercial 4 0)
<CcBySa> = licensed under (?:a )?(?:cc by sa 4 0|creative commons attribution sharealike 4 0)
<CcByNd> = licensed under (?:a )?(?:cc by nd 4 0|creative commons attribution noderivatives 4 0)
<CcBy> = licensed under (?:a )?(?:cc by 4 0|creative commons attribution 4 0)
<Cc0> = (?:cc0 1 0 universal|licensed under cc0 1 0)
<Reserved>| = all rights reserved\|
"""
#: Licences and the identifiers that must follow each other.
_RULES = """
Apache-2.0 = ApacheGrant ApacheCompliance ApacheAsIs
Apache-2.0 = ApacheGrant
Apache-2.0 = ApacheCompliance ApacheAsIs
Apache-2.0 = ApacheTitle
MIT = MitPermission MitConditions
MIT = MitGrant
ISC = IscPermission
Zlib = ZlibPermission ZlibOrigin
BSL-1.0 = BoostPermission
BSL-1.0 = BoostGrant
BSD-4-Clause = BsdRedistribution BsdAdvertising BsdEndorse
BSD-3-Clause = BsdRedistribution BsdEndorse
BSD-2-Clause = BsdRedistribution BsdSource BsdBinary
BSD = BsdGrant
AGPL-3.0-or-later = AgplFree Either3
AGPL-3.0-or-later = AgplTerms Either3
AGPL-3.0-only = AgplFree Only3
AGPL-3.0-only = AgplTerms Only3
AGPL-3.0-only = Agpl3Published
AGPL-3.0 = Agpl3Title
AGPL-3.0 = Agpl3Grant
AGPL = AgplGrant
LGPL-3.0-or-later = LgplFree Either3
LGPL-3.0-or-later = LgplTerms Either3
LGPL-2.1-or-later = LgplFree Either21
LGPL-2.1-or-later = LgplTerms Either21
LGPL-2.0-or-later = LgplFree Either2
LGPL-2.0-or-later = LgplTerms Either2
LGPL-3.0-only = LgplFree Only3
LGPL-3.0-only = LgplTerms Only3
LGPL-3.0-only = Lgpl3Published
LGPL-2.1-only = LgplFree Only21
LGPL-2.1-only = LgplTerms Only21
LGPL-2.1-only = Lgpl21Published
LGPL-2.0-only = LgplFree Only2
LGPL-2.0-only = LgplTerms Only2
LGPL-2.0-only = Lgpl2Published
LGPL-3.0 = Lgpl3Title
LGPL-2.1 = Lgpl21Title
LGPL-3.0 = Lgpl3Grant
LGPL-2.1 = Lgpl21Grant
LGPL = LgplGrant
GPL-3.0-or-later = GplFree Either3
GPL-3.0-or-later = GplTerms Either3
GPL-2.0-or-later = GplFree Either2
GPL-2.0-or-later = GplTerms Either2
GPL-3.0-only = GplFree Only3
GPL-3.0-only = GplTerms Only3
GPL-3.0-only = Gpl3Published
GPL-2.0-only = GplFree Only2
GPL-2.0-only = GplTerms Only2
GPL-2.0-only = Gpl2Published
GPL-3.0 = Gpl3Title
GPL-2.0 = Gpl2Title
GPL-3.0 = Gpl3Grant
GPL-2.0 = Gpl2Grant
GPL = GplFree
GPL = GplTerms
MPL-2.0 = Mpl2
EPL-2.0 = Epl2
Unlicense = UnlicenseDomain UnlicenseAnyone
WTFPL = WtfplTitle
CC-BY-NC-SA-4.0 = CcByNcSa
CC-BY-NC-4.0 = CcByNc
CC-BY-SA-4.0 = CcBySa
CC-BY-ND-4.0 = CcByNd
CC-BY-4.0 = CcBy
CC0-1.0 = Cc0
Proprietary = Reserved
"""
#: Names in SPDX tags; longer ones first.
_TAGS = """
MIT Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause ISC Zlib BSL-1.0 AGPL-3.0-or-later AGPL-3.0-only AGPL-3.0 LGPL-3.0-or-later LGPL-3.0-only LGPL-3.0 LGPL-2.1-or-later LGPL-2.1-only LGPL-2.1
LGPL-2.0-or-later LGPL-2.0-only LGPL-2.0 GPL-3.0-or-later GPL-3.0-only GPL-3.0 GPL-2.0-or-later GPL-2.0-only GPL-2.0 MPL-2.0 EPL-2.0 Unlicense WTFPL CC-BY-NC-SA-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0
CC-BY-ND-4.0 CC-BY-4.0 CC0-1.0
"""
_SPACE = r"[\t\n\f\r ]"
_HINTS = "licen gpl permission permitted software redistribution conditions rights cc0 copyright advertising hope modify misrepresented"


def _lines(block: str) -> list[list[str]]:
    return [x.split(" = ", 1) for x in block.strip().split("\n")]


def license_sql() -> str:
    named = "plain"
    for becomes, pattern in _lines(_SENTENCES):
        named = f"regexp_replace({named}, '{pattern}', '{becomes}', 'g')"
    tags = [(t, t.replace("-", "").replace(".", "")) for t in _TAGS.split()]
    for t, short in tags:
        words = t.lower().replace("-", " ").replace(".", " ")
        named = rf"regexp_replace({named}, '(\|spdx license identifier (?:[^|]* )?){words}( or | and | with |\|)', '\1<Spdx{short}>\2', 'g')"
    rules = [(t, f"Spdx{short}") for t, short in tags] + _lines(_RULES)
    fits = ", ".join(f"case when regexp_matches(line, ';{';(.*;)?'.join(need.split())};') then '{name}' end" for name, need in rules)
    hinted = " or ".join(f"contains(lower(text), '{h}')" for h in _HINTS.split())
    return rf"""
with a as (select doc_id, text, regexp_replace(replace(lower(regexp_replace(coalesce(text, ''), '(^|[^A-Za-z])(Inc|Ltd|Corp|Co|LLC|GmbH)\.{_SPACE}+([a-z])', '\1\2 \3', 'g')), '|', ' '), '^#![^\n]*\n', chr(10) || chr(10)) as w from documents),
t as (select doc_id, text, regexp_replace(regexp_replace(w, '(gpl-[0-9]\.[0-9])\+', '\1-or-later', 'g'), 'spdx-license-identifier:([^\n]*)', '|spdx-license-identifier \1|', 'g') as x from a),
b as (select doc_id, text, regexp_replace(x, '(^|\n)[\t ]*(/\*+|\*+/|\*+|//+|#+|;+|--+|<!--|%+|dnl )', '\1', 'g') as x from t),
c as (select doc_id, text, regexp_replace(x, '(^|[^a-z])(v|ver|vers)\.{_SPACE}+([0-9])', '\1\2 \3', 'g') as x from b),
d as (select doc_id, text, regexp_replace(x, '([.!?;:])["'')]*{_SPACE}+', '|', 'g') as x from c),
e as (select doc_id, text, regexp_replace(x, '\n[\t\f\r ]*\n', '|', 'g') as x from d),
f as (select doc_id, text, regexp_replace('|' || regexp_replace(x, '[^a-z0-9|]+', ' ', 'g') || '|', '( ?\| ?)+', '|', 'g') as plain from e),
g as (select doc_id, case when {hinted} then regexp_extract_all({named}, '<([A-Za-z0-9]+)>', 1) else [] end as ids from f),
h as (select doc_id, ids, ';' || array_to_string(ids, ';') || ';' as line from g),
fits as (select doc_id, ids, list_filter([{{fits}}], lambda y: y is not null) as every from h)
select doc_id, cast(len(ids) as integer) as n_sentences, array_to_string(ids, ';') as sentence_ids, every[1] as license,
  coalesce(array_to_string(list_filter(every, lambda y, k: list_position(every, y) = k), ';'), '') as licenses
from fits
""".replace("{fits}", fits)
