"""Licence recognition by sentences and rules.

A text is cut into sentences, whatever its line breaks and comment marks, and each is normalised to lower-case words. Known licence
sentences, whole ones or the clause that makes a grant, are mapped to identifiers; the sequence of a text's identifiers is matched against ordered
rules, and the first rule that fits names the licence.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers and normalised sentences of published licences, as patterns. ^ and $ stand for the sentence's ends.
SENTENCES = [
    # MIT, ISC, zlib, Boost
    ("MitPermission", "^permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("MitConditions", "^the above copyright notice and this permission notice (including the next paragraph )?shall be included in all copies or substantial portions of the software$"),
    ("IscPermission", "^permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies$"),
    ("ZlibPermission", "^permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions$"),
    ("ZlibOrigin", "^the origin of this software must not be misrepresented"),
    ("BoostPermission", "^permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("BoostGrant", "distributed under the boost software license version 1 0"),
    ("SoftwareAsIs", "^the software is provided as is (without warranty of any kind|and the author disclaims all warranties)"),
    # BSD
    ("BsdRedistribution", "^redistribution and use in source and binary forms"),
    ("BsdSource", "^redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer$"),
    ("BsdBinary", "^redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution$"),
    ("BsdAdvertising", "^all advertising materials mentioning features or use of this software must display the following acknowledgement$"),
    ("BsdEndorse", "used to endorse or promote products derived from this software"),
    ("BsdAsIs", "^this software is provided by [a-z0-9 ]*as is and any express or implied warranties"),
    # Apache
    ("ApacheGrant", "licensed under the apache license version 2 0"),
    ("ApacheCompliance", "you may not use this file except in compliance with the license$"),
    ("ApacheCopy", "^you may obtain a copy of the license at$"),
    ("ApacheAsIs", "distributed under the license is distributed on an as is basis"),
    ("ApacheTitle", "apache license version 2 0 january 2004"),
    # GNU
    ("GplFree", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("LgplFree", "is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license as published by the free software foundation"),
    ("AgplFree", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("GnuFree", "is free software$"),
    ("GplTerms", "^you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("LgplTerms", "^you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license as published by the free software foundation"),
    ("AgplTerms", "^you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("Gpl2Published", "the gnu general public license version 2( only)? as published by the free software foundation"),
    ("Gpl3Published", "the gnu general public license version 3( only)? as published by the free software foundation"),
    ("Lgpl21Published", "the gnu (lesser|library) general public license version 2 1( only)? as published by the free software foundation"),
    ("Lgpl2Published", "the gnu (lesser|library) general public license version 2( only)? as published by the free software foundation"),
    ("Lgpl3Published", "the gnu (lesser|library) general public license version 3( only)? as published by the free software foundation"),
    ("Agpl3Published", "the gnu affero general public license version 3( only)? as published by the free software foundation"),
    ("Either3", "either version 3 of the license or at your option any later version"),
    ("Either21", "either version 2 1 of the license or at your option any later version"),
    ("Either2", "either version 2 of the license or at your option any later version"),
    ("Only3", "version 3 of the license"),
    ("Only21", "version 2 1 of the license"),
    ("Only2", "version 2 of the license"),
    ("Gpl3Title", "gnu general public license version 3 29 june 2007"),
    ("Gpl2Title", "gnu general public license version 2 june 1991"),
    ("Lgpl3Title", "gnu lesser general public license version 3 29 june 2007"),
    ("Lgpl21Title", "gnu lesser general public license version 2 1 february 1999"),
    ("Agpl3Title", "gnu affero general public license version 3 19 november 2007"),
    ("GnuHope", "distributed in the hope that it will be useful but without any warranty"),
    ("Gpl3Grant", "(released|licensed|distributed) under (the )?(terms of the )?(gnu )?(general public license|gpl) ?(version |v)?3"),
    ("Gpl2Grant", "(released|licensed|distributed) under (the )?(terms of the )?(gnu )?(general public license|gpl) ?(version |v)?2"),
    ("Lgpl3Grant", "(released|licensed|distributed) under (the )?(terms of the )?(gnu )?(lesser general public license|lgpl) ?(version |v)?3"),
    ("Lgpl21Grant", "(released|licensed|distributed) under (the )?(terms of the )?(gnu )?(lesser general public license|lgpl) ?(version |v)?2 1"),
    ("LgplGrant", "(released|licensed|distributed) under (the )?(terms of the )?(gnu )?(lesser general public license|lgpl)"),
    ("Agpl3Grant", "(released|licensed|distributed) under (the )?(terms of the )?(gnu )?(affero general public license|agpl) ?(version |v)?3"),
    ("AgplGrant", "(released|licensed|distributed) under (the )?(terms of the )?(gnu )?(affero general public license|agpl)"),
    # others
    ("Mpl2", "subject to the terms of the mozilla public license v 2 0$"),
    ("Epl2", "under the terms of the eclipse public license (v )?2 0"),
    ("UnlicenseDomain", "^this is free and unencumbered software released into the public domain$"),
    ("UnlicenseAnyone", "^anyone is free to copy modify publish use compile sell or distribute this software"),
    ("WtfplTitle", "do what the fuck you want to public license"),
    ("MitGrant", "(released|licensed|distributed) under the (terms of the )?mit license"),
    ("BsdGrant", "(released|licensed|distributed) under the bsd (license|licence)"),
    ("CcByNcSa", "licensed under (a )?(cc by nc sa 4 0|creative commons attribution noncommercial sharealike 4 0)"),
    ("CcByNc", "licensed under (a )?(cc by nc 4 0|creative commons attribution noncommercial 4 0)"),
    ("CcBySa", "licensed under (a )?(cc by sa 4 0|creative commons attribution sharealike 4 0)"),
    ("CcByNd", "licensed under (a )?(cc by nd 4 0|creative commons attribution noderivatives 4 0)"),
    ("CcBy", "licensed under (a )?(cc by 4 0|creative commons attribution 4 0)"),
    ("Cc0", "(cc0 1 0 universal|licensed under cc0 1 0)"),
    ("Reserved", "all rights reserved$"),
]
#: SPDX names that a tag can give; of names that begin alike the longer stand first.
SPDX = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "Zlib", "BSL-1.0", "AGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0", "LGPL-3.0-or-later", "LGPL-3.0-only", "LGPL-3.0",
    "LGPL-2.1-or-later", "LGPL-2.1-only", "LGPL-2.1", "LGPL-2.0-or-later", "LGPL-2.0-only", "LGPL-2.0", "GPL-3.0-or-later", "GPL-3.0-only", "GPL-3.0", "GPL-2.0-or-later", "GPL-2.0-only", "GPL-2.0",
    "MPL-2.0", "EPL-2.0", "Unlicense", "WTFPL", "CC-BY-NC-SA-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-4.0", "CC0-1.0",
]
#: The rules in order, as an SPDX name and the identifiers that must follow each other, others between them or not.
RULES = [
    *((name, ["Spdx" + re.sub("[^A-Za-z0-9]", "", name)]) for name in SPDX),
    ("Apache-2.0", ["ApacheGrant", "ApacheCompliance", "ApacheAsIs"]),
    ("Apache-2.0", ["ApacheGrant"]),
    ("Apache-2.0", ["ApacheCompliance", "ApacheAsIs"]),
    ("Apache-2.0", ["ApacheTitle"]),
    ("MIT", ["MitPermission", "MitConditions"]),
    ("MIT", ["MitGrant"]),
    ("ISC", ["IscPermission"]),
    ("Zlib", ["ZlibPermission", "ZlibOrigin"]),
    ("BSL-1.0", ["BoostPermission"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSD-4-Clause", ["BsdRedistribution", "BsdAdvertising", "BsdEndorse"]),
    ("BSD-3-Clause", ["BsdRedistribution", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdRedistribution", "BsdSource", "BsdBinary"]),
    ("BSD", ["BsdGrant"]),
    ("AGPL-3.0-or-later", ["AgplFree", "Either3"]),
    ("AGPL-3.0-or-later", ["AgplTerms", "Either3"]),
    ("AGPL-3.0-only", ["AgplFree", "Only3"]),
    ("AGPL-3.0-only", ["AgplTerms", "Only3"]),
    ("AGPL-3.0-only", ["Agpl3Published"]),
    ("AGPL-3.0", ["Agpl3Title"]),
    ("AGPL-3.0", ["Agpl3Grant"]),
    ("AGPL", ["AgplGrant"]),
    ("LGPL-3.0-or-later", ["LgplFree", "Either3"]),
    ("LGPL-3.0-or-later", ["LgplTerms", "Either3"]),
    ("LGPL-2.1-or-later", ["LgplFree", "Either21"]),
    ("LGPL-2.1-or-later", ["LgplTerms", "Either21"]),
    ("LGPL-2.0-or-later", ["LgplFree", "Either2"]),
    ("LGPL-2.0-or-later", ["LgplTerms", "Either2"]),
    ("LGPL-3.0-only", ["LgplFree", "Only3"]),
    ("LGPL-3.0-only", ["LgplTerms", "Only3"]),
    ("LGPL-3.0-only", ["Lgpl3Published"]),
    ("LGPL-2.1-only", ["LgplFree", "Only21"]),
    ("LGPL-2.1-only", ["LgplTerms", "Only21"]),
    ("LGPL-2.1-only", ["Lgpl21Published"]),
    ("LGPL-2.0-only", ["LgplFree", "Only2"]),
    ("LGPL-2.0-only", ["LgplTerms", "Only2"]),
    ("LGPL-2.0-only", ["Lgpl2Published"]),
    ("LGPL-3.0", ["Lgpl3Title"]),
    ("LGPL-2.1", ["Lgpl21Title"]),
    ("LGPL-3.0", ["Lgpl3Grant"]),
    ("LGPL-2.1", ["Lgpl21Grant"]),
    ("LGPL", ["LgplGrant"]),
    ("GPL-3.0-or-later", ["GplFree", "Either3"]),
    ("GPL-3.0-or-later", ["GplTerms", "Either3"]),
    ("GPL-2.0-or-later", ["GplFree", "Either2"]),
    ("GPL-2.0-or-later", ["GplTerms", "Either2"]),
    ("GPL-3.0-only", ["GplFree", "Only3"]),
    ("GPL-3.0-only", ["GplTerms", "Only3"]),
    ("GPL-3.0-only", ["Gpl3Published"]),
    ("GPL-2.0-only", ["GplFree", "Only2"]),
    ("GPL-2.0-only", ["GplTerms", "Only2"]),
    ("GPL-2.0-only", ["Gpl2Published"]),
    ("GPL-3.0", ["Gpl3Title"]),
    ("GPL-2.0", ["Gpl2Title"]),
    ("GPL-3.0", ["Gpl3Grant"]),
    ("GPL-2.0", ["Gpl2Grant"]),
    ("GPL", ["GplFree"]),
    ("GPL", ["GplTerms"]),
    ("MPL-2.0", ["Mpl2"]),
    ("EPL-2.0", ["Epl2"]),
    ("Unlicense", ["UnlicenseDomain", "UnlicenseAnyone"]),
    ("WTFPL", ["WtfplTitle"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSa"]),
    ("CC-BY-NC-4.0", ["CcByNc"]),
    ("CC-BY-SA-4.0", ["CcBySa"]),
    ("CC-BY-ND-4.0", ["CcByNd"]),
    ("CC-BY-4.0", ["CcBy"]),
    ("CC0-1.0", ["Cc0"]),
    ("Proprietary", ["Reserved"]),
]
#: Words of which every known sentence has one: texts without any need no further look.
HINTS = ("licen", "gpl", "permission", "permitted", "software", "redistribution", "conditions", "rights", "cc0", "copyright", "advertising", "hope", "modify", "misrepresented")
SPACE = r"[\t\n\f\r ]"


def plain_sentences(text: Column) -> Column:
    """All sentences of a text as words of a-z and 0-9, with | before, between and after them.

    Comment marks at the beginnings of lines go, and a first line that names an interpreter. Sentences end at blank lines and, where white space follows, at . ! ? ; and : but
    not between v. and a number, nor after Inc., Ltd., Corp., Co., LLC. or GmbH. where a small letter follows; other line ends are spaces. An SPDX tag is a sentence, to its line's end.
    """
    x = F.regexp_replace(text, rf"(^|[^A-Za-z])(Inc|Ltd|Corp|Co|LLC|GmbH)\.{SPACE}+([a-z])", "$1$2 $3")
    x = F.regexp_replace(F.regexp_replace(F.lower(x), r"\|", " "), r"^#![^\n]*\n", "\n\n")
    x = F.regexp_replace(x, r"(gpl-[0-9]\.[0-9])\+", "$1-or-later")
    x = F.regexp_replace(x, r"spdx-license-identifier:([^\n]*)", "|spdx-license-identifier $1|")
    x = F.regexp_replace(x, r"(^|\n)[\t ]*(/\*+|\*+/|\*+|//+|#+|;+|--+|<!--|%+|dnl )", "$1")
    x = F.regexp_replace(x, rf"(^|[^a-z])(v|ver|vers)\.{SPACE}+([0-9])", "$1$2 $3")
    x = F.regexp_replace(x, rf"([.!?;:])[\"')]*{SPACE}+", "|")
    x = F.regexp_replace(x, r"\n[\t\f\r ]*\n", "|")
    x = F.regexp_replace(x, "[^a-z0-9|]+", " ")
    return F.regexp_replace(F.concat(F.lit("|"), x, F.lit("|")), r"( ?\| ?)+", "|")


def marked(plain: Column) -> Column:
    """Sentences with each known one replaced by its identifier between < and >."""
    for name, pattern in SENTENCES:
        first, last = pattern.startswith("^"), pattern.endswith("$")
        groups = pattern.count("(")
        found = (r"(\|)" if first else "()") + pattern.removeprefix("^").removesuffix("$") + (r"(\|)" if last else "()")
        plain = F.regexp_replace(plain, found, f"$1<{name}>${groups + 2}")
    for name in SPDX:
        words = re.sub("[^a-z0-9]+", " ", name.lower())
        plain = F.regexp_replace(plain, rf"(\|spdx license identifier (?:[^|]* )?){words}( or | and | with |\|)", f"$1<Spdx{re.sub('[^A-Za-z0-9]', '', name)}>$2")
    return plain


def hinted(x: Column) -> Column:
    low = F.lower(x)
    return reduce(lambda a, b: a | b, (low.contains(h) for h in HINTS))


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, license, licenses): one row per row of ``docs``, in one pass without a shuffle.

    n_sentences int and sentence_ids array: the recognised sentences in order; of overlapping ones the first of SENTENCES; license: that of the
    first rule that fits, else null; licenses: of all that fit, in the order of the rules, each once. Null or empty text: none. Very long
    texts are read whole. Repeated rows are each returned; an empty table gives no rows; other columns are not read.
    """
    found = F.regexp_extract_all(marked(plain_sentences(F.col(text))), F.lit("<([A-Za-z0-9]+)>"), F.lit(1))
    ids = F.when(hinted(F.col(text)), found).otherwise(F.array().cast("array<string>"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, need)).alias("need")) for name, need in RULES))
    # how far the list of a rule has been met, one sentence after the other
    met = lambda ids, r: F.aggregate(ids, F.lit(0), lambda k, x: F.when(F.get(r["need"], k) == x, k + 1).otherwise(k)) == F.size(r["need"])
    names = lambda ids: F.array_distinct(F.transform(F.filter(rules, lambda r: met(ids, r)), lambda r: r["name"]))
    every = lambda ids: F.when(F.size(ids) > 0, names(ids)).otherwise(F.array().cast("array<string>"))
    # generated, so that no later filter or column copies the chain of expressions
    once = F.explode(F.transform(F.array(ids), lambda ids: F.struct(ids.alias("ids"), every(ids).alias("names"))))
    out = docs.select("doc_id", once.alias("x"))
    return out.select("doc_id", F.size("x.ids").alias("n_sentences"), F.col("x.ids").alias("sentence_ids"), F.get("x.names", F.lit(0)).alias("license"), F.col("x.names").alias("licenses"))
