"""Licence scan: sentences to identifiers, identifier sequences to licences, in built-in expressions only.

A text is cut into sentences, each normalised to lower-case letters and digits; a table maps known
licence sentences to identifiers; ordered rules then rewrite the sequence of identifiers, longest
form first, so that a full licence text is not also reported by its parts.

Defined results: null or empty text, and texts without a licence sentence, give empty lists and 0;
equal sentences count each time; repeated rows are scanned each for itself; empty tables give empty
tables; other columns are ignored.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netprobe.llm.common import text_or_empty

# Licences and the names that notices give them.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License, Version 2.0 (the \"License\")", "Apache License 2.0", "Apache 2.0 License", "Apache Software License, Version 2.0"],
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License version 3.0", "GNU GPL v3", "GNU GPL version 3", "GPLv3", "GPL v3", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+", "GPLv3+"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License version 2.0", "GNU GPL v2", "GNU GPL version 2", "GPLv2", "GPL v2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+", "GPLv2+"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0+"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1+"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD license", "3-clause BSD license", "New BSD License", "Modified BSD License", "BSD-style license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "FreeBSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "4-clause BSD license"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v2.0"],
    "ISC": ["ISC License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, version 2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal License", "CC0 1.0 Universal"],
    "Unlicense": ["Unlicense"],
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License"],
}
# The ways in which a notice grants a licence by name.
GRANTS = [
    "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}",
    "Available under the {}", "This work is licensed under {}", "This work is licensed under the {}",
    "This work is licensed under a {}", "This software is licensed under the {}", "This project is licensed under the {}",
    "This file is licensed under the {}", "SPDX-License-Identifier {}",
]
# Sentences of well-known licence texts.
SENTENCES: dict[str, list[str]] = {
    "MIT.grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "MIT.notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "AS-IS.warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "ISC.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "BSD.grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BSD.binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BSD.endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSD.advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "APACHE.except": ["you may not use this file except in compliance with the License"],
    "APACHE.obtain": ["You may obtain a copy of the License at"],
    "APACHE.title": ["Apache License"],
    "APACHE.dated": ["Version 2.0, January 2004"],
    "GPL.freedom": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "GPL.notice3": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "GPL.notice2": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"],
    "GPL.only2": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "GPL.only3": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"],
    "GPL.version3": ["either version 3 of the License, or (at your option) any later version"],
    "GPL.version2": ["either version 2 of the License, or (at your option) any later version"],
    "GPL.warranty": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "GPL.title": ["GNU GENERAL PUBLIC LICENSE"],
    "GPL.dated3": ["Version 3, 29 June 2007"],
    "GPL.dated2": ["Version 2, June 1991"],
    "LGPL.freedom": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "LGPL.notice3": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "LGPL.notice21": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version"],
    "LGPL.version21": ["either version 2.1 of the License, or (at your option) any later version"],
    "LGPL.title": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "LGPL.dated21": ["Version 2.1, February 1999"],
    "AGPL.freedom": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "AGPL.notice3": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "AGPL.title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "AGPL.dated3": ["Version 3, 19 November 2007"],
    "MPL.terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"],
    "MPL.title": ["Mozilla Public License Version 2.0"],
    "EPL.terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"],
    "BOOST.title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "BOOST.grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "ZLIB.warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "ZLIB.grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "ZERO.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "UNLICENSE.domain": ["This is free and unencumbered software released into the public domain"],
    "RESERVED": ["All rights reserved"],
}
SENTENCES["BSD.endorse"] += [
    "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
]
#: Ordered rules: the licence, and the identifiers that must follow one another.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["MIT.grant", "MIT.notice", "AS-IS.warranty"]),
    ("MIT", ["MIT.grant", "MIT.notice"]),
    ("BSD-4-Clause", ["BSD.grant", "BSD.source", "BSD.binary", "BSD.advert", "BSD.endorse"]),
    ("BSD-4-Clause", ["BSD.grant", "BSD.source", "BSD.binary", "BSD.advert"]),
    ("BSD-3-Clause", ["BSD.grant", "BSD.source", "BSD.binary", "BSD.endorse"]),
    ("BSD-2-Clause", ["BSD.grant", "BSD.source", "BSD.binary"]),
    ("AGPL-3.0", ["AGPL.freedom", "GPL.version3"]),
    ("AGPL-3.0", ["AGPL.title", "AGPL.dated3"]),
    ("LGPL-3.0", ["LGPL.freedom", "GPL.version3"]),
    ("LGPL-3.0", ["LGPL.title", "GPL.dated3"]),
    ("LGPL-2.1", ["LGPL.freedom", "LGPL.version21"]),
    ("LGPL-2.1", ["LGPL.title", "LGPL.dated21"]),
    ("GPL-3.0", ["GPL.freedom", "GPL.version3"]),
    ("GPL-3.0", ["GPL.title", "GPL.dated3"]),
    ("GPL-2.0", ["GPL.freedom", "GPL.version2"]),
    ("GPL-2.0", ["GPL.title", "GPL.dated2"]),
    ("Apache-2.0", ["Apache-2.0", "APACHE.except", "APACHE.obtain"]),
    ("Apache-2.0", ["Apache-2.0", "APACHE.except"]),
    ("Apache-2.0", ["APACHE.title", "APACHE.dated"]),
    ("BSL-1.0", ["BOOST.title", "BOOST.grant"]),
    ("Zlib", ["ZLIB.warranty", "ZLIB.grant"]),
    ("AGPL-3.0", ["AGPL.notice3"]),
    ("LGPL-3.0", ["LGPL.notice3"]),
    ("LGPL-2.1", ["LGPL.notice21"]),
    ("GPL-3.0", ["GPL.notice3"]),
    ("GPL-3.0", ["GPL.only3"]),
    ("GPL-2.0", ["GPL.notice2"]),
    ("GPL-2.0", ["GPL.only2"]),
    ("MPL-2.0", ["MPL.terms"]),
    ("MPL-2.0", ["MPL.title"]),
    ("EPL-2.0", ["EPL.terms"]),
    ("BSL-1.0", ["BOOST.grant"]),
    ("Zlib", ["ZLIB.grant"]),
    ("0BSD", ["ZERO.grant"]),
    ("ISC", ["ISC.grant"]),
    ("Unlicense", ["UNLICENSE.domain"]),
    *[(name, [name]) for name in NAMES],
    ("Proprietary", ["RESERVED"]),
]
#: Every known sentence holds one of these, so texts and sentences without any are passed over.
CUES = ["licen", "under", "copyright", "permission", "warranty", "redistribut", "rights reserved", "version 3", "version 2", "public domain", "advertising materials"]
UNKNOWN = "?"
#: The colon after this tag ends no sentence; what follows may be an expression of several licences.
TAG = "spdx-license-identifier"
TAGGED = "spdx license identifier "


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))).strip()


def sentence_table() -> dict[str, str]:
    """Normalised sentence to identifier."""
    tagged = lambda s: s.replace(" or later", " orlater") if s.startswith(TAGGED) else s
    out = {tagged(normal(g.format(n))): name for name, names in NAMES.items() for n in [*names, name] for g in GRANTS}
    return out | {normal(s): k for k, forms in SENTENCES.items() for s in forms}


def _expression(s: Column) -> Column:
    """A tag with several licences as so many sentences: joined by AND and OR; what follows WITH is an exception."""
    parts = F.split(F.replace(F.substring(s, len(TAGGED) + 1, 2**31 - 1), F.lit(" or later"), F.lit(" orlater")), " (or|and) ")
    own = F.transform(parts, lambda p: F.concat(F.lit(TAGGED), F.regexp_replace(p, " with .*$", "")))
    return F.when(F.startswith(s, F.lit(TAGGED)), own).otherwise(F.array(s))


def _sentences(text: Column, breaks: str) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    lower = F.replace(lower, F.lit(TAG + ":"), F.lit(TAG))
    ended = F.regexp_replace(lower, breaks, "\u0001")
    return F.flatten(F.transform(F.split(ended, "\u0001"), lambda s: _expression(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))))


def _has_cue(text: Column) -> Column:
    out = F.lit(False)
    for cue in CUES:
        out = out | F.contains(text, F.lit(cue))
    return out


def _identify(sentences: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in sentence_table().items() for x in pair])
    known = F.transform(F.filter(sentences, _has_cue), lambda s: F.coalesce(F.try_element_at(table, s), F.when(F.contains(s, F.lit("licen")), UNKNOWN)))
    return F.filter(known, lambda x: x.isNotNull())


#: A line end closes a sentence; or, for texts wrapped at a margin, only an empty line does.
BY_LINE = "[.!?;:]+([ \\t\\n\\r]|\\z)|\\n"
BY_STOP = "[.!?;:]+([ \\t\\n\\r]|\\z)|\\n[ \\t\\r]*\\n"


def scan(docs: DataFrame) -> DataFrame:
    """Adds sentence_ids, licenses (arrays) and n_unknown to every document."""
    lower = F.translate(F.col("_text"), string.ascii_uppercase, string.ascii_lowercase)
    none = F.array().cast("array<string>")
    count_known = lambda ids: F.size(F.filter(ids, lambda x: x != UNKNOWN))
    out = docs.withColumn("_text", text_or_empty())
    out = out.withColumn("_lined", F.when(_has_cue(lower), _identify(_sentences(F.col("_text"), BY_LINE))).otherwise(none))
    out = out.withColumn("_flowed", F.when(_has_cue(lower), _identify(_sentences(F.col("_text"), BY_STOP))).otherwise(none))
    out = out.withColumn("sentence_ids", F.when(count_known(F.col("_flowed")) > count_known(F.col("_lined")), F.col("_flowed")).otherwise(F.col("_lined")))
    sequence = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    for name, ids in RULES:
        sequence = F.replace(sequence, F.lit("," + ",".join(ids) + ","), F.lit(f",,<{name}>,,")) if len(ids) > 1 else F.regexp_replace(sequence, f",{re.escape(ids[0])}(?=,)", f",<{name}>")
    out = out.withColumn("_matched", F.when(F.size("sentence_ids") > 0, sequence).otherwise(F.lit("")))
    out = out.withColumn("licenses", F.array_sort(F.array_distinct(F.regexp_extract_all("_matched", F.lit("<([^>]+)>"), F.lit(1)))))
    out = out.withColumn("n_unknown", F.size(F.filter("sentence_ids", lambda x: x == UNKNOWN)).cast("long"))
    return out.drop("_text", "_lined", "_flowed", "_matched")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
        F.size("sentence_ids").cast("long").alias("n_sentences"), "n_unknown",
    )


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lower = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sentence_table().items())
    sequence = "',' || ids || ','"
    for name, ids in RULES:
        if len(ids) > 1:
            sequence = f"replace({sequence}, {quote(',' + ','.join(ids) + ',')}, {quote(f',,<{name}>,,')})"
        else:  # RE2 has no look-ahead: double the commas first
            sequence = f"replace(replace(replace({sequence}, ',', ',,'), {quote(f',{ids[0]},')}, {quote(f',<{name}>,')}), ',,', ',')"

    def pieces(mode: str, breaks: str) -> str:
        return f"""{mode} AS (SELECT doc_id, string_agg(id, ',' ORDER BY i, j) AS ids, count(*) AS n, count(*) FILTER (id <> '?') AS known FROM (
    SELECT doc_id, i, j, coalesce(k.id, CASE WHEN contains(s, 'licen') THEN '?' END) AS id FROM (
        SELECT doc_id, i, generate_subscripts(e, 1) AS j, unnest(e) AS s FROM (
            SELECT doc_id, i, CASE WHEN starts_with(s, '{TAGGED}') THEN list_transform(string_split_regex(replace(substr(s, {len(TAGGED) + 1}), ' or later', ' orlater'), ' (or|and) '), lambda x: '{TAGGED}' || regexp_replace(x, ' with .*$', '')) ELSE [s] END AS e FROM (
                SELECT doc_id, generate_subscripts(p, 1) AS i, trim(regexp_replace(unnest(p), '[^a-z0-9]+', ' ', 'g')) AS s FROM (
                    SELECT doc_id, string_split(regexp_replace(replace({lower}, '{TAG}:', '{TAG}'), '{breaks}', chr(1), 'g'), chr(1)) AS p FROM base)))
    ) LEFT JOIN known k USING (s)) WHERE id IS NOT NULL GROUP BY doc_id)"""

    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
known(s, id) AS (VALUES {values}),
{pieces("lined", BY_LINE.replace(chr(92) * 2, chr(92)))},
{pieces("flowed", BY_STOP.replace(chr(92) * 2, chr(92)))},
best AS (SELECT doc_id, CASE WHEN coalesce(f.known, 0) > coalesce(l.known, 0) THEN f.ids ELSE l.ids END AS ids
    FROM base LEFT JOIN lined l USING (doc_id) LEFT JOIN flowed f USING (doc_id))
SELECT doc_id, coalesce(ids, '') AS sentence_ids,
    CASE WHEN ids IS NULL THEN '' ELSE array_to_string(list_sort(list_distinct(regexp_extract_all({sequence}, '<([^>]+)>', 1))), ',') END AS licenses,
    CASE WHEN ids IS NULL THEN 0 ELSE len(string_split(ids, ',')) END::BIGINT AS n_sentences,
    CASE WHEN ids IS NULL THEN 0 ELSE len(list_filter(string_split(ids, ','), lambda x: x = '?')) END::BIGINT AS n_unknown
FROM best
"""


ORACLE = _oracle()
