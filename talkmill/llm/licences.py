"""Licence scans by sentence rules.

A text is cut into paragraphs at blank lines, and a paragraph into sentences twice: as one run of text, since notices are wrapped at any
column and often behind comment marks, and line by line. Each sentence is normalised and mapped to the identifier of a known licence
sentence; of the two cuts a paragraph takes the one that knows more of its sentences, the first on a tie. Runs of other sentences are
skipped. A rule is an ordered list of identifiers; it matches a text whose identifier sequence has them in this order. A rule whose
sentences all belong to another, longer match adds nothing: the longest evidence names the licence. Everything is a built-in expression
over one pass of the texts; the tables of sentences and rules are constants of a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import need

def _named(*names: str) -> tuple[str, ...]:
    """The ways a line names a licence. Of names that may be words of prose or of other things only those that say licence."""
    ways = ("", "the ", "released under ", "released under the ", "distributed under ", "distributed under the ", "licensed under ", "licensed under the ", "this project is licensed under the ", "this work is licensed under ", "this work is licensed under the ", "this software is licensed under the ", "this file is licensed under the ", "license ", "spdx license identifier ")
    return tuple(f"{p}{n}" for n in names for p in ways if "licen" in p or "licen" in n or n.startswith("cc by") and p)


def _gnu(kind: str, version: str) -> tuple[str, ...]:
    text = "{0} is free software you can redistribute it and or modify it under the terms of the gnu {1} as published by the free software foundation either version {2} of the license or at your option any later version"
    return tuple(text.format(x, kind, version) for x in ("this program", "this library", "this software"))


#: Identifier -> sentences, normalised: lower case, ASCII letters, digits and dots inside numbers, single spaces.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit_name": _named("mit license", "mit"),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as_is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "isc_name": _named("isc license", "isc"),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "isc_disclaim": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "apache2_name": _named("apache license version 2.0", "apache license 2.0", "apache 2.0", "apache license version 2.0 the license"),
    "apache2_header": ("licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",),
    "apache2_comply": ("you may not use this file except in compliance with the license",),
    "apache2_copy": ("you may obtain a copy of the license at http www.apache.org licenses license 2.0", "you may obtain a copy of the license at"),
    "apache2_unless": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "gpl3_name": _named("gnu general public license version 3", "gnu general public license v3.0", "gpl 3.0", "gplv3", "gpl 3.0 only"),
    "gpl2_name": _named("gnu general public license version 2", "gnu general public license v2.0", "gpl 2.0", "gplv2", "gpl 2.0 only"),
    "gpl3_redistribute": _gnu("general public license", "3"),
    "gpl2_redistribute": _gnu("general public license", "2"),
    "lgpl3_redistribute": _gnu("lesser general public license", "3"),
    "lgpl21_redistribute": _gnu("lesser general public license", "2.1"),
    "agpl3_redistribute": _gnu("affero general public license", "3"),
    "gnu_warranty": tuple(f"{x} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose" for x in ("this program", "this library", "this software")),
    "lgpl21_name": _named("gnu lesser general public license version 2.1", "lgpl 2.1", "lgpl 2.1 only"),
    "lgpl3_name": _named("gnu lesser general public license version 3", "lgpl 3.0", "lgpl 3.0 only"),
    "agpl3_name": _named("gnu affero general public license version 3", "agpl 3.0", "agpl 3.0 only"),
    "mpl2_name": _named("mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0"),
    "mpl2_subject": ("this source code form is subject to the terms of the mozilla public license v. 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", "2.0"),
    "mpl2_obtain": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0"),
    "epl2_made": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at http www.eclipse.org legal epl 2.0"),
    "epl2_name": _named("eclipse public license 2.0", "eclipse public license version 2.0", "epl 2.0"),
    "unlicense_free": ("this is free and unencumbered software released into the public domain",),
    "unlicense_anyone": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "cc0_name": _named("cc0 1.0", "cc0 1.0 universal", "creative commons zero v1.0 universal"),
    "cc0_waive": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    "ccbync4_name": _named("cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license") + ("this work is licensed under a creative commons attribution noncommercial 4.0 international license",),
    "ccbysa4_name": _named("cc by sa 4.0", "creative commons attribution sharealike 4.0 international license") + ("this work is licensed under a creative commons attribution sharealike 4.0 international license",),
    "ccby4_name": _named("cc by 4.0", "creative commons attribution 4.0 international license") + ("this work is licensed under a creative commons attribution 4.0 international license",),
    "zlib_as_is": ("this software is provided as is without any express or implied warranty",),
    "zlib_grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "boost_grant": ("distributed under the boost software license version 1.0",),
    "bsd_grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "all_rights": ("all rights reserved",),
}
SENTENCES["mpl2_subject"] = SENTENCES["mpl2_subject"][:2]
#: (licence, ordered identifiers): longer evidence first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache2_name", "apache2_comply", "apache2_copy")),
    ("Apache-2.0", ("apache2_header", "apache2_copy")),
    ("GPL-3.0-or-later", ("gpl3_redistribute", "gnu_warranty")),
    ("GPL-2.0-or-later", ("gpl2_redistribute", "gnu_warranty")),
    ("LGPL-3.0-or-later", ("lgpl3_redistribute", "gnu_warranty")),
    ("LGPL-2.1-or-later", ("lgpl21_redistribute", "gnu_warranty")),
    ("AGPL-3.0-or-later", ("agpl3_redistribute", "gnu_warranty")),
    ("MPL-2.0", ("mpl2_subject", "mpl2_obtain")),
    ("ISC", ("isc_grant", "isc_disclaim")),
    ("Unlicense", ("unlicense_free", "unlicense_anyone")),
    ("Zlib", ("zlib_as_is", "zlib_grant")),
    ("EPL-2.0", ("epl2_made",)),
    ("BSL-1.0", ("boost_grant",)),
    ("CC0-1.0", ("cc0_waive",)),
    ("MIT", ("mit_name",)),
    ("ISC", ("isc_name",)),
    ("Apache-2.0", ("apache2_name",)),
    ("GPL-3.0-only", ("gpl3_name",)),
    ("GPL-2.0-only", ("gpl2_name",)),
    ("LGPL-3.0-only", ("lgpl3_name",)),
    ("LGPL-2.1-only", ("lgpl21_name",)),
    ("AGPL-3.0-only", ("agpl3_name",)),
    ("MPL-2.0", ("mpl2_name",)),
    ("EPL-2.0", ("epl2_name",)),
    ("CC0-1.0", ("cc0_name",)),
    ("CC-BY-NC-4.0", ("ccbync4_name",)),
    ("CC-BY-SA-4.0", ("ccbysa4_name",)),
    ("CC-BY-4.0", ("ccby4_name",)),
    ("Proprietary", ("all_rights",)),
)
#: A paragraph ends at a line that is blank but for comment marks; marks at the start of a line aren't text.
PARAGRAPH = r"\n[\x20\x09\x0B-\x0D#*/;%-]*\n"
#: A sentence ends at . ! ? before white space or the end; lines also at a line break, : and ;.
SENTENCE = r"[.!?](?=[\x20\x09-\x0D]|$)"
LINE = r"\n|[.!?;:](?=[\x20\x09-\x0D]|$)"
NOISE = r"[^a-z0-9.]+"
#: A word of each known sentence; texts without any of them have no known sentence.
HINT = rf"(?i)licen|permission|redistribut|rights{NOISE}reserved|copyright|cc{NOISE}by|software|warranty|mozilla"


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), NOISE, " "))


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order."""
    known = F.create_map(*[F.lit(x) for k, ss in SENTENCES.items() for s in ss for x in (s, k)])

    def of(paragraph: Column, cut: str) -> Column:
        return F.filter(F.transform(F.filter(F.split(paragraph, cut), lambda s: s.rlike(HINT)), lambda s: F.try_element_at(known, normal(s))), lambda k: k.isNotNull())

    def better(p: Column) -> Column:
        both = F.transform(F.array(p), lambda x: F.struct(of(x, SENTENCE).alias("s"), of(x, LINE).alias("l")))
        return F.flatten(F.transform(both, lambda x: F.when(F.size(x["l"]) > F.size(x["s"]), x["l"]).otherwise(x["s"])))

    found = F.flatten(F.transform(F.filter(F.split(text, PARAGRAPH), lambda p: p.rlike(HINT)), better))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """The distinct licences whose rule matches the identifier sequence, in the order of the rules."""
    line = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    hits, used = [], {}
    for name, rule in RULES:
        pattern = "(?s)" + ".* ".join(f" {k}" if n == 0 else k for n, k in enumerate(rule)) + " "
        ok = line.rlike(pattern)
        # a rule that is a part of another one counts only where that one doesn't match
        longer = [used[r] for r in used if set(rule) < set(r)]
        for x in longer:
            ok = ok & ~x
        used[rule] = line.rlike(pattern)
        hits.append(F.when(ok, F.lit(name)))
    return F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known (known licence sentences), sentence_ids and licences (space-joined, in order) of every whole text.

    Null and empty texts have none; repeated rows are scanned each. Ties between rules go to the order of RULES.
    """
    need(docs, "doc_id", "text")
    had = docs.select("doc_id", F.coalesce(identifiers(F.coalesce(F.col("text"), F.lit(""))), F.array().cast("array<string>")).alias("ids"))
    return had.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", " ").alias("sentence_ids"), F.array_join(licences(F.col("ids")), " ").alias("licences"))


def sql() -> str:
    """The same in DuckDB's SQL, which has no look-ahead: ends of sentences become line feeds, which are white space, first."""
    rows = ", ".join(f"('{s}', '{k}')" for k, ss in SENTENCES.items() for s in ss)
    hits, used = [], {}
    for name, rule in RULES:
        test = "regexp_matches(line, '(?s)" + ".* ".join(f" {k}" if n == 0 else k for n, k in enumerate(rule)) + " ')"
        longer = "".join(f" AND NOT {used[r]}" for r in used if set(rule) < set(r))
        used[rule] = test
        hits.append(f"CASE WHEN {test}{longer} THEN '{name}' END")
    ws = r"[\x20\x09-\x0D]"
    return rf"""
WITH known(sentence, id) AS (VALUES {rows}),
r AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, unnest(parts) AS p, generate_subscripts(parts, 1) AS k FROM (SELECT r, string_split_regex(text, '{PARAGRAPH}') AS parts FROM r)),
c AS (SELECT r, k, 0 AS how, string_split_regex(regexp_replace(p, '[.!?]({ws}|$)', chr(1), 'g'), chr(1)) AS parts FROM p
      UNION ALL SELECT r, k, 1, string_split_regex(regexp_replace(p, '[.!?;:]({ws}|$)', chr(10), 'g'), chr(10)) FROM p),
s AS (SELECT r, k, how, unnest(parts) AS s, generate_subscripts(parts, 1) AS n FROM c),
f AS (SELECT r, k, how, string_agg(id, ' ' ORDER BY n) AS ids, count(*) AS n FROM s JOIN known ON trim(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g')) = sentence GROUP BY r, k, how),
b AS (SELECT r, k, arg_max(ids, n * 2 - how) AS ids, max(n) AS n FROM f GROUP BY r, k),
g AS (SELECT r, string_agg(ids, ' ' ORDER BY k) AS ids, sum(n) AS n FROM b GROUP BY r),
d AS (SELECT doc_id, coalesce(g.n, 0)::BIGINT AS n_known, coalesce(ids, '') AS sentence_ids, ' ' || coalesce(ids, '') || ' ' AS line FROM r LEFT JOIN g USING (r))
SELECT doc_id, n_known, sentence_ids, array_to_string(list_distinct_in_order, ' ') AS licences
FROM (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_in_order
      FROM (SELECT *, list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) AS l FROM d))
"""
